"""Filling fixed-capacity containers with items, whole wherever an item fits.

Items matter to the plan only by their length, so each lane is reduced to counts per length (at most
``capacity`` rows). The plan is made on those counts: singles, pairs and triples of lengths whose sum is
exactly the capacity are indexed by their complement and consumed while counts last; what remains is placed
best-fit, decreasing. Items are then numbered within (lane, length) and take the plan's places in order.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.measures import token_size
from lodestone.operators.ranking import index_within
from lodestone.plans.shared import stage

PLACE = "lane string, size int, first_idx long, n_items long, per_bin int, first_bin long"


def plan_lane(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places for the items of one lane: (size, first index within the size, number of items, items of that
    size per container, first container). ``counts`` has sizes 1 to ``capacity``.

    A group of equal containers is planned at once, so the work follows the number of lengths and of kinds of
    container, not the number of items. Deterministic.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    places: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def take(sizes: list[int], times: int) -> None:
        """Fill ``times`` containers with ``sizes`` each."""
        nonlocal bins
        for s in sorted(set(sizes), reverse=True):
            per = sizes.count(s)
            places.append((s, used[s], per * times, per, bins))
            used[s] += per * times
            left[s] -= per * times
            if not left[s]:
                del left[s]
        bins += times

    def times(sizes: list[int]) -> int:
        return min(left.get(s, 0) // sizes.count(s) for s in set(sizes))

    if n := left.get(capacity, 0):
        take([capacity], n)
    for a in sorted(left, reverse=True):  # pairs that are exactly full
        if a >= capacity - a and (n := times([a, capacity - a])):
            take([a, capacity - a], n)
    for a in sorted(left, reverse=True):  # triples that are exactly full, the largest first
        if a * 3 < capacity:
            break
        gap = capacity - a
        for b in sorted((s for s in left if (gap + 1) // 2 <= s <= min(a, gap - 1)), reverse=True):
            if a not in left:
                break
            if b in left and (n := times([a, b, gap - b])):
                take([a, b, gap - b], n)

    # the rest, best fit in decreasing size: open containers of one gap are kept together as runs
    open_runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first container, containers)
    gaps: list[int] = []

    def put(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in open_runs:
                insort(gaps, gap)
                open_runs[gap] = []
            open_runs[gap].append((first, n))

    for s in sorted(left, reverse=True):
        todo = left[s]
        while todo:
            at = bisect_left(gaps, s)
            if at < len(gaps):
                gap = gaps[at]
                first, n = open_runs[gap].pop()
                if not open_runs[gap]:
                    del open_runs[gap]
                    gaps.pop(at)
            else:
                gap, first = capacity, bins
                n = -(-todo // (capacity // s))
                bins += n
            per = min(gap // s, -(-todo // n))
            full = min(n, todo // per)
            if full:
                places.append((s, used[s], per * full, per, first))
                used[s] += per * full
                todo -= per * full
                put(gap - per * s, first, full)
            if full < n:  # one container takes fewer, the others stay as they were
                rest = min(todo, per)
                if rest:
                    places.append((s, used[s], rest, rest, first + full))
                    used[s] += rest
                    todo -= rest
                    put(gap - rest * s, first + full, 1)
                    full += 1
                put(gap, first + full, n - full)
    return places


def pack(items: DataFrame, id_col: str, lane: str, size: Column, capacities: DataFrame, salts: int = 64) -> DataFrame:
    """One row per piece of an item: ``doc_id`` (the id), ``lane``, ``piece_no``, ``n_pieces``, ``from_token``,
    ``n_tokens``, ``capacity_tokens`` and ``bin_id``, the container within the lane (from 0).

    Only items above the capacity are divided: into pieces of exactly the capacity and a rest. An item of size
    0 takes no place and lies in container 0. Items whose lane is null, unknown or without a positive capacity
    come out whole with a null capacity and container. Ids must be unique; a lane named twice in
    ``capacities`` has its largest capacity. An empty table gives no rows.
    """
    caps = capacities.groupBy(F.col("lane").alias("lane")).agg(F.max("capacity_tokens").alias("capacity_tokens")).where("lane IS NOT NULL AND capacity_tokens > 0")
    sized = items.select(F.col(id_col).alias("doc_id"), F.col(lane).alias("lane"), size.cast("int").alias("size"))
    sized = sized.join(F.broadcast(caps), "lane", "left")  # one row per lane of a configuration
    cap = F.col("capacity_tokens")
    n_pieces = F.when(F.col("size") > cap, F.ceil(F.col("size") / cap)).otherwise(1).cast("int")
    sized = stage(sized.withColumn("n_pieces", n_pieces), "sizes")

    pieces = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece_no")).select(
        "doc_id", "lane", "piece_no", "n_pieces", cap,
        F.when(cap.isNull(), 0).otherwise(F.col("piece_no") * cap).alias("from_token"),
        F.when(cap.isNull(), F.col("size")).otherwise(F.least(F.col("size") - F.col("piece_no") * cap, cap)).alias("n_tokens"),
    )
    placed_by_plan = F.col("capacity_tokens").isNotNull() & (F.col("n_tokens") > 0)

    # at most capacity rows for a lane reach its planner, whatever the number of items
    counts = pieces.where(placed_by_plan).groupBy("lane", "capacity_tokens", F.col("n_tokens").alias("size")).agg(F.count(F.lit(1)).alias("n"))

    def plan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = plan_lane(dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True)), int(key[1]))
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["lane", "size", "first_idx", "n_items", "per_bin", "first_bin"])

    places = stage(counts.groupBy("lane", "capacity_tokens").applyInPandas(plan, PLACE), "places")

    numbered = index_within(pieces.where(placed_by_plan), ["lane", "n_tokens"], F.struct("doc_id", "piece_no"), "idx", salts)
    # at most a few places per length, so the side sent to all is bounded by the capacities
    l, r = numbered.alias("l"), F.broadcast(places).alias("r")
    here = (F.col("l.lane") == F.col("r.lane")) & (F.col("l.n_tokens") == F.col("r.size"))
    within = (F.col("l.idx") >= F.col("r.first_idx")) & (F.col("l.idx") < F.col("r.first_idx") + F.col("r.n_items"))
    bin_id = F.col("r.first_bin") + F.floor((F.col("l.idx") - F.col("r.first_idx")) / F.col("r.per_bin"))
    columns = ["doc_id", "lane", "piece_no", "n_pieces", "from_token", "n_tokens", "capacity_tokens"]
    placed = l.join(r, here & within).select(*[F.col(f"l.{c}") for c in columns], bin_id.cast("long").alias("bin_id"))
    others = pieces.where(~placed_by_plan).select(*columns, F.when(F.col("capacity_tokens").isNotNull(), F.lit(0)).cast("long").alias("bin_id"))
    return placed.unionByName(others)


def documents(docs: DataFrame, plan: DataFrame) -> DataFrame:
    return pack(docs, "doc_id", "lane", token_size(F.col("text")), plan)


def fill(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Per lane: containers used, tokens placed, the least number of containers possible and the share of space filled."""
    got = documents(docs, plan).where("capacity_tokens IS NOT NULL AND n_tokens > 0")
    sums = got.groupBy("lane", "capacity_tokens").agg((F.max("bin_id") + 1).alias("n_bins"), F.sum("n_tokens").alias("tokens"))
    return sums.select("lane", "capacity_tokens", "n_bins", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_bins"), (F.col("tokens") / (F.col("n_bins") * F.col("capacity_tokens"))).alias("filled"))


def found(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents that had to be divided."""
    return documents(docs, plan).where("n_pieces > 1 AND piece_no = 0").select("doc_id")
