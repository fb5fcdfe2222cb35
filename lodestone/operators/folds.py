"""Folds over ordered events: moving averages, alert lifecycles, time to live, votes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranking import running_sums
from lodestone.plans.shared import ship, stage

ALPHA, SEED = 0.3, 0.5


def score_four(success: Column, latency_ms: Column, calls: Column, consensus: Column) -> Column:
    """0.4 success, 0.2 for speed within a minute, 0.2 for few calls, 0.2 consensus (null and 0 count 0.5)."""
    ok = F.when(F.coalesce(success, F.lit(False)), 1.0).otherwise(0.0)
    fast = F.greatest(F.lit(0.0), 1 - F.coalesce(latency_ms, F.lit(60000.0)) / 60000)
    few = F.greatest(F.lit(0.0), 1 - F.coalesce(calls, F.lit(20)) / 20)
    return 0.4 * ok + 0.2 * fast + 0.2 * few + 0.2 * F.coalesce(F.nullif(consensus, F.lit(0.0)), F.lit(0.5))


def score_three(success: Column, latency_ms: Column, calls: Column) -> Column:
    """0.5 success, 0.25 for speed, 0.25 for few calls."""
    ok = F.when(F.coalesce(success, F.lit(False)), 1.0).otherwise(0.0)
    fast = F.greatest(F.lit(0.0), 1 - F.coalesce(latency_ms, F.lit(60000.0)) / 60000)
    few = F.greatest(F.lit(0.0), 1 - F.coalesce(calls, F.lit(20)) / 20)
    return 0.5 * ok + 0.25 * fast + 0.25 * few


def ema(events: DataFrame, key: str, order: list[str], value: str, alpha: float = ALPHA, seed: float = SEED) -> DataFrame:
    """(key, ema, n): the exponential moving average of each key's values in order.

    With decay b = 1 - alpha it is seed * b^n + alpha * sum(b^(n-i) * v_i). The sum is taken over parts: all events
    are sorted by key and order into ranges, each range folds what it holds of a key into (n, sum), and those
    few rows per key and range are folded in turn. So a hot key is spread over ranges and never gathered.
    Null values are left out; null keys are a key.
    """
    ship(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(value).isNotNull()).select(key, *order, F.col(value).cast("double").alias("__v"))
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).select(F.col(key).alias("k"), F.col("__v").alias("v"), F.spark_partition_id().alias("part"))
    decay = 1 - alpha

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list | None = None  # key, part, n, sum of the key that the last batch ended with
        for pdf in batches:
            if not len(pdf):
                continue
            k = pdf["k"]
            codes = (k.ne(k.shift()) & ~(k.isna() & k.shift().isna())).to_numpy()
            codes[0] = True
            starts = np.append(np.flatnonzero(codes), len(pdf))
            v, out = pdf["v"].to_numpy(), []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                n = b - a
                total = float((v[a:b] * decay ** np.arange(n - 1, -1, -1)).sum())
                name = k.iloc[a] if not pd.isna(k.iloc[a]) else None
                if held is not None and held[0] == name:
                    held[2], held[3] = held[2] + n, held[3] * decay**n + total
                else:
                    if held is not None:
                        out.append(tuple(held))
                    held = [name, int(pdf["part"].iloc[a]), int(n), total]
            if out:
                yield pd.DataFrame(out, columns=["k", "part", "n", "s"])
        if held is not None:
            yield pd.DataFrame([tuple(held)], columns=["k", "part", "n", "s"])

    parts = stage(ranged.mapInPandas(fold, f"k {kind}, part int, n bigint, s double"), "ema-parts")
    after = Window.partitionBy("k").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    later = F.coalesce(F.sum("n").over(after), F.lit(0))
    weighed = parts.withColumn("w", F.col("s") * F.pow(F.lit(decay), later))
    return weighed.groupBy(F.col("k").alias(key)).agg((seed * F.pow(F.lit(decay), F.sum("n")) + alpha * F.sum("w")).alias("ema"), F.sum("n").alias("n"))


def _runs(v: np.ndarray, decay: float) -> np.ndarray:
    """s_i = decay * s_(i-1) + v_i of one run, in blocks of 64."""
    n = len(v)
    blocks = np.concatenate((v, np.zeros(-n % 64))).reshape(-1, 64)
    i = np.arange(64)
    out = blocks @ np.where(i[:, None] <= i[None, :], decay ** np.maximum(i[None, :] - i[:, None], 0), 0.0)
    carry = 0.0
    for row in out:
        row += carry * decay ** (i + 1)
        carry = row[-1]
    return out.ravel()[:n]


def ema_history(events: DataFrame, key: str, order: list[str], value: str, alpha: float = ALPHA, seed: float = SEED) -> DataFrame:
    """(key, order, ema, n): the key's moving average after each of its events, and how many they are so far.

    As in :func:`ema` events are sorted into ranges, each is folded by itself, and the few rows per key and range carry the average
    from range to range; a hot key is spread over ranges. Null values are left out; null keys are a key.
    """
    ship(events.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    rows = events.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), *order, F.col(value).cast("double").alias("v"))
    ranged = rows.repartitionByRange("k", *order).sortWithinPartitions("k", *order).withColumn("part", F.spark_partition_id())
    decay = 1 - alpha

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None  # key, count and sum that the last batch ended with
        for pdf in batches:
            if not len(pdf):
                continue
            k, v = pdf["k"], pdf["v"].to_numpy()
            new = (k.ne(k.shift()) & ~(k.isna() & k.shift().isna())).to_numpy()
            new[0] = True
            starts = np.append(np.flatnonzero(new), len(pdf))
            m, s = np.empty(len(pdf), np.int64), np.empty(len(pdf))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                name = None if pd.isna(k.iloc[a]) else k.iloc[a]
                m[a:b], s[a:b] = np.arange(1, b - a + 1), _runs(v[a:b], decay)
                if a == 0 and last is not None and last[0] == name:
                    s[a:b] += last[2] * decay ** m[a:b]
                    m[a:b] += last[1]
                last = (name, int(m[b - 1]), float(s[b - 1]))
            yield pdf[["k", *order, "part"]].assign(m=m, s=s)

    folded = stage(ranged.mapInPandas(fold, ", ".join([f"k {types[key]}", *[f"{o} {types[o]}" for o in order], "part int, m bigint, s double"])), "ema-history")
    parts = folded.groupBy("k", "part").agg(F.max("m").alias("n"), F.max_by("s", "m").alias("s"))
    # one element per range that the key is spread over
    l = parts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("part", "n", "s"))).alias("l"))
    none = F.array().cast("array<struct<part:int,before:bigint,start:double,n:bigint,end:double>>")
    put = lambda acc, e: F.concat(acc, F.array(F.struct(
        e["part"].alias("part"), F.coalesce(F.try_element_at(acc, F.lit(-1))["n"], F.lit(0)).cast("bigint").alias("before"), F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(seed)).alias("start"),
        (F.coalesce(F.try_element_at(acc, F.lit(-1))["n"], F.lit(0)) + e["n"]).cast("bigint").alias("n"),
        (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(seed)) * F.pow(F.lit(decay), e["n"]) + alpha * e["s"]).alias("end"),
    )))
    carried = l.select(F.col("k").alias("__k"), F.explode(F.aggregate("l", none, put)).alias("c")).select("__k", F.col("c.part").alias("__part"), "c.before", "c.start")
    joined = folded.join(carried, F.col("k").eqNullSafe(F.col("__k")) & (F.col("part") == F.col("__part")))
    return joined.select(F.col("k").alias(key), *order, (F.col("start") * F.pow(F.lit(decay), F.col("m")) + alpha * F.col("s")).alias("ema"), (F.col("before") + F.col("m")).alias("n"))


# fixed values: roles never suspended, events before an agent is judged, and the share of the mean that it must reach
PROTECTED, WARM_UP, THETA = ("coordinator", "queen", "security"), 3, 0.6


def eligibility(events: DataFrame, agents: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Each event (key, order, ema, n) with ``threshold`` and ``eligible`` as they were right after it, and the key's ``suspensions`` and ``recoveries`` so far.

    An agent is eligible while its role is protected or it has less than WARM_UP events; else if its average reaches THETA of the mean
    over all agents warmed up by then. That mean needs no replay: an agent's average depends on its own events alone, so each
    event changes the sum over agents by a known amount, and running sums over all events in order give every moment's mean.
    ``order`` must be unique. ``agents`` has the key and ``role``; others have no role. Events of a null key are left out.
    """
    steps = ema_history(events.where(F.col(key).isNotNull()), key, order, value)
    mine = Window.partitionBy(key, "__block").orderBy("n")
    # an agent's own last average: within blocks of its events, and across them by the block's first row
    blocks = steps.withColumn("__block", F.expr("(n - 1) div 65536"))
    ends = blocks.groupBy(key, "__block").agg(F.max_by("ema", "n").alias("__end")).select(key, (F.col("__block") + 1).alias("__block"), "__end")
    steps = blocks.withColumn("__lag", F.lag("ema").over(mine)).join(ends, [key, "__block"], "left").withColumn("__lag", F.coalesce("__lag", "__end"))
    change = F.when(F.col("n") > WARM_UP, F.col("ema") - F.col("__lag")).when(F.col("n") == WARM_UP, F.col("ema"))
    summed = running_sums(steps.select(key, *order, "ema", "n", change.alias("__c")), [], order, {"__sum": F.col("__c"), "__warm": (F.col("n") == WARM_UP).cast("bigint")})
    roles = agents.select(F.col(key).alias("__a"), "role").dropDuplicates(["__a"])
    judged = summed.withColumn("threshold", THETA * F.try_divide(F.col("__sum"), F.nullif("__warm", F.lit(0)))).join(roles, F.col(key) == F.col("__a"), "left")
    free = F.coalesce(F.col("role").isin(*PROTECTED), F.lit(False)) | (F.col("n") < WARM_UP)
    judged = judged.select(key, *order, "ema", "n", "threshold", (free | (F.col("ema") >= F.col("threshold"))).alias("eligible"))
    # every agent begins eligible
    before = Window.partitionBy(key, "__block").orderBy("n")
    marked = judged.withColumn("__block", F.expr("(n - 1) div 65536"))
    ends = marked.groupBy(key, "__block").agg(F.max_by("eligible", "n").alias("__end")).select(key, (F.col("__block") + 1).alias("__block"), "__end")
    marked = marked.withColumn("__was", F.lag("eligible").over(before)).join(ends, [key, "__block"], "left").withColumn("__was", F.coalesce("__was", "__end", F.lit(True)))
    flips = {"suspensions": (F.col("__was") & ~F.col("eligible")).cast("bigint"), "recoveries": (~F.col("__was") & F.col("eligible")).cast("bigint")}
    return running_sums(marked.select(key, *order, "ema", "n", "threshold", "eligible", "__was"), [key], order, flips).drop("__was")


def suspend(agents: DataFrame, which: Column) -> DataFrame:
    """``agents`` with the chosen ones made ineligible and their ``suspension_count`` raised, eligible before or not."""
    hit = F.coalesce(which, F.lit(False))
    return agents.withColumns({"eligible": F.when(hit, False).otherwise(F.col("eligible")), "suspension_count": F.col("suspension_count") + hit.cast("int")})


def recover(agents: DataFrame, which: Column) -> DataFrame:
    """``agents`` with each chosen one recovered by itself: 0.1 more score (1 at most), then judged again against all agents as they
    are, its own new score among them; one that becomes eligible so has a recovery more."""
    warm = F.col("sample_count") >= WARM_UP
    means = agents.agg(F.sum(F.when(warm, F.col("ema_score"))).alias("__sum"), F.count_if(warm & F.col("ema_score").isNotNull()).alias("__n"))
    raised = F.least(F.lit(1.0), F.col("ema_score") + 0.1)
    threshold = THETA * F.try_divide(F.col("__sum") + F.when(warm, raised - F.col("ema_score")).otherwise(0.0), F.nullif("__n", F.lit(0)))
    free = F.coalesce(F.col("role").isin(*PROTECTED), F.lit(False)) | ~warm | threshold.isNull()
    hit, good = F.coalesce(which, F.lit(False)), F.coalesce(free | (raised >= threshold), F.lit(False))
    both = agents.crossJoin(F.broadcast(means)).withColumns({"__hit": hit, "__good": good, "__raised": raised, "__judged": ~free})  # one row of sums
    again = F.col("__hit") & F.col("__judged") & ~F.col("eligible") & F.col("__good")
    out = both.withColumns({
        "recovery_attempts": F.col("recovery_attempts") + F.coalesce(again, F.lit(False)).cast("int"),
        "suspension_count": F.col("suspension_count") + F.coalesce(F.col("__hit") & F.col("__judged") & F.col("eligible") & ~F.col("__good"), F.lit(False)).cast("int"),
        "ema_score": F.when(F.col("__hit"), F.col("__raised")).otherwise(F.col("ema_score")),
    })
    return out.withColumn("eligible", F.when(F.col("__hit"), F.col("__good")).otherwise(F.col("eligible"))).select(*agents.columns)


def in_flight(spans: DataFrame, start: str, end: str, most: int) -> DataFrame:
    """(at, running, waits): how many spans run from each moment one begins or ends on, ends taken first, and whether a limit of ``most`` is passed.

    One row per moment. Spans with a null end run on; those with a null start never ran.
    """
    begins = spans.where(F.col(start).isNotNull()).select(F.col(start).alias("at"), F.lit(1).cast("bigint").alias("d"))
    ends = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(F.col(end).alias("at"), F.lit(-1).cast("bigint").alias("d"))
    moments = begins.unionByName(ends).groupBy("at").agg(F.sum("d").alias("d"))
    return running_sums(moments, [], ["at"], {"running": F.col("d")}).select("at", "running", (F.col("running") > most).alias("waits"))


def running_average(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The mean of each event's key up to it, ``running_avg``, and of how many values, ``running_n``; ``order`` must be unique within a key."""
    v = F.col(value).cast("double")
    sums = running_sums(events, keys, order, {"__sum": v, "running_n": v.isNotNull().cast("bigint")})
    return sums.withColumn("running_avg", F.try_divide(F.col("__sum"), F.nullif("running_n", F.lit(0)))).drop("__sum")


def alert_episodes(samples: DataFrame, key: str, order: str, breached: Column) -> DataFrame:
    """Runs of breaching samples: (key, opened, last, n_samples, acknowledged); an alert is acknowledged once a sample recovers."""
    by = Window.partitionBy(key).orderBy(order)
    marked = samples.withColumn("__b", F.coalesce(breached, F.lit(False)))
    start = F.col("__b") & ~F.coalesce(F.lag("__b").over(by), F.lit(False))
    numbered = marked.withColumn("__n", F.sum(start.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__end", F.max(order).over(Window.partitionBy(key)))
    runs = numbered.where("__b").groupBy(key, "__n").agg(F.min(order).alias("opened"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n_samples"), F.max("__end").alias("__end"))
    return runs.select(key, "opened", "last", "n_samples", (F.col("last") < F.col("__end")).alias("acknowledged"))


def ttl_hits(access: DataFrame, key: str, at: str, ttl_seconds: float) -> DataFrame:
    """Each access with ``hit``: whether the key was used within ``ttl_seconds`` before; every access renews it."""
    before = previous(access, key, at, F.date_trunc("day", at).cast("timestamp_ntz"))
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("__before").cast("timestamp"))) / 1e6
    return before.withColumn("hit", F.coalesce(gap <= ttl_seconds, F.lit(False))).drop("__before")


def previous(events: DataFrame, key: str, at: str, bucket: Column) -> DataFrame:
    """``events`` with ``__before``: the key's time before each event's.

    Windows run within a key's ``bucket`` (a non-decreasing function of the time), so a hot key is spread over its
    buckets; the first event of a bucket takes the greatest time of the bucket before, from one row per key and bucket.
    """
    marked = events.withColumn("__bucket", bucket)
    by = Window.partitionBy(key, "__bucket").orderBy(at)
    inner = marked.withColumn("__lag", F.lag(at).over(by)).withColumn("__first", F.row_number().over(by) == 1)
    ends = marked.groupBy(key, "__bucket").agg(F.max(at).alias("__max"))
    ends = ends.withColumn("__prior", F.lag("__max").over(Window.partitionBy(key).orderBy("__bucket"))).drop("__max")
    l, r = inner.alias("l"), ends.alias("r")
    joined = l.join(r, F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")) & F.col("l.__bucket").eqNullSafe(F.col("r.__bucket")), "left")
    return joined.select(*[F.col(f"l.{c}") for c in events.columns], F.when(F.col("l.__first"), F.col("r.__prior")).otherwise(F.col("l.__lag")).alias("__before"))


def lru_caches(access: DataFrame, cache: str, order: str, op: str, key: str, capacity: int) -> DataFrame:
    """(cache, place, key): final content, oldest use first (place 0), of caches of ``capacity`` after their accesses in order: a 'get' renews a
    key held, a 'set' of a key already held does not. A cache's accesses are sequential by nature: they stream through one task, which holds
    the content of one cache. Rows with a null order come first; null caches and keys are values like others."""
    ship(access.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in access.schema}
    rows = access.select(F.col(cache).alias("c"), F.col(order).alias("o"), F.col(op).alias("op"), F.col(key).alias("k")).repartition("c").sortWithinPartitions("c", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        now: list = []

        def content() -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * n, schema.field("c").type), pa.array(range(n), pa.int32()), pa.array(list(held), schema.field("k").type)], names=["c", "place", "k"])

        for batch in batches:
            schema = batch.schema
            for c, o, k in zip(batch.column("c").to_pylist(), batch.column("op").to_pylist(), batch.column("k").to_pylist(), strict=True):
                if not now or now[0] != c:
                    if now:
                        yield content()
                    held, now = {}, [c]
                if o == "get":
                    if k in held:
                        held[k] = held.pop(k)
                elif k not in held:
                    if len(held) >= capacity:
                        held.pop(next(iter(held)))
                    held[k] = True
        if now:
            yield content()

    return rows.mapInArrow(run, f"c {kinds[cache]}, place int, k {kinds[key]}").select(F.col("c").alias(cache), "place", F.col("k").alias(key))


def lru(access: DataFrame, order: str, op: str, key: str, capacity: int) -> list[tuple]:
    """The final content of one cache, as :func:`lru_caches` tells: at most ``capacity`` keys, oldest use first."""
    got = lru_caches(access.withColumn("__cache", F.lit(0)), "__cache", order, op, key, capacity)
    return [r[0] for r in got.orderBy("place").select(key).collect()]


def majority(votes: DataFrame, proposal: str, voter: str, order: list[str], vote: str, n_voters: int) -> DataFrame:
    """(proposal, yes, no, accepted, rejected): the last vote of each voter that is not null counts; a side wins with more than half of all voters."""
    last = votes.where(F.col(vote).isNotNull()).groupBy(proposal, voter).agg(F.max_by(vote, F.struct(*order)).alias("__vote"))
    sums = last.groupBy(proposal).agg(F.count_if(F.col("__vote")).alias("yes"), F.count_if(~F.col("__vote")).alias("no"))
    return sums.select(proposal, "yes", "no", (F.col("yes") > n_voters / 2).alias("accepted"), (F.col("no") > n_voters / 2).alias("rejected"))


def first_results(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each event with ``replayed``: whether its key has been seen before (null keys never)."""
    seen = F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1
    return events.withColumn("replayed", F.col(key).isNotNull() & seen)


def last_n(events: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The newest ``n`` events."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(n)
