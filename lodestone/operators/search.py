"""Exact nearest neighbours, hybrid ranking and diversity re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import bm25, tokens
from lodestone.operators.ranking import running_sums
from lodestone.plans.shared import ship

#: Query vectors sent to all tasks at once; more of them are searched in several passes over the items.
BROADCAST_BYTES = 64 << 20


def usable(vector: Column, dim: int) -> Column:
    """Of ``dim`` finite components, not all of them 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


def _best(found: pa.Table, limits: np.ndarray) -> pa.Table:
    """The rows (q, value, id) among the greatest ``limits[q]`` values of their query, of equal ones those with the smaller ids."""
    found = found.sort_by([("q", "ascending"), ("value", "descending"), ("id", "ascending")])
    q = found.column("q").to_numpy()
    return found.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < limits[q]))


def knn(queries: DataFrame, items: DataFrame, dim: int, k: int, space: str = "cosine", broadcast_bytes: int = BROADCAST_BYTES, cells: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """(qid, id, distance, rank): the ``k`` nearest items of each query, exactly; ties go to the smaller id.

    Both sides have columns ``id`` and ``vector``; where ``queries`` has a column ``k`` (never null), each has its own number, ``k`` at most.
    Rows with an unusable vector or a null id are left out. Items are scanned in blocks against the queries by as many tasks as
    there are cores; a task keeps its best rows of each query over all its blocks, so the shuffle is a number of rows per query and
    task that does not grow with the items. With ``cells`` (centroids, probes), items have a column ``cell``, and a query only
    meets those of as many cells as it probes. ``space`` is 'cosine', 'l2' (squared) or 'ip'; distances are rounded to nine decimals.
    """
    spark = queries.sparkSession
    ship(spark)
    good = lambda df: df.where(F.col("id").isNotNull() & usable(F.col("vector"), dim))
    limit = F.least(F.col("k"), F.lit(k)) if "k" in queries.columns else F.lit(k)
    queries = good(queries).select("id", F.col("vector").cast("array<double>").alias("vector"), limit.cast("int").alias("k"))
    items = good(items).select("id", F.col("vector").cast("array<double>").alias("vector"), *(["cell"] if cells else [])).coalesce(spark.sparkContext.defaultParallelism)
    passes = max(1, -(-queries.count() * (dim * 8 + k * 24) // broadcast_bytes))
    parts = []
    for i in range(passes):
        some = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i)
        rows = some.toPandas()  # at most about broadcast_bytes
        matrix = np.array(rows["vector"].tolist(), dtype=np.float64).reshape(len(rows), dim)
        sent = spark.sparkContext.broadcast((pa.array(rows["id"]), matrix, rows["k"].to_numpy(dtype=np.int64)))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, limits = sent.value
            if not len(q):
                return
            q = q / np.linalg.norm(q, axis=1, keepdims=True) if space == "cosine" else q
            most = int(limits.max())
            everyone = np.arange(len(q))
            if cells:
                near_cells = np.argsort(-(q @ cells[0].T), axis=1)[:, : cells[1]]
            least = np.full(len(q), -np.inf)  # what a value must reach to be among a query's best so far
            held: list[pa.Table] = []
            n_held = 0

            def shrink() -> None:
                nonlocal held, n_held
                best = _best(pa.concat_tables(held), limits).combine_chunks()
                held, n_held = [best], best.num_rows
                at = best.column("q").to_numpy()
                ends = np.flatnonzero(np.append(at[1:] != at[:-1], True)) if len(at) else np.empty(0, int)
                full = ends[np.diff(np.concatenate(([-1], ends))) == limits[at[ends]]]
                least[at[full]] = best.column("value").to_numpy()[full]

            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                if space == "cosine":
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                ids_here = batch.column("id")
                jobs = [(everyone, np.arange(len(x)))]  # which queries meet which of the rows
                if cells:
                    cell = batch.column("cell").to_numpy()
                    jobs = [(np.flatnonzero((near_cells == c).any(axis=1)), np.flatnonzero(cell == c)) for c in np.unique(cell)]
                for who, those in ((w[s : s + 512], r) for w, r in jobs for s in range(0, len(w), 512)):
                    near = q[who] @ x[those].T
                    if space == "l2":
                        near = 2 * near - (q[who] ** 2).sum(1)[:, None] - (x[those] ** 2).sum(1)[None, :]
                    near = np.round(near, 9)
                    bound = least[who, None]
                    if near.shape[1] > most:
                        bound = np.maximum(bound, np.partition(near, near.shape[1] - most, axis=1)[:, -most][:, None])
                    a, b = np.nonzero(near >= bound)
                    held.append(pa.table({"q": pa.array(who[a]), "value": pa.array(near[a, b]), "id": ids_here.take(pa.array(those[b]))}))
                    n_held += len(a)
                    if n_held > 4 * most * max(512, len(q)):
                        shrink()
            if held:
                shrink()
                out = held[0]
                value = out.column("value").to_numpy()
                distance = 1 - value if space in ("cosine", "ip") else -value
                at = out.column("q").to_numpy()
                yield from pa.table({"qid": ids.take(pa.array(at)), "id": out.column("id"), "distance": pa.array(np.round(distance, 9)), "k": pa.array(limits[at].astype(np.int32))}).to_batches()

        fields = f"qid {queries.schema['id'].dataType.simpleString()}, id {items.schema['id'].dataType.simpleString()}, distance double, k int"
        parts.append(items.mapInArrow(scan, fields))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= F.col("k")).drop("k")


def hybrid_score(similarity: Column, text_score: Column, reward: Column) -> Column:
    """0.7 similarity + 0.3 text score (the similarity alone without one), times 0.5 + 0.5 reward; a null reward counts 0."""
    blend = F.when(text_score.isNull(), similarity).otherwise(0.7 * similarity + 0.3 * text_score)
    return blend * (0.5 + 0.5 * F.coalesce(reward, F.lit(0.0)))


def hybrid_search(queries: DataFrame, entries: DataFrame, dim: int, k: int = 10, most: int = 100) -> DataFrame:
    """(qid, id, similarity, text_score, score, rank): each query's nearest entries, re-ranked by similarity, text and reward.

    ``queries``: id, vector, text, k (null: ``k``; at most ``most``); ``entries``: id, vector, content, reward. Ties go to the smaller id.
    """
    hits = knn(queries.select("id", "vector", F.coalesce("k", F.lit(k)).alias("k")), entries, dim, most)
    # the entries' texts meet the hits by id; only the hits are shuffled in full
    joined = hits.join(queries.select(F.col("id").alias("qid"), "text"), "qid")
    joined = joined.drop("rank").join(entries.select("id", "content", "reward"), "id")
    terms = F.filter(tokens(F.col("text")), lambda t: t != "")
    text_score = F.when(F.col("text").isNotNull(), bm25(F.col("content"), terms))
    scored = joined.select("qid", "id", (1 - F.col("distance")).alias("similarity"), F.round(text_score, 9).alias("text_score"), "reward")
    scored = scored.withColumn("score", F.round(hybrid_score(F.col("similarity"), F.col("text_score"), F.col("reward")), 9))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).drop("reward")


def mmr(ranked: DataFrame, vectors: DataFrame, alpha: float = 0.7, lam: float = 0.7, most: int = 100) -> DataFrame:
    """``ranked`` (qid, id, score, rank) with ``mmr_rank``: greedily the best of alpha * score - lam * similarity to what is
    already chosen; the first of equal ones. All items of a query are kept; ``rank`` above ``most`` is refused.

    A query's items, at most ``most``, are one group. Items without a vector have similarity 0.
    """
    ship(ranked.sparkSession)
    rows = ranked.where(F.col("rank") <= most).join(vectors.select("id", F.col("vector").cast("array<double>").alias("vector")), "id", "left")
    schema = f"qid {ranked.schema['qid'].dataType.simpleString()}, id {ranked.schema['id'].dataType.simpleString()}, score double, rank int, mmr_rank int"

    def order(t: pa.Table) -> pa.Table:
        t = t.sort_by([("rank", "ascending")]).combine_chunks()
        n, v = t.num_rows, t.column("vector").combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy()
        dim = max(int(sizes.max()), 1) if n else 1
        x, whole = np.zeros((n, dim)), sizes == dim  # a null or shorter vector has no direction
        if whole.any():
            x[whole] = v.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        length = np.linalg.norm(x, axis=1)
        unit = np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0)
        sims = np.round(np.nan_to_num(unit @ unit.T), 9)
        score, near, left, chosen = t.column("score").to_numpy(), np.zeros(n), np.ones(n, bool), np.zeros(n, np.int32)
        for place in range(n):
            best = int(np.argmax(np.where(left, np.round(alpha * score - lam * near, 12), -np.inf)))
            chosen[best], left[best] = place + 1, False
            near = np.maximum(near, sims[best])
        return t.select(["qid", "id", "score", "rank"]).append_column("mmr_rank", pa.array(chosen))

    return rows.groupBy("qid").applyInArrow(order, schema)


def index_percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Values at place floor(n * share) of a group's sorted values, for each named share, with the group's ``n`` and ``mean``; nulls left out.

    Works on counts per value, summed in ranges of the sorted counts, so that a hot group is not gathered, however many its values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    runs = running_sums(counts, [group], ["__v"], {"__upto": F.col("__c")})
    sizes = counts.groupBy(group).agg(F.sum("__c").alias("n"), (F.sum(F.col("__v") * F.col("__c")) / F.sum("__c")).alias("mean"))
    l, r = runs.alias("l"), sizes.alias("r")
    both = l.join(r, F.col(f"l.{group}").eqNullSafe(F.col(f"r.{group}")))
    at = {name: F.least(F.floor(F.col("r.n") * s), F.col("r.n") - 1) for name, s in shares.items()}
    picks = [F.min(F.when((F.col("l.__upto") > p), F.col("l.__v"))).alias(name) for name, p in at.items()]
    return both.groupBy(F.col(f"r.{group}").alias(group)).agg(F.max("r.n").alias("n"), F.max("r.mean").alias("mean"), *picks)
