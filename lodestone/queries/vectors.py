"""Vector operators, search and ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import vectors as v
from lodestone.functions.numbers import js_round
from lodestone.functions.text import bm25, overlap, tokens
from lodestone.operators import search
from lodestone.operators.ranking import in_order
from lodestone.queries.base import MEMORY, Tables, query, r6

DIM, SMALL, EMBEDDED = 128, 64, 384
#: Usable vectors of the memory table in SQL: right length, finite, not all zero.
GOOD = "embedding IS NOT NULL AND len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
QGOOD = GOOD.replace("embedding", "vector")


def entries(t: Tables):
    return t.memory.select("id", F.col("embedding").alias("vector"), "content", "reward")


def searches(t: Tables):
    return t.search_query.select(F.col("query_id").alias("id"), "vector", F.col("text_query").alias("text"), "k")


def small(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


# -- vectors -----------------------------------------------------------------------------------------


@query("vec_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _cosine(t: Tables):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("e2"))
    return t.embeddings.join(b, "vec_id").select(F.col("vec_id").alias("a"), "b", r6(v.cosine(F.col("embedding"), F.col("e2"))).alias("similarity"))


@query("vec_distances", "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS l2, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS ip FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _distances(t: Tables):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    e, f = F.col("embedding"), F.col("e2")
    return t.embeddings.join(b, "vec_id").select("vec_id", r6(v.l2(e, f)).alias("l2"), r6(v.dot(e, f)).alias("ip"))


@query(
    "vec_knn",
    """SELECT qid, id, round(d, 6) AS distance, rank FROM (SELECT q.vec_id AS qid, e.vec_id AS id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS d,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9), e.vec_id) AS rank
    FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) WHERE rank <= 10""",
)
def _knn(t: Tables):
    """Every vector whose id is divisible by 20 against all."""
    return search.knn(small(t).where("id % 20 = 0"), small(t), SMALL, 10).withColumn("distance", r6("distance"))


@query(
    "vec_knn_l2",
    """SELECT qid, id, round(d, 6) AS distance, rank FROM (SELECT q.vec_id AS qid, e.vec_id AS id, round(pow(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 2), 9) AS d,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(pow(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 2), 9), e.vec_id) AS rank
    FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) WHERE rank <= 5""",
)
def _knn_l2(t: Tables):
    return search.knn(small(t).where("id % 20 = 0"), small(t), SMALL, 5, "l2").withColumn("distance", r6("distance"))


@query("vec_size", "SELECT count(*) AS n FROM embeddings ANTI JOIN (SELECT vec_id FROM embeddings WHERE label = 3) USING (vec_id)")
def _size(t: Tables):
    return small(t).join(t.embeddings.where("label = 3").select(F.col("vec_id").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("n"))


@query("vec_q_none", "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS v FROM embeddings")
def _none(t: Tables):
    return t.embeddings.select("vec_id", F.transform(v.doubles(F.col("embedding")), lambda x: F.round(x, 6)).alias("v"))


@query("vec_q_binary", "SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE -1 END) AS code FROM embeddings")
@query("vec_q_rabitq", "SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE -1 END) AS code FROM embeddings")
def _binary(t: Tables):
    return t.embeddings.select("vec_id", v.quantise_binary(F.col("embedding")).alias("code"))


@query("vec_q_pq8", "SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE + 1) / 2 * 255 + 0.5)))::INT) AS code FROM embeddings")
def _pq8(t: Tables):
    return t.embeddings.select("vec_id", v.quantise_uniform(F.col("embedding"), 8).alias("code"))


@query("vec_q_pq4", "SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(15, floor((x::DOUBLE + 1) / 2 * 15 + 0.5)))::INT) AS code FROM embeddings")
def _pq4(t: Tables):
    return t.embeddings.select("vec_id", v.quantise_uniform(F.col("embedding"), 4).alias("code"))


@query("vec_compression", "SELECT level, bits, factor, dim * bits / 8 AS bytes FROM (VALUES ('none', 32, 1), ('pq8', 8, 4), ('pq4', 4, 8), ('binary', 1, 32), ('rabitq', 1, 32)) l(level, bits, factor), (SELECT max(len(embedding)) AS dim FROM embeddings)")
def _compression(t: Tables):
    levels = t.spark.createDataFrame([(k, *x) for k, x in v.LEVELS.items()], "level string, bits int, factor int")
    dim = t.embeddings.agg(F.max(F.size("embedding"))).scalar()
    return levels.select("level", "bits", "factor", (dim * F.col("bits") / 8).alias("bytes"))


_WRAP = "((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"


@query(
    "vec_hash",
    f"""SELECT vec_id, CASE WHEN h < 0 THEN '-' ELSE '' END || lower(to_base(abs(h), 36)) AS hash FROM (
    SELECT vec_id, list_reduce(list_transform(embedding[1:100], lambda x: floor(x::DOUBLE * 1000 + 0.5)::BIGINT), lambda h, c: {_WRAP}, 0::BIGINT) AS h FROM embeddings)""",
)
def _hash(t: Tables):
    return t.embeddings.select("vec_id", v.hash_vector(F.col("embedding")).alias("hash"))


@query("vec_embed")
def _embed(t: Tables):
    """Texts to unit vectors; the sine of large numbers differs between libraries, so there is no SQL."""
    return t.pull_request.select("pr_id", v.embed(F.col("title"), EMBEDDED).alias("vector")).select("pr_id", "vector", r6(v.norm(F.col("vector"))).alias("norm"))


@query("vec_anchor_relevance")
def _relevance(t: Tables):
    both = t.pull_request.select("pr_id", v.embed(F.col("title"), EMBEDDED).alias("a"), v.embed(F.col("description"), EMBEDDED).alias("b"))
    return both.select("pr_id", r6(v.cosine(F.col("a"), F.col("b"))).alias("relevance"))


@query(
    "vec_maxsim_group",
    """SELECT vec_id, round(greatest(0, list_cosine_similarity(embedding::DOUBLE[], c0), list_cosine_similarity(embedding::DOUBLE[], c1)), 6) AS sim
    FROM embeddings, (SELECT embedding::DOUBLE[] AS c0 FROM embeddings WHERE vec_id = 0), (SELECT embedding::DOUBLE[] AS c1 FROM embeddings WHERE vec_id = 1)""",
)
def _maxsim(t: Tables):
    chosen = t.embeddings.where("vec_id < 2").agg(F.collect_list("embedding")).scalar()
    both = t.embeddings.select("vec_id", "embedding", chosen.alias("chosen"))
    return both.select("vec_id", r6(v.max_similarity(F.col("embedding"), F.col("chosen"))).alias("sim"))


@query("vec_centroids", "SELECT label, any_value(n) AS n, list(m ORDER BY i) AS mean FROM (SELECT label, i, count(*) AS n, round(avg(x), 6) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1")
def _centroids(t: Tables):
    """The mean vector of every label, component by component."""
    each = t.embeddings.select("label", F.posexplode(v.doubles(F.col("embedding"))).alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("m"))
    return means.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("mean"))


# -- search and ranking ------------------------------------------------------------------------------

_NEAR = f"""{MEMORY},
    hits AS (SELECT q.query_id AS qid, e.id, q.text_query AS text, e.content, e.reward, coalesce(q.k, 10) AS k, round(list_cosine_similarity(q.vector::DOUBLE[], e.embedding::DOUBLE[]), 9) AS sim
        FROM search_query q, memory e WHERE {GOOD} AND {QGOOD}),
    near AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(1 - sim, 9), id) <= least(k, 100)),
    words AS (SELECT *, string_split_regex(lower(content), '[ \\t\\n\\x0b\\f\\r]+') AS w, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS q FROM near),
    freq AS (SELECT *, list_transform(q, lambda x: len(list_filter(w, lambda y: y = x))::DOUBLE) AS tf FROM words),
    texts AS (SELECT *, CASE WHEN text IS NULL THEN NULL WHEN content IS NULL THEN 0.0
        ELSE round(coalesce(list_sum(list_transform(tf, lambda f: 0.4054651081081644 * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / 100.0)))), 0.0), 9) END AS text_score FROM freq),
    scored AS (SELECT qid, id, sim, text_score, round(CASE WHEN text_score IS NULL THEN sim ELSE 0.7 * sim + 0.3 * text_score END * (0.5 + 0.5 * coalesce(reward, 0.0)), 9) AS score FROM texts)"""


@query("rnk_hybrid", f"WITH {_NEAR} SELECT qid, id, round(sim, 6) AS similarity, round(text_score, 6) AS text_score, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored")
def _hybrid(t: Tables):
    got = search.hybrid_search(searches(t), entries(t), DIM)
    return got.select("qid", "id", r6("similarity").alias("similarity"), r6("text_score").alias("text_score"), r6("score").alias("score"), "rank")


@query("join_hits_entries", f"WITH {_NEAR} SELECT qid, count(*) AS n, round(max(score), 6) AS best FROM scored GROUP BY 1")
def _hits(t: Tables):
    return search.hybrid_search(searches(t), entries(t), DIM).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), r6(F.max("score")).alias("best"))


@query("rnk_search")
def _search(t: Tables):
    """The flagship: nearest entries, hybrid scores, diversity re-ranking."""
    ranked = search.hybrid_search(searches(t), entries(t), DIM)
    got = search.mmr(ranked.select("qid", "id", "score", "rank"), entries(t).select("id", "vector"))
    return got.select("qid", "id", r6("score").alias("score"), "rank", "mmr_rank")


@query("rnk_mmr")
def _mmr(t: Tables):
    """Re-ranking by diversity alone, of each label's vectors nearest to its first one: cosine as the score; checked against brute force on a fixture."""
    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(F.col("label").alias("id"), "vector")
    hits = search.knn(first, small(t), SMALL, 50).select("qid", "id", (1 - F.col("distance")).alias("score"), "rank")
    return search.mmr(hits, small(t)).select(F.col("qid").alias("label"), "id", r6("score").alias("score"), "rank", "mmr_rank")


@query(
    "rnk_pattern_similar",
    """WITH t AS (SELECT pr_id, list_distinct(string_split_regex(lower(title), '[ \\t\\n\\x0b\\f\\r]+')) AS w FROM pull_request WHERE title IS NOT NULL),
    p AS (SELECT a.pr_id, b.pr_id AS other, round(len(list_intersect(a.w, b.w))::DOUBLE / greatest(len(a.w), len(b.w)), 6) AS overlap FROM t a JOIN t b ON a.pr_id <> b.pr_id)
    SELECT pr_id, other, overlap FROM p WHERE overlap > 0.5 QUALIFY row_number() OVER (PARTITION BY pr_id ORDER BY overlap DESC, other) <= 5""",
)
def _similar(t: Tables):
    """Of all titles the five with the greatest overlap above a half.

    More than half of either title's words are shared, so one of the rarer half of its words (rounded up) is among the other's as well.
    """
    words = t.pull_request.where("title IS NOT NULL").select("pr_id", F.array_distinct(tokens(F.col("title"))).alias("w"))
    each = words.select("pr_id", F.explode("w").alias("word"), F.size("w").alias("n"))
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    rare = each.join(counts, "word").groupBy("pr_id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "word"))).alias("l"))
    keys = rare.select("pr_id", "n", F.explode(F.expr("slice(l, 1, (n + 1) div 2).word")).alias("word"))
    other = keys.select("word", F.col("pr_id").alias("other"), F.col("n").alias("n2"))
    pairs = keys.join(other, "word").where("pr_id <> other AND 2 * least(n, n2) > greatest(n, n2)").select("pr_id", "other").distinct()
    titles = t.pull_request.select("pr_id", "title")
    pairs = pairs.join(titles, "pr_id").join(titles.select(F.col("pr_id").alias("other"), F.col("title").alias("title2")), "other")
    pairs = pairs.withColumn("overlap", r6(overlap(F.col("title"), F.col("title2")))).where("overlap > 0.5")
    return pairs.withColumn("n", F.row_number().over(Window.partitionBy("pr_id").orderBy(F.desc("overlap"), "other"))).where("n <= 5").select("pr_id", "other", "overlap")


@query("rnk_bm25_top", """WITH d AS (SELECT doc_id, string_split_regex(lower(text), '[ \\t\\n\\x0b\\f\\r]+') AS w FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, list_sum(list_transform(['saga', 'quorum'], lambda x: 0.4054651081081644 * len(list_filter(w, lambda y: y = x)) * 2.2 / (len(list_filter(w, lambda y: y = x)) + 1.2 * (0.25 + 0.75 * len(w) / 100.0)))) AS s FROM d)
    SELECT doc_id, round(s, 6) AS score FROM s WHERE s > 0 ORDER BY round(s, 9) DESC, doc_id LIMIT 20""")  # fmt: skip
def _bm25_top(t: Tables):
    s = F.round(bm25(F.col("text"), ["saga", "quorum"]), 9)
    return t.documents.select("doc_id", s.alias("s")).where("s > 0").orderBy(F.desc("s"), "doc_id").limit(20).select("doc_id", r6("s").alias("score"))


@query("rnk_agents", "SELECT agent_id, role, ema_score, rank() OVER (PARTITION BY role ORDER BY ema_score DESC) AS place FROM agent_pheromone WHERE eligible")
def _agents(t: Tables):
    return t.agent_pheromone.where("eligible").select("agent_id", "role", "ema_score", F.rank().over(Window.partitionBy("role").orderBy(F.desc("ema_score"))).alias("place"))


@query("rnk_priority_queue", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM orders")
def _queue(t: Tables):
    order = ["o_orderpriority", "o_orderdate", "o_orderkey"]
    return in_order(t.orders.select(*order), order, "n").select("o_orderkey", (F.col("n") + 1).alias("place"))


@query("rnk_history_cap", "SELECT update_id FROM (SELECT DISTINCT update_id, ts FROM pheromone_update) ORDER BY ts DESC, update_id DESC LIMIT 5000")
def _cap(t: Tables):
    return t.pheromone_update.select("update_id", "ts").distinct().orderBy(F.desc("ts"), F.desc("update_id")).limit(5000).select("update_id")


@query(
    "rnk_percentiles",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, l[floor(count(*) * 0.5)::INT + 1] AS p50, l[floor(count(*) * 0.95)::INT + 1] AS p95, l[floor(count(*) * 0.99)::INT + 1] AS p99
    FROM events JOIN (SELECT event_type, list(value ORDER BY value) AS l FROM events GROUP BY 1) USING (event_type) GROUP BY event_type, l""",
)
def _percentiles(t: Tables):
    return search.index_percentiles(t.events, "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).withColumn("mean", r6("mean"))


@query("rnk_rounding", "SELECT vec_id, floor(embedding[1]::DOUBLE * 10 + 0.5)::BIGINT AS tenths FROM embeddings")
def _rounding(t: Tables):
    return t.embeddings.select("vec_id", js_round(F.col("embedding")[0].cast("double") * 10).alias("tenths"))
