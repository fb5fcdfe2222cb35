"""Adaptation, pattern banks, transfer, generated weights and rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as x
from lodestone.operators import ann, learning, routing, search
from lodestone.queries.aggregates import _ROUTE, _judge
from lodestone.queries.base import MEMORY, ORACLE, Tables, query, r6
from lodestone.queries.vectors import DIM, GOOD, QGOOD, SMALL, searches, small
from lodestone.sources import store


@query("num_peft_routing", f"WITH {_ROUTE.replace('FROM documents', 'FROM pull_request').replace('doc_id', 'pr_id').replace('coalesce(text', 'coalesce(description').replace('* 1.5 *', '* 1.3 *')} SELECT pr_id, 'expert-' || i AS expert, round(exp(top) / z, 6) AS confidence FROM m")
def _peft(t: Tables):
    s = routing.expert_scores(F.col("description"), F.lit("critical"))
    return t.pull_request.select("pr_id", routing.best_expert(s).alias("b")).select("pr_id", "b.expert", r6("b.confidence").alias("confidence"))


def _patterns(t: Tables):
    return t.memory.where("type = 'semantic' AND consolidated").select("id", F.col("embedding").alias("vector"), "reward", F.col("metadata.mode").alias("mode"))


_SONA = f"""{MEMORY}, hits AS (SELECT q.query_id, e.id, e.reward, e.metadata.mode AS mode, row_number() OVER (PARTITION BY q.query_id ORDER BY round(1 - list_cosine_similarity(q.vector::DOUBLE[], e.embedding::DOUBLE[]), 9), e.id) AS rank
        FROM search_query q, memory e WHERE e.type = 'semantic' AND e.consolidated AND {GOOD} AND {QGOOD}),
    sona AS (SELECT q.query_id, h.id AS pattern_id, coalesce(h.reward, 0.5) AS confidence, coalesce(h.mode, 'convergent') AS mode, coalesce(n, 0) AS n_patterns FROM search_query q LEFT JOIN (SELECT * FROM hits WHERE rank = 1) h USING (query_id)
        LEFT JOIN (SELECT query_id, count(*) AS n FROM hits WHERE rank <= 10 GROUP BY 1) c USING (query_id))"""


def adaptations(t: Tables):
    """Each query's nearest consolidated pattern of ten, its reward as confidence (0.5 without any), and the mode its weights are scaled by."""
    patterns = _patterns(t)
    hits = search.knn(searches(t).select("id", "vector"), patterns.select("id", "vector"), DIM, 10)
    counts = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    first = hits.where("rank = 1").join(patterns.select("id", "reward", "mode"), "id").select("qid", F.col("id").alias("pattern_id"), "reward", "mode")
    q = t.search_query.select("query_id", F.col("query_id").alias("qid"))
    both = q.join(first, "qid", "left").join(counts, "qid", "left")
    return both.select("query_id", "pattern_id", F.coalesce("reward", F.lit(0.5)).alias("confidence"), F.coalesce("mode", F.lit("convergent")).alias("mode"), F.coalesce("n", F.lit(0)).alias("n_patterns"))


_SCALE = "CASE mode " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in learning.MODE_SCALE.items()) + " ELSE 1.0 END"


@query("wf_sona", f"WITH {_SONA} SELECT query_id, pattern_id, round(confidence, 6) AS confidence, mode, n_patterns, round(({_SCALE})::DOUBLE, 6) AS factor FROM sona")
def _sona(t: Tables):
    factor = learning.scale_by_mode(F.array(F.lit(1.0)), F.col("mode"))[0]
    return adaptations(t).select("query_id", "pattern_id", r6("confidence").alias("confidence"), "mode", "n_patterns", r6(factor).alias("factor"))


@query("misc_tracking", f"""WITH {_SONA} SELECT 'traj-' || query_id AS id, 1 AS step, 'pattern_retrieval' AS action, 'Retrieved ' || n_patterns || ' patterns' AS result, 0.1::DOUBLE AS reward FROM sona WHERE n_patterns > 0
    UNION ALL SELECT 'traj-' || query_id, 2, 'lora_extraction', 'Extracted LoRA from ' || pattern_id, 0.2 FROM sona WHERE n_patterns > 0 UNION ALL SELECT 'traj-' || query_id, 3, 'mode_adaptation', 'Applied ' || mode || ' mode', 0.2 FROM sona WHERE n_patterns > 0""")  # fmt: skip
def _tracking(t: Tables):
    """The three steps of every adaptation that found a pattern."""
    step = lambda n, action, result, reward: F.struct(F.lit(n).alias("step"), F.lit(action).alias("action"), result.alias("result"), F.lit(reward).alias("reward"))
    steps = F.array(
        step(1, "pattern_retrieval", F.concat(F.lit("Retrieved "), F.col("n_patterns").cast("string"), F.lit(" patterns")), 0.1),
        step(2, "lora_extraction", F.concat(F.lit("Extracted LoRA from "), "pattern_id"), 0.2), step(3, "mode_adaptation", F.concat(F.lit("Applied "), "mode", F.lit(" mode")), 0.2),
    )
    return adaptations(t).where("n_patterns > 0").select(F.concat(F.lit("traj-"), "query_id").alias("id"), F.explode(steps).alias("s")).select("id", "s.*")


@query("wf_bank", f"""WITH {MEMORY}, judged AS ({ORACLE["num_judge"].replace("WITH " + MEMORY + ",", "WITH", 1)}), k AS (SELECT DISTINCT coalesce(reward, 0) AS reward, length(id) AS n FROM memory),
    v AS (SELECT reward, n, list_avg(list_transform(range(49152), lambda i: greatest(0, 0.5 * reward + 0.5 + 0.1 * sin(n + i)))) AS importance FROM k)
    SELECT m.id, CASE WHEN success THEN 'success' ELSE 'failure' END AS verdict, support, pattern, CASE WHEN pattern IS NULL THEN 'Novel approach' ELSE 'Similar to ' || pattern END || CASE WHEN success THEN ' succeeded' ELSE ' failed' END AS reasoning,
        coalesce(array_to_string(metadata.tags, ' → '), '') AS steps, round(importance, 6) AS importance, true AS consolidated FROM memory m JOIN judged j ON j.id = m.id JOIN v ON v.reward = coalesce(m.reward, 0) AND v.n = length(m.id)""")  # fmt: skip
def _bank(t: Tables):
    """Entries as trajectories: the pattern of the domain most like them retrieved, judged by reward, distilled with their steps, and consolidated with the importance of their weights."""
    rows = t.memory.select("id", "metadata.tags", F.coalesce("reward", F.lit(0.0)).alias("reward"), F.length("id").alias("n"))
    both = learning.importance_summary(rows, "reward", "n", learning.WEIGHTS).join(_judge(t), "id").withColumn("importance", r6("mean"))
    how = F.concat(F.when(F.col("pattern").isNull(), "Novel approach").otherwise(F.concat(F.lit("Similar to "), "pattern")), F.when(F.col("success"), " succeeded").otherwise(" failed"))
    return both.select("id", F.when(F.col("success"), "success").otherwise("failure").alias("verdict"), "support", "pattern", how.alias("reasoning"), F.coalesce(F.array_join("tags", " → "), F.lit("")).alias("steps"), "importance", F.lit(True).alias("consolidated"))


@query("wf_transfer", f"""WITH {MEMORY}, best AS (SELECT id, reward FROM memory WHERE metadata.domain = 'security' AND consolidated ORDER BY reward DESC NULLS LAST, id LIMIT 50)
    SELECT id, metadata.domain AS domain, NULL AS moved_from, reward, consolidated FROM memory UNION ALL SELECT 'transfer-' || id, 'testing', 'security', reward, false FROM best""")  # fmt: skip
def _transfer(t: Tables):
    """The fifty best patterns of one domain copied to another; fifty is the operator's own number."""
    return learning.transfer(t.memory, "security", "testing", 50)


@query("misc_expert_weights")
def _weights(t: Tables):
    """All 49,536 weights of each of the twelve domains; checked against a loop on a fixture."""
    return learning.lora_weights(routing.experts(t.spark).select("domain"), "domain").select(F.col("name").alias("domain"), "part", "pos", r6("v").alias("v"))


@query("vec_add", "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE label <> 1 UNION ALL SELECT vec_id, list_transform(embedding, lambda x: -x::DOUBLE) FROM embeddings WHERE label = 1 UNION ALL SELECT vec_id + 1000000, embedding::DOUBLE[] FROM embeddings WHERE label = 1")
def _add(t: Tables):
    """Vectors added to an index: some under new ids, some in place of those with their id."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    new = rows.where("label = 1")
    changed = new.withColumn("v", F.transform("v", lambda e: -e)).unionByName(new.withColumn("id", F.col("id") + 1000000))
    return store.upsert(rows.drop("label"), changed.drop("label"), "id")


@query("vec_remove", "SELECT vec_id, label FROM embeddings WHERE label <> 2")
def _remove(t: Tables):
    return store.delete(t.embeddings, t.embeddings.where("label = 2"), "vec_id").select("vec_id", "label")


@query("vec_hnsw_cfg")
def _ann(t: Tables):
    """Every vector whose id is divisible by 20 against the cells nearest to it; recall is tested against brute force."""
    centroids = ann.fit(small(t), SMALL, 32)
    return ann.search(small(t).where("id % 20 = 0"), ann.index(small(t), SMALL, centroids), SMALL, 10, centroids, 22).withColumn("distance", r6("distance"))


@query("txt_tpl_validate", """WITH n AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\\{\\{([A-Za-z0-9_]+)\\}\\}', 1))) AS names FROM documents WHERE text LIKE '%{{%'),
    v AS (SELECT doc_id, unnest(names) AS name, generate_subscripts(names, 1) AS i FROM n) SELECT doc_id, name, CASE WHEN i % 3 = 1 THEN 'given' WHEN i % 3 = 2 THEN 'default' ELSE 'missing' END AS state FROM v""")  # fmt: skip
def _validate(t: Tables):
    """The names in each template: given a value, filled by a default, or missing (here by turns of three), as the required check tells."""
    names = F.array_sort(x.template_names(F.col("text")))
    each = t.documents.where(F.col("text").contains("{{")).select("doc_id", F.posexplode(names).alias("i", "name"))
    value, default = F.when(F.col("i") % 3 == 0, "v"), F.when(F.col("i") % 3 == 1, "d")
    return each.select("doc_id", "name", x.variable_state(value, default, F.lit(True)).alias("state"))


@query("join_template_vars", """WITH v AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\{\\{([A-Za-z0-9_]+)\\}\\}', 1))) AS name FROM documents WHERE text LIKE '%{{%'), g AS (SELECT agent_id AS name, role AS value FROM agent_pheromone)
    SELECT doc_id, name, value FROM v LEFT JOIN g USING (name)""")  # fmt: skip
def _vars(t: Tables):
    """The names in each template against a table of values."""
    v = t.documents.where(F.col("text").contains("{{")).select("doc_id", F.explode(x.template_names(F.col("text"))).alias("name"))
    return v.join(t.agent_pheromone.select(F.col("agent_id").alias("name"), F.col("role").alias("value")), "name", "left").select("doc_id", "name", "value")


@query("misc_batch", f"WITH {MEMORY} SELECT verdict, count(*) AS n, round(sum(coalesce(reward, 0)), 6) AS reward FROM memory WHERE NOT consolidated GROUP BY 1")
def _batch(t: Tables):
    """All that waits for consolidation, in one pass."""
    return t.memory.where("NOT consolidated").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.coalesce("reward", F.lit(0.0)))).alias("reward"))


@query("misc_bench_entries", "SELECT 'entry-' || i AS id, CASE i % 3 WHEN 0 THEN 'order' WHEN 1 THEN 'inventory' ELSE 'payment' END AS tag, (i * 37 % 100) / 100.0::DOUBLE AS reward, CASE WHEN i * 37 % 100 >= 50 THEN 'success' ELSE 'failure' END AS verdict, 384 AS dim FROM range(10000) r(i)")
def _entries(t: Tables):
    """Ten thousand generated entries with vectors of 384 numbers, the same at every run."""
    made = store.generated_entries(t.spark, 10000, 384)
    return made.select("id", "tag", "reward", "verdict", F.size("vector").alias("dim"))
