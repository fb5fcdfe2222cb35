"""Sources, sinks, filters, sets and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions.text import extension
from lodestone.functions.vectors import quantise_uniform
from lodestone.operators.ranking import in_order, index_within
from lodestone.plans.shared import shared_dir
from lodestone.queries.base import FILES, MEMORY, PATCHES, UPDATES, Tables, query, r6
from lodestone.sources import store

# -- sources and sinks -----------------------------------------------------------------------------


@query("set_latest", f"WITH {MEMORY} SELECT id, type, tier, reward, access_count, updated_at FROM memory")
def _latest(t: Tables):
    return t.memory.select("id", "type", "tier", "reward", "access_count", "updated_at")


_INSERTED = MEMORY.replace("memory_entry", "(SELECT id, type, tier, reward, access_count, updated_at, embedding FROM memory_entry UNION ALL SELECT id, type, 9, reward, access_count + 1, updated_at + INTERVAL 1 DAY, embedding FROM memory_entry WHERE verdict = 'failure' UNION ALL SELECT 'new-' || id, type, tier, reward, 0, updated_at, embedding FROM memory_entry WHERE type = 'working')")


@query("src_insert", f"WITH {_INSERTED} SELECT id, type, tier, access_count, list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE + 1) / 2 * 255 + 0.5)))::INT) AS code FROM memory WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0")
def _insert(t: Tables):
    """A batch of changed and new entries appended to the stored table; the latest version of an id counts, and finite vectors are quantised for the index."""
    cols = ["id", "type", "tier", "reward", "access_count", "updated_at", "embedding"]
    base = t.memory_entry.select(*cols)
    later = {"tier": F.lit(9), "access_count": F.col("access_count") + 1, "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 DAY")}
    batch = t.memory_entry.where("verdict = 'failure'").select(*cols).withColumns(later)
    batch = batch.unionByName(t.memory_entry.where("type = 'working'").select(*cols).withColumns({"id": F.concat(F.lit("new-"), "id"), "access_count": F.lit(0).cast("bigint")}))
    path = f"{shared_dir(t.spark)}/lodestone/entries-{uuid.uuid4().hex}"
    store.append(base, path)
    store.append(batch, path)
    rows = store.latest(t.spark.read.parquet(path), ["id"], ["updated_at", "access_count", "reward"])
    finite = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite).select("id", "type", "tier", "access_count", quantise_uniform(F.col("embedding"), 8).alias("code"))


@query("src_load_all", "SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(embedding) AS n_vectors FROM memory_entry")
def _load(t: Tables):
    return t.memory_entry.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"), F.count("embedding").alias("n_vectors"))


@query("src_get_by_id", f"WITH {MEMORY} SELECT id, type, content FROM memory WHERE id = 'mem-00000000003'")
def _get(t: Tables):
    return store.by_id(t.memory, "id", "mem-00000000003").select("id", "type", "content")


@query("src_get_by_ids", f"WITH {MEMORY} SELECT id, type, reward FROM memory WHERE 'agent-worker-0000001' = provenance.agent_id AND id IN (SELECT id FROM memory_entry WHERE verdict = 'success')")
def _gets(t: Tables):
    wanted = t.memory_entry.where("verdict = 'success'").select("id")
    return store.by_ids(t.memory.where("provenance.agent_id = 'agent-worker-0000001'"), wanted, "id").select("id", "type", "reward")


@query("src_update", f"WITH {MEMORY} SELECT id, CASE WHEN verdict = 'failure' THEN 0.0 ELSE reward END AS reward, consolidated OR coalesce(verdict = 'failure', false) AS consolidated FROM memory")
def _update(t: Tables):
    m = t.memory.select("id", "reward", "consolidated", "verdict")
    return store.update(m, m.where("verdict = 'failure'").select("id", F.lit(0.0).alias("reward"), F.lit(True).alias("consolidated")), "id").drop("verdict")


@query("src_upsert", f"WITH {MEMORY} SELECT id, type, CASE WHEN type = 'working' THEN 9 ELSE tier END AS tier FROM memory UNION ALL SELECT 'new-' || id, type, 9 FROM memory WHERE type = 'working'")
def _upsert(t: Tables):
    m = t.memory.select("id", "type", "tier")
    changed = m.where("type = 'working'").withColumn("tier", F.lit(9))
    return store.upsert(m, changed.unionByName(changed.withColumn("id", F.concat(F.lit("new-"), "id"))), "id")


@query("src_delete", f"WITH {MEMORY} SELECT id, type FROM memory WHERE id NOT IN (SELECT id FROM memory_entry WHERE verdict = 'failure')")
def _delete(t: Tables):
    return store.delete(t.memory, t.memory_entry.where("verdict = 'failure'"), "id").select("id", "type")


@query("src_json_sink", "SELECT 'pheromone:' || agent_id AS id, ema_score AS reward, json_extract_string(to_json(struct_pack(agent_id := agent_id)), '$.agent_id') AS agent FROM agent_pheromone")
def _sink(t: Tables):
    return store.as_records(t.agent_pheromone.drop("last_updated"), "pheromone:", "agent_id", F.col("ema_score")).select("id", "reward", F.get_json_object("content", "$.agent_id").alias("agent"))


@query("src_json_scan", "SELECT agent_id, role, ema_score, sample_count, eligible FROM agent_pheromone")
def _scan(t: Tables):
    records = store.as_records(t.agent_pheromone, "pheromone:", "agent_id")
    return store.from_records(records, "pheromone:", "agent_id string, role string, ema_score double, sample_count bigint, eligible boolean")


@query("src_json_state", "SELECT * FROM (SELECT id, json_type(content) AS kind FROM (SELECT DISTINCT id, content FROM memory_entry WHERE content LIKE '{%' AND json_valid(content))) WHERE kind = 'OBJECT'")
def _state(t: Tables):
    kept = t.memory_entry.where(F.col("content").startswith("{")).select("id", "content").distinct()
    return kept.where(F.expr("try_parse_json(content) IS NOT NULL")).select("id", F.lit("OBJECT").alias("kind"))


@query("src_export_import", "SELECT doc_id, coalesce(source, '') AS source, length(text) AS n FROM documents WHERE text IS NOT NULL")
def _export(t: Tables):
    out = t.documents.where("text IS NOT NULL").select("doc_id", F.to_json(F.struct("source", "text")).alias("j"))
    return out.select("doc_id", F.from_json("j", "source string, text string").alias("d")).select("doc_id", F.coalesce("d.source", F.lit("")).alias("source"), F.length("d.text").cast("bigint").alias("n"))


@query("src_index_io", "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings")
def _io(t: Tables):
    """An index saved (vectors and ids, by label) and loaded again, whole."""
    path = f"{shared_dir(t.spark)}/lodestone/vectors-{uuid.uuid4().hex}"
    store.write_partitioned(t.embeddings, path, "label")
    return t.spark.read.parquet(path).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


# -- filters ---------------------------------------------------------------------------------------


@query("flt_registry_search", f"WITH {MEMORY} SELECT id, tier FROM memory WHERE tier <= 2 AND list_has_any(metadata.tags, ['cache', 'memory', 'pattern']) AND contains(lower(content), 'quorum') ORDER BY id LIMIT 20")
def _registry(t: Tables):
    tags = F.arrays_overlap("metadata.tags", F.array(*map(F.lit, ("cache", "memory", "pattern"))))
    return t.memory.where((F.col("tier") <= 2) & tags & F.contains(F.lower("content"), F.lit("quorum"))).orderBy("id").limit(20).select("id", "tier")


@query("flt_by_tag", f"WITH {MEMORY} SELECT id FROM memory WHERE list_contains(metadata.tags, 'layer')")
def _by_tag(t: Tables):
    return t.memory.where(F.array_contains("metadata.tags", "layer")).select("id")


@query("txt_lang", f"WITH {FILES} SELECT repo, file, coalesce(l.language, 'unknown') AS language FROM files LEFT JOIN lang_ext l ON l.ext = lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1))")
def _file_lang(t: Tables):
    """The language of every file by its extension."""
    exts = t.lang_ext.select("ext", F.col("language").alias("known"))
    return t.files.join(F.broadcast(exts), extension(F.col("file")) == F.col("ext"), "left").select("repo", "file", F.coalesce("known", F.lit("unknown")).alias("language"))


@query("set_sort_recent", "SELECT pr_id, created_at, row_number() OVER (ORDER BY created_at DESC, pr_id) AS place FROM pull_request")
def _recent(t: Tables):
    """All pull requests from the newest on, with their places."""
    return in_order(t.pull_request.select("pr_id", "created_at"), [F.desc("created_at"), F.col("pr_id")], "n").select("pr_id", "created_at", (F.col("n") + 1).alias("place"))


@query("flt_tpl_search", "SELECT pr_id, title FROM pull_request WHERE contains(lower(title), 'stock') OR contains(lower(description), 'stock') OR contains(lower(head_branch), 'stock')")
def _search(t: Tables):
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit("stock")), F.lit(False))
    return t.pull_request.where(has("title") | has("description") | has("head_branch")).select("pr_id", "title")


@query("flt_adr_list", "SELECT pr_id, author, created_at FROM pull_request WHERE author = 'dev-0001' AND base_branch = 'main'")
def _list(t: Tables):
    return t.pull_request.where("author = 'dev-0001' AND base_branch = 'main'").orderBy(F.desc("created_at"), "pr_id").select("pr_id", "author", "created_at")


@query("flt_arch_changes", f"WITH {PATCHES} SELECT pr_file_id, filename FROM patches WHERE additions + deletions > 50 OR status IN ('added', 'renamed')")
def _arch(t: Tables):
    return t.patches.where((F.col("additions") + F.col("deletions") > 50) | F.col("status").isin("added", "renamed")).select("pr_file_id", "filename")


@query("flt_anomalies", f"WITH {UPDATES} SELECT update_id FROM updates WHERE latency_ms < 0 OR isnan(latency_ms) OR isinf(latency_ms)")
def _anomalies(t: Tables):
    v = F.col("latency_ms")
    return t.updates.where((v < 0) | F.isnan(v) | (F.abs(v) == float("inf"))).select("update_id")


@query("flt_search_filter", f"WITH {MEMORY} SELECT metadata.domain AS domain, count(*) AS n FROM memory WHERE embedding IS NOT NULL AND type = 'semantic' AND reward >= 0.8 GROUP BY 1")
def _pre(t: Tables):
    return t.memory.where("embedding IS NOT NULL AND type = 'semantic' AND reward >= 0.8").groupBy(F.col("metadata.domain").alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_stuck", "SELECT agent_id FROM agent_pheromone WHERE eligible AND last_updated < (SELECT max(last_updated) FROM agent_pheromone) - INTERVAL 30 DAY")
def _stuck(t: Tables):
    now = t.agent_pheromone.agg(F.max("last_updated")).scalar()
    return t.agent_pheromone.where(F.col("eligible") & (F.col("last_updated") < now - F.expr("INTERVAL 30 DAYS"))).select("agent_id")


@query("flt_low_stock", "SELECT p_partkey, p_size FROM part WHERE p_size < 10")
def _low(t: Tables):
    return t.part.where("p_size < 10").select("p_partkey", "p_size")


@query("flt_list_orders", "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1997-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def _orders(t: Tables):
    some = t.orders.where("o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP_NTZ '1997-01-01'")
    return some.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("flt_search_contacts", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '99') ORDER BY c_custkey LIMIT 20")
def _contacts(t: Tables):
    return t.customer.where(F.contains(F.lower("c_name"), F.lit("99"))).orderBy("c_custkey").limit(20).select("c_custkey", "c_name")


@query(
    "flt_reconcile",
    """SELECT coalesce(o_orderkey, k) AS orderkey, round(o_totalprice, 4) AS booked, round(s, 4) AS shipped FROM orders
    FULL JOIN (SELECT l_orderkey AS k, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON o_orderkey = k WHERE s IS NULL OR o_totalprice IS NULL OR abs(o_totalprice - s) > 1000""",
)
def _reconcile(t: Tables):
    shipped = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("s"))
    both = t.orders.join(shipped, F.col("o_orderkey") == F.col("k"), "full")
    return both.where("s IS NULL OR o_totalprice IS NULL OR abs(o_totalprice - s) > 1000").select(F.coalesce("o_orderkey", "k").alias("orderkey"), F.round("o_totalprice", 4).alias("booked"), F.round("s", 4).alias("shipped"))


# -- sets ------------------------------------------------------------------------------------------


@query("set_concat", "SELECT agent_id FROM agent_pheromone UNION ALL SELECT agent_id FROM pheromone_update WHERE NOT success")
def _concat(t: Tables):
    return t.agent_pheromone.select("agent_id").unionByName(t.pheromone_update.where("NOT success").select("agent_id"))


@query("set_flatten", f"WITH {FILES} SELECT repo, file, e.message AS message, e.line AS line FROM (SELECT repo, file, unnest(errors) AS e FROM files)")
def _flatten(t: Tables):
    return t.files.select("repo", "file", F.explode("errors").alias("e")).select("repo", "file", "e.message", "e.line")


@query("set_dedup", "SELECT DISTINCT i.source AS source FROM (SELECT unnest(imports) AS i FROM parse_result)")
def _dedup(t: Tables):
    return t.parse_result.select(F.explode("imports").alias("i")).select("i.source").distinct()


@query("set_take", "SELECT update_id, latency_ms FROM (SELECT DISTINCT update_id, latency_ms FROM pheromone_update WHERE isfinite(latency_ms)) ORDER BY latency_ms DESC, update_id LIMIT 10")
def _take(t: Tables):
    v = F.col("latency_ms")
    return t.pheromone_update.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select("update_id", "latency_ms").distinct().orderBy(F.desc("latency_ms"), "update_id").limit(10)


@query("set_reverse", "SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber DESC) AS lines FROM lineitem GROUP BY 1")
def _reverse(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.reverse(F.array_sort(F.collect_list("l_linenumber"))).alias("lines"))


@query("set_numbered", "SELECT source, count(*) AS n, min(idx) AS lowest, max(idx) AS highest, count(DISTINCT idx) AS n_idx FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents) GROUP BY 1")
def _numbered(t: Tables):
    """Dense numbers within groups of any size."""
    got = index_within(t.documents.select("source", "doc_id"), ["source"], F.col("doc_id"))
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("lowest"), F.max("idx").alias("highest"), F.countDistinct("idx").alias("n_idx"))


# -- joins -----------------------------------------------------------------------------------------


@query("join_agent_pher", f"WITH {UPDATES} SELECT u.agent_id, a.role, count(*) AS n FROM updates u JOIN agent_pheromone a USING (agent_id) WHERE a.eligible GROUP BY 1, 2")
def _agent(t: Tables):
    return t.updates.join(t.agent_pheromone.where("eligible").select("agent_id", "role"), "agent_id").groupBy("agent_id", "role").agg(F.count(F.lit(1)).alias("n"))


@query("join_assign_agent", f"WITH {MEMORY} SELECT m.id, a.role, round(a.ema_score, 6) AS ema_score FROM memory m LEFT JOIN agent_pheromone a ON a.agent_id = m.provenance.agent_id")
def _assign(t: Tables):
    a = t.agent_pheromone.select("agent_id", "role", "ema_score")
    return t.memory.select("id", F.col("provenance.agent_id").alias("aid")).join(a, F.col("aid") == F.col("agent_id"), "left").select("id", "role", r6("ema_score").alias("ema_score"))


@query("join_adr_change", "SELECT DISTINCT pr_id FROM pull_request SEMI JOIN pr_file USING (pr_id)")
def _semi(t: Tables):
    return t.pull_request.join(t.pr_file.select("pr_id"), "pr_id", "left_semi").select("pr_id")


@query("join_adr_missing", "SELECT agent_id FROM (SELECT DISTINCT agent_id FROM pheromone_update WHERE agent_id IS NOT NULL) ANTI JOIN agent_pheromone USING (agent_id)")
def _anti(t: Tables):
    return t.pheromone_update.where("agent_id IS NOT NULL").select("agent_id").distinct().join(t.agent_pheromone.select("agent_id"), "agent_id", "left_anti")


@query("join_metric_component", "SELECT b.name, coalesce(m.component, 'general') AS component, count(*) AS n FROM benchmark_result b LEFT JOIN (VALUES ('cached', 'cache'), ('rerank', 'ranking'), ('hybrid', 'search'), ('vector', 'search')) m(word, component) ON split_part(b.name, ' ', 1) = m.word GROUP BY 1, 2")
def _component(t: Tables):
    words = F.create_map(*[F.lit(x) for x in ("cached", "cache", "rerank", "ranking", "hybrid", "search", "vector", "search")])
    component = F.coalesce(F.try_element_at(words, F.split_part("name", F.lit(" "), F.lit(1))), F.lit("general"))
    return t.benchmark_result.groupBy("name", component.alias("component")).agg(F.count(F.lit(1)).alias("n"))


@query("join_lang_ext", f"WITH {FILES} SELECT coalesce(l.language, 'unknown') AS language, count(*) AS n FROM files LEFT JOIN lang_ext l ON l.ext = lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) GROUP BY 1")
def _lang(t: Tables):
    exts = t.lang_ext.select("ext", F.col("language").alias("known"))
    return t.files.join(F.broadcast(exts), extension(F.col("file")) == F.col("ext"), "left").groupBy(F.coalesce("known", F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query("join_issue_pattern", f"WITH {FILES} SELECT repo, file, e.message AS message, e.line AS line FROM (SELECT repo, file, unnest(errors) AS e FROM files) WHERE 'E-' || upper(split_part(e.message, ' ', 1)) IN ('E-PARSE', 'E-UNEXPECTED')")
def _issue(t: Tables):
    each = t.files.select("repo", "file", F.explode("errors").alias("e")).select("repo", "file", "e.message", "e.line")
    known = t.spark.createDataFrame([("E-PARSE",), ("E-UNEXPECTED",)], "rule string")
    return each.join(F.broadcast(known), F.concat(F.lit("E-"), F.upper(F.split_part("message", F.lit(" "), F.lit(1)))) == F.col("rule"), "left_semi")


@query("join_step_comp", "SELECT o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber DESC) AS step FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def _steps(t: Tables):
    from pyspark.sql import Window

    j = t.orders.where("o_orderstatus = 'P'").select("o_orderkey").join(t.lineitem.select("l_orderkey", "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("o_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("o_orderkey").orderBy(F.desc("l_linenumber"))).alias("step"))
