"""Further operators on the tables: code extraction, rules on text, routing cascades, generated rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as x
from lodestone.functions.measures import token_size
from lodestone.operators import extract, folds, graph, learning, routing
from lodestone.queries.base import FILES, MEMORY, PATCHES, UPDATES, Tables, query, r6
from lodestone.queries.graphs import _PACKAGES, _RING, ring
from lodestone.queries.text import SPACE
from lodestone.sources import store

# -- sources and filters -----------------------------------------------------------------------------


@query("src_files", f"WITH {PATCHES} SELECT lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1)) AS ext, count(*) AS n, sum(length(patch))::BIGINT AS chars FROM patches WHERE patch IS NOT NULL GROUP BY 1")
def _files(t: Tables):
    p = t.patches.where("patch IS NOT NULL")
    return p.groupBy(x.extension(F.col("filename")).alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("patch")).alias("chars"))


@query("src_export_tpl", "SELECT pr_id, json_object('pr_id', pr_id, 'author', author) AS j FROM pull_request WHERE author IS NOT NULL")
def _export(t: Tables):
    return t.pull_request.where("author IS NOT NULL").select("pr_id", F.to_json(F.struct("pr_id", "author")).alias("j"))


@query("src_import_tpl", "SELECT pr_id, author FROM pull_request WHERE author IS NOT NULL")
def _import(t: Tables):
    return _export(t).select(F.from_json("j", "pr_id string, author string").alias("r")).select("r.*")


@query("flt_alerts", f"WITH {UPDATES} SELECT update_id, agent_id FROM updates WHERE NOT success AND consensus_score < 0.3")
def _alerts(t: Tables):
    return t.updates.where("NOT success AND consensus_score < 0.3").select("update_id", "agent_id")


@query("flt_eval_status", f"WITH {MEMORY} SELECT verdict, count(*) AS n FROM memory GROUP BY 1")
def _verdicts(t: Tables):
    return t.memory.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("flt_tpl_category", "SELECT doc_id, lang FROM documents WHERE lower(trim(source)) = 'template.core'")
def _category(t: Tables):
    return t.documents.where(F.lower(F.trim("source")) == "template.core").select("doc_id", "lang")


@query("flt_instances", f"WITH {PATCHES} SELECT pr_file_id, pr_id FROM patches WHERE pr_id IN (SELECT pr_id FROM pull_request WHERE base_branch = 'release')")
def _instances(t: Tables):
    return t.patches.join(t.pull_request.where("base_branch = 'release'").select("pr_id"), "pr_id", "left_semi").select("pr_file_id", "pr_id")


# -- joins, folds --------------------------------------------------------------------------------------


# -- rules on code and text ----------------------------------------------------------------------------


@query("ap_parse_errors", f"WITH {FILES} SELECT repo, file, len(errors) AS n, list_max(list_transform(errors, lambda e: e.line)) AS last_line FROM files WHERE len(errors) > 0")
def _errors(t: Tables):
    return t.files.where(F.size("errors") > 0).select("repo", "file", F.size("errors").alias("n"), F.array_max(F.transform("errors", lambda e: e["line"])).alias("last_line"))


@query("ap_parse_extract", "SELECT doc_id, len(regexp_extract_all(text, '(?m)^\\s*(?:export\\s+)?(?:async\\s+)?(?:function|def|fn|func)\\s+([A-Za-z_]\\w*)', 1)) AS functions, len(regexp_extract_all(text, '(?m)^\\s*(?:export\\s+)?(?:abstract\\s+)?(?:class|struct|interface)\\s+([A-Za-z_]\\w*)', 1)) AS classes FROM documents WHERE text IS NOT NULL")
def _extract(t: Tables):
    return t.documents.where("text IS NOT NULL").select("doc_id", extract.functions(F.col("text")).alias("f"), extract.classes(F.col("text")).alias("c")).select("doc_id", F.size("f").alias("functions"), F.size("c").alias("classes"))


# -- cascades and generated rows -----------------------------------------------------------------------


@query("misc_fisher_lookup", f"WITH {MEMORY} SELECT id, len(embedding) AS n FROM memory WHERE id = 'mem-00000000007'")
def _lookup(t: Tables):
    return store.by_id(t.memory, "id", "mem-00000000007").select("id", F.size("embedding").alias("n"))


@query("misc_sink_reward", f"WITH {MEMORY} SELECT verdict, consolidated, count(*) AS n, round(sum(CASE verdict WHEN 'success' THEN 1.0 WHEN 'failure' THEN 0.0 ELSE 0.5 END), 3)::DOUBLE AS reward FROM memory GROUP BY 1, 2")
def _reward(t: Tables):
    r = F.when(F.col("verdict") == "success", 1.0).when(F.col("verdict") == "failure", 0.0).otherwise(0.5)
    return t.memory.groupBy("verdict", "consolidated").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(r), 3).alias("reward"))


@query("misc_status", "SELECT CASE WHEN count(*) > 0 THEN 'active' ELSE 'idle' END AS status, count(DISTINCT role) AS roles FROM agent_pheromone")
def _status(t: Tables):
    return t.agent_pheromone.agg(F.when(F.count(F.lit(1)) > 0, "active").otherwise("idle").alias("status"), F.countDistinct("role").alias("roles"))


@query("agg_size_by_lane", f"SELECT lane, sum(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\n\\x0b\\f\\r]+')))::BIGINT AS tokens, sum(len(string_split_regex(coalesce(text, ''), '{SPACE}')))::BIGINT AS words FROM documents GROUP BY 1")
def _by_lane(t: Tables):
    return t.documents.groupBy("lane").agg(F.sum(token_size(F.col("text"))).alias("tokens"), F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+", -1))).alias("words"))
