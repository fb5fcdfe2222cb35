"""Scores, rules and issues of parsed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import quality
from lodestone.queries.base import FILES, PATCHES, Tables, query, r6
from lodestone.sources.store import latest

_MAINT = """greatest(0.0, least(100.0, 100 - (CASE WHEN cc > 10 THEN least(30, (cc - 10) * 2) ELSE 0 END) - (CASE WHEN cog > 15 THEN least(25, (cog - 15) * 1.5) ELSE 0 END) - (CASE WHEN nest > 4 THEN least(15, (nest - 4) * 3) ELSE 0 END)
    + (CASE WHEN mi < 65 THEN -(65 - mi) * 0.5 WHEN mi > 85 THEN least(10, (mi - 85) * 0.3) ELSE 0 END)))"""
_SCORES = f"""{FILES}, base AS (SELECT *, metrics.cyclomatic_complexity::DOUBLE AS cc, metrics.cognitive_complexity::DOUBLE AS cog, metrics.nesting_depth::DOUBLE AS nest, metrics.maintainability_index::DOUBLE AS mi,
        coalesce(len(list_filter(imports, lambda i: regexp_matches(lower(i.source), 'async'))) > 0, false) AS has_async, coalesce(len(list_filter(imports, lambda i: regexp_matches(lower(i.source), 'cache|memo'))) > 0, false) AS has_cache FROM files),
    parts AS (SELECT repo, file, CASE WHEN metrics IS NULL THEN 100.0 ELSE {_MAINT} END::DOUBLE AS maintainability,
        greatest(0, least(100, 100 - CASE WHEN NOT has_async AND coalesce(lower(trim(language)), '') <> 'go' THEN 10 ELSE 0 END - 15 * coalesce(len(list_filter(classes, lambda c: c.n_methods > 20 OR c.n_properties > 15)), 0)))::DOUBLE AS scalability,
        100.0::DOUBLE AS security, (100 - CASE WHEN NOT has_cache AND coalesce(n_functions, 0) > 10 THEN 10 ELSE 0 END)::DOUBLE AS performance FROM base),
    scores AS (SELECT *, floor(maintainability * 0.35 + scalability * 0.25 + security * 0.25 + performance * 0.15 + 0.5)::BIGINT AS total FROM parts)"""


@query("num_file_total", f"WITH {_SCORES} SELECT repo, file, round(maintainability, 6) AS maintainability, scalability, security, performance, total FROM scores")
def _scores(t: Tables):
    return quality.file_scores(t.files).withColumn("maintainability", r6("maintainability"))


def _part(name: str, dimension: str):
    query(name, f"WITH {_SCORES} SELECT repo, file, round({dimension}, 6) AS score FROM scores")(lambda t: quality.file_scores(t.files).select("repo", "file", r6(dimension).alias("score")))


for _name, _dimension in (("num_file_maint", "maintainability"), ("num_file_scal", "scalability"), ("num_file_perf", "performance")):
    _part(_name, _dimension)


@query("agg_overall", f"WITH {_SCORES} SELECT repo, round(sum(maintainability), 4) AS maintainability, round(avg(scalability), 4) AS scalability, round(avg(performance), 4) AS performance, count(*) AS n FROM scores GROUP BY 1")
def _overall(t: Tables):
    avg = lambda c: F.round(F.avg(c), 4).alias(c)
    return quality.file_scores(t.files).groupBy("repo").agg(F.round(F.sum("maintainability"), 4).alias("maintainability"), avg("scalability"), avg("performance"), F.count(F.lit(1)).alias("n"))


@query("agg_weighted", f"WITH {_SCORES} SELECT s.repo, floor(sum(total * loc) / sum(loc) + 0.5)::BIGINT AS score FROM scores s JOIN (SELECT repo, file, metrics.lines_of_code AS loc FROM files WHERE metrics IS NOT NULL) f ON f.repo = s.repo AND f.file = s.file GROUP BY 1")
def _weighted(t: Tables):
    files = t.files.where("metrics IS NOT NULL")
    both = quality.file_scores(files).join(files.select("repo", "file", F.col("metrics.lines_of_code").alias("weight")), ["repo", "file"])
    return quality.weighted(both.withColumn("score", F.col("total")), ["repo"])


@query("num_factors", f"""WITH {FILES}, a AS (SELECT repo, avg(metrics.cyclomatic_complexity) AS cc, avg(metrics.cognitive_complexity) AS cog, avg(metrics.nesting_depth) AS nest FROM files GROUP BY 1),
    f AS (SELECT repo, 'cyclomatic' AS factor, greatest(0, 100 - cc * 5) AS score FROM a UNION ALL SELECT repo, 'cognitive', greatest(0, 100 - cog * 3) FROM a UNION ALL SELECT repo, 'nesting', greatest(0, 100 - nest * 5) FROM a) SELECT repo, factor, round(score, 6) AS score FROM f""")  # fmt: skip
def _factors(t: Tables):
    avg = lambda c: F.avg(f"metrics.{c}")
    a = t.files.groupBy("repo").agg(F.greatest(F.lit(0.0), 100 - avg("cyclomatic_complexity") * 5).alias("cyclomatic"), F.greatest(F.lit(0.0), 100 - avg("cognitive_complexity") * 3).alias("cognitive"), F.greatest(F.lit(0.0), 100 - avg("nesting_depth") * 5).alias("nesting"))
    return a.unpivot("repo", ["cyclomatic", "cognitive", "nesting"], "factor", "score").withColumn("score", r6("score"))


@query("rnk_worst_dim", f"WITH {_SCORES} SELECT repo, file, CASE least(maintainability, performance, scalability, security) WHEN maintainability THEN 'maintainability' WHEN performance THEN 'performance' WHEN scalability THEN 'scalability' ELSE 'security' END AS dimension FROM scores")
def _worst(t: Tables):
    dims = sorted(quality.DIMENSIONS)
    worst = F.array_min(F.array(*[F.struct(F.col(d).alias("score"), F.lit(d).alias("dimension")) for d in dims]))
    return quality.file_scores(t.files).select("repo", "file", worst["dimension"].alias("dimension"))


_CLASSES = "SELECT repo, file, unnest(classes) AS c FROM files"
_RULES = f"""{FILES}, cls AS ({_CLASSES}), has AS (SELECT repo, file, count_if(c.n_methods > 20 OR c.n_properties > 15) AS big, count_if(c.complexity > 2 AND c.n_methods > 0) AS envy FROM cls GROUP BY 1, 2),
    issues AS (SELECT f.repo, f.file, 'AP-GOD_CLASS' AS rule, 'high' AS severity, NULL AS subject, NULL::INT AS line FROM files f LEFT JOIN has h ON h.repo = f.repo AND h.file = f.file WHERE coalesce(h.big, 0) > 0 OR (coalesce(metrics.lines_of_code, 0) > 500 AND len(classes) > 0)
    UNION ALL SELECT repo, file, 'AP-GOD_CLASS', 'high', c.name, c.line FROM cls WHERE c.n_methods > 20 UNION ALL SELECT repo, file, 'AP-GOD_CLASS', 'high', c.name, c.line FROM cls WHERE c.n_properties > 15
    UNION ALL SELECT repo, file, 'AP-GOD_METHOD', 'high', c.name, c.line FROM cls WHERE c.complexity > 15 UNION ALL SELECT repo, file, 'AP-FEATURE_ENVY', 'medium', NULL, NULL FROM has WHERE envy > 0
    UNION ALL SELECT repo, file, 'CC001', 'high', NULL, NULL FROM files WHERE metrics.cyclomatic_complexity > 20 UNION ALL SELECT repo, file, 'AP001', 'high', c.name, c.line FROM cls WHERE c.n_methods > 20)"""


@query("ap_detect_all", f"WITH {_RULES} SELECT repo, file, rule, severity, subject, line FROM issues")
def _issues(t: Tables):
    return quality.issues(t.files)


def _rule(name: str, sql: str):
    query(f"ap_{name}", f"WITH {_RULES} SELECT repo, file, rule, severity, subject, line FROM issues WHERE rule = '{sql}'")(lambda t: quality.rules(t.files)[name])


for _name, _sql in (("god_class", "AP-GOD_CLASS"), ("god_method", "AP-GOD_METHOD"), ("feature_envy", "AP-FEATURE_ENVY")):
    _rule(_name, _sql)


@query("ap_shotgun_surgery", f"WITH {PATCHES} SELECT pr_id, count(DISTINCT filename) AS n_items FROM patches GROUP BY 1 HAVING count(DISTINCT filename) > 5")
def _shotgun(t: Tables):
    return quality.co_changes(t.patches, "pr_id", "filename", 5)


@query("ap_rec_worst", f"WITH {_SCORES} SELECT repo, file, least(maintainability, performance, scalability, security) AS score FROM scores WHERE least(maintainability, performance, scalability, security) < 70")
def _rec(t: Tables):
    files = t.files
    return quality.recommendations(quality.file_scores(files), quality.issues(files)).select("repo", "file", "score")


@query("ap_rec_critical", f"WITH {_RULES} SELECT rule, count(*) AS n, count(DISTINCT repo) AS repos FROM issues WHERE severity = 'high' GROUP BY 1")
def _critical(t: Tables):
    return quality.issues(t.files).where("severity = 'high'").groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("repo").alias("repos"))


_CUT = "TIMESTAMP '2025-04-01'"


def _project(alias: str, where: str) -> str:
    names = {"files AS (": f"{alias}_f AS (", "FROM files)": f"FROM {alias}_f)", "base AS (": f"{alias}_base AS (", "FROM base)": f"FROM {alias}_base)", "parts AS (": f"{alias}_parts AS (", "FROM parts)": f"FROM {alias}_parts)", "scores AS (": f"{alias}_scores AS ("}
    sql = _SCORES.replace("FROM parse_result QUALIFY", f"FROM parse_result {where} QUALIFY")
    for old, new in names.items():
        sql = sql.replace(old, new)
    return sql + f", {alias} AS (SELECT s.repo, floor(sum(total * metrics.lines_of_code) / nullif(sum(metrics.lines_of_code), 0) + 0.5)::BIGINT AS score, count(*) AS n FROM {alias}_scores s JOIN {alias}_f f ON f.repo = s.repo AND f.file = s.file WHERE metrics IS NOT NULL GROUP BY 1)"


@query("st_incremental", f"""WITH {_project("old", f"WHERE parsed_at < {_CUT}")}, {_project("new", "")}, changed AS (SELECT repo, count(DISTINCT file) AS n_changed FROM parse_result WHERE parsed_at >= {_CUT} GROUP BY 1)
    SELECT n.repo, o.score AS before, n.score AS after, n.score - o.score AS delta, coalesce(n_changed, 0) AS n_changed FROM new n LEFT JOIN old o ON o.repo = n.repo LEFT JOIN changed c ON c.repo = n.repo WHERE n.repo IS NOT NULL""")  # fmt: skip
def _incremental(t: Tables):
    """A project's score before and after the parses since April replaced those of their files, and the files they are of."""
    late = F.col("parsed_at") >= F.expr("TIMESTAMP_NTZ '2025-04-01'")
    every = t.parse_result.where("repo IS NOT NULL")
    return quality.project_delta(every, late)


@query("st_incremental_files", f"""WITH {_project("old", f"WHERE parsed_at < {_CUT}")}, {_project("new", "")} SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.file, o.file) AS file, o.total AS before, n.total AS after, n.total - o.total AS delta
    FROM new_scores n FULL JOIN old_scores o ON o.repo = n.repo AND o.file = n.file WHERE coalesce(n.repo, o.repo) IS NOT NULL AND coalesce(n.file, o.file) IS NOT NULL""")  # fmt: skip
def _delta(t: Tables):
    every = t.parse_result.where("repo IS NOT NULL AND file IS NOT NULL")
    state = lambda df: quality.file_scores(latest(df, ["repo", "file"], ["parsed_at", "ingested_at", "parse_id"]))
    return quality.score_delta(state(every.where("parsed_at < TIMESTAMP_NTZ '2025-04-01'")), state(every))
