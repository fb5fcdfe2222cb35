"""Rules and views on changed code: the patches keep the text that the parsed tables lack."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as x
from lodestone.operators import extract, graph, quality
from lodestone.operators.ranking import in_order
from lodestone.queries.base import PATCHES, Tables, query, r6
from lodestone.queries.code import _RULES
from lodestone.queries.graphs import _FOLDERS, _PAIRS, _REACH, _RING, folder_edges, folder_imports, ring
from lodestone.queries.text import _ISSUES, _UNSAFE

_PARAMS = r"""params AS (SELECT pr_file_id, list_filter(list_transform(string_split(p, ','), lambda a: trim(a)), lambda a: a <> '') AS p FROM (SELECT pr_file_id, unnest(regexp_extract_all(patch, '(?:function|def|fn|func)\s+\w+\s*\(([^()\n]*)\)', 1)) AS p FROM patches)),
    signed AS (SELECT pr_file_id, len(p) AS n, array_to_string(list_transform(p, lambda a: CASE WHEN regexp_matches(a, ':\s*[^=]+') THEN trim(regexp_extract(a, ':\s*([^=]+)', 1)) ELSE trim(regexp_extract(a, '^([^:=]*)', 1)) END), ',') AS k FROM params)"""


def signatures(t: Tables):
    """(pr_file_id, n, k): every function of a patch with its number of parameters and their types, or names where they have none."""
    p = t.patches.where("patch IS NOT NULL").select("pr_file_id", F.explode(extract.parameters(F.col("patch"))).alias("p"))
    return p.select("pr_file_id", F.size("p").alias("n"), extract.signature(F.col("p")).alias("k"))


@query("agg_param_groups", f"WITH {PATCHES}, {_PARAMS} SELECT pr_file_id, k, count(*) AS n FROM signed WHERE n >= 2 GROUP BY 1, 2 HAVING count(*) >= 2")
def _groups(t: Tables):
    """Signatures that several functions of a patch share."""
    return signatures(t).where("n >= 2").groupBy("pr_file_id", "k").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("ap_long_parameter_list", f"WITH {PATCHES}, {_PARAMS} SELECT pr_file_id, max(n) AS n FROM signed GROUP BY 1 HAVING max(n) > 5")
def _long(t: Tables):
    return signatures(t).groupBy("pr_file_id").agg(F.max("n").alias("n")).where(F.col("n") > quality.PARAMETERS)


@query("ap_data_clump", f"WITH {PATCHES}, {_PARAMS} SELECT DISTINCT pr_file_id FROM (SELECT pr_file_id FROM signed WHERE n >= 3 GROUP BY pr_file_id, k HAVING count(*) >= 3)")
def _clump(t: Tables):
    return signatures(t).where("n >= 3").groupBy("pr_file_id", "k").agg(F.count(F.lit(1)).alias("c")).where("c >= 3").select("pr_file_id").distinct()


_ASYNC = r"regexp_extract_all(patch, 'async\s+(function|def|fn)')"
_FUNC = r"regexp_extract_all(patch, '(?:function|def|fn|func)\s+\w+\s*\(')"


@query("agg_async_ratio", f"WITH {PATCHES} SELECT pr_id, round(avg((len({_ASYNC}) > 0)::INT), 6) AS files, round(sum(len({_ASYNC})) * 100.0 / nullif(sum(len({_FUNC})), 0), 6)::DOUBLE AS functions FROM patches WHERE patch IS NOT NULL GROUP BY 1")
def _async(t: Tables):
    """Of a pull request's patches those with asynchronous functions, and of its functions, in percent, those that are."""
    p = t.patches.where("patch IS NOT NULL").select("pr_id", F.regexp_count("patch", F.lit(r"async\s+(function|def|fn)")).alias("a"), F.regexp_count("patch", F.lit(extract.ANY_FUNCTION)).alias("f"))
    return p.groupBy("pr_id").agg(r6(F.avg((F.col("a") > 0).cast("int"))).alias("files"), r6(F.try_divide(F.sum("a") * 100.0, F.nullif(F.sum("f"), F.lit(0)))).alias("functions"))


@query("agg_vuln_surface", f"WITH {PATCHES} SELECT pr_id, greatest(0, 100 - 5 * sum({_ISSUES}))::BIGINT AS surface FROM patches GROUP BY 1")
def _surface(t: Tables):
    return t.patches.groupBy("pr_id").agg(F.greatest(F.lit(0), 100 - 5 * F.sum(x.code_issues(F.col("patch")))).cast("bigint").alias("surface"))


_LAYER = " OR ".join("(contains(lower(filename), '{}') AND ({}))".format(k, " OR ".join(f"contains(patch, '{w}')" for w in words)) for k, words in quality.LAYERS.items())


@query("ap_layer_violation", f"WITH {PATCHES} SELECT pr_file_id FROM patches WHERE {_LAYER}")
def _layer(t: Tables):
    return t.patches.where(quality.breaks_layer(F.col("filename"), F.col("patch"))).select("pr_file_id")


@query("ap_switch_statements", f"WITH {PATCHES} SELECT pr_file_id, len(regexp_extract_all(patch, 'switch\\s*\\([^)]+\\)')) AS n FROM patches WHERE len(regexp_extract_all(patch, 'switch\\s*\\([^)]+\\)')) > 2")
def _switch(t: Tables):
    n = F.regexp_count("patch", F.lit(r"switch\s*\([^)]+\)"))
    return t.patches.select("pr_file_id", n.alias("n")).where("n > 2")


@query("ap_circular_imports", f"WITH RECURSIVE {_FOLDERS}, {_REACH} SELECT src AS node FROM reach WHERE src = dst")
def _circular_imports(t: Tables):
    return graph.on_cycles(folder_edges(t)).select("node")


@query("ap_circular_dependency", f"WITH RECURSIVE {_RING}, c AS (SELECT src, dst, 1 AS d FROM edges UNION ALL SELECT c.src, e.dst, d + 1 FROM c JOIN edges e ON e.src = c.dst WHERE d < 25) SELECT DISTINCT src AS node FROM c WHERE src = dst")
def _circular(t: Tables):
    """The same rule on a graph with long cycles, which the imports at hand have not."""
    return graph.on_cycles(ring(t)).select("node")


_LINES = "list_filter(list_transform(string_split(patch, chr(10)), lambda s: trim(substr(s, 2), ' ')), lambda s: s <> '')"


@query("ap_duplicate_code", f"""WITH {PATCHES}, l AS (SELECT pr_file_id, {_LINES} AS l FROM patches WHERE patch IS NOT NULL), s AS (SELECT DISTINCT pr_file_id, unnest(list_transform(range(1, len(l) - 4), lambda i: array_to_string(l[i:i + 5], chr(10)))) AS s FROM l WHERE len(l) >= 6),
    k AS (SELECT s, count(*) AS n FROM s GROUP BY 1) SELECT pr_file_id, count(*) AS shingles, count_if(n > 1) AS shared FROM s JOIN k USING (s) GROUP BY 1 HAVING count_if(n > 1) >= 0.8 * count(*)""")  # fmt: skip
def _duplicate(t: Tables):
    """Patches of which at least 0.8 of the runs of six lines stand in another one as well."""
    return quality.duplicates(t.patches, "pr_file_id", "patch")


@query("ap_sec001", f"WITH {PATCHES} SELECT pr_file_id, filename, 'SEC001' AS rule, 'critical' AS severity FROM patches WHERE regexp_matches(patch, '{_UNSAFE[0][1]}')")
def _sec(t: Tables):
    return t.patches.where(F.col("patch").rlike(x.UNSAFE[0][1])).select("pr_file_id", "filename", F.lit("SEC001").alias("rule"), F.lit("critical").alias("severity"))


@query("ap_issue", f"WITH {_RULES}, {PATCHES} SELECT repo AS place, file, rule, severity FROM issues WHERE rule IN ('CC001', 'AP001') UNION ALL SELECT pr_id, filename, 'SEC001', 'critical' FROM patches WHERE regexp_matches(patch, '{_UNSAFE[0][1]}')")
def _issue(t: Tables):
    """Issues of parsed files (complexity, methods) and of patches (a literal key)."""
    parsed = quality.issues(t.files).where("rule IN ('CC001', 'AP001')").select(F.col("repo").alias("place"), "file", "rule", "severity")
    keys = t.patches.where(F.col("patch").rlike(x.UNSAFE[0][1])).select(F.col("pr_id").alias("place"), F.col("filename").alias("file"), F.lit("SEC001").alias("rule"), F.lit("critical").alias("severity"))
    return parsed.unionByName(keys)


@query("ap_list", "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{s}')" for r, s in quality.SEVERITIES.items()) + ") r(rule, severity)")
def _rules(t: Tables):
    return t.spark.createDataFrame(list(quality.SEVERITIES.items()), "rule string, severity string")


@query("ap_add", f"WITH {_RULES} SELECT repo, file, rule, severity, subject, line FROM issues UNION ALL SELECT repo, file, 'AP-DEEP', 'low', NULL, NULL FROM files WHERE metrics.nesting_depth > 8")
def _added(t: Tables):
    """All rules and one of the caller's own."""
    return quality.issues(t.files, {"deep": lambda files: quality.files_where(files, "AP-DEEP", "low", quality.m("nesting_depth") > 8)})


@query("num_risk", f"WITH {PATCHES}, c AS (SELECT pr_id, count(DISTINCT filename) AS n, bool_or(status = 'deleted') AS gone FROM patches GROUP BY 1) SELECT pr_id, CASE WHEN n > 10 THEN 'high' WHEN gone THEN 'medium' ELSE 'low' END AS risk FROM c")
def _risk(t: Tables):
    c = t.patches.groupBy("pr_id").agg(F.countDistinct("filename").alias("n"), F.bool_or(F.col("status") == "deleted").alias("gone"))
    return c.select("pr_id", F.when(F.col("n") > 10, "high").when(F.col("gone"), "medium").otherwise("low").alias("risk"))


@query("misc_consequences", f"""WITH {PATCHES}, c AS (SELECT pr_id, count(DISTINCT filename) > 10 AS high FROM patches GROUP BY 1)
    SELECT pr_id, 'positive' AS kind, 'high' AS impact FROM c UNION ALL SELECT pr_id, 'negative', 'medium' FROM c WHERE high UNION ALL SELECT pr_id, 'neutral', 'low' FROM c""")  # fmt: skip
def _consequences(t: Tables):
    """What a decision entails: a gain and some work always, a danger where the risk is high."""
    one = lambda kind, impact: F.struct(F.lit(kind).alias("kind"), F.lit(impact).alias("impact"))
    kinds = F.array_compact(F.array(one("positive", "high"), F.when(F.col("risk").isin("high", "critical"), one("negative", "medium")), one("neutral", "low")))
    return _risk(t).select("pr_id", F.explode(kinds).alias("c")).select("pr_id", "c.*")


_ARCH = "(additions + deletions > 50 OR status IN ('added', 'renamed'))"
_ANCHORS = "anchors AS (SELECT DISTINCT filename FROM patches JOIN pull_request USING (pr_id) WHERE lower(split_part(head_branch, '/', 1)) IN ('docs', 'chore'))"


@query("wf_pr_gate", f"""WITH {PATCHES}, {_ANCHORS}, m AS (SELECT pr_id, filename FROM patches WHERE {_ARCH} AND filename IS NOT NULL AND filename NOT IN (SELECT filename FROM anchors WHERE filename IS NOT NULL))
    SELECT p.pr_id, count(m.filename) = 0 AS passed, coalesce(list(DISTINCT m.filename ORDER BY m.filename) FILTER (m.filename IS NOT NULL), []) AS files FROM pull_request p LEFT JOIN m ON m.pr_id = p.pr_id GROUP BY 1""")  # fmt: skip
def _gate(t: Tables):
    """Pull requests pass unless an architectural change has no decision record; here records are anchored to files by documenting branches."""
    patches = t.patches
    arch = patches.where((F.col("additions") + F.col("deletions") > 50) | F.col("status").isin("added", "renamed")).where("filename IS NOT NULL").select("pr_id", "filename")
    documenting = t.pull_request.where(F.lower(F.split_part("head_branch", F.lit("/"), F.lit(1))).isin("docs", "chore")).select("pr_id")
    return quality.gate(t.pull_request.select("pr_id"), arch, patches.join(documenting, "pr_id", "left_semi").select("filename"), "pr_id", "filename")


_PREFIX = "CASE status WHEN 'added' THEN 'Introduce' WHEN 'renamed' THEN 'Refactor' WHEN 'deleted' THEN 'Update dependency' ELSE 'Change' END"


@query("txt_adr_title", f"WITH {PATCHES} SELECT pr_file_id, {_PREFIX} || ' ' || CASE WHEN filename IS NULL THEN 'system' ELSE string_split(filename, '/')[-1] END || ': ' || left(coalesce(title, ''), 50) AS title FROM patches LEFT JOIN pull_request USING (pr_id)")
def _adr_title(t: Tables):
    both = t.patches.select("pr_file_id", "pr_id", "filename", "status").join(t.pull_request.select("pr_id", "title"), "pr_id", "left")
    return both.select("pr_file_id", x.decision_title(F.col("status"), F.col("filename"), F.col("title")).alias("title"))


@query("txt_ctx", f"""WITH {PATCHES}, c AS (SELECT pr_id, count(DISTINCT filename) AS n, list(DISTINCT CASE WHEN len(string_split(filename, '/')) > 1 THEN string_split(filename, '/')[-2] ELSE 'root' END) FILTER (filename IS NOT NULL) AS m FROM patches GROUP BY 1)
    SELECT pr_id, '## Context' || chr(10) || chr(10) || '**Trigger:** ' || coalesce(title, '') || chr(10) || '**Affected Files:** ' || n || chr(10) || '**Affected Modules:** ' || array_to_string(list_sort(coalesce(m, [])), ', ') AS body FROM pull_request JOIN c USING (pr_id)""")  # fmt: skip
def _ctx(t: Tables):
    """The context section of a decision record."""
    c = t.patches.groupBy("pr_id").agg(F.countDistinct("filename").alias("n"), F.array_sort(F.collect_set(F.when(F.col("filename").isNotNull(), x.module_of(F.col("filename"))))).alias("m"))
    return t.pull_request.select("pr_id", "title").join(c, "pr_id").select("pr_id", x.context_section(F.col("title"), F.col("n"), F.col("m")).alias("body"))


@query("txt_decision", f"WITH {PATCHES} SELECT pr_file_id, md5('## Decision' || chr(10) || chr(10) || CASE status WHEN 'renamed' THEN '{x.DECISIONS['renamed']}' WHEN 'added' THEN '{x.DECISIONS['added']}' WHEN 'deleted' THEN '{x.DECISIONS['deleted']}' ELSE 'Apply the necessary changes.' END) AS h FROM patches")
def _decision(t: Tables):
    return t.patches.select("pr_file_id", F.md5(x.decision_section(F.col("status"))).alias("h"))


@query("agg_plan_totals", f"WITH {PATCHES} SELECT pr_id, sum(additions + deletions)::BIGINT AS duration, list(DISTINCT lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1)) ORDER BY lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1))) AS kinds FROM patches WHERE filename IS NOT NULL GROUP BY 1")
def _plan(t: Tables):
    """A plan's tasks summed up: changed lines stand for durations, kinds of files for kinds of agents."""
    return t.patches.where("filename IS NOT NULL").groupBy("pr_id").agg(F.sum(F.col("additions") + F.col("deletions")).alias("duration"), F.array_sort(F.collect_set(x.extension(F.col("filename")))).alias("kinds"))


@query("misc_packages_used", f"WITH {_PAIRS} SELECT repo, count(DISTINCT dst) AS n FROM pairs WHERE src <> dst GROUP BY 1")
def _used(t: Tables):
    return folder_imports(t).groupBy("repo").agg(F.countDistinct("dst").alias("n"))


@query("ap_affected", f"WITH RECURSIVE {_FOLDERS}, {_REACH}, changed AS (SELECT DISTINCT repo || ':' || string_split(translate(file, chr(92), '/'), '/')[-2] AS node FROM parse_result WHERE parsed_at >= TIMESTAMP '2025-04-01' AND contains(translate(file, chr(92), '/'), '/') AND repo IS NOT NULL) SELECT DISTINCT src AS node FROM reach JOIN changed ON node = dst WHERE src <> dst")
def _affected(t: Tables):
    """Folders that depend, over any number of imports, on one with a file parsed since April."""
    path = F.translate("file", "\\", "/")
    late = t.parse_result.where("parsed_at >= TIMESTAMP_NTZ '2025-04-01' AND repo IS NOT NULL").where(F.contains(path, F.lit("/")))
    changed = late.select(F.concat("repo", F.lit(":"), F.element_at(F.split(path, "/"), -2)).alias("node")).distinct()
    return graph.dependents(folder_edges(t)).join(changed, "node", "left_semi").select(F.col("dependent").alias("node")).distinct()


@query("wf_queue", "SELECT pr_file_id, row_number() OVER (ORDER BY CASE WHEN status = 'deleted' THEN 0 WHEN status = 'renamed' THEN 1 WHEN status = 'added' THEN 2 ELSE 3 END, committed_at, pr_file_id) AS place FROM (SELECT * FROM pr_file QUALIFY row_number() OVER (PARTITION BY pr_file_id ORDER BY ingested_at DESC NULLS LAST) = 1)")
def _queue(t: Tables):
    """All tasks in the order they are worked off: by kind, then age."""
    kind = F.when(F.col("status") == "deleted", 0).when(F.col("status") == "renamed", 1).when(F.col("status") == "added", 2).otherwise(3)
    rows = t.patches.select("pr_file_id", "committed_at", kind.alias("kind"))
    return in_order(rows, ["kind", F.asc_nulls_last("committed_at"), F.col("pr_file_id")], "n").select("pr_file_id", (F.col("n") + 1).alias("place"))
