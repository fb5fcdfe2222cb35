"""The queries of this subpackage, with the SQL they are checked against where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import credentials as p4
from lodestone.llm import handwritten as p5
from lodestone.llm import mixing as p8
from lodestone.llm import neighbours as p3
from lodestone.llm import packing as p7
from lodestone.llm import percentiles as p2
from lodestone.llm import spans as p1
from lodestone.llm import splitting as p9
from lodestone.llm import syntax as p6
from lodestone.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda s, d: p1.found(table(s, d, "memory_entry"), table(s, d, "pr_file")),
    "p1_shares": lambda s, d: p1.shares(table(s, d, "memory_entry"), table(s, d, "pr_file")),
    "p1_sentence_runs": lambda s, d: p1.sentence_runs(table(s, d, "memory_entry"), table(s, d, "pr_file")),
    "p1_cleaned": lambda s, d: p1.without_repeats(table(s, d, "memory_entry"), table(s, d, "pr_file")).withColumn("text", F.md5("text")),
    "p2_found": lambda s, d: p2.found(table(s, d, "pheromone_update"), table(s, d, "benchmark_result")),
    "p2_percentiles": lambda s, d: p2.percentiles(
        p2.latency_counts(table(s, d, "pheromone_update"), table(s, d, "benchmark_result")), ["grp_kind", "grp_key"], [50.0, 90.0, 95.0, 99.0]
    ),
    "p2_sketch": lambda s, d: p2.daily_sketch(table(s, d, "pheromone_update"), table(s, d, "benchmark_result"), [50.0, 90.0, 95.0, 99.0]).withColumn("value", F.round("value", 6)),
    "p3_found": lambda s, d: p3.found(table(s, d, "memory_entry"), table(s, d, "search_query")),
    "p3_neighbours": lambda s, d: p3.memory(table(s, d, "memory_entry"), table(s, d, "search_query")),
    "p4_found": lambda s, d: p4.found(table(s, d, "pr_file")),
    "p4_findings": lambda s, d: p4.report(table(s, d, "pr_file")),
    "p4_masked": lambda s, d: p4.redact(table(s, d, "pr_file")),
    "p5_found": lambda s, d: p5.found(table(s, d, "parse_result"), table(s, d, "lang_ext")),
    "p5_origins": lambda s, d: p5.by_repo(table(s, d, "parse_result"), table(s, d, "lang_ext")),
    "p6_found": lambda s, d: p6.found(table(s, d, "parse_result"), table(s, d, "lang_ext")),
    "p6_reports": lambda s, d: p6.reports(table(s, d, "parse_result"), table(s, d, "lang_ext")),
    "p6_rates": lambda s, d: p6.rates(table(s, d, "parse_result"), table(s, d, "lang_ext")),
    "p7_found": lambda s, d: p7.found(table(s, d, "documents"), table(s, d, "container_plan")),
    "p7_places": lambda s, d: p7.documents(table(s, d, "documents"), table(s, d, "container_plan")),
    "p7_fill": lambda s, d: p7.fill(table(s, d, "documents"), table(s, d, "container_plan")),
    "p8_found": lambda s, d: p8.found(table(s, d, "documents"), table(s, d, "mix_target")),
    "p8_shares": lambda s, d: p8.shares(table(s, d, "documents"), table(s, d, "mix_target")),
    "p8_documents": lambda s, d: p8.mixed(table(s, d, "documents"), table(s, d, "mix_target")),
    "p9_found": lambda s, d: p9.found(table(s, d, "documents")),
    "p9_pieces": lambda s, d: p9.split(table(s, d, "documents").select("doc_id", "text"), "text").drop("text"),
}

_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0b\f\r]+'))"

_READINGS = """
    SELECT DISTINCT 'agent' AS grp_kind, agent_id AS grp_key, update_id AS id, latency_ms AS v FROM pheromone_update
    WHERE agent_id IS NOT NULL AND latency_ms >= 0 AND isfinite(latency_ms)
    UNION ALL
    SELECT DISTINCT 'bench', name, run_id, p95_latency_ms FROM benchmark_result
    WHERE name IS NOT NULL AND p95_latency_ms >= 0 AND isfinite(p95_latency_ms)
"""
_RANKED = f"""
    WITH r AS ({_READINGS}),
    k AS (SELECT *, row_number() OVER (PARTITION BY grp_kind, grp_key ORDER BY v) AS i, count(*) OVER (PARTITION BY grp_kind, grp_key) AS n FROM r)
"""

_RUNS = r"""
    WITH r AS (SELECT DISTINCT 'memory_entry' AS rec_kind, id AS rec_id, content AS text FROM memory_entry WHERE id IS NOT NULL AND content IS NOT NULL
        UNION ALL SELECT DISTINCT 'pr_file', pr_file_id::VARCHAR, patch FROM pr_file WHERE pr_file_id IS NOT NULL AND patch IS NOT NULL),
    l AS (SELECT rec_kind, rec_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '') AS l FROM r),
    s AS (SELECT rec_kind, rec_id, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS sentence_no FROM l),
    t AS (SELECT *, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c FROM s WINDOW w AS (PARTITION BY rec_kind, rec_id ORDER BY sentence_no)),
    h AS (SELECT a, b, c, count(DISTINCT (rec_kind, rec_id)) AS n_records, min((rec_kind, rec_id)) AS least FROM t WHERE c IS NOT NULL GROUP BY ALL HAVING count(DISTINCT (rec_kind, rec_id)) > 1),
    runs AS (SELECT rec_kind, rec_id, sentence_no, n_records, (rec_kind, rec_id) = least AS first FROM t JOIN h USING (a, b, c))
"""

ORACLE: dict[str, str] = {
    "p1_sentence_runs": _RUNS + "SELECT rec_kind, rec_id, sentence_no, n_records, first FROM runs",
    "p1_cleaned": _RUNS + r""",
    pieces AS (SELECT rec_kind, rec_id, text, string_split(regexp_replace(text, '([.!?] |\n)', '\1' || chr(57345), 'g'), chr(57345)) AS l FROM r),
    piece AS (SELECT rec_kind, rec_id, text, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM pieces),
    filled AS (SELECT *, trim(rtrim(raw, chr(10)), ' ') <> '' AS is_s, count(*) FILTER (trim(rtrim(raw, chr(10)), ' ') <> '') OVER (PARTITION BY rec_kind, rec_id, text ORDER BY i) - 1 AS no FROM piece),
    gone AS (SELECT DISTINCT rec_kind, rec_id, sentence_no + d AS no FROM runs, range(3) t(d) WHERE NOT first)
    SELECT f.rec_kind, f.rec_id, count(*) FILTER (is_s) AS n_sentences, count(*) FILTER (is_s AND g.no IS NOT NULL) AS n_removed, md5(coalesce(string_agg(CASE WHEN is_s AND g.no IS NOT NULL THEN '' ELSE raw END, '' ORDER BY i), '')) AS text
    FROM filled f LEFT JOIN gone g USING (rec_kind, rec_id, no) GROUP BY f.rec_kind, f.rec_id, text
    """,
    "p2_found": _RANKED + """
    SELECT grp_kind, grp_key FROM k
    WHERE n >= 30 AND ((grp_kind = 'agent' AND i = (95 * n + 99) // 100 AND v > 5000) OR (grp_kind = 'bench' AND i = (90 * n + 99) // 100 AND v > 400))
    """,
    "p2_percentiles": _RANKED + """
    SELECT grp_kind, grp_key, p::DOUBLE AS percent, v AS value, n AS n_values
    FROM k, (VALUES (50), (90), (95), (99)) t(p) WHERE i = (p * n + 99) // 100
    """,
    "p2_sketch": f"""
    WITH r AS ({_READINGS}), b AS (SELECT grp_kind, grp_key, CASE WHEN v = 0 THEN 0 ELSE pow(1.01 / 0.99, ceil(ln(v) / ln(1.01 / 0.99))) * 2 / (1.01 / 0.99 + 1) END AS v FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY grp_kind, grp_key ORDER BY v) AS i, count(*) OVER (PARTITION BY grp_kind, grp_key) AS n FROM b)
    SELECT grp_kind, grp_key, p::DOUBLE AS percent, round(v, 6) AS value, n AS n_values FROM k, (VALUES (50), (90), (95), (99)) t(p) WHERE i = (p * n + 99) // 100
    """,
    "p7_found": f"""
    SELECT doc_id FROM documents JOIN (SELECT lane, max(capacity_tokens) AS cap FROM container_plan GROUP BY lane) USING (lane) WHERE {_SIZE} > cap
    """,
    "p8_found": f"""
    WITH sizes AS (SELECT lower(trim(source)) AS src, {_SIZE} AS size FROM documents),
    total AS (SELECT sum(size) AS all_tokens FROM sizes),
    tokens AS (SELECT src, sum(size) AS tokens FROM sizes GROUP BY src),
    rows AS (SELECT *, weight / sum(weight) OVER (PARTITION BY mix_id) * budget_ratio * all_tokens AS target FROM mix_target, total WHERE weight > 0)
    SELECT mix_id, source FROM rows LEFT JOIN tokens ON src = lower(trim(source)) WHERE target > max_repeats * coalesce(tokens, 0)
    """,
    "p9_found": rf"""
    WITH d AS (SELECT doc_id, text FROM documents WHERE {_SIZE} > 800),
    stretch AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) AS text FROM d)
    SELECT doc_id, CASE WHEN max({_SIZE}) > 800 THEN 'hard' ELSE 'soft' END AS cut_kind FROM stretch GROUP BY doc_id
    """,
}
