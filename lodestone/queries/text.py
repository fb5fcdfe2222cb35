"""Text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as x
from lodestone.functions.measures import token_size
from lodestone.functions.numbers import hash32
from lodestone.operators.learning import scales, weights
from lodestone.operators.ranking import in_order
from lodestone.queries.base import FILES, MEMORY, PATCHES, Tables, query, r6
from lodestone.queries.vectors import _WRAP

SPACE = "[ \\t\\n\\x0b\\f\\r]+"
_WORDS = f"string_split_regex(lower({{}}), '{SPACE}')"


@query("txt_tokens", f"SELECT doc_id, len({_WORDS.format('text')}) AS n, len(list_distinct({_WORDS.format('text')})) AS n_distinct FROM documents WHERE text IS NOT NULL")
def _tokens(t: Tables):
    w = x.tokens(F.col("text"))
    return t.documents.where("text IS NOT NULL").select("doc_id", F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("n_distinct"))


@query("txt_token_size", "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\n\\x0b\\f\\r]+')) AS n FROM documents")
def _size(t: Tables):
    return t.documents.select("doc_id", token_size(F.col("text")).alias("n"))


@query(
    "txt_bm25",
    f"""SELECT doc_id, round(CASE WHEN text IS NULL THEN 0 ELSE list_sum(list_transform(['saga', 'ledger', 'saga'], lambda q: 0.4054651081081644 * tf(w, q) * 2.2 / (tf(w, q) + 1.2 * (0.25 + 0.75 * len(w) / 100.0)))) END, 6) AS score
    FROM (SELECT doc_id, text, {_WORDS.format('text')} AS w FROM documents)""".replace("tf(w, q)", "len(list_filter(w, lambda y: y = q))"),
)
def _bm25(t: Tables):
    return t.documents.select("doc_id", r6(x.bm25(F.col("text"), ["saga", "ledger", "saga"])).alias("score"))


@query(
    "txt_overlap",
    f"""SELECT pr_id, round(coalesce(len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / greatest(len(list_distinct(a)), len(list_distinct(b))), 0), 6) AS overlap
    FROM (SELECT pr_id, {_WORDS.format('title')} AS a, {_WORDS.format('description')} AS b FROM pull_request)""",
)
def _overlap(t: Tables):
    return t.pull_request.select("pr_id", r6(x.overlap(F.col("title"), F.col("description"))).alias("overlap"))


@query("txt_kw_hits", f"SELECT pr_id, len(list_filter({_WORDS.format('description')}, lambda w: w IN ('the', 'every', 'agent', 'ledger', 'quorum'))) AS hits FROM pull_request WHERE description IS NOT NULL")
def _hits(t: Tables):
    words = F.array(*map(F.lit, ("the", "every", "agent", "ledger", "quorum")))
    return t.pull_request.where("description IS NOT NULL").select("pr_id", x.keyword_hits(F.col("description"), words).alias("hits"))


CAPS = {"write": "write", "delete": "admin", "merge": "write", "audit": "review", "verify": "review"}


@query("txt_infer_caps", "SELECT pr_id, CASE WHEN len(c) > 0 THEN c ELSE ['read'] END AS caps FROM (SELECT pr_id, list_transform(list_filter([['write', 'write'], ['delete', 'admin'], ['merge', 'write'], ['audit', 'review'], ['verify', 'review']], lambda p: contains(lower(title), p[1])), lambda p: p[2]) AS c FROM pull_request WHERE title IS NOT NULL)")
def _caps(t: Tables):
    return t.pull_request.where("title IS NOT NULL").select("pr_id", x.infer_capabilities(F.col("title"), CAPS, "read").alias("caps"))


@query("txt_hash32", f"SELECT DISTINCT agent_id, abs(list_reduce(list_transform(string_split(agent_id, ''), lambda c: unicode(c)::BIGINT), lambda h, c: {_WRAP}, 0::BIGINT)) AS h FROM pheromone_update WHERE agent_id IS NOT NULL")
def _hash32(t: Tables):
    return t.pheromone_update.where("agent_id IS NOT NULL").select("agent_id").distinct().select("agent_id", hash32(F.col("agent_id")).alias("h"))


_SEED = f"abs(list_reduce(list_transform(string_split(role, ''), lambda c: unicode(c)::BIGINT), lambda h, c: {_WRAP}, 0::BIGINT))"
_STEP = "((h * 1664525 + 1013904223 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"
_LCG = f"""WITH RECURSIVE s AS (SELECT DISTINCT role, {_SEED} AS h, 0 AS i FROM agent_pheromone WHERE role IS NOT NULL UNION ALL SELECT role, {_STEP}, i + 1 FROM s WHERE i < 8)"""


@query("txt_lcg_matrix", _LCG + " SELECT role, i AS pos, round((h / 4294967295.0 * 2 - 1) * 0.01, 6) AS v FROM s WHERE i > 0")
def _lcg(t: Tables):
    roles = t.agent_pheromone.where("role IS NOT NULL").select("role").distinct()
    return roles.select("role", F.posexplode(weights(F.col("role"), 8)).alias("p", "v")).select("role", (F.col("p") + 1).alias("pos"), r6("v").alias("v"))


@query("txt_lcg_scales", _LCG + " SELECT role, i AS pos, round(h / 4294967295.0 * 0.5 + 0.75, 6) AS v FROM s WHERE i > 0")
def _scales(t: Tables):
    roles = t.agent_pheromone.where("role IS NOT NULL").select("role").distinct()
    return roles.select("role", F.posexplode(scales(F.col("role"), 8)).alias("p", "v")).select("role", (F.col("p") + 1).alias("pos"), r6("v").alias("v"))


@query("txt_codemod_match", f"""WITH {PATCHES} SELECT pr_file_id, CASE WHEN regexp_matches(patch, '\\bvar\\s+\\w+\\s*=') THEN 'const-conversion' WHEN regexp_matches(patch, 'console\\.(log|warn|error|info|debug)\\(') THEN 'remove-console'
    WHEN regexp_matches(patch, '(?m)^import .*\\n(.*\\n)*?import ') THEN 'sort-imports' WHEN regexp_matches(patch, '//\\s*(TODO|FIXME)') THEN 'add-ticket-to-todo' END AS codemod FROM patches""")  # fmt: skip
def _match(t: Tables):
    return t.patches.select("pr_file_id", x.match_codemod(F.col("patch")).alias("codemod"))


@query("txt_cm_const", f"WITH {PATCHES} SELECT pr_file_id, md5(regexp_replace(patch, '\\bvar\\s+(\\w+)\\s*=', 'const \\1 =', 'g')) AS h FROM patches WHERE patch IS NOT NULL")
def _const(t: Tables):
    return t.patches.where("patch IS NOT NULL").select("pr_file_id", F.md5(x.var_to_const(F.col("patch"))).alias("h"))


@query("txt_cm_console", "SELECT doc_id, md5(regexp_replace(text, 'console\\.(log|warn|error|info|debug)\\([^)]*\\);?\\n?', '', 'g')) AS h FROM documents WHERE text IS NOT NULL")
def _console(t: Tables):
    return t.documents.where("text IS NOT NULL").select("doc_id", F.md5(x.drop_console(F.col("text"))).alias("h"))


@query("txt_cm_imports", """SELECT doc_id, md5(CASE WHEN len(i) > 0 THEN array_to_string(list_concat(list_concat(i, ['']), r), chr(10)) ELSE text END) AS h FROM (
    SELECT doc_id, text, list_sort(list_distinct(list_filter(string_split(text, chr(10)), lambda s: starts_with(ltrim(s), 'import ')))) AS i, list_filter(string_split(text, chr(10)), lambda s: NOT starts_with(ltrim(s), 'import ')) AS r FROM documents WHERE text IS NOT NULL)""")  # fmt: skip
def _imports(t: Tables):
    return t.documents.where("text IS NOT NULL").select("doc_id", F.md5(x.sort_imports(F.col("text"))).alias("h"))


@query("txt_cm_todo", "SELECT doc_id, md5(regexp_replace(text, '(?m)//\\s*(TODO|FIXME):?[ \\t]*(.*)$', '// \\1: [AUTO-TICKET] \\2', 'g')) AS h FROM documents WHERE text IS NOT NULL")
def _todo(t: Tables):
    return t.documents.where("text IS NOT NULL").select("doc_id", F.md5(x.ticket_todos(F.col("text"))).alias("h"))


@query("txt_line_diff", """WITH t AS (SELECT a.doc_id, string_split(coalesce(a.text, ''), chr(10)) AS a, string_split(coalesce(b.text, ''), chr(10)) AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
    h AS (SELECT *, least(len(a), len(b)) AS m, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i]), true) - 1, least(len(a), len(b)))::INT AS first,
        coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[-i] <> b[-i]), true) - 1, least(len(a), len(b))) AS tail FROM t),
    e AS (SELECT doc_id, first, (len(a) - least(tail, m - first) - 1)::INT AS old_last, (len(b) - least(tail, m - first) - 1)::INT AS new_last FROM h)
    SELECT doc_id, CASE WHEN old_last < first AND new_last < first THEN 'none' WHEN old_last < first THEN 'added' WHEN new_last < first THEN 'deleted' ELSE 'modified' END AS kind, first, old_last, new_last FROM e""")  # fmt: skip
def _diff(t: Tables):
    """Lines that differ between a document and the next one."""
    nxt = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("newer"))
    return t.documents.join(nxt, "doc_id").select("doc_id", x.diff_range(F.col("text"), F.col("newer")).alias("d")).select("doc_id", "d.*")


@query("txt_loc", """SELECT doc_id, len(l) - len(list_filter(l, lambda s: s = '' OR starts_with(s, '//') OR starts_with(s, '/*'))) AS code, len(list_filter(l, lambda s: starts_with(s, '//') OR starts_with(s, '/*'))) AS comments, len(list_filter(l, lambda s: s = '')) AS blank
    FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS l FROM documents WHERE text IS NOT NULL)""")  # fmt: skip
def _loc(t: Tables):
    return t.documents.where("text IS NOT NULL").select("doc_id", x.line_counts(F.col("text")).alias("c")).select("doc_id", "c.*")


@query("txt_substr_flags", "SELECT count_if(contains(text, 'cache')) AS cache, count_if(contains(text, 'validate')) AS validate, count_if(regexp_matches(text, 'crypto|encrypt|hash')) AS crypto, count_if(contains(text, 'WeakMap')) AS weak FROM documents")
def _flags(t: Tables):
    c = F.col("text")
    return t.documents.agg(F.count_if(c.contains("cache")).alias("cache"), F.count_if(c.contains("validate")).alias("validate"), F.count_if(c.rlike("crypto|encrypt|hash")).alias("crypto"), F.count_if(c.contains("WeakMap")).alias("weak"))


#: The eight patterns, as SQL.
_UNSAFE = [(n, p.replace("'", "''")) for n, p in x.UNSAFE]
_LOST = " + ".join(f"(CASE WHEN regexp_matches(patch, '{p}') THEN {n} ELSE 0 END)" for n, p in _UNSAFE)
_ISSUES = " + ".join(f"coalesce(regexp_matches(patch, '{p}'), false)::INT" for _, p in _UNSAFE)


@query("txt_secrets", f"WITH {PATCHES} SELECT pr_file_id, {_LOST} AS lost, greatest(0, 100 - ({_LOST})) AS score FROM patches WHERE patch IS NOT NULL")
def _secrets(t: Tables):
    """Points that a patch loses, and the security score left."""
    lost = x.code_findings(F.col("patch"))
    return t.patches.where("patch IS NOT NULL").select("pr_file_id", lost.alias("lost"), F.greatest(F.lit(0), 100 - lost).alias("score"))


@query("txt_switches", "SELECT doc_id, len(regexp_extract_all(text, 'switch\\s*\\([^)]+\\)')) AS n FROM documents WHERE text IS NOT NULL")
def _switches(t: Tables):
    return t.documents.where("text IS NOT NULL").select("doc_id", F.regexp_count("text", F.lit(r"switch\s*\([^)]+\)")).alias("n"))


@query("txt_module", f"WITH {FILES} SELECT repo, file, CASE WHEN len(string_split(file, '/')) > 1 THEN string_split(file, '/')[-2] ELSE 'root' END AS module FROM files")
def _module(t: Tables):
    return t.files.select("repo", "file", x.module_of(F.col("file")).alias("module"))


@query("agg_distinct_modules", f"WITH {FILES} SELECT repo, count(DISTINCT CASE WHEN len(string_split(file, '/')) > 1 THEN string_split(file, '/')[-2] ELSE 'root' END) AS n FROM files GROUP BY 1")
def _modules(t: Tables):
    return t.files.groupBy("repo").agg(F.countDistinct(x.module_of(F.col("file"))).alias("n"))


@query("txt_adr_id", "SELECT pr_id, 'ADR-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS adr FROM (SELECT pr_id, row_number() OVER (ORDER BY created_at, pr_id) AS n FROM pull_request)")
def _adr(t: Tables):
    return in_order(t.pull_request.select("pr_id", "created_at"), ["created_at", "pr_id"], "n").select("pr_id", F.format_string("ADR-%03d", F.col("n") + 1).alias("adr"))


@query("txt_effort", "SELECT pr_id, CASE WHEN h < 8 THEN ceil(h)::INT || ' hours' WHEN h < 40 THEN ceil(h / 8)::INT || ' days' ELSE ceil(h / 40)::INT || ' weeks' END AS effort FROM (SELECT pr_id, count(DISTINCT filename) * 2.0 * 3 AS h FROM pr_file GROUP BY 1)")
def _effort(t: Tables):
    n = t.pr_file.groupBy("pr_id").agg(F.countDistinct("filename").alias("n"))
    return n.select("pr_id", x.effort(F.col("n").cast("double"), F.lit(3)).alias("effort"))


@query("txt_title_steps", "SELECT l_orderkey, array_to_string(list_distinct_ordered, ' + ') || ' Strategy' AS title FROM (SELECT l_orderkey, list(w ORDER BY i, w) AS list_distinct_ordered FROM (SELECT l_orderkey, l_returnflag AS w, min(l_linenumber) AS i FROM lineitem GROUP BY 1, 2) GROUP BY 1)")
def _title(t: Tables):
    rows = t.lineitem.groupBy("l_orderkey", F.col("l_returnflag").alias("w")).agg(F.min("l_linenumber").alias("i")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("l"))
    return rows.select("l_orderkey", x.title_of_steps(F.transform("l", lambda e: F.concat(e["w"], F.lit("_step")))).alias("title"))


@query("txt_desc_steps", "SELECT o_orderkey, 'Steps: ' || o_orderstatus || ' → ' || o_orderpriority || '. Reward: ' || printf('%.2f', round(o_totalprice, 2)) AS description FROM orders")
def _desc(t: Tables):
    return t.orders.select("o_orderkey", x.describe_steps(F.array("o_orderstatus", "o_orderpriority"), F.round("o_totalprice", 2)).alias("description"))


@query("txt_template", "SELECT pr_id, replace(replace('{{who}}: {{what}} {{rest}}', '{{who}}', coalesce(author, '')), '{{what}}', coalesce(title, 'untitled')) AS line FROM pull_request")
def _template(t: Tables):
    values = F.create_map(F.lit("who"), F.coalesce("author", F.lit("")))
    return t.pull_request.select("pr_id", x.render(F.lit("{{who}}: {{what}} {{rest}}"), values, F.create_map(F.lit("what"), F.coalesce("title", F.lit("untitled")))).alias("line"))


@query("txt_sha256", "SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL")
def _sha(t: Tables):
    return t.documents.where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))


@query("misc_snippet", f"WITH {PATCHES} SELECT pr_file_id, md5(array_to_string(string_split(patch, chr(10))[2:5], chr(10))) AS h FROM patches WHERE patch IS NOT NULL")
def _snippet(t: Tables):
    return t.patches.where("patch IS NOT NULL").select("pr_file_id", F.md5(x.snippet(F.col("patch"), 2, 5)).alias("h"))
