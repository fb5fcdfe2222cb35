"""The catalogue of servers and tools, configuration, and small views."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import catalogue, routing
from lodestone.queries.base import MEMORY, PATCHES, Tables, query, r6


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SERVERS = "servers(name, tier, tags, capabilities, destructive, per_minute, burst) AS (VALUES " + ", ".join(f"('{n}', {t}, {_list(g)}, {_list(c)}, {str(d).lower()}, {r}, {b})" for n, t, g, c, d, r, b in catalogue.SERVERS) + ")"
_TOOLS = "tools(server, tool, ord, tier, capabilities, destructive) AS (VALUES " + ", ".join(f"('{s}', '{n}', {i}, {t}, {_list(c)}, {str(d).lower()})" for i, (s, n, t, c, d) in enumerate(catalogue.TOOLS)) + ")"
_NEW = "new(name, tier, tags, capabilities, destructive, per_minute, burst) AS (VALUES ('business-crm', 1, ['crm'], ['read'], false, 5, 1), ('docs', 1, ['text'], ['read'], false, 100, 20))"


@query("misc_catalogue", f"WITH {_SERVERS}, {_TOOLS} SELECT s.name, s.per_minute, t.tool, t.tier, t.capabilities, t.destructive FROM servers s JOIN tools t ON t.server = s.name")
def _catalogue(t: Tables):
    s = catalogue.servers(t.spark).select("name", "per_minute")
    return s.join(catalogue.tools(t.spark), F.col("server") == F.col("name")).select("name", "per_minute", "tool", "tier", "capabilities", "destructive")


@query("src_registry", f"WITH {_SERVERS}, {_NEW} SELECT name, tier, capabilities FROM servers WHERE name NOT IN (SELECT name FROM new) UNION ALL SELECT name, tier, capabilities FROM new")
def _register(t: Tables):
    """Two servers registered, one of them under a name that is taken."""
    new = t.spark.createDataFrame([("business-crm", 1, ["crm"], ["read"], False, 5, 1), ("docs", 1, ["text"], ["read"], False, 100, 20)], catalogue.servers(t.spark).schema)
    return catalogue.register(catalogue.servers(t.spark), new).select("name", "tier", "capabilities")


@query("flt_server_by_name", f"WITH {_SERVERS} SELECT name, tier, tags FROM servers WHERE name = 'business-payments'")
def _by_name(t: Tables):
    return catalogue.servers(t.spark).where("name = 'business-payments'").select("name", "tier", "tags")


@query("flt_by_cap", f"WITH {_SERVERS} SELECT name FROM servers WHERE list_contains(capabilities, 'payment')")
def _by_cap(t: Tables):
    return catalogue.with_capability(catalogue.servers(t.spark), "payment").select("name")


@query("flt_by_tier", f"WITH {_SERVERS} SELECT name, tier FROM servers WHERE tier <= 2")
def _by_tier(t: Tables):
    return catalogue.up_to_tier(catalogue.servers(t.spark), 2).select("name", "tier")


@query("join_pattern_tool", f"""WITH {MEMORY}, {_TOOLS}, s AS (SELECT m.id, t.tool, t.ord, len(list_filter(string_split_regex(lower(coalesce(m.content, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: list_contains(string_split(t.tool, '_'), w))) AS hits, t.tier, t.destructive FROM memory m, tools t)
    SELECT id, min_by(tool, (-(hits + (4 - tier) * 0.5 + CASE WHEN destructive THEN 0 ELSE 1 END), ord)) AS tool, max(hits + (4 - tier) * 0.5 + CASE WHEN destructive THEN 0 ELSE 1 END)::DOUBLE AS score FROM s GROUP BY 1""")  # fmt: skip
def _pattern_tool(t: Tables):
    """The best of the 18 tools for every pattern, by the words of their names."""
    tools = catalogue.tools(t.spark).select("tool", "ord", catalogue.words_of(F.col("tool")).alias("words"), "tier", "destructive")
    return routing.rank_tools(t.memory.select(F.col("id").alias("task_id"), F.col("content").alias("text")), tools).withColumnRenamed("task_id", "id")


@query("wf_route_tool", f"""WITH {MEMORY}, {_TOOLS}, best AS (SELECT metadata.domain AS domain, max(reward) AS r, min_by(id, (-reward, id)) AS pattern FROM memory WHERE reward > 0.85 GROUP BY 1),
    s AS (SELECT m.id, t.tool, t.ord, len(list_filter(string_split_regex(lower(coalesce(m.content, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: list_contains(string_split(t.tool, '_'), w))) + (4 - t.tier) * 0.5 + CASE WHEN t.destructive THEN 0 ELSE 1 END AS s FROM memory m, tools t),
    g AS (SELECT id, min_by(tool, (-s, ord)) AS tool FROM s GROUP BY 1),
    c AS (SELECT id, CASE WHEN regexp_matches(content, '\\bvar\\s+\\w+\\s*=') THEN 'const-conversion' WHEN regexp_matches(content, 'console\\.(log|warn|error|info|debug)\\(') THEN 'remove-console'
        WHEN regexp_matches(content, '(?m)^import .*\\n(.*\\n)*?import ') THEN 'sort-imports' WHEN regexp_matches(content, '//\\s*(TODO|FIXME)') THEN 'add-ticket-to-todo' END AS codemod, metadata.domain AS domain FROM memory)
    SELECT c.id, CASE WHEN codemod IS NOT NULL THEN 1 WHEN r IS NOT NULL THEN 2 ELSE 3 END AS tier, coalesce(codemod, pattern, tool) AS chosen FROM c LEFT JOIN best USING (domain) JOIN g ON g.id = c.id""")  # fmt: skip
def _route(t: Tables):
    """A rewrite where the text calls for one, else the best pattern of the domain above 0.85, else the best tool."""
    from lodestone.functions.text import match_codemod

    best = t.memory.where("reward > 0.85").groupBy(F.col("metadata.domain").alias("domain")).agg(F.max("reward").alias("r"), F.min_by("id", F.struct((-F.col("reward")).alias("a"), F.col("id").alias("b"))).alias("pattern"))
    tools = _pattern_tool(t).select("id", "tool")
    rows = t.memory.select("id", match_codemod(F.col("content")).alias("codemod"), F.col("metadata.domain").alias("domain")).join(best, "domain", "left").join(tools, "id")
    tier = F.when(F.col("codemod").isNotNull(), 1).when(F.col("r").isNotNull(), 2).otherwise(3)
    return rows.select("id", tier.alias("tier"), F.coalesce("codemod", "pattern", "tool").alias("chosen"))


@query("flt_running", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O'")
def _running(t: Tables):
    return t.orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate")


@query("flt_adr_proposed", f"WITH {MEMORY} SELECT id, created_at FROM memory WHERE NOT consolidated")
def _proposed(t: Tables):
    """Records not accepted yet."""
    return t.memory.where("NOT consolidated").select("id", "created_at")


@query("flt_accepted", f"WITH {MEMORY} SELECT id, created_at FROM memory WHERE consolidated")
def _accepted(t: Tables):
    return t.memory.where("consolidated").select("id", "created_at")


_DEFAULTS = {"alpha": 0.3, "theta": 0.6, "warm_up": 3.0, "max_agents": 50.0}


@query("misc_config_merge", "SELECT d.key, coalesce(u.value, d.value)::DOUBLE AS value, u.value IS NOT NULL AS changed FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _DEFAULTS.items()) + ") d(key, value) LEFT JOIN (SELECT 'max_agents' AS key, count(*) AS value FROM agent_pheromone) u USING (key)")
def _merge(t: Tables):
    """Defaults with one setting overridden, by the number of agents."""
    defaults = t.spark.createDataFrame(list(_DEFAULTS.items()), "key string, value double")
    changes = t.agent_pheromone.agg(F.count(F.lit(1)).cast("double").alias("new")).select(F.lit("max_agents").alias("key"), "new")
    return defaults.join(changes, "key", "left").select("key", F.coalesce("new", "value").alias("value"), F.col("new").isNotNull().alias("changed"))


@query("misc_reset", "SELECT agent_id, ema_score FROM agent_pheromone WHERE false")
def _reset(t: Tables):
    """All agents forgotten: their table's columns, without rows."""
    return t.agent_pheromone.where(F.lit(False)).select("agent_id", "ema_score")


@query("misc_cow_files", f"WITH {PATCHES} SELECT pr_id, list(DISTINCT filename ORDER BY filename) AS files FROM patches WHERE contains(filename, '.cow') GROUP BY 1")
def _cow(t: Tables):
    """Changes that touch files with a mark in their name, and those files."""
    return t.patches.where(F.contains("filename", F.lit(".cow"))).groupBy("pr_id").agg(F.array_sort(F.collect_set("filename")).alias("files"))


@query("agg_correctness", "SELECT role, sum(ok) / nullif(sum(n), 0) AS correctness FROM (SELECT a.role, count_if(u.success) AS ok, count(u.success) AS n FROM agent_pheromone a LEFT JOIN (SELECT DISTINCT update_id, agent_id, success FROM pheromone_update) u USING (agent_id) GROUP BY 1) GROUP BY 1")
def _correct(t: Tables):
    """Passed over all outcomes of a role's agents; null without any."""
    return _suites(t).select("role", F.try_divide(F.col("ok").cast("double"), F.nullif("n", F.lit(0))).alias("correctness"))


def _suites(t: Tables):
    """Outcomes by role: passed, all, and the mean of the consensus, which stands for coverage."""
    outcomes = t.pheromone_update.select("update_id", "agent_id", "success", "consensus_score").distinct()
    both = t.agent_pheromone.select("agent_id", "role").join(outcomes, "agent_id", "left")
    return both.groupBy("role").agg(F.count_if("success").alias("ok"), F.count("success").alias("n"), F.avg("consensus_score").alias("coverage"))


_SUITES = "suites AS (SELECT a.role, count_if(u.success) AS ok, count(u.success) AS n, avg(u.consensus_score) AS coverage FROM agent_pheromone a LEFT JOIN (SELECT DISTINCT update_id, agent_id, success, consensus_score FROM pheromone_update) u USING (agent_id) GROUP BY 1)"


@query("agg_quality", f"WITH {_SUITES} SELECT role, round(0.7 * ok / nullif(n, 0) + 0.3 * coverage, 6) AS quality FROM suites")
def _quality(t: Tables):
    passed = F.try_divide(F.col("ok").cast("double"), F.nullif("n", F.lit(0)))
    return _suites(t).select("role", r6(0.7 * passed + 0.3 * F.col("coverage")).alias("quality"))


# fixed values: weight and least value of the criteria
CRITERIA = {"performance": (0.3, 0.9), "quality": (0.25, 0.85), "security": (0.2, 0.95), "regression": (0.15, 0.9), "correctness": (0.1, 0.99)}


@query("agg_flywheel", f"""WITH {_SUITES}, bench AS (SELECT avg((p50_latency_ms <= 100)::INT) AS performance FROM (SELECT DISTINCT run_id, p50_latency_ms FROM benchmark_result)),
    v AS (SELECT role, performance, 0.7 * ok / n + 0.3 * coverage AS quality, 1.0 AS security, 1.0 AS regression, ok / n AS correctness FROM suites, bench WHERE n > 0)
    SELECT role, round(0.3 * performance + 0.25 * quality + 0.2 * security + 0.15 * regression + 0.1 * correctness, 6)::DOUBLE AS score,
        performance >= 0.9 AND quality >= 0.85 AND correctness >= 0.99 AND 0.3 * performance + 0.25 * quality + 0.2 * security + 0.15 * regression + 0.1 * correctness >= 0.85 AS passed FROM v""")  # fmt: skip
def _flywheel(t: Tables):
    """A role's agents as a candidate: five criteria, their weighted mean, and whether all are met with 0.85 in all; without audits security and regression are 1."""
    runs = t.benchmark_result.select("run_id", "p50_latency_ms").distinct().agg(F.avg((F.col("p50_latency_ms") <= 100).cast("int")).alias("performance"))
    s = _suites(t).where("n > 0").crossJoin(F.broadcast(runs))  # one row
    share = F.col("ok") / F.col("n")
    s = s.select("role", "performance", (0.7 * share + 0.3 * F.col("coverage")).alias("quality"), F.lit(1.0).alias("security"), F.lit(1.0).alias("regression"), share.alias("correctness"))
    return routing.weigh(s, "role", CRITERIA, 0.85).withColumn("score", r6("score"))
