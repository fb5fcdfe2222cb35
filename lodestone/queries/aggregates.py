"""Aggregations, statistics, routing and learning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import numbers as n
from lodestone.operators import folds, learning, routing
from lodestone.queries.base import FILES, MEMORY, UPDATES, Tables, query, r6

# -- aggregations ------------------------------------------------------------------------------------


@query("agg_file_means", f"WITH {FILES} SELECT repo, count(*) AS n, round(avg(metrics.cyclomatic_complexity), 6) AS cc, round(avg(metrics.cognitive_complexity), 6) AS cognitive, round(sum(metrics.maintainability_index), 3) AS mi_sum FROM files GROUP BY 1")
def _means(t: Tables):
    avg = lambda c: r6(F.avg(f"metrics.{c}"))
    return t.files.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), avg("cyclomatic_complexity").alias("cc"), avg("cognitive_complexity").alias("cognitive"), F.round(F.sum("metrics.maintainability_index"), 3).alias("mi_sum"))


@query("agg_flag_score", "SELECT lane, least(100, greatest(0, 50 + 2 * count_if(contains(text, 'cache')) - count_if(contains(text, 'TODO'))))::BIGINT AS score FROM documents GROUP BY 1")
def _flag(t: Tables):
    score = 50 + 2 * F.count_if(F.contains("text", F.lit("cache"))) - F.count_if(F.contains("text", F.lit("TODO")))
    return t.documents.groupBy("lane").agg(F.least(F.lit(100), F.greatest(F.lit(0), score)).cast("bigint").alias("score"))


@query("agg_tpl_by_category", "SELECT lang, list(DISTINCT source ORDER BY source) AS sources FROM documents WHERE source IS NOT NULL GROUP BY 1")
def _category(t: Tables):
    return t.documents.where("source IS NOT NULL").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))


@query("agg_global_ema", "SELECT round(avg(CASE WHEN sample_count >= 3 THEN ema_score END), 6) AS mean, round(coalesce(avg(CASE WHEN sample_count >= 3 THEN ema_score END), 0.5) * 0.6, 6) AS threshold FROM agent_pheromone")
def _global(t: Tables):
    mean = F.avg(F.when(F.col("sample_count") >= 3, F.col("ema_score")))
    return t.agent_pheromone.agg(r6(mean).alias("mean"), r6(F.coalesce(mean, F.lit(0.5)) * folds.THETA).alias("threshold"))


@query("agg_swarm_status", "SELECT count(*) AS agents, count_if(eligible) AS eligible, count_if(suspension_count > 0) AS suspended, round(count_if(eligible)::DOUBLE / greatest(1, count(*)), 6) AS share FROM agent_pheromone")
def _status(t: Tables):
    e = F.count_if("eligible")
    return t.agent_pheromone.agg(F.count(F.lit(1)).alias("agents"), e.alias("eligible"), F.count_if(F.col("suspension_count") > 0).alias("suspended"), r6(e / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("share"))


@query("agg_pher_metrics", "SELECT least(floor(ema_score * 10), 9)::INT AS bucket, count(*) AS n FROM agent_pheromone WHERE ema_score IS NOT NULL GROUP BY 1")
def _histogram(t: Tables):
    return t.agent_pheromone.where("ema_score IS NOT NULL").groupBy(F.least(F.floor(F.col("ema_score") * 10), F.lit(9)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_exec_metrics", f"WITH {UPDATES} SELECT date_trunc('day', ts) AS day, count_if(success) AS done, count_if(NOT success) AS failed, sum(tool_calls)::BIGINT AS calls, count(DISTINCT agent_id) AS agents FROM updates GROUP BY 1")
def _exec(t: Tables):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    return t.updates.groupBy(day).agg(F.count_if("success").alias("done"), F.count_if(~F.col("success")).alias("failed"), F.sum("tool_calls").alias("calls"), F.countDistinct("agent_id").alias("agents"))


@query("agg_bench_pass", "SELECT name, round(avg((p50_latency_ms <= 100)::INT), 6) AS passed, count(*) AS n FROM (SELECT DISTINCT run_id, name, p50_latency_ms FROM benchmark_result) GROUP BY 1")
def _pass(t: Tables):
    runs = t.benchmark_result.select("run_id", "name", "p50_latency_ms").distinct()
    return runs.groupBy("name").agg(r6(F.avg((F.col("p50_latency_ms") <= 100).cast("int"))).alias("passed"), F.count(F.lit(1)).alias("n"))


@query("agg_order_total", "SELECT l_orderkey, round(sum(l_quantity * l_extendedprice), 4) AS total FROM lineitem GROUP BY 1")
def _total(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), 4).alias("total"))


@query("agg_revenue_day", "SELECT date_trunc('day', o_orderdate) AS day, round(sum(o_totalprice), 4) AS revenue, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def _revenue(t: Tables):
    day = F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day")
    return t.orders.where("o_orderstatus <> 'P'").groupBy(day).agg(F.round(F.sum("o_totalprice"), 4).alias("revenue"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("day"))


@query("agg_conversion", "SELECT date_trunc('month', ts) AS month, round(count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END)::DOUBLE / nullif(count(DISTINCT user_id), 0), 6) AS rate FROM events GROUP BY 1")
def _conversion(t: Tables):
    month = F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")
    got = t.events.groupBy(month).agg(F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("a"), F.countDistinct("user_id").alias("b"))
    return got.select("month", r6(F.try_divide(F.col("a").cast("double"), F.nullif("b", F.lit(0)))).alias("rate"))


@query("agg_aov", "SELECT c_mktsegment, round(avg(o_totalprice), 4) AS aov, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def _aov(t: Tables):
    j = t.orders.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").agg(F.round(F.avg("o_totalprice"), 4).alias("aov"), F.count(F.lit(1)).alias("n"))


@query("agg_retention", f"WITH {MEMORY} SELECT id FROM memory WHERE NOT (updated_at < TIMESTAMP '2025-02-01' AND access_count < 2 AND NOT consolidated)")
def _retention(t: Tables):
    old = (F.col("updated_at") < F.expr("TIMESTAMP_NTZ '2025-02-01'")) & (F.col("access_count") < 2) & ~F.col("consolidated")
    return t.memory.where(~old).select("id")


@query("agg_reg_report", """WITH v AS (SELECT name, avg(CASE WHEN ts < TIMESTAMP '2025-03-01' THEN avg_latency_ms END) AS b, avg(CASE WHEN ts >= TIMESTAMP '2025-03-01' THEN avg_latency_ms END) AS c FROM (SELECT DISTINCT run_id, name, ts, avg_latency_ms FROM benchmark_result WHERE isfinite(avg_latency_ms)) GROUP BY 1),
    d AS (SELECT name, (c - b) / nullif(b, 0) * 100 AS d FROM v) SELECT count_if(d >= 5) AS regressed, count_if(d <= -5) AS improved, count_if(abs(d) < 5) AS stable FROM d""")  # fmt: skip
def _report(t: Tables):
    d = F.col("delta")
    return deltas(t).agg(F.count_if(d >= 5).alias("regressed"), F.count_if(d <= -5).alias("improved"), F.count_if(F.abs(d) < 5).alias("stable"))


def deltas(t: Tables):
    """Change in percent of every benchmark's mean latency from before March on, lower being better."""
    v = F.col("avg_latency_ms")
    runs = t.benchmark_result.select("run_id", "name", "ts", "avg_latency_ms").distinct().where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    early = F.col("ts") < F.expr("TIMESTAMP_NTZ '2025-03-01'")
    got = runs.groupBy("name").agg(F.avg(F.when(early, v)).alias("b"), F.avg(F.when(~early, v)).alias("c"))
    return got.select("name", n.percent_delta(F.col("b"), F.col("c")).alias("delta"))


@query("num_delta", """WITH v AS (SELECT name, avg(CASE WHEN ts < TIMESTAMP '2025-03-01' THEN avg_latency_ms END) AS b, avg(CASE WHEN ts >= TIMESTAMP '2025-03-01' THEN avg_latency_ms END) AS c FROM (SELECT DISTINCT run_id, name, ts, avg_latency_ms FROM benchmark_result WHERE isfinite(avg_latency_ms)) GROUP BY 1),
    d AS (SELECT name, (c - b) / nullif(b, 0) * 100 AS d FROM v) SELECT name, round(d, 6) AS delta, CASE WHEN d >= 10 THEN 'critical' WHEN d >= 5 THEN 'warning' END AS severity FROM d""")  # fmt: skip
def _delta(t: Tables):
    return deltas(t).select("name", r6("delta").alias("delta"), n.severity(F.col("delta"), F.lit(True)).alias("severity"))




# -- statistics --------------------------------------------------------------------------------------

_CDF = "(CASE WHEN x > 0 THEN 1 - tail ELSE tail END)"
_AB = """v AS (SELECT user_id % 2 AS variant, avg((event_type = 'purchase')::INT) AS rate, count(*) AS n FROM events GROUP BY 1),
    ab AS (SELECT a.rate AS a, b.rate AS b, a.n + b.n AS n FROM v a, v b WHERE a.variant = 0 AND b.variant = 1),
    z AS (SELECT *, abs(b - a) / nullif(sqrt((a + b) / 2 * (1 - (a + b) / 2) * 2 / n), 0) AS x FROM ab),
    t AS (SELECT *, 1 / (1 + 0.2316419 * abs(x)) AS t FROM z),
    p AS (SELECT *, 0.3989422804014327 * exp(-x * x / 2) * ((((1.330274429 * t - 1.821255978) * t + 1.781477937) * t - 0.356563782) * t + 0.319381530) * t AS tail FROM t)"""


def variants(t: Tables):
    got = t.events.groupBy((F.col("user_id") % 2).alias("variant")).agg(F.avg((F.col("event_type") == "purchase").cast("int")).alias("rate"), F.count(F.lit(1)).alias("n"))
    pick = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    return got.agg(pick(0, "rate").alias("a"), pick(1, "rate").alias("b"), F.sum("n").alias("n"))


@query("num_z_test", f"WITH {_AB} SELECT round(x, 6) AS z, round(2 * (1 - {_CDF}), 6) AS p FROM p")
def _z(t: Tables):
    return variants(t).select(n.two_proportion_z(F.col("a"), F.col("b"), F.col("n")).alias("z0")).select(r6("z0").alias("z"), r6(n.two_sided_p(F.col("z0"))).alias("p"))


@query("num_ci95", f"WITH {_AB} SELECT round(b - a - 1.96 * sqrt((a * (1 - a) + b * (1 - b)) / n), 6) AS lo, round(b - a + 1.96 * sqrt((a * (1 - a) + b * (1 - b)) / n), 6) AS hi FROM ab")
def _ci(t: Tables):
    return variants(t).select(n.ci95(F.col("a"), F.col("b"), F.col("n")).alias("c")).select(r6("c.lo").alias("lo"), r6("c.hi").alias("hi"))


@query("num_winner", f"WITH {_AB} SELECT CASE WHEN 2 * (1 - {_CDF}) < 0.05 THEN CASE WHEN b > a THEN 'B' ELSE 'A' END END AS winner FROM p")
def _winner(t: Tables):
    p = n.two_sided_p(n.two_proportion_z(F.col("a"), F.col("b"), F.col("n")))
    return variants(t).select(F.when(p < 0.05, F.when(F.col("b") > F.col("a"), "B").otherwise("A")).alias("winner"))


@query("num_guardrail", "WITH v AS (SELECT user_id % 2 AS variant, avg((event_type = 'error')::INT) AS rate FROM events GROUP BY 1) SELECT bool_and(rate <= (SELECT rate * 1.05 FROM v WHERE variant = 0)) AS ok FROM v")
def _guard(t: Tables):
    got = t.events.groupBy((F.col("user_id") % 2).alias("variant")).agg(F.avg((F.col("event_type") == "error").cast("int")).alias("rate"))
    most = got.where("variant = 0").select(F.col("rate") * 1.05).scalar()
    return got.select((F.col("rate") <= most).alias("kept")).agg(F.bool_and("kept").alias("ok"))


@query("num_normal_cdf", "WITH z AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity - 25) / 10 AS x FROM lineitem), t AS (SELECT *, 1 / (1 + 0.2316419 * abs(x)) AS t FROM z), p AS (SELECT *, 0.3989422804014327 * exp(-x * x / 2) * ((((1.330274429 * t - 1.821255978) * t + 1.781477937) * t - 0.356563782) * t + 0.319381530) * t AS tail FROM t) SELECT DISTINCT x, round(" + _CDF + ", 6) AS p FROM p")
def _cdf(t: Tables):
    return t.lineitem.select(((F.col("l_quantity") - 25) / 10).alias("x")).distinct().select("x", r6(n.normal_cdf(F.col("x"))).alias("p"))


@query("num_bench_delta", "SELECT run_id, round((p99_latency_ms - p95_latency_ms) / nullif(p95_latency_ms, 0) * 100, 6) AS delta FROM (SELECT DISTINCT run_id, p95_latency_ms, p99_latency_ms FROM benchmark_result WHERE isfinite(p95_latency_ms) AND p95_latency_ms > 0 AND isfinite(p99_latency_ms))")
def _bench(t: Tables):
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    runs = t.benchmark_result.select("run_id", "p95_latency_ms", "p99_latency_ms").distinct().where(ok("p95_latency_ms") & ok("p99_latency_ms") & (F.col("p95_latency_ms") > 0))
    return runs.select("run_id", r6(n.percent_delta(F.col("p95_latency_ms"), F.col("p99_latency_ms"))).alias("delta"))


@query("num_mi", f"WITH {FILES} SELECT repo, file, round(CASE WHEN metrics.halstead_volume > 0 AND metrics.lines_of_code > 0 THEN greatest(0, 171 - 5.2 * ln(metrics.halstead_volume) - 0.23 * metrics.cyclomatic_complexity - 16.2 * ln(metrics.lines_of_code)) END, 6) AS mi FROM files")
def _mi(t: Tables):
    c = lambda x: F.col(f"metrics.{x}").cast("double")
    return t.files.select("repo", "file", r6(n.maintainability(c("lines_of_code"), c("cyclomatic_complexity"), c("halstead_volume"))).alias("mi"))


@query("num_backoff", "SELECT agent_id, least(1000 * pow(2, recovery_attempts), 30000) AS exponential, least(1000.0 * (recovery_attempts + 1), 30000)::DOUBLE AS linear, 1000.0::DOUBLE AS fixed FROM agent_pheromone")
def _backoff(t: Tables):
    a = F.col("recovery_attempts").cast("double")
    wait = lambda kind: n.backoff(a, F.lit(kind), 1000.0, 30000.0).alias(kind)
    return t.agent_pheromone.select("agent_id", wait("exponential"), wait("linear"), wait("fixed"))


@query("num_softmax", f"WITH {MEMORY}, s AS (SELECT id, [tier::DOUBLE, coalesce(reward, 0), access_count / 10.0] AS s FROM memory) SELECT id, list_transform(s, lambda x: round(exp(x - list_max(s)) / list_sum(list_transform(s, lambda y: exp(y - list_max(s)))), 6)) AS p FROM s")
def _softmax(t: Tables):
    s = F.array(F.col("tier").cast("double"), F.coalesce("reward", F.lit(0.0)), F.col("access_count") / 10.0)
    return t.memory.select("id", s.alias("s")).select("id", F.transform(n.softmax(F.col("s")), lambda x: F.round(x, 6)).alias("p"))


@query("num_zpenalty", f"WITH {MEMORY}, s AS (SELECT id, [tier::DOUBLE, coalesce(reward, 0), access_count / 10.0] AS s FROM memory), d AS (SELECT *, list_avg(s) AS a, list_stddev_pop(s) AS d FROM s) SELECT id, list_transform(s, lambda x: round(x - 0.1 * (x - a) / (d + 1e-8), 6)) AS p FROM d")
def _penalty(t: Tables):
    s = F.array(F.col("tier").cast("double"), F.coalesce("reward", F.lit(0.0)), F.col("access_count") / 10.0)
    return t.memory.select("id", s.alias("s")).select("id", F.transform(n.spread_penalty(F.col("s")), lambda x: F.round(x, 6)).alias("p"))


# -- routing -----------------------------------------------------------------------------------------

_SPECS = ", ".join(f"({i}, {list(w)})" for i, w in enumerate(routing.EXPERTS.values()))
_ROUTE = f"""w AS (SELECT doc_id, list_distinct(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0b\\f\\r]+')) AS w FROM documents),
    s AS (SELECT doc_id, e.i, len(list_filter(e.words, lambda x: list_contains(w, x))) * 2.0 * 1.5 * 0.8 AS s FROM w, (VALUES {_SPECS}) e(i, words)),
    m AS (SELECT doc_id, max(s) AS top, min_by(i, (-s, i)) AS i, sum(exp(s)) AS z FROM s GROUP BY 1)"""


def routed(t: Tables):
    return t.documents.select("doc_id", routing.expert_scores(F.col("text"), F.lit("systems")).alias("s"))


@query("num_route_scores", f"WITH {_ROUTE} SELECT doc_id, i, round(s::DOUBLE, 6) AS score FROM s WHERE s > 0")
def _scores(t: Tables):
    return routed(t).select("doc_id", F.posexplode("s").alias("i", "x")).where("x > 0").select("doc_id", "i", r6("x").alias("score"))


@query("wf_route_moe", f"WITH {_ROUTE} SELECT doc_id, 'expert-' || i AS expert, round(exp(top) / z, 6) AS confidence FROM m")
def _moe(t: Tables):
    return routed(t).select("doc_id", routing.best_expert(F.col("s")).alias("b")).select("doc_id", "b.expert", r6("b.confidence").alias("confidence"))


@query("num_spectral", f"""WITH {_ROUTE}, a AS (SELECT doc_id, avg(s) AS a, stddev_pop(s) AS d FROM s GROUP BY 1), p AS (SELECT doc_id, i, s - 0.1 * (s - a) / (d + 1e-8) AS p FROM s JOIN a USING (doc_id)),
    q AS (SELECT doc_id, max(p) AS top, min_by(i, (-round(p, 9), i)) AS i, sum(exp(p)) AS z FROM p GROUP BY 1) SELECT doc_id, 'expert-' || i AS expert, round(exp(top) / z, 6) AS confidence FROM q""")
def _spectral(t: Tables):
    return routed(t).select("doc_id", routing.spectral_expert(F.col("s")).alias("b")).select("doc_id", "b.expert", r6("b.confidence").alias("confidence"))


@query("num_topk_routing", f"""WITH {_ROUTE}, k AS (SELECT doc_id, greatest(1, least(12, ceil(least(1.0, least(coalesce(length(text), 0) / 1000.0, 0.3) + 0.2 + 0.1) * 12)))::INT AS k FROM documents),
    l AS (SELECT doc_id, list({{'e': 'expert-' || i, 's': s}} ORDER BY s DESC, i) AS l FROM s GROUP BY 1)
    SELECT doc_id, list_transform(l[1:k], lambda x: x.e) AS experts, round(l[1].s / nullif(list_sum(list_transform(l[1:k], lambda x: x.s)), 0), 6)::DOUBLE AS confidence FROM l JOIN k USING (doc_id)""")
def _topk(t: Tables):
    width = routing.complexity(F.col("text"), F.lit(2), F.lit(1), F.lit(""))
    both = t.documents.select("doc_id", routing.expert_scores(F.col("text"), F.lit("systems")).alias("s"), width.alias("w"))
    return both.select("doc_id", routing.adaptive_top(F.col("s"), F.col("w")).alias("b")).select("doc_id", "b.experts", r6("b.confidence").alias("confidence"))


@query("num_complexity", "SELECT doc_id, round(least(1.0, least(coalesce(length(text), 0) / 1000.0, 0.3) + 0.2 + 0.1 + least(coalesce(length(source), 0) / 5000.0, 0.2)), 6) AS complexity FROM documents")
def _complexity(t: Tables):
    return t.documents.select("doc_id", r6(routing.complexity(F.col("text"), F.lit(2), F.lit(1), F.col("source"))).alias("complexity"))


@query("agg_expert_stats", f"WITH {_ROUTE} SELECT 'expert-' || e.i AS expert_id, count(m.doc_id) AS n, round(count(m.doc_id)::DOUBLE / sum(count(m.doc_id)) OVER (), 6) AS usage, round(coalesce(avg(exp(top) / z), 0), 6) AS confidence FROM (SELECT range AS i FROM range(12)) e LEFT JOIN m ON m.i = e.i GROUP BY e.i")
def _stats(t: Tables):
    b = routed(t).select(routing.best_expert(F.col("s")).alias("b")).select(F.col("b.expert").alias("expert_id"), "b.confidence")
    got = routing.expert_stats(routing.experts(t.spark), b)
    return got.select("expert_id", "n", r6("usage").alias("usage"), r6("confidence").alias("confidence"))


@query("join_expert_hist", f"WITH {_ROUTE} SELECT 'expert-' || e.i AS expert_id, m.doc_id, round(exp(top) / z, 6) AS confidence FROM (SELECT range AS i FROM range(12)) e LEFT JOIN m ON m.i = e.i")
def _hist(t: Tables):
    """Every expert with the documents routed to it; one that was never chosen comes once, without a document."""
    b = routed(t).select("doc_id", routing.best_expert(F.col("s")).alias("b")).select("doc_id", F.col("b.expert").alias("expert_id"), r6("b.confidence").alias("confidence"))
    return routing.experts(t.spark).select("expert_id").join(b, "expert_id", "left")


@query("misc_recover_collapse", f"WITH {_ROUTE}, u AS (SELECT e.i, count(m.doc_id) AS n, count(m.doc_id)::DOUBLE / sum(count(m.doc_id)) OVER () AS u FROM (SELECT range AS i FROM range(12)) e LEFT JOIN m ON m.i = e.i GROUP BY e.i) SELECT 'expert-' || i AS expert_id, u < 0.1 / 12 AS reset, CASE WHEN u < 0.1 / 12 THEN 0 ELSE n END AS load FROM u")
def _recover(t: Tables):
    """Collapsed experts begin anew: no load, and weights generated again from their domain (see misc_expert_weights)."""
    return routing.recovered(_stats(t), 12).select("expert_id", "reset", "load")


@query("st_load", f"WITH {_ROUTE}, u AS (SELECT e.i, count(m.doc_id) AS n FROM (SELECT range AS i FROM range(12)) e LEFT JOIN m ON m.i = e.i GROUP BY e.i) SELECT 'expert-' || i AS expert_id, n AS load, greatest(0, n - 1) AS rebalanced, round(greatest(0, n - 0.1 * (SELECT avg(n) FROM u)), 6)::DOUBLE AS target FROM u")
def _load(t: Tables):
    """Load after all routes, after one round of rebalancing, and the soft target: a tenth of the mean less."""
    return routing.loads(_stats(t).select("expert_id", F.col("n").alias("load"))).withColumn("target", r6("target"))


@query("agg_collapse", f"WITH {_ROUTE}, u AS (SELECT e.i, count(m.doc_id)::DOUBLE / sum(count(m.doc_id)) OVER () AS u FROM (SELECT range AS i FROM range(12)) e LEFT JOIN m ON m.i = e.i GROUP BY e.i) SELECT 'expert-' || i AS expert_id FROM u WHERE u < 0.1 / 12")
def _collapse(t: Tables):
    return routing.collapsed(_stats(t), 12).select("expert_id")


@query("rnk_tool_best", """WITH tools(tool, ord, words, tier, destructive) AS (VALUES ('read', 0, ['read', 'audit', 'verify'], 1, false), ('write', 1, ['write', 'merge', 'store'], 2, false), ('drop', 2, ['drop', 'prune', 'delete'], 3, true)),
    s AS (SELECT pr_id, tool, ord, len(list_filter(string_split_regex(lower(coalesce(title, '')), '[ \\t\\n]+'), lambda w: list_contains(words, w))) + (4 - tier) * 0.5 + CASE WHEN destructive THEN 0 ELSE 1 END AS s FROM pull_request, tools)
    SELECT pr_id AS task_id, min_by(tool, (-s, ord)) AS tool, max(s)::DOUBLE AS score FROM s GROUP BY 1""")  # fmt: skip
def _tool(t: Tables):
    tools = t.spark.createDataFrame([("read", 0, ["read", "audit", "verify"], 1, False), ("write", 1, ["write", "merge", "store"], 2, False), ("drop", 2, ["drop", "prune", "delete"], 3, True)], "tool string, ord int, words array<string>, tier int, destructive boolean")
    return routing.rank_tools(t.pull_request.select(F.col("pr_id").alias("task_id"), F.col("title").alias("text")), tools)


@query("rnk_tool_for_pattern", f"WITH {MEMORY} SELECT id, CASE WHEN len(list_filter(metadata.tags, lambda x: x NOT IN ('cache', 'memory', 'layer'))) = 0 THEN 'cache' WHEN len(list_filter(metadata.tags, lambda x: x NOT IN ('agent', 'worker', 'queue'))) = 0 THEN 'queue' ELSE 'cache' END AS tool FROM memory WHERE metadata.tags IS NOT NULL")
def _for(t: Tables):
    tools = [("cache", ["cache", "memory", "layer"]), ("queue", ["agent", "worker", "queue"])]
    return t.memory.where("metadata.tags IS NOT NULL").select("id", routing.tool_for(F.col("metadata.tags"), tools).alias("tool"))


@query("rnk_fallbacks", f"WITH {MEMORY} SELECT id, list_filter(['working', 'episodic', 'semantic', 'pattern', 'other'], lambda x: x <> type)[1:3] AS others FROM memory WHERE type IS NOT NULL")
def _fallbacks(t: Tables):
    return t.memory.where("type IS NOT NULL").select("id", routing.fallbacks(F.col("type"), ["working", "episodic", "semantic", "pattern", "other"]).alias("others"))


# -- learning ----------------------------------------------------------------------------------------

_P = f"{MEMORY}, p AS (SELECT id, reward, updated_at, length(id) AS n, list_transform(embedding, lambda x: x::DOUBLE) AS p FROM memory WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(embedding) >= 16)"


def params(t: Tables):
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = t.memory.where(F.col("embedding").isNotNull() & finite & (F.size("embedding") >= 16))
    return rows.select("id", "reward", "updated_at", F.length("id").alias("n"), F.col("embedding").cast("array<double>").alias("p"))


_R6 = lambda c: F.transform(c, lambda x: F.round(x, 6))


@query("num_gradients", f"WITH {_P} SELECT id, list_transform(p, lambda x, i: round(abs(x) * 0.1 * reward + (sin(n + i - 1) - 0.5) * 0.2, 6)) AS g FROM p")
def _gradients(t: Tables):
    return params(t).select("id", _R6(learning.gradients(F.col("p"), F.col("reward"), F.col("n"))).alias("g"))


@query("num_fisher", f"WITH {_P} SELECT id, list_transform(p, lambda x: round(x * x * (1 + reward), 6)) AS f FROM p")
def _fisher(t: Tables):
    return params(t).select("id", _R6(learning.fisher(F.col("p"), F.col("reward"))).alias("f"))


@query("st_fisher_ema", f"WITH {_P} SELECT id, list_transform(p, lambda x: round(0.9 * x + 0.1 * x * x, 6)) AS f FROM p")
def _fema(t: Tables):
    return params(t).select("id", _R6(learning.fisher_ema(F.col("p"), F.col("p"))).alias("f"))


@query("num_bank_importance", f"WITH {MEMORY}, k AS (SELECT DISTINCT reward, length(id) AS n FROM memory WHERE reward IS NOT NULL), v AS (SELECT reward, n, list_transform(range(49152), lambda i: greatest(0, 0.5 * reward + 0.5 + 0.1 * sin(n + i))) AS v FROM k) SELECT id, round(list_avg(v), 6) AS mean, round(list_min(v), 6) AS least, round(list_max(v), 6) AS greatest FROM memory JOIN v ON v.reward = memory.reward AND v.n = length(id)")
def _bank(t: Tables):
    """Importance of all 49,152 weights of a pattern, summed up."""
    rows = t.memory.where("reward IS NOT NULL").select("id", "reward", F.length("id").alias("n"))
    return learning.importance_summary(rows, "reward", "n", learning.WEIGHTS).select("id", r6("mean").alias("mean"), r6("least").alias("least"), r6("greatest").alias("greatest"))


@query("num_ewc_loss", f"WITH {_P} SELECT id AS key, round(5 * list_sum(list_transform(p, lambda x: x * x * pow(x - 0.5 * x, 2))), 6) AS loss FROM p")
def _ewc(t: Tables):
    rows = params(t)
    anchors = rows.select(F.col("id").alias("key"), F.transform("p", lambda x: 0.5 * x).alias("params"), learning.fisher(F.col("p")).alias("fisher"))
    return learning.ewc_loss(rows.select(F.col("id").alias("key"), F.col("p").alias("params")), anchors).withColumn("loss", r6("loss"))


@query("join_fisher_params", f"WITH {_P}, o AS (SELECT DISTINCT ON (n) n, p AS f FROM p ORDER BY n, id) SELECT id, count(*) AS positions, round(sum(x * y), 6) AS product FROM (SELECT p.id, unnest(p.p[1:least(len(p.p), len(o.f))]) AS x, unnest(o.f[1:least(len(p.p), len(o.f))]) AS y FROM p JOIN o USING (n)) GROUP BY 1")
def _fisher_join(t: Tables):
    """Parameters of every row against those of the first of its key, position by position to the shorter one."""
    rows = params(t).select("id", "n", "p")
    other = rows.groupBy("n").agg(F.min_by("p", "id").alias("f"))
    return learning.by_position(rows, other, "n", "p", "f").select("id", F.size("z").alias("positions"), r6(F.aggregate("z", F.lit(0.0), lambda a, e: a + e["p"] * e["f"])).alias("product"))


@query("agg_ewc_stats", f"WITH {_P} SELECT count(*) AS n, sum(len(p))::BIGINT AS params, round(avg(sqrt(list_sum(list_transform(p, lambda x: x * x * x * x)))), 6) AS norm, count_if(updated_at > (SELECT max(updated_at) FROM p) - INTERVAL 24 HOUR) AS last_day FROM p")
def _ewcs(t: Tables):
    length = F.sqrt(F.aggregate(learning.fisher(F.col("p")), F.lit(0.0), lambda a, x: a + x * x))
    rows = params(t)
    recent = F.col("updated_at") > rows.agg(F.max("updated_at")).scalar() - F.expr("INTERVAL 24 HOURS")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("p")).alias("params"), r6(F.avg(length)).alias("norm"), F.count_if(recent).alias("last_day"))


@query("agg_is_protected", f"WITH {_P} SELECT id, list_avg(list_transform(p, lambda x: x * x)) > 0.5 AS protected FROM p")
def _protected(t: Tables):
    return params(t).select("id", (F.aggregate(learning.fisher(F.col("p")), F.lit(0.0), lambda a, x: a + x) / F.size("p") > learning.PROTECTED_FISHER).alias("protected"))


@query("num_mode_scale", f"WITH {_P} SELECT p.id, list_transform(p, lambda x: round(x * CASE m.metadata.mode WHEN 'divergent' THEN 1.2 WHEN 'lateral' THEN 1.1 WHEN 'systems' THEN 1.3 WHEN 'critical' THEN 0.9 ELSE 1.0 END, 6) + 0.0::DOUBLE) AS v FROM p JOIN memory m ON m.id = p.id")
def _mode(t: Tables):
    return params(t).join(t.memory.select("id", F.col("metadata.mode").alias("mode")), "id").select("id", _R6(learning.scale_by_mode(F.col("p"), F.col("mode"))).alias("v"))


@query("num_flatten", f"WITH {_P} SELECT id, list_concat(list_concat(p[1:len(p) // 2], p[len(p) // 2 + 1:]), p[1:2]) AS v FROM p")
def _flatten(t: Tables):
    p, half = F.col("p"), F.expr("size(p) div 2")
    return params(t).select("id", learning.flatten_parts(F.array(F.slice(p, F.lit(1), half)), F.array(F.slice(p, half + 1, F.size(p) - half)), F.slice(p, 1, 2)).alias("v"))


@query("num_lora_apply", """WITH c AS (SELECT vec_id AS i, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings)
    SELECT b.i, a.j, round(coalesce(any_value(w.v), 0) + 0.25 * (1 + b.i % 3) * sum(b.v * a.v), 6) AS v FROM c b JOIN c a ON a.i = b.j LEFT JOIN c w ON w.i = b.i AND w.j = a.j WHERE b.j < 8 AND a.i < 8 GROUP BY b.i, a.j""")  # fmt: skip
def _lora(t: Tables):
    cells = t.embeddings.select(F.col("vec_id").alias("i"), F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "v"))
    scale = t.embeddings.select(F.col("vec_id").alias("i"), (1 + F.col("vec_id") % 3).cast("double").alias("s"))
    return learning.apply_lora(cells, cells.where("i < 8"), cells.where("j < 8"), scale, 2.0, 8).withColumn("v", r6("v"))


@query("num_judge", f"""WITH {MEMORY}, p AS (SELECT DISTINCT metadata.domain AS domain, metadata.task_type AS pattern, metadata.task_type || ' of the ' || metadata.context AS text FROM memory WHERE metadata.task_type IS NOT NULL AND metadata.context IS NOT NULL),
    one AS (SELECT domain, pattern, min(text) AS text FROM p GROUP BY 1, 2),
    o AS (SELECT m.id, m.reward, one.pattern, round(coalesce(len(list_intersect(list_distinct(string_split_regex(lower(m.content), '[ \\t\\n\\x0b\\f\\r]+')), list_distinct(string_split_regex(lower(one.text), '[ \\t\\n]+'))))::DOUBLE
        / greatest(len(list_distinct(string_split_regex(lower(m.content), '[ \\t\\n\\x0b\\f\\r]+'))), len(list_distinct(string_split_regex(lower(one.text), '[ \\t\\n]+')))), 0), 9) AS o FROM memory m LEFT JOIN one ON one.domain = m.metadata.domain)
    SELECT id, coalesce(max(reward), 0) >= 0.7 AS success, round(coalesce(max(o), 0), 6) AS support, min_by(pattern, (-o, pattern)) AS pattern FROM o GROUP BY 1""")  # fmt: skip
def _judge(t: Tables):
    m = t.memory
    patterns = m.where("metadata.task_type IS NOT NULL AND metadata.context IS NOT NULL").groupBy(F.col("metadata.domain").alias("domain"), F.col("metadata.task_type").alias("pattern")).agg(F.min(F.concat_ws(" of the ", "metadata.task_type", "metadata.context")).alias("text"))
    runs = m.select("id", F.col("metadata.domain").alias("domain"), F.col("content").alias("text"), "reward")
    return learning.judge(runs, patterns).withColumn("support", r6("support"))


@query("misc_experts", "SELECT 'expert-' || i AS expert_id, len(words) AS n_words, 100 AS capacity FROM (VALUES " + _SPECS + ") e(i, words)")
def _experts(t: Tables):
    return routing.experts(t.spark).select("expert_id", F.size("words").alias("n_words"), "capacity")


@query("misc_rank_share", "SELECT role, agent_id, round(ema_score / sum(ema_score) OVER (PARTITION BY role), 6) AS share FROM agent_pheromone")
def _share(t: Tables):
    return t.agent_pheromone.select("role", "agent_id", r6(F.col("ema_score") / F.sum("ema_score").over(Window.partitionBy("role"))).alias("share"))
