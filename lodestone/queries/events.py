"""Folds over ordered events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import folds
from lodestone.operators.ranking import running_sums
from lodestone.queries.base import UPDATES, Tables, query, r6

_S4 = "0.4 * (CASE WHEN success THEN 1 ELSE 0 END) + 0.2 * greatest(0, 1 - lat / 60000) + 0.2 * greatest(0, 1 - coalesce(tool_calls, 20) / 20.0) + 0.2 * coalesce(nullif(consensus_score, 0), 0.5)"
_S3 = "0.5 * (CASE WHEN success THEN 1 ELSE 0 END) + 0.25 * greatest(0, 1 - lat / 60000) + 0.25 * greatest(0, 1 - coalesce(tool_calls, 20) / 20.0)"


def _ema_sql(score: str) -> str:
    return f"""WITH {UPDATES}, v AS (SELECT agent_id, ({score})::DOUBLE AS v, row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, update_id DESC) - 1 AS back FROM (SELECT *, CASE WHEN isfinite(latency_ms) AND latency_ms >= 0 THEN latency_ms ELSE 60000 END AS lat FROM updates))
    SELECT agent_id, round(0.5 * pow(0.7, count(*)) + sum(0.3 * pow(0.7, back) * v), 6) AS ema, count(*) AS n FROM v GROUP BY 1"""


def scored(t: Tables, score):
    v = F.col("latency_ms")
    latency = F.when((v >= 0) & ~F.isnan(v) & (v < float("inf")), v)
    return t.updates.select("agent_id", "ts", "update_id", score(latency).alias("score"))


@query("st_ema_sched", _ema_sql(_S4))
def _ema4(t: Tables):
    got = folds.ema(scored(t, lambda lat: folds.score_four(F.col("success"), lat, F.col("tool_calls"), F.col("consensus_score"))), "agent_id", ["ts", "update_id"], "score")
    return got.withColumn("ema", r6("ema"))


@query("st_ema_swarm", _ema_sql(_S3))
def _ema3(t: Tables):
    got = folds.ema(scored(t, lambda lat: folds.score_three(F.col("success"), lat, F.col("tool_calls"))), "agent_id", ["ts", "update_id"], "score")
    return got.withColumn("ema", r6("ema"))


@query("st_eligible_list", "SELECT agent_id FROM agent_pheromone WHERE eligible AND role IS NOT NULL AND NOT (suspension_count > 0 AND recovery_attempts = 0)")
def _eligible(t: Tables):
    return t.agent_pheromone.where("eligible AND role IS NOT NULL AND NOT (suspension_count > 0 AND recovery_attempts = 0)").select("agent_id")


@query("st_running_avg", f"WITH {UPDATES} SELECT update_id, round(sum(consensus_score) OVER w, 3) AS running_sum, count(consensus_score) OVER w AS running_n FROM updates WINDOW w AS (PARTITION BY agent_id, success ORDER BY ts, update_id ROWS UNBOUNDED PRECEDING)")
def _running(t: Tables):
    return folds.running_average(t.updates, ["agent_id", "success"], ["ts", "update_id"], "consensus_score").select("update_id", F.round(F.col("running_avg") * F.col("running_n"), 3).alias("running_sum"), "running_n")


@query("st_baseline_track", "SELECT name, min_by(p50_latency_ms, (ts, run_id)) AS baseline, max_by(p50_latency_ms, (ts, run_id)) AS current FROM (SELECT DISTINCT run_id, name, ts, p50_latency_ms FROM benchmark_result WHERE p50_latency_ms IS NOT NULL) GROUP BY 1")
def _track(t: Tables):
    runs = t.benchmark_result.where("p50_latency_ms IS NOT NULL").select("run_id", "name", "ts", "p50_latency_ms").distinct()
    order = F.struct("ts", "run_id")
    return runs.groupBy("name").agg(F.min_by("p50_latency_ms", order).alias("baseline"), F.max_by("p50_latency_ms", order).alias("current"))


@query("st_alert_lifecycle", """WITH d AS (SELECT name, date_trunc('day', ts) AS day, avg(avg_latency_ms) AS v FROM (SELECT DISTINCT run_id, name, ts, avg_latency_ms FROM benchmark_result WHERE isfinite(avg_latency_ms)) GROUP BY 1, 2),
    m AS (SELECT *, round(v, 6) > 30 AS b FROM d), s AS (SELECT *, sum((b AND NOT coalesce(lag_b, false))::INT) OVER (PARTITION BY name ORDER BY day) AS k, max(day) OVER (PARTITION BY name) AS last_day FROM (SELECT *, lag(b) OVER (PARTITION BY name ORDER BY day) AS lag_b FROM m))
    SELECT name, min(day) AS opened, max(day) AS last, count(*) AS n_samples, max(day) < any_value(last_day) AS acknowledged FROM s WHERE b GROUP BY name, k""")  # fmt: skip
def _alerts(t: Tables):
    v = F.col("avg_latency_ms")
    runs = t.benchmark_result.select("run_id", "name", "ts", "avg_latency_ms").distinct().where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    daily = runs.groupBy("name", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.round(F.avg(v), 6).alias("v"))
    return folds.alert_episodes(daily, "name", "day", F.col("v") > 30)


@query("st_ttl", "SELECT user_id, count(*) AS n, count_if(epoch_us(ts) - epoch_us(p) <= 3600000000) AS hits FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) GROUP BY 1")
def _ttl(t: Tables):
    return folds.ttl_hits(t.events, "user_id", "ts", 3600).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))


@query("st_vote", f"WITH {UPDATES}, l AS (SELECT update_id % 50 AS proposal, agent_id, max_by(success, (ts, update_id)) AS v FROM updates WHERE agent_id IS NOT NULL GROUP BY 1, 2) SELECT proposal, count_if(v) AS yes, count_if(NOT v) AS no, count_if(v) > 20 AS accepted, count_if(NOT v) > 20 AS rejected FROM l GROUP BY 1")
def _vote(t: Tables):
    votes = t.updates.where("agent_id IS NOT NULL").withColumn("proposal", F.col("update_id") % 50)
    return folds.majority(votes, "proposal", "agent_id", ["ts", "update_id"], "success", 40)


@query("st_quorum", "SELECT role, count(*) AS agents, count_if(eligible) >= ceil(count(*) / 2.0) AS healthy FROM agent_pheromone GROUP BY 1")
def _quorum(t: Tables):
    c = F.count(F.lit(1))
    return t.agent_pheromone.groupBy("role").agg(c.alias("agents"), (F.count_if("eligible") >= F.ceil(c / 2)).alias("healthy"))


@query("st_idempotency", "SELECT update_id, count(*) AS n, count_if(r > 1) AS replayed FROM (SELECT update_id, row_number() OVER (PARTITION BY update_id ORDER BY ingested_at) AS r FROM pheromone_update) GROUP BY 1")
def _idem(t: Tables):
    return folds.first_results(t.pheromone_update, "update_id", ["ingested_at"]).groupBy("update_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("replayed").alias("replayed"))


_E = f"""{UPDATES}, v AS (SELECT agent_id, update_id, ts, ({_S4})::DOUBLE AS v, row_number() OVER (PARTITION BY agent_id ORDER BY ts, update_id) AS n FROM (SELECT *, CASE WHEN isfinite(latency_ms) AND latency_ms >= 0 THEN latency_ms ELSE 60000 END AS lat FROM updates) WHERE agent_id IS NOT NULL),
    h AS (SELECT a.agent_id, a.update_id, any_value(a.ts) AS ts, any_value(a.n) AS n, 0.5 * pow(0.7, any_value(a.n)) + 0.3 * sum(pow(0.7, a.n - b.n) * b.v) AS ema FROM v a JOIN v b ON b.agent_id = a.agent_id AND b.n <= a.n AND b.n > a.n - 120 GROUP BY 1, 2),
    c AS (SELECT *, CASE WHEN n > 3 THEN ema - lag(ema) OVER (PARTITION BY agent_id ORDER BY n) WHEN n = 3 THEN ema ELSE 0 END AS c FROM h),
    m AS (SELECT *, 0.6 * sum(c) OVER w / nullif(sum((n = 3)::INT) OVER w, 0) AS threshold FROM c WINDOW w AS (ORDER BY ts, update_id ROWS UNBOUNDED PRECEDING)),
    j AS (SELECT m.*, coalesce(a.role IN ('coordinator', 'queen', 'security'), false) OR n < 3 OR ema >= threshold AS eligible FROM m LEFT JOIN agent_pheromone a USING (agent_id)),
    f AS (SELECT *, coalesce(lag(eligible) OVER (PARTITION BY agent_id ORDER BY n), true) AS was FROM j)"""


@query("st_eligibility", f"WITH {_E} SELECT agent_id, max(n) AS n, round(max_by(ema, n), 6) AS ema, round(max_by(threshold, n), 6) AS threshold, max_by(eligible, n) AS eligible, count_if(was AND NOT eligible) AS suspensions, count_if(NOT was AND eligible) AS recoveries FROM f GROUP BY 1")
def _eligibility(t: Tables):
    """Every agent's state after all events, each event judged against all agents as they stood then."""
    got = folds.eligibility(scored(t, lambda lat: folds.score_four(F.col("success"), lat, F.col("tool_calls"), F.col("consensus_score"))), t.agent_pheromone, "agent_id", ["ts", "update_id"], "score")
    last = lambda c: F.max_by(c, "n").alias(c)
    return got.groupBy("agent_id").agg(F.max("n").alias("count"), last("ema"), last("threshold"), last("eligible"), last("suspensions"), last("recoveries")).select("agent_id", F.col("count").alias("n"), r6("ema").alias("ema"), r6("threshold").alias("threshold"), "eligible", "suspensions", "recoveries")


@query("st_suspend", "SELECT agent_id, CASE WHEN coalesce(ema_score < 0.4, false) THEN false ELSE eligible END AS eligible, suspension_count + coalesce(ema_score < 0.4, false)::INT AS suspension_count FROM agent_pheromone")
def _suspend(t: Tables):
    """Agents below 0.4 suspended by hand."""
    return folds.suspend(t.agent_pheromone, F.col("ema_score") < 0.4).select("agent_id", "eligible", "suspension_count")


@query("st_recover", """WITH s AS (SELECT sum(ema_score) AS s, count(ema_score) AS n FROM agent_pheromone WHERE sample_count >= 3),
    r AS (SELECT a.*, least(1, ema_score + 0.1) AS up, 0.6 * (s + CASE WHEN sample_count >= 3 THEN least(1, ema_score + 0.1) - ema_score ELSE 0 END) / nullif(n, 0) AS threshold FROM agent_pheromone a, s)
    SELECT agent_id, round(CASE WHEN NOT eligible THEN up ELSE ema_score END, 6) AS ema_score,
        CASE WHEN NOT eligible THEN coalesce(coalesce(role IN ('coordinator', 'queen', 'security'), false) OR NOT coalesce(sample_count >= 3, false) OR threshold IS NULL OR up >= threshold, false) ELSE eligible END AS eligible,
        recovery_attempts + CASE WHEN NOT eligible AND NOT coalesce(role IN ('coordinator', 'queen', 'security'), false) AND sample_count >= 3 AND up >= threshold THEN 1 ELSE 0 END AS recovery_attempts FROM r""")  # fmt: skip
def _recover(t: Tables):
    """Every suspended agent recovered by hand, each judged again."""
    return folds.recover(t.agent_pheromone, ~F.col("eligible")).select("agent_id", r6("ema_score").alias("ema_score"), "eligible", "recovery_attempts")


_SPANS = f"""{UPDATES}, spans AS (SELECT epoch_us(ts) - (latency_ms * 1000)::BIGINT AS a, epoch_us(ts) AS b FROM updates WHERE isfinite(latency_ms) AND latency_ms >= 0),
    moments AS (SELECT x, sum(d) AS d FROM (SELECT a AS x, 1 AS d FROM spans UNION ALL SELECT b, -1 FROM spans) GROUP BY 1), running AS (SELECT x, sum(d) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM moments)"""


def in_flight(t: Tables, most: int):
    """Runs from their latency before an update to the update, in microseconds."""
    v = F.col("latency_ms")
    b = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = t.updates.where((v >= 0) & ~F.isnan(v) & (v < float("inf"))).select((b - F.round(v * 1000).cast("bigint")).alias("a"), b.alias("b"))
    return folds.in_flight(spans, "a", "b", most)


@query("st_semaphore", f"WITH {_SPANS} SELECT x AS moment, running, running > 3 AS waits FROM running")
def _semaphore(t: Tables):
    return in_flight(t, 3).withColumnRenamed("at", "moment")


@query("st_max_concurrent", f"WITH {_SPANS} SELECT x // 86400000000 AS day, max(running) AS most, max(running) > 10 AS exceeded FROM running GROUP BY 1")
def _concurrent(t: Tables):
    """The most runs at a time on each day, against a limit of ten."""
    return in_flight(t, 10).groupBy(F.expr("at div 86400000000").alias("day")).agg(F.max("running").alias("most"), (F.max("running") > 10).alias("exceeded"))


@query("st_history", f"WITH {UPDATES} SELECT agent_id, update_id, sum(tool_calls) OVER (PARTITION BY agent_id ORDER BY ts, update_id)::BIGINT AS calls FROM updates WHERE success")
def _history(t: Tables):
    some = t.updates.where("success").select("agent_id", "update_id", "ts", "tool_calls")
    return running_sums(some, ["agent_id"], ["ts", "update_id"], {"calls": F.col("tool_calls").cast("bigint")}).select("agent_id", "update_id", "calls")


@query("st_lru")
def _lru(t: Tables):
    """What caches of 50, one for each seventh of the users, hold after all accesses, oldest use first; checked against a loop on a fixture."""
    ops = t.events.select("event_id", F.when(F.col("event_type") == "view", "get").otherwise("set").alias("op"), "user_id", (F.col("user_id") % 7).alias("cache"))
    return folds.lru_caches(ops, "cache", "event_id", "op", "user_id", 50)


@query("st_sessions", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) > 1800000000 GROUP BY 1")
def _sessions(t: Tables):
    return folds.ttl_hits(t.events, "user_id", "ts", 1800).where("NOT hit").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))
