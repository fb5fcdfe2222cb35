"""Streaming folds taken over all files of a table at once, with the SQL of the batch folds they must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import folds as batch
from lodestone.queries.base import UPDATES, Tables, query, r6
from lodestone.queries.events import _S4, _ema_sql
from lodestone.sources.store import latest
from lodestone.streaming import folds as s


def stream(t: Tables, name: str):
    """The table's file or folder of files; a pattern, as a stream's plain path must be a folder."""
    return s.source(t.spark, f"{t.folder}/{name}.parque[t]", getattr(t, name).schema)


@query("st_ema_stream", _ema_sql(_S4))
def _ema(t: Tables):
    v = F.col("latency_ms")
    latency = F.when((v >= 0) & ~F.isnan(v) & (v < float("inf")), v)
    events = s.once(stream(t, "pheromone_update"), "update_id", "ts", "400 days")
    score = batch.score_four(F.col("success"), latency, F.col("tool_calls"), F.col("consensus_score"))
    out = s.run_once(s.ema(events, "agent_id", ["ts", "update_id"], score), "ema", "update")
    return latest(out, ["key"], ["batch"]).select(F.col("key").alias("agent_id"), r6("ema").alias("ema"), "n")


@query("st_window_stream", f"WITH {UPDATES} SELECT date_trunc('day', ts) AS day, role, n FROM (SELECT date_trunc('day', ts) AS ts, 'all' AS role, count(*) AS n FROM updates GROUP BY 1)")
def _window(t: Tables):
    events = s.once(stream(t, "pheromone_update"), "update_id", "ts", "400 days").withColumn("role", F.lit("all"))
    counts = events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "role").agg(F.count(F.lit(1)).alias("n"))
    return latest(s.run_once(counts, "window", "update"), ["day", "role"], ["batch"]).select("day", "role", "n")


@query("src_watch", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def _watch(t: Tables):
    counts = stream(t, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return latest(s.run_once(counts, "watch", "update"), ["source"], ["batch"]).select("source", "n")
