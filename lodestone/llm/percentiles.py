"""Percentiles of very large numeric columns, from combinable value frequencies.

The state is a table of (group, value, n). States of separate partitions, files or days are combined by
:func:`merge_counts`; a percentile is then found by range-sorting the frequencies, summing them in windows
within each range, shifting those sums by the totals of earlier ranges and keeping the first value that
reaches the target rank. No group is ever gathered into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.shared import stage


def value_counts(df: DataFrame, groups: list[str], value: str, id_col: str | None = None, rel_error: float = 0.0) -> DataFrame:
    """The combinable state of ``df``: columns ``groups``, ``value`` (double) and ``n``.

    Null and NaN values are left out; null groups are groups like others. With ``id_col`` an id counts once
    in a group, by its greatest value, and rows without an id count each. ``rel_error`` = 0 keeps values as
    they are, so that percentiles are exact; above 0, values are snapped to logarithmic bins whose centre
    differs from them by at most that share, which bounds the state per group whatever the number of rows.
    """
    v = F.col(value).cast("double")
    readings = df.where(v.isNotNull() & ~F.isnan(v))
    if id_col:
        none = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
        readings = readings.groupBy(*groups, F.col(id_col).alias("__id"), none.alias("__none")).agg(F.max(v).alias("value"))
    else:
        readings = readings.select(*groups, v.alias("value"))
    if rel_error > 0:
        gamma = (1 + rel_error) / (1 - rel_error)
        finite = F.abs("value") < float("inf")
        size = F.pow(F.lit(gamma), F.ceil(F.log(F.abs("value")) / F.log(F.lit(gamma)))) * (2 / (gamma + 1))
        readings = readings.withColumn("value", F.when((F.col("value") != 0) & finite, F.signum("value") * size).otherwise(F.col("value")))
    return readings.groupBy(*groups, (F.col("value") + F.lit(0.0)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(states: list[DataFrame], groups: list[str]) -> DataFrame:
    """One state from several; the order does not matter."""
    every = reduce(DataFrame.unionByName, [s.select(*groups, "value", "n") for s in states])
    return every.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, groups: list[str], percents: list[float], min_count: int = 1) -> DataFrame:
    """Rows (``groups``, ``percent``, ``value``, ``n_values``) for every group with at least ``min_count`` values.

    The p-th percentile is the smallest value with at least p % of the values at or below it (p = 0: the
    smallest). Ties need no rule, as equal values are one row. An empty state gives no rows.
    """
    ranged = counts.select(*groups, "value", "n").repartitionByRange(*groups, "value")
    table = stage(ranged.withColumn("__part", F.spark_partition_id()), "frequencies")

    own = Window.partitionBy(*groups)
    sums = table.groupBy(*groups, "__part").agg(F.sum("n").alias("__size"))
    sums = sums.withColumns({
        "__start": F.coalesce(F.sum("__size").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "n_values": F.sum("__size").over(own),
    }).where(F.col("n_values") >= min_count)
    # ranks in whole numbers: percents are taken to six decimals
    wanted = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("percent"), F.lit(round(p * 10**6)).cast("long").alias("q")) for p in percents]))
    rank = F.greatest(F.lit(1), F.expr("(__p.q * n_values + 99999999) div 100000000"))
    targets = (
        sums.withColumn("__p", wanted)
        .withColumn("__rank", rank - F.col("__start"))
        .where((F.col("__rank") >= 1) & (F.col("__rank") <= F.col("__size")))
        .select(*groups, "__part", "n_values", F.col("__p.percent").alias("percent"), "__rank")
    )
    running = table.withColumn("__upto", F.sum("n").over(Window.partitionBy(*groups, "__part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    l, r = running.alias("l"), targets.alias("r")
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups] + [F.col("l.__part") == F.col("r.__part")]
    reached = (F.col("l.__upto") >= F.col("r.__rank")) & (F.col("l.__upto") - F.col("l.n") < F.col("r.__rank"))
    return l.join(r, [*same, reached]).select(*[F.col(f"r.{g}") for g in groups], "r.percent", "l.value", "r.n_values")


# -- queries ---------------------------------------------------------------------------------------

AGENT_PERCENT, AGENT_ABOVE = 95.0, 5000.0
BENCH_PERCENT, BENCH_ABOVE = 90.0, 400.0
LEAST_READINGS = 30


def latency_counts(updates: DataFrame, runs: DataFrame) -> DataFrame:
    """The state of agents' latencies and of benchmarks' 95th percentiles: valid readings, each id once, no null group."""

    def part(df: DataFrame, kind: str, key: str, id_col: str, value: str) -> DataFrame:
        v = F.col(value).cast("double")
        valid = df.where(F.col(key).isNotNull() & (v >= 0) & (v < float("inf")) & ~F.isnan(v))
        return value_counts(valid.select(F.lit(kind).alias("grp_kind"), F.col(key).alias("grp_key"), id_col, value), ["grp_kind", "grp_key"], value, id_col)

    return merge_counts([part(updates, "agent", "agent_id", "update_id", "latency_ms"), part(runs, "bench", "name", "run_id", "p95_latency_ms")], ["grp_kind", "grp_key"])


def daily_sketch(updates: DataFrame, runs: DataFrame, percents: list[float], rel_error: float = 0.01) -> DataFrame:
    """Percentiles of the same readings within ``rel_error`` of their value, from states of single days: the state of a group and day
    is bounded by its bins whatever the readings, and merging the days' states is all that a longer period takes."""
    valid = lambda v: (v >= 0) & (v < float("inf")) & ~F.isnan(v)

    def days(df: DataFrame, kind: str, key: str, id_col: str, value: str) -> DataFrame:
        rows = df.where(F.col(key).isNotNull() & valid(F.col(value).cast("double")))
        rows = rows.select(F.lit(kind).alias("grp_kind"), F.col(key).alias("grp_key"), F.to_date("ts").alias("day"), id_col, value)
        return value_counts(rows, ["grp_kind", "grp_key", "day"], value, id_col, rel_error)

    states = [days(updates, "agent", "agent_id", "update_id", "latency_ms"), days(runs, "bench", "name", "run_id", "p95_latency_ms")]
    return percentiles(merge_counts(states, ["grp_kind", "grp_key"]), ["grp_kind", "grp_key"], percents)


def found(updates: DataFrame, runs: DataFrame) -> DataFrame:
    got = percentiles(latency_counts(updates, runs), ["grp_kind", "grp_key"], [AGENT_PERCENT, BENCH_PERCENT], LEAST_READINGS)
    agent = (F.col("grp_kind") == "agent") & (F.col("percent") == AGENT_PERCENT) & (F.col("value") > AGENT_ABOVE)
    bench = (F.col("grp_kind") == "bench") & (F.col("percent") == BENCH_PERCENT) & (F.col("value") > BENCH_ABOVE)
    return got.where(agent | bench).select("grp_kind", "grp_key")
