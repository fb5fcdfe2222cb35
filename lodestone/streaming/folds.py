"""The folds over events as Structured Streaming queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestone.operators.folds import ALPHA, SEED
from lodestone.plans.shared import shared_dir, ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the parquet files that appear under a path."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def watch_text(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (path, content) of text files that appear under a folder."""
    return spark.readStream.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


class _Ema(StatefulProcessor):
    def __init__(self, order: list[str], alpha: float, seed: float):
        self.order, self.alpha, self.seed = order, alpha, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ema", "ema double, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ema, n = self.state.get() if self.state.exists() else (self.seed, 0)
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        for v in batch["value"]:
            ema, n = self.alpha * v + (1 - self.alpha) * ema, n + 1
        self.state.update((float(ema), int(n)))
        yield pd.DataFrame({"key": [key[0]], "ema": [float(ema)], "n": [int(n)]})

    def close(self) -> None:
        pass


def ema(events: DataFrame, key: str, order: list[str], value: Column, alpha: float = ALPHA, seed: float = SEED) -> DataFrame:
    """Each batch's new (key, ema, n). Events are taken in ``order`` within a batch; batches in their own order. A key's
    events of one batch are one group, so bound a batch by the files it may read. Null values are left out."""
    ship(events.sparkSession)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.select(F.col(key).alias("key"), *order, value.cast("double").alias("value")).where("value IS NOT NULL")
    kind = events.schema[key].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Ema(order, alpha, seed), outputStructType=f"key {kind}, ema double, n bigint", outputMode="Update", timeMode="None")


class _Fresh(StatefulProcessor):
    """Whether a key was used within the time to live; RocksDB drops what was not."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "at timestamp", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.exists()
        n = sum(len(p) for p in rows)
        self.state.update((pd.Timestamp(timerValues.getCurrentProcessingTimeInMs(), unit="ms").to_pydatetime(),))
        yield pd.DataFrame({"key": [key[0]], "hits": [n if known else n - 1]})

    def close(self) -> None:
        pass


def cache_hits(events: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """Hits of each batch's keys in a cache whose entries live ``ttl_ms`` of processing time after their last use."""
    ship(events.sparkSession)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = events.schema[key].dataType.simpleString()
    return events.select(F.col(key).alias("key")).groupBy("key").transformWithStateInPandas(statefulProcessor=_Fresh(ttl_ms), outputStructType=f"key {kind}, hits bigint", outputMode="Update", timeMode="ProcessingTime")


def once(events: DataFrame, id_col: str, at: str, late: str = "7 days") -> DataFrame:
    """Redelivered events within the lateness dropped."""
    return events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late).dropDuplicatesWithinWatermark([id_col]).drop("__at")


def windowed(events: DataFrame, at: str, keys: list[str], width: str, late: str, value: str) -> DataFrame:
    """(window start, keys, n, mean) of tumbling windows, final once the watermark has passed them."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return timed.groupBy(F.window("__at", width), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), *keys, "n", "mean")


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """(key, start, stop, n) of sessions that a gap ends."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    got = timed.groupBy(F.session_window("__at", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return got.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def run_once(stream: DataFrame, name: str, mode: str, merge: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """All that is there now taken through the stream; what it put out, with ``batch``, the number of the batch.

    Output and progress lie in the shared folder; a batch that is run again replaces its own output.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/lodestone/stream-{name}-{uuid.uuid4().hex}"

    def keep(df: DataFrame, batch: int) -> None:
        (merge(df, batch) if merge else df).write.mode("overwrite").parquet(f"{at}/out/batch={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{at}/out")
