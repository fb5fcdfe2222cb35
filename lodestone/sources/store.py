"""A keyed table of versions: upsert, update, delete, look-up, and records as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order`` (nulls least). Versions are reduced before the shuffle, so a hot key costs no more than others."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order]))  # an order of nulls is still an order
    got = df.groupBy(*keys).agg(best.alias("__v"))
    return got.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` replace those of ``base`` with the same key; others are added. A key twice in ``changes`` comes twice."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def update(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Non-null columns of ``changes`` (one row per key) overwrite those of ``base``; keys that ``base`` lacks are ignored."""
    cols = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in cols])
    joined = base.join(new, F.col(key) == F.col("__k"), "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns])


def delete(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return base.join(ids.select(key), key, "left_anti")


def by_id(base: DataFrame, key: str, value) -> DataFrame:
    """Point look-up; the filter is pushed into the scan."""
    return base.where(F.col(key) == F.lit(value))


def by_ids(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return base.join(ids.select(key).distinct(), key, "left_semi")


def as_records(df: DataFrame, prefix: str, key: str, reward: Column | None = None) -> DataFrame:
    """(id, content, reward): every row as JSON under a prefixed id."""
    return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.to_json(F.struct(*df.columns)).alias("content"), (F.lit(None).cast("double") if reward is None else reward).alias("reward"))


def from_records(records: DataFrame, prefix: str, schema) -> DataFrame:
    """Rows of the records under a prefix; content that is not such JSON gives nulls."""
    return records.where(F.col("id").startswith(prefix)).select(F.from_json("content", schema).alias("r")).select("r.*")


def append(df: DataFrame, path: str) -> None:
    """Rows added to a stored table as new files; what is there stays, and :func:`latest` tells versions apart."""
    df.write.mode("append").parquet(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the text files under a folder, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def generated_entries(spark: SparkSession, n: int, dim: int) -> DataFrame:
    """(id, tag, reward, verdict, vector): ``n`` made-up entries; numbers come from hashes of their place, so every run gives the same."""
    i = F.col("id")
    number = lambda j: F.pmod(F.xxhash64(i, j), F.lit(2_000_001)) / 1_000_000.0 - 1  # noqa: E731  from -1 to 1
    reward = F.pmod(i * 37, F.lit(100)) / 100.0
    tag = F.element_at(F.array(*map(F.lit, ("order", "inventory", "payment"))), (F.pmod(i, F.lit(3)) + 1).cast("int"))
    return spark.range(n).select(F.concat(F.lit("entry-"), i.cast("string")).alias("id"), tag.alias("tag"), reward.alias("reward"), F.when(reward >= 0.5, "success").otherwise("failure").alias("verdict"), F.transform(F.sequence(F.lit(1), F.lit(dim)), number).cast("array<float>").alias("vector"))
