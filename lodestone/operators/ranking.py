"""Positions within groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.shared import ship, stage


def index_within(df: DataFrame, keys: list[str], order: Column, out: str = "idx", salts: int = 64, by: str | None = None) -> DataFrame:
    """Add ``out``: a dense 0-based index of each row within its ``keys``, without bringing a group into one task.

    A group is cut into ``salts`` parts by the hash of ``order``; each part is numbered by a window, and the
    parts' sizes, a table of at most groups x salts rows, are summed into offsets. ``order`` must be unique
    within a group for the numbering to be repeatable; null keys form a group.
    """
    salt, start = "__salt", "__start"
    salted = df.withColumn(salt, F.pmod(F.xxhash64(order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(*keys, salt).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, salt, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(start))
    numbered = salted.withColumn(out, F.row_number().over(Window.partitionBy(*keys, salt).orderBy(order)) - 1)
    joined = numbered.alias("l").join(starts.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, salt)])
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col(f"l.{out}") + F.col(f"r.{start}")).alias(out))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for batch in batches:
        yield batch.append_column("__at", pa.array(np.arange(n, n + batch.num_rows, dtype=np.int64)))
        n += batch.num_rows


def in_order(df: DataFrame, order: list[str | Column], out: str = "idx") -> DataFrame:
    """Add ``out``: the 0-based place of each row among all rows by ``order``, which should be unique for the numbering to be repeatable.

    Sorted in ranges, numbered range by range and shifted by the sizes of the ranges before; a column called ``out`` gives way.
    """
    ship(df.sparkSession)
    kept = df.drop(out)
    ranged = kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    placed = stage(ranged.mapInArrow(_number, f"{fields}, __at bigint"), "places")
    before = Window.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").select(*kept.columns, (F.col("__at") + F.col("__start")).alias(out))


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add, for each name in ``sums``, the sum of its expression over the rows of the same ``keys`` up to this one, by ``order``.

    The table is sorted by keys and order into ranges; a key's sums run within each range that holds a part of it, and the totals of its
    earlier ranges (one row a key and range) are added. So no key, nor the whole table where ``keys`` is empty, is gathered in one task.
    Nulls add nothing (a sum of nulls only is null); null keys form a group; ``order`` should be unique within a key.
    """
    names = list(sums)
    kept = df.drop(*names)
    valued = df.select(*kept.columns, *[v.alias(f"__v_{n}") for n, v in sums.items()])
    ranged = stage(valued.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = ranged.withColumns({f"__s_{n}": F.sum(f"__v_{n}").over(own) for n in names})
    totals = ranged.groupBy(*keys, "__part").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names])
    earlier = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__part", *[F.sum(f"__t_{n}").over(earlier).alias(f"__b_{n}") for n in names])
    l, r = inner.alias("l"), totals.alias("r")
    joined = l.join(r, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col("l.__part") == F.col("r.__part")])
    both = lambda n: F.when(F.col(f"l.__s_{n}").isNotNull() | F.col(f"r.__b_{n}").isNotNull(), F.coalesce(f"l.__s_{n}", F.lit(0)) + F.coalesce(f"r.__b_{n}", F.lit(0)))
    return joined.select(*[F.col(f"l.{c}") for c in kept.columns], *[both(n).alias(n) for n in names])
