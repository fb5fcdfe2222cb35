"""Approximate nearest neighbours: an inverted file of cells.

Centroids are fitted on a bounded sample, every row is assigned to its nearest one, and a query is compared with the
rows of the ``probes`` cells nearest to it. The settings of a navigable graph have their counterparts: cells for links
a node, rounds of fitting for the effort of construction, and probes for that of a search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.search import knn, usable
from lodestone.plans.shared import ship

#: Rows that centroids are fitted on, at most: those with the least hashes of their ids.
SAMPLE = 20_000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit(items: DataFrame, dim: int, cells: int, rounds: int = 10, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of ``cells`` cells, by spherical k-means on a sample of at most ``sample`` usable rows."""
    rows = items.where(F.col("id").isNotNull() & usable(F.col("vector"), dim)).orderBy(F.xxhash64("id"), "id").limit(sample)
    x = _unit(np.array([r.vector for r in rows.select("vector").collect()], dtype=np.float64).reshape(-1, dim))
    if not len(x):
        return np.zeros((0, dim))
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), c)
    return c


def index(items: DataFrame, dim: int, centroids: np.ndarray) -> DataFrame:
    """Usable rows (id, vector) with ``cell``, the number of the nearest centroid."""
    ship(items.sparkSession)
    kind = items.schema["id"].dataType.simpleString()
    good = items.where(F.col("id").isNotNull() & usable(F.col("vector"), dim)).select("id", F.col("vector").cast("array<double>").alias("vector"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                yield b.append_column("cell", pa.array(np.argmax(x @ centroids.T, axis=1).astype(np.int32)))

    return good.mapInArrow(assign, f"id {kind}, vector array<double>, cell int")


def search(queries: DataFrame, indexed: DataFrame, dim: int, k: int, centroids: np.ndarray, probes: int) -> DataFrame:
    """What :func:`lodestone.operators.search.knn` gives by cosine, of the items in the ``probes`` cells nearest to each query."""
    return knn(queries, indexed, dim, k, cells=(centroids, probes))
