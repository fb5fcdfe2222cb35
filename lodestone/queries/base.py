"""The register of queries, and what their SQL has in common."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.store import latest
from lodestone.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name as attributes; and those of current rows only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @property
    def memory(self) -> DataFrame:
        return latest(self.memory_entry, ["id"], ["updated_at", "access_count", "reward"])

    @property
    def files(self) -> DataFrame:
        return latest(self.parse_result, ["repo", "file"], ["parsed_at", "ingested_at", "parse_id"])

    @property
    def updates(self) -> DataFrame:
        return latest(self.pheromone_update, ["update_id"], ["ingested_at", "ts"])

    @property
    def patches(self) -> DataFrame:
        return latest(self.pr_file, ["pr_file_id"], ["ingested_at"])


def newest(alias: str, source: str, keys: str, order: str) -> str:
    by = ", ".join(f"{c} DESC NULLS LAST" for c in order.split(", "))
    return f"{alias} AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {by}) = 1)"


MEMORY = newest("memory", "memory_entry", "id", "updated_at, access_count, reward")
FILES = newest("files", "parse_result", "repo, file", "parsed_at, ingested_at, parse_id")
UPDATES = newest("updates", "pheromone_update", "update_id", "ingested_at, ts")
PATCHES = newest("patches", "pr_file", "pr_file_id", "ingested_at")


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables`."""

    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)
