"""Materialised intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import pathlib
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


_lock = threading.Lock()  # queries may be built from several threads


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only in local mode is a temporary folder set where it is unset."""
    with _lock:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found:
            return found.rstrip("/")
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", made)
        return made


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone at exit
        pass


def stage(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` written once as a parquet table in the shared folder and read back: lineage is cut, later
    branches read the columns they need, and a lost executor costs no recomputation. The table is removed
    when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    out = df if files is None else df.coalesce(files)
    out.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Remove the table behind a frame that :func:`stage` returned, once nothing lazy reads it any more."""
    files = df.inputFiles()
    if files:
        _remove(df.sparkSession, files[0].rsplit("/", 1)[0])


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, wherever they run."""
    with _lock:
        app = spark.sparkContext.applicationId
        if app in _shipped:
            return
        package = pathlib.Path(__file__).resolve().parent.parent
        to = pathlib.Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(to))  # the driver serves it to every executor
        _shipped.add(app)
