"""Dependency graphs: edges from imports, layers, closure, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.shared import drop_staged, stage


def stem(path: Column) -> Column:
    """The path without extension, and without a trailing /index."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), r"/index$", "")


def resolve_path(folder: Column, target: Column) -> Column:
    """A relative import against its folder, with . and .. taken out."""
    parts = F.split(F.concat_ws("/", folder, target), "/")
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == ".") | (p == ""), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.array_join(walked, "/")


def import_edges(files: DataFrame) -> DataFrame:
    """(repo, src, dst) of relative imports that name a file of the repository; of several such files the first by name.

    ``files``: repo, file (unique), imports (array of struct with source). An equi-join on the resolved path.
    """
    folder = F.regexp_replace(F.col("file"), r"/?[^/]*$", "")
    wanted = files.select("repo", F.col("file").alias("src"), folder.alias("folder"), F.explode("imports").alias("i")).where(F.col("i.source").startswith("."))
    wanted = wanted.select("repo", "src", resolve_path(F.col("folder"), F.col("i.source")).alias("stem"))
    known = files.groupBy("repo", stem(F.col("file")).alias("stem")).agg(F.min("file").alias("dst"))
    return wanted.join(known, ["repo", "stem"]).where("src <> dst").select("repo", "src", "dst").distinct()


def closure(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct (src, dst, depth) with dst reachable from src over any number of edges, or 1 to ``most``, depth the least number; src itself only over a cycle.

    Semi-naive: only pairs new in a round are extended.
    """
    edges = edges.select("src", "dst").distinct()
    found = stage(edges.select("src", "dst", F.lit(1).alias("depth")), "closure")
    fresh = found
    depth = 1
    while most is None or depth < most:
        depth += 1
        step = fresh.select("src", F.col("dst").alias("via")).join(edges.withColumnRenamed("src", "via"), "via").select("src", "dst").distinct()
        fresh = stage(step.join(found, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
    return found


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer): 0 for nodes that nothing points to, else one more than the greatest layer pointing to it; -1 in and behind cycles.

    Peeled level by level; each level reads what is left of the edges.
    """
    edges = edges.select("src", "dst").distinct()
    left, todo = edges, nodes.select("node").distinct()
    out = todo.limit(0).withColumn("layer", F.lit(0))
    level = 0
    while True:
        free = stage(todo.join(left.select(F.col("dst").alias("node")), "node", "left_anti"), "layer")
        if free.isEmpty():
            return out.unionByName(todo.withColumn("layer", F.lit(-1)))
        out = out.unionByName(free.withColumn("layer", F.lit(level)))
        todo = stage(todo.join(free, "node", "left_anti"), "nodes-left")
        left = stage(left.join(free.withColumnRenamed("node", "src"), "src", "left_anti"), "edges-left")
        level += 1


def on_cycles(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Nodes that reach themselves, within ``most`` edges if given, with the length of the shortest way."""
    return closure(edges, most).where("src = dst").select(F.col("src").alias("node"), F.col("depth").alias("length"))


def short_cycles(edges: DataFrame, most: int = 3) -> DataFrame:
    """Simple cycles of up to ``most`` nodes, each once, as arrays that begin with their smallest node."""
    edges = edges.select("src", "dst").where("src <> dst").distinct()
    loops = edges.where("src = dst").select(F.array("src").alias("cycle"))
    paths = edges.where("src < dst").select(F.array("src", "dst").alias("path"))
    out = loops
    for n in range(2, most + 1):
        ends = paths.withColumn("last", F.element_at("path", -1))
        back = ends.join(edges.select(F.col("src").alias("last"), F.col("dst").alias("home")), "last").where(F.col("home") == F.col("path")[0])
        out = out.unionByName(back.select(F.col("path").alias("cycle")))
        if n < most:
            step = ends.join(edges.select(F.col("src").alias("last"), F.col("dst").alias("nxt")), "last")
            paths = step.where((F.col("nxt") > F.col("path")[0]) & ~F.array_contains("path", F.col("nxt"))).select(F.concat("path", F.array("nxt")).alias("path"))
    return out


def dependents(edges: DataFrame) -> DataFrame:
    """Distinct (node, dependent): whatever leads to a node over any number of edges, but itself."""
    return closure(edges).where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("dependent"))


def reverse(edges: DataFrame) -> DataFrame:
    """(target, importers): who points to a node, sorted."""
    return edges.groupBy(F.col("dst").alias("target")).agg(F.array_sort(F.collect_set("src")).alias("importers"))


def degree_coupling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges per node, 1 at most; 0 without nodes."""
    both = edges.select(F.lit(1).alias("e"), F.lit(0).alias("n")).unionAll(nodes.select(F.lit(0), F.lit(1)))
    sums = both.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("edges"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"))
    return sums.select("edges", "nodes", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("edges").cast("double"), "nodes"), F.lit(0.0))).alias("coupling"))


__all__ = ["closure", "degree_coupling", "dependents", "drop_staged", "import_edges", "layers", "on_cycles", "resolve_path", "reverse", "short_cycles", "stem"]
