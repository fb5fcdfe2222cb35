"""Graph operators over imports and over the tree of part numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.queries.base import FILES, Tables, query

_TREE = "edges AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1)"


def tree(t: Tables):
    """Every part points to the one with half its number."""
    return t.part.where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))


_RING = "edges AS (SELECT n_nationkey AS src, (2 * n_nationkey + 1) % 25 AS dst FROM nation WHERE n_nationkey <> (2 * n_nationkey + 1) % 25)"


def ring(t: Tables):
    """Nations k to 2k + 1 modulo 25: with cycles."""
    return t.nation.select(F.col("n_nationkey").alias("src"), ((2 * F.col("n_nationkey") + 1) % 25).cast("int").alias("dst")).where("src <> dst")


def file_edges(t: Tables):
    return graph.import_edges(t.files.select("repo", F.regexp_replace(F.translate("file", "\\", "/"), r"^(\./)+", "").alias("file"), "imports").dropDuplicates(["repo", "file"]))


_EDGES = f"""{FILES},
    n AS (SELECT DISTINCT ON (repo, f) repo, f, imports FROM (SELECT repo, regexp_replace(translate(file, chr(92), '/'), '^(\\./)+', '') AS f, imports FROM files)),
    w AS (SELECT repo, f AS src, regexp_replace(f, '/?[^/]*$', '') AS folder, unnest(imports) AS i FROM n),
    r AS (SELECT repo, src, CASE WHEN starts_with(i.source, './') THEN folder || '/' || i.source[3:] ELSE regexp_replace(folder, '/?[^/]*$', '') || '/' || i.source[4:] END AS stem FROM w WHERE starts_with(i.source, './') OR (starts_with(i.source, '../') AND NOT starts_with(i.source, '../../'))
        UNION ALL SELECT repo, src, regexp_replace(regexp_replace(folder, '/?[^/]*$', ''), '/?[^/]*$', '') || '/' || i.source[7:] FROM w WHERE starts_with(i.source, '../../')),
    k AS (SELECT repo, regexp_replace(regexp_replace(f, '\\.[A-Za-z0-9]+$', ''), '/index$', '') AS stem, min(f) AS dst FROM n GROUP BY 1, 2),
    edges AS (SELECT DISTINCT repo, src, dst FROM r JOIN k USING (repo, stem) WHERE src <> dst)"""


@query("join_import_resolve", f"WITH {_EDGES} SELECT repo, src, dst FROM edges")
def _resolve(t: Tables):
    return file_edges(t)


@query("gr_coupling", f"WITH {_EDGES} SELECT (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM n) AS nodes, least(1.0::DOUBLE, (SELECT count(*) FROM edges)::DOUBLE / (SELECT count(*) FROM n)) AS coupling")
def _coupling(t: Tables):
    nodes = t.files.select("repo", F.regexp_replace(F.translate("file", "\\", "/"), r"^(\./)+", "").alias("file")).distinct()
    return graph.degree_coupling(file_edges(t), nodes)


_PAIRS = f"""{FILES}, pairs AS (SELECT DISTINCT repo, file, string_split(translate(file, chr(92), '/'), '/')[-2] AS src, split_part(i.source, '/', 2) AS dst FROM (SELECT repo, file, unnest(imports) AS i FROM files) WHERE starts_with(i.source, '../') AND NOT starts_with(i.source, '../../') AND contains(translate(file, chr(92), '/'), '/'))"""
_PACKAGES = _PAIRS  # repeated pairs change nothing there
_FOLDERS = _PAIRS + """, edges AS (SELECT DISTINCT repo || ':' || src AS src, repo || ':' || dst AS dst FROM pairs WHERE src <> dst AND repo IS NOT NULL), nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"""
_REACH = "c AS (SELECT src, dst, 1 AS depth FROM edges UNION SELECT c.src, e.dst, depth + 1 FROM c JOIN edges e ON e.src = c.dst WHERE depth < 40), reach AS (SELECT src, dst, min(depth) AS depth FROM c GROUP BY 1, 2)"


def folder_imports(t: Tables):
    """(repo, file, src, dst): a file in folder src imports from the sibling folder dst."""
    path = F.translate("file", "\\", "/")
    each = t.files.select("repo", "file", path.alias("p"), F.explode("imports").alias("i")).where(F.col("i.source").startswith("../") & ~F.col("i.source").startswith("../../") & F.contains("p", F.lit("/")))
    return each.select("repo", "file", F.element_at(F.split("p", "/"), -2).alias("src"), F.split_part("i.source", F.lit("/"), F.lit(2)).alias("dst")).where("src <> dst").distinct()


def folder_edges(t: Tables):
    """The import graph of folders, each named with its repository. Imports name no file of the tables, so files have no edges."""
    name = lambda c: F.concat("repo", F.lit(":"), c).alias(c)
    return folder_imports(t).where("repo IS NOT NULL").select(name("src"), name("dst")).distinct()


@query("gr_packages", f"WITH {_PACKAGES} SELECT dst AS target, list(DISTINCT src ORDER BY src) AS importers FROM pairs WHERE src <> dst GROUP BY 1")
def _packages(t: Tables):
    """Folders importing a folder, over all repositories."""
    return graph.reverse(folder_imports(t).select("src", "dst").distinct())


@query("gr_build", f"WITH {_PAIRS} SELECT repo, src, dst, count(DISTINCT file) AS weight FROM pairs WHERE src <> dst GROUP BY 1, 2, 3")
def _build(t: Tables):
    """The folders' edges, weighted by the files that import."""
    return folder_imports(t).groupBy("repo", "src", "dst").agg(F.count(F.lit(1)).alias("weight"))


@query("gr_reverse", f"WITH {_FOLDERS} SELECT dst AS target, list(DISTINCT src ORDER BY src) AS importers FROM edges GROUP BY 1")
def _reverse(t: Tables):
    return graph.reverse(folder_edges(t))


@query("gr_closure", f"WITH RECURSIVE {_FOLDERS}, {_REACH} SELECT src, dst, depth FROM reach")
def _closure(t: Tables):
    return graph.closure(folder_edges(t))


@query("gr_dependents", f"WITH RECURSIVE {_FOLDERS}, {_REACH} SELECT dst AS node, src AS dependent FROM reach WHERE src <> dst")
def _dependents(t: Tables):
    return graph.dependents(folder_edges(t))


@query("gr_cycles", f"WITH RECURSIVE {_FOLDERS}, {_REACH} SELECT src AS node, depth AS length FROM reach WHERE src = dst")
def _cycles(t: Tables):
    return graph.on_cycles(folder_edges(t))


@query("gr_ring_cycles", f"WITH RECURSIVE {_RING}, c AS (SELECT src, dst, 1 AS depth FROM edges UNION ALL SELECT c.src, e.dst, depth + 1 FROM c JOIN edges e ON e.src = c.dst WHERE depth < 25) SELECT src AS node, min(depth) AS length FROM c WHERE src = dst GROUP BY 1")
def _ring_cycles(t: Tables):
    """A graph with long cycles, which the imports at hand have not."""
    return graph.on_cycles(ring(t))


@query("gr_short_cycles", f"WITH {_RING} SELECT [a.src, a.dst] AS cycle FROM edges a JOIN edges b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst UNION SELECT [a.src, a.dst, b.dst] FROM edges a JOIN edges b ON b.src = a.dst JOIN edges c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst")
def _short(t: Tables):
    return graph.short_cycles(ring(t))


_LAYERS = _REACH + """, bad AS (SELECT src AS node FROM reach WHERE src = dst UNION SELECT r.dst FROM reach r JOIN reach o ON o.src = o.dst AND o.src = r.src),
    d AS (SELECT node, 0 AS layer FROM nodes WHERE node NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, d.layer + 1 FROM d JOIN edges e ON e.src = d.node WHERE e.dst NOT IN (SELECT node FROM bad)),
    layers AS (SELECT node, max(layer) AS layer FROM d GROUP BY 1 UNION ALL SELECT node, -1 FROM bad)"""


@query("gr_layers", f"WITH RECURSIVE {_FOLDERS}, {_LAYERS} SELECT node, layer FROM layers")
def _layers(t: Tables):
    edges = folder_edges(t)
    return graph.layers(edges.select(F.col("src").alias("node")).union(edges.select("dst")), edges)


@query("gr_depth", f"WITH RECURSIVE {_FOLDERS}, {_LAYERS} SELECT greatest(0, max(layer)) AS depth FROM layers")
def _depth(t: Tables):
    return _layers(t).agg(F.greatest(F.lit(0), F.max("layer")).alias("depth"))


@query("gr_tree_layers", f"WITH RECURSIVE {_TREE}, heads AS (SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT dst FROM edges)), d AS (SELECT node, 0 AS layer FROM heads UNION SELECT e.dst, d.layer + 1 FROM d JOIN edges e ON e.src = d.node) SELECT node, max(layer) AS layer FROM d GROUP BY 1")
def _tree_layers(t: Tables):
    """A deeper graph than the imports': every part points to the one with half its number."""
    return graph.layers(t.part.select(F.col("p_partkey").alias("node")), tree(t))
