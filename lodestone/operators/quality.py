"""Scores, rules and issues of parsed source files.

Files have the columns of ``parse_result``: ``repo, file, language, imports, exports, classes (name, n_methods,
n_properties, line, complexity), n_functions, metrics, errors``. Null metrics score as a file without a finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.numbers import clamp, js_round
from lodestone.sources.store import latest

# fixed values: weights of the four dimensions, and of the factors that the parsed tables can give
DIMENSIONS = {"maintainability": 0.35, "scalability": 0.25, "security": 0.25, "performance": 0.15}
METHODS, PROPERTIES, LINES, COMPLEXITY, FILE_COMPLEXITY, PARAMETERS = 20, 15, 500, 15, 20, 5
# fixed values: words that code of a layer must not use
LAYERS = {
    "controller": ("Repository", "DAO", "Database", "EntityManager", "Session"),
    "service": ("Controller", "HttpRequest", "Response"),
    "domain": ("Repository", "DAO", "Controller"),
}
# fixed values: the rules and how severe they are; the last four never find anything
SEVERITIES = {
    "god_class": "high", "god_method": "high", "feature_envy": "medium", "layer_violation": "high", "circular_dependency": "critical", "shotgun_surgery": "high",
    "data_clump": "low", "long_parameter_list": "medium", "duplicate_code": "medium", "switch_statements": "medium", "refused_bequest": "low",
    "dead_code": "low", "inappropriate_intimacy": "medium", "speculative_generality": "low", "temporary_field": "low",
}


def m(name: str) -> Column:
    return F.col(f"metrics.{name}").cast("double")


def _over(x: Column, limit: float, step: float, most: float) -> Column:
    return F.when(x > limit, F.least(F.lit(most), (x - limit) * step)).otherwise(0.0)


def file_maintainability() -> Column:
    index = m("maintainability_index")
    gain = F.when(index < 65, -(65 - index) * 0.5).when(index > 85, F.least(F.lit(10.0), (index - 85) * 0.3)).otherwise(0.0)
    lost = _over(m("cyclomatic_complexity"), 10, 2, 30) + _over(m("cognitive_complexity"), 15, 1.5, 25) + _over(m("nesting_depth"), 4, 3, 15)
    return clamp(100 - lost + gain, 0, 100)


def big_classes() -> Column:
    return F.coalesce(F.size(F.filter("classes", lambda c: (c["n_methods"] > METHODS) | (c["n_properties"] > PROPERTIES))), F.lit(0))


def file_scalability(has_async: Column) -> Column:
    slow = F.when(~has_async & (F.coalesce(F.lower(F.trim("language")), F.lit("")) != "go"), 10).otherwise(0)
    return clamp((100 - slow - F.greatest(big_classes(), F.lit(0)) * 15).cast("double"), 0, 100)


def file_performance(has_cache: Column) -> Column:
    return clamp((100 - F.when(~has_cache & (F.coalesce("n_functions", F.lit(0)) > 10), 10).otherwise(0)).cast("double"), 0, 100)


def imports_any(words: tuple[str, ...]) -> Column:
    return F.coalesce(F.exists("imports", lambda i: F.lower(i["source"]).rlike("|".join(words))), F.lit(False))


def file_scores(files: DataFrame) -> DataFrame:
    """(repo, file, four scores, total): asynchronous and caching code is told by the imported modules, and
    security by its findings, of which the parsed tables have none."""
    scored = files.select(
        "repo", "file", file_maintainability().alias("maintainability"), file_scalability(imports_any(("async",))).alias("scalability"),
        F.lit(100.0).alias("security"), file_performance(imports_any(("cache", "memo"))).alias("performance"),
    )
    return scored.withColumn("total", js_round(sum((F.col(d) * w for d, w in DIMENSIONS.items()), F.lit(0.0))))


def weighted(parts: DataFrame, keys: list[str], score: str = "score", weight: str = "weight") -> DataFrame:
    """(keys, score): the weighted mean of factors, rounded half up."""
    return parts.groupBy(*keys).agg(js_round(F.try_divide(F.sum(F.col(score) * F.col(weight)), F.sum(weight))).alias("score"))


# -- rules -----------------------------------------------------------------------------------------


def files_where(files: DataFrame, rule: str, severity: str, condition: Column) -> DataFrame:
    return files.where(condition).select("repo", "file", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("int").alias("line"))


def _classes_where(files: DataFrame, rule: str, severity: str, condition) -> DataFrame:
    c = F.col("c")
    each = files.select("repo", "file", F.explode("classes").alias("c")).where(condition(c))
    return each.select("repo", "file", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("c.name").alias("subject"), F.col("c.line").alias("line"))


def _any_class(condition) -> Column:
    return F.coalesce(F.exists("classes", condition), F.lit(False))


def rules(files: DataFrame) -> dict[str, DataFrame]:
    """Issues by rule, each (repo, file, rule, severity, subject, line). A rule may report a file and each offending class in it."""
    many, wide = (lambda c: c["n_methods"] > METHODS), (lambda c: c["n_properties"] > PROPERTIES)
    complexity = m("cyclomatic_complexity")
    return {
        "god_class": files_where(files, "AP-GOD_CLASS", "high", _any_class(lambda c: many(c) | wide(c)) | (F.coalesce(m("lines_of_code"), F.lit(0.0)) > LINES) & (F.size("classes") > 0))
        .unionByName(_classes_where(files, "AP-GOD_CLASS", "high", many)).unionByName(_classes_where(files, "AP-GOD_CLASS", "high", wide)),
        "god_method": _classes_where(files, "AP-GOD_METHOD", "high", lambda c: c["complexity"] > COMPLEXITY),
        "feature_envy": files_where(files, "AP-FEATURE_ENVY", "medium", _any_class(lambda c: (c["complexity"] > 2) & (c["n_methods"] > 0))),
        "CC001": files_where(files, "CC001", "high", complexity > FILE_COMPLEXITY),
        "AP001": _classes_where(files, "AP001", "high", many),
    }


def issues(files: DataFrame, added: dict | None = None) -> DataFrame:
    """Issues of all rules; ``added`` are further ones by name: functions of the files that give rows as :func:`rules` does, in place of a rule of the same name."""
    out = None
    for found in {**rules(files), **{k: f(files) for k, f in (added or {}).items()}}.values():
        out = found if out is None else out.unionByName(found)
    return out


def co_changes(changes: DataFrame, group: str, item: str, most: int) -> DataFrame:
    """Groups (changes) that touch more than ``most`` distinct items."""
    return changes.groupBy(group).agg(F.countDistinct(item).alias("n_items")).where(F.col("n_items") > most)


def recommendations(file_score: DataFrame, found: DataFrame) -> DataFrame:
    """Per file with a dimension below 70: its worst one (of equal ones the first by name), and its number of severe issues."""
    dims = sorted(DIMENSIONS)
    worst = F.array_min(F.array(*[F.struct(F.col(d).alias("score"), F.lit(d).alias("dimension")) for d in dims]))
    severe = found.where("severity IN ('high', 'critical')").groupBy("repo", "file").agg(F.count(F.lit(1)).alias("n_severe"))
    return file_score.select("repo", "file", worst.alias("w")).where("w.score < 70").join(severe, ["repo", "file"], "left").select("repo", "file", "w.dimension", "w.score", F.coalesce("n_severe", F.lit(0)).alias("n_severe"))


def score_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, file, before, after, delta) over the files of either side; a missing side is null."""
    a, b = before.select("repo", "file", F.col("total").alias("before")), after.select("repo", "file", F.col("total").alias("after"))
    return a.join(b, ["repo", "file"], "full").select("repo", "file", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def project_score(files: DataFrame) -> DataFrame:
    """(repo, score): total scores of the files weighted by their lines; files without metrics do not count."""
    some = files.where("metrics IS NOT NULL")
    both = file_scores(some).withColumnRenamed("total", "score").join(some.select("repo", "file", F.col("metrics.lines_of_code").alias("weight")), ["repo", "file"])
    return weighted(both, ["repo"])


def project_delta(parses: DataFrame, late: Column) -> DataFrame:
    """(repo, before, after, delta, n_changed): a project's score by the parses that are not ``late``, by all of them, and the files with late ones."""
    state = lambda df: project_score(latest(df, ["repo", "file"], ["parsed_at", "ingested_at", "parse_id"]))
    before = state(parses.where(~late)).withColumnRenamed("score", "before")
    changed = parses.where(late).groupBy("repo").agg(F.countDistinct("file").alias("n_changed"))
    out = state(parses).withColumnRenamed("score", "after").join(before, "repo", "left").join(changed, "repo", "left").fillna(0, ["n_changed"])
    return out.select("repo", "before", "after", (F.col("after") - F.col("before")).alias("delta"), "n_changed")


# -- rules on texts --------------------------------------------------------------------------------


def breaks_layer(file: Column, code: Column) -> Column:
    """Whether the code of a file named after a layer uses what is not the layer's."""
    hits = [F.contains(F.lower(file), F.lit(layer)) & code.rlike("|".join(words)) for layer, words in LAYERS.items()]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return F.coalesce(out, F.lit(False))


def duplicates(files: DataFrame, key: str, text: str, lines: int = 6, similarity: float = 0.8) -> DataFrame:
    """(key, shingles, shared): files of whose distinct runs of ``lines`` lines (trimmed, without their mark; blank ones left out) a share of
    at least ``similarity`` stands in another file as well. Files are not paired: a run costs its number of files. Shorter and null texts give no row."""
    kept = F.filter(F.transform(F.split(text, "\n", -1), lambda s: F.trim(F.substring(s, 2, 2**31 - 1))), lambda s: s != "")
    rows = files.where(F.col(text).isNotNull()).select(key, kept.alias("__l")).where(F.size("__l") >= lines)
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("__l") - lines + 1), lambda i: F.array_join(F.slice("__l", i, lines), "\n")))
    each = rows.select(key, F.explode(runs).alias("__s")).select(key, F.xxhash64("__s").alias("__x"), F.xxhash64(F.lit(1), "__s").alias("__y")).distinct()
    held = each.groupBy("__x", "__y").agg(F.count(F.lit(1)).alias("__n"))
    sums = each.join(held, ["__x", "__y"]).groupBy(key).agg(F.count(F.lit(1)).alias("shingles"), F.count_if(F.col("__n") > 1).alias("shared"))
    return sums.where(F.col("shared") >= similarity * F.col("shingles"))


def gate(requests: DataFrame, changes: DataFrame, recorded: DataFrame, key: str, file: str) -> DataFrame:
    """(key, passed, files): each request with the changed files that no record covers, and whether there are none. ``changes``: key, file; ``recorded``: file."""
    missing = changes.join(recorded.where(F.col(file).isNotNull()).distinct(), file, "left_anti").groupBy(key).agg(F.array_sort(F.collect_set(file)).alias("files"))
    none = F.array().cast("array<string>")
    return requests.join(missing, key, "left").select(key, F.col("files").isNull().alias("passed"), F.coalesce("files", none).alias("files"))
