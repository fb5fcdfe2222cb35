"""Generated, minified, bundled, vendored and data files among parsed sources.

File contents are not kept, so the layout statistics are those of the parser's metrics: the Halstead volume of
a line stands for mean line length (a minified line carries thousands of times the usual volume), the shares of
blank and of comment lines for white space, functions a line for hand-written structure. Each is taken against
the files of its language, all of them: as a deviation from their median in units of their own spread (the middle
half, which a minority of machine-made files does not move) and of the noise of so many lines. What the layout does not tell, as it
is that of hand-written code (third-party copies, and tool output that looks like it), paths and bundlers' imports name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.shared import stage

# fixed values: folder names under which third-party code or tool output is kept
VENDOR_DIRS = (
    "node_modules", "bower_components", "jspm_packages", "vendor", "vendored", "vendors", "third_party", "third-party", "thirdparty", "3rdparty",
    "3rd_party", "external", "extern", "externals", "pods", "carthage", "godeps", "site-packages", "dist-packages", "_vendor", "contrib_vendored",
)
OUTPUT_DIRS = ("generated", "__generated__", "_generated", "gen", "autogen", "codegen_out", "generated-sources", "generated-src", "dist", ".next", "__pycache__")
GENERATED_NAMES = r"(\.(generated|gen|g|pb|pb\.gw|designer|freezed|min-gen)\.[a-z]+|(_pb2?|_pb2_grpc|_generated|\.pb2|_grpc_pb|_string_gen)\.[a-z]+)$"
MINIFIED_NAMES = r"([.-]min|\.prod|\.bundle|[.-]bundle\.min|\.chunk|-packed)\.(js|mjs|cjs|css|jsx|ts|tsx)$"
#: A versioned copy of a library among a site's static files.
STATIC_COPY = r"(^|/)(static|assets|public|wwwroot)/(.*/)?[^/]*-[0-9]+\.[0-9]+(\.[0-9]+)?\.(js|mjs|css)$"
#: Run-time modules that bundlers put their output on; nobody imports them by hand.
BUNDLER_IMPORT = r"^(__bundler_runtime__|__webpack_|webpack/runtime/|\u0000)"
#: Deviations from which a file's lines are too full, and its layout (comments, blank lines and functions together, with few comments) too bare.
DENSE, BARE, FEW_COMMENTS = 5.0, 7.0, -0.8
#: Languages with fewer files are measured against all files.
LEAST_FILES = 50
STATS = ("volume", "blank", "comments", "functions")


def latest(parses: DataFrame, *columns: str) -> DataFrame:
    """One row per (``repo``, ``file``) as delivered: its latest parse by ``parsed_at``, then ``ingested_at``, then ``parse_id``; nulls come first."""
    newest = F.max_by(F.struct(*columns), F.struct("parsed_at", "ingested_at", "parse_id"))
    return parses.groupBy("repo", "file").agg(newest.alias("__p")).select("repo", "file", "__p.*")


def latest_known(parses: DataFrame, *columns: str) -> DataFrame:
    """One row per (``repo``, ``file``): of each column the latest value that is not null, in the order of :func:`latest`."""
    order = F.struct("parsed_at", "ingested_at", "parse_id")
    return parses.groupBy("repo", "file").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def path(file: Column) -> Column:
    """With forward slashes and without a leading './'."""
    return F.regexp_replace(F.translate(file, "\\", "/"), r"^(\./)+", "")


def language_of(file: Column, language: Column, ext_language: Column) -> Column:
    """The extension's language where it is known, else the one reported, else 'unknown'."""
    said = F.lower(F.trim(language))
    return F.coalesce(ext_language, F.when(said != "", said), F.lit("unknown"))


def with_language(df: DataFrame, lang_ext: DataFrame) -> DataFrame:
    """Adds ``lang``. ``lang_ext`` is a fixed table of a few extensions."""
    known = lang_ext.groupBy(F.lower(F.trim("ext")).alias("__ext")).agg(F.min(F.lower(F.trim("language"))).alias("__lang")).where("__ext IS NOT NULL")
    ext = F.lower(F.regexp_extract(path(F.col("file")), r"\.([A-Za-z0-9]+)$", 1))
    joined = df.withColumn("__e", ext).join(F.broadcast(known), F.col("__e") == F.col("__ext"), "left")
    return joined.withColumn("lang", language_of(F.col("file"), F.col("language"), F.col("__lang"))).drop("__e", "__ext", "__lang")


def with_layout(files: DataFrame) -> DataFrame:
    """Adds ``dense`` and ``bare``, null without metrics, from ``lang``, ``metrics`` and ``n_functions``; and drops ``metrics``."""
    m = lambda c: F.coalesce(F.col(f"metrics.{c}").cast("double"), F.lit(0.0))
    code = F.greatest(m("lines_of_code"), F.lit(1.0))
    lines = F.greatest(m("lines_of_code") + m("blank_lines") + m("lines_of_comments"), F.lit(1.0))
    stats = {"volume": F.log(F.greatest(m("halstead_volume"), F.lit(1.0)) / code), "blank": m("blank_lines") / lines, "comments": m("lines_of_comments") / lines, "functions": F.coalesce("n_functions", F.lit(0)) / code}
    known = F.col("metrics").isNotNull()
    files = files.withColumns({**{f"__{k}": F.when(known, v) for k, v in stats.items()}, "__lines": lines, "__code": code}).drop("metrics")
    files = stage(files, "layout")  # read by the statistics and by what they are compared with

    quarters = lambda prefix: [F.percentile_approx(f"__{k}", [0.25, 0.5, 0.75], 10000).alias(f"{prefix}{k}") for k in STATS]  # noqa: E731  mergeable summaries
    per_lang = files.groupBy(F.col("lang").alias("__l")).agg(F.count("__volume").alias("__n"), *quarters("__l_")).where(F.col("__n") >= LEAST_FILES)
    # one row per language, and one row
    files = files.join(F.broadcast(per_lang), F.col("lang") == F.col("__l"), "left").crossJoin(F.broadcast(files.agg(*quarters("__all_"))))

    def deviation(k: str) -> Column:
        q = F.coalesce(f"__l_{k}", f"__all_{k}")
        spread = F.pow((q[2] - q[0]) / 1.349, F.lit(2.0))
        noise = F.lit(0.0) if k == "volume" else q[1] * (1 - F.least(q[1], F.lit(1.0))) / F.col("__code" if k == "functions" else "__lines")
        return F.try_divide(F.col(f"__{k}") - q[1], F.sqrt(spread + noise + 1e-12))

    z = files.withColumns({f"__z_{k}": deviation(k) for k in STATS})
    low = lambda k: F.pow(F.least(F.col(f"__z_{k}"), F.lit(0.0)), F.lit(2.0))
    bare = (low("comments") + low("blank") + F.pow("__z_functions", F.lit(2.0)) > BARE) & (F.col("__z_comments") < FEW_COMMENTS)
    return z.select(*[c for c in z.columns if not c.startswith("__")], (F.col("__z_volume") > DENSE).alias("dense"), bare.alias("bare"))


def classify(parses: DataFrame, lang_ext: DataFrame) -> DataFrame:
    """One row per (``repo``, ``file``): ``lang`` and ``origin``, which is 'vendored', 'generated', 'minified', 'data' or 'hand-written'.

    The layout decides first, then names. A null in the latest parse gives way to the latest value that is known; metrics or
    imports that are null in every parse leave the decision to the rest; a file with nothing against it is hand-written.
    Null repos and files are values like others. An empty table gives no rows.
    """
    files = with_layout(with_language(latest_known(parses, "language", "metrics", "imports", "n_functions"), lang_ext))

    at = F.concat(F.lit("/"), F.lower(path(F.col("file"))))
    inside = lambda names: F.arrays_overlap(F.slice(F.split(at, "/"), 1, F.greatest(F.size(F.split(at, "/")) - 1, F.lit(0))), F.array(*map(F.lit, names)))
    imports = lambda pattern: F.coalesce(F.exists("imports", lambda i: F.coalesce(i["source"], F.lit("")).rlike(pattern)), F.lit(False))
    bare, none = F.coalesce("bare", F.lit(False)), F.col("n_functions") == 0
    dense = F.coalesce("dense", F.lit(False))
    origin = (
        F.when(none & (dense | bare), "data").when(dense, "minified").when(bare, "generated")
        .when(inside(VENDOR_DIRS) | at.rlike(STATIC_COPY), "vendored")
        .when(inside(OUTPUT_DIRS) | at.rlike(GENERATED_NAMES), "generated")
        .when(at.rlike(MINIFIED_NAMES) | imports(BUNDLER_IMPORT), "minified")
        .otherwise("hand-written")
    )
    return files.select("repo", "file", "lang", origin.alias("origin"))


def found(parses: DataFrame, lang_ext: DataFrame) -> DataFrame:
    return classify(parses, lang_ext).where("origin <> 'hand-written'").select("repo", "file")


def by_repo(parses: DataFrame, lang_ext: DataFrame) -> DataFrame:
    """Files of each origin per repository and language."""
    return classify(parses, lang_ext).groupBy("repo", "lang", "origin").agg(F.count(F.lit(1)).alias("n_files"))
