"""Mixing sources to target shares of tokens, by entropy balancing.

Among all document rates that give a source its target tokens, those closest to taking every document once
(in relative entropy) are exponential in the document's size: min(max_repeats, exp(lambda * size)). The one
multiplier per source of a mix is the solution of a convex dual; Newton steps find it, each from sums that
the cluster takes over (source, size) frequencies. Rates are then rounded into whole copies, carrying the
fractions from size to size so that a source's total stays within about one document of its target.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.measures import token_size
from lodestone.operators.ranking import index_within
from lodestone.plans.shared import stage

TOLERANCE, MOST_STEPS = 1e-6, 60
RATES = "row_id long, lam double, cap double, scale double"


def _key(c: str):
    return F.lower(F.trim(F.col(c)))


class Mix:
    """The solved mixing problem: ``documents()``, the copies of each, and ``shares()``, what was reached.

    ``docs`` needs ``id_col``, ``source`` and ``size`` columns; ``targets`` needs ``mix_id, source, weight,
    max_repeats, budget_ratio``. Sources are compared without outer spaces and in lower case. Rows without a
    weight above 0 take no part; a null ``budget_ratio`` counts 1, a null or negative ``max_repeats`` 0.
    Repeated rows of a mix are separate rows. Documents without a source count towards the total only;
    documents of size 0 get no copies. ``targets`` is a configuration: its rows are held by the driver.
    """

    def __init__(self, docs: DataFrame, id_col: str, source: str, size, targets: DataFrame, salts: int = 64):
        spark = docs.sparkSession
        self.salts = salts
        sized = docs.select(F.col(id_col).alias("doc_id"), _key(source).alias("src"), size.cast("long").alias("size"))
        self.sized = stage(sized, "mix-sizes")
        hist = self.sized.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n"))
        self.hist = stage(hist, "mix-frequencies", files=max(1, min(8, spark.sparkContext.defaultParallelism)))
        total = self.hist.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).cast("double")).scalar()
        within = Window.partitionBy("mix_id")
        rows = targets.where("weight > 0").select(
            "mix_id", "source", _key("source").alias("src"), F.col("weight").cast("double").alias("weight"),
            F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("double").alias("cap"),
            F.coalesce("budget_ratio", F.lit(1.0)).cast("double").alias("ratio"),
        )
        rows = rows.withColumn("target", F.col("weight") / F.sum("weight").over(within) * F.col("ratio") * total)
        sums = self.hist.where("src IS NOT NULL").groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("tokens"), F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")).alias("squares"))
        rows = rows.join(sums, "src", "left").fillna(0, ["tokens", "squares"])
        self.rows = rows.orderBy("mix_id", "source", "weight", "cap").collect()
        self.rates = self._solve(spark)

    def _solve(self, spark: SparkSession) -> list[tuple[int, float, float, float]]:
        """(row, lambda, cap, scale) of every row that takes documents; rate = min(cap, exp(lambda * size / scale))."""
        state: dict[int, dict] = {}
        for i, r in enumerate(self.rows):
            if r.tokens and r.cap > 0:
                scale = r.squares / r.tokens  # the mean size of a token's document
                if r.target >= r.cap * r.tokens:  # the dual has no finite solution: all rates at their bound
                    state[i] = {"lam": math.inf, "cap": r.cap, "scale": scale, "done": True}
                else:
                    # sizes are 1 at least, so the solution lies between the rates that no document, and that all, would pass
                    lo, hi = scale * min(0.0, math.log(r.target / r.tokens)) - 1, scale * max(0.0, math.log(r.cap)) + 1
                    state[i] = {"lam": min(hi, max(lo, math.log(r.target / r.tokens))), "cap": r.cap, "scale": scale, "lo": lo, "hi": hi, "done": False}
        for step_no in range(MOST_STEPS + 1):
            open_rows = [(i, s["lam"], s["cap"], s["scale"]) for i, s in state.items() if not s["done"]]
            if not open_rows:
                break
            if step_no == MOST_STEPS:
                raise RuntimeError(f"{len(open_rows)} rows of the mixes not solved in {MOST_STEPS} steps, the first of them {self.rows[open_rows[0][0]].mix_id} {self.rows[open_rows[0][0]].source}")
            for got in self._rated(spark, open_rows).groupBy("row_id").agg(F.sum(F.col("n") * F.col("size") * F.col("w")).alias("value"), F.sum(F.when(F.col("w") < F.col("cap"), F.col("n") * F.col("size") * F.col("size") * F.col("w") / F.col("scale")).otherwise(0.0)).alias("slope")).collect():
                s, target = state[got.row_id], self.rows[got.row_id].target
                if abs(got.value - target) <= TOLERANCE * target:
                    s["done"] = True
                    continue
                s["lo" if got.value < target else "hi"] = s["lam"]
                # a Newton step on the logarithm of the dual's gradient; the bracket is halved where that leaves it, and in the second half of the steps
                step = s["lam"] + (math.log(target / got.value) * got.value / got.slope if got.slope > 0 and got.value > 0 else math.inf)
                s["lam"] = step if s["lo"] < step < s["hi"] and step_no < MOST_STEPS // 2 else (s["lo"] + s["hi"]) / 2
        return [(i, min(s["lam"], 1e300), s["cap"], s["scale"]) for i, s in state.items()]

    def _rated(self, spark: SparkSession, rates: list[tuple]) -> DataFrame:
        """Frequencies of the rows' sources with the rate ``w`` of each size."""
        lam = spark.createDataFrame([(*r, self.rows[r[0]].src) for r in rates], RATES + ", src string")
        power = F.least(F.log("cap"), F.when(F.col("lam") > 1e200, F.log("cap")).otherwise(F.col("lam") * F.col("size") / F.col("scale")))
        # one row per row of the mixes' configuration, which the driver holds
        return self.hist.where("src IS NOT NULL AND size > 0").join(F.broadcast(lam), "src").withColumn("w", F.when(power >= F.log("cap"), F.col("cap")).otherwise(F.exp(power)))

    def _plan(self, spark: SparkSession) -> DataFrame:
        """Copies ``m`` in all for the ``n`` documents of a size in a row's source."""
        rated = self._rated(spark, self.rates) if self.rates else self._rated(spark, [])
        by = Window.partitionBy("row_id").orderBy(F.desc("size"))
        ideal = F.sum(F.col("n") * F.col("w")).over(by.rowsBetween(Window.unboundedPreceding, 0))
        upto = F.floor(ideal + 0.5 + 1e-7)
        return rated.withColumn("__upto", upto).withColumn("m", F.col("__upto") - F.coalesce(F.lag("__upto").over(by), F.lit(0)))

    def _row_table(self, spark: SparkSession) -> DataFrame:
        fields = "row_id long, mix_id string, source string, target double, source_tokens long"
        return spark.createDataFrame([(i, r.mix_id, r.source, float(r.target), int(r.tokens)) for i, r in enumerate(self.rows)], fields)

    def shares(self, spark: SparkSession) -> DataFrame:
        """One row per row of ``targets`` with a weight: target and reached tokens and shares, and ``capped``, whether the
        solved rates are all at their bound (or there is nothing to take) and still give fewer tokens than the target."""
        reached = self._plan(spark).groupBy("row_id").agg(
            F.sum(F.col("m") * F.col("size")).alias("tokens"), F.sum("m").alias("copies"),
            F.sum(F.col("n") * F.col("size") * F.col("w")).alias("rated"), F.bool_and(F.col("w") >= F.col("cap")).alias("bound"),
        )
        mix = Window.partitionBy("mix_id")
        share = lambda c: F.try_divide(F.col(c).cast("double"), F.sum(c).over(mix))
        out = self._row_table(spark).join(reached, "row_id", "left").fillna(0, ["tokens", "copies"])
        capped = F.coalesce("bound", F.lit(True)) & (F.coalesce("rated", F.lit(0.0)) < F.col("target"))
        return out.select(
            "mix_id", "source", F.col("target").alias("target_tokens"), "source_tokens", "tokens", "copies",
            share("target").alias("target_share"), share("tokens").alias("share"), capped.alias("capped"),
        )

    def documents(self, spark: SparkSession) -> DataFrame:
        """(mix_id, source, doc_id, size, copies) of every document with at least one copy in a mix."""
        plan = self._plan(spark).join(F.broadcast(self._row_table(spark).select("row_id", "mix_id", "source")), "row_id").select("mix_id", "source", "src", "size", "n", "m")
        numbered = index_within(self.sized.where("src IS NOT NULL AND size > 0"), ["src", "size"], F.col("doc_id"), "idx", self.salts)
        copies = F.expr("m div n + if(idx < m % n, 1, 0)")
        return numbered.join(plan, ["src", "size"]).select("mix_id", "source", "doc_id", "size", copies.cast("int").alias("copies")).where("copies > 0")


def solve(docs: DataFrame, targets: DataFrame) -> Mix:
    return Mix(docs, "doc_id", "source", token_size(F.col("text")), targets)


def shares(docs: DataFrame, targets: DataFrame) -> DataFrame:
    return solve(docs, targets).shares(docs.sparkSession)


def mixed(docs: DataFrame, targets: DataFrame) -> DataFrame:
    return solve(docs, targets).documents(docs.sparkSession)


def found(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of the mixes that cannot reach their target within their repeats."""
    return shares(docs, targets).where("capped").select("mix_id", "source")
