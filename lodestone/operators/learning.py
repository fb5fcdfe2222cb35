"""Low-rank weights, parameter importance and trajectories, as arrays of doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.numbers import hash32, lcg
from lodestone.functions.text import overlap

# fixed values: scale of low-rank weights by mode
MODE_SCALE = {"convergent": 1.0, "divergent": 1.2, "lateral": 1.1, "systems": 1.3, "critical": 0.9}


# fixed values: mean Fisher value above which a pattern is protected, rank and width of an expert's weights, and shifts of their seeds
PROTECTED_FISHER, RANK, WIDE, SHIFTS = 0.5, 64, 384, {"a": 0, "b": 1000, "scales": 2000}
WEIGHTS = 2 * RANK * WIDE


def lora_weights(names: DataFrame, name: str) -> DataFrame:
    """(name, part, pos, v): all weights generated from a name, parts 'a' and 'b' of RANK x WIDE and 'scales' of WIDE, row by row. Null names give none."""
    seeds = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), hash32(F.col(name)).alias("seed")).distinct()

    def run(batches):
        for batch in batches:
            for n, seed in zip(batch["name"], batch["seed"], strict=True):
                for part, shift in SHIFTS.items():
                    h, out = seed + shift, []
                    for _ in range(WIDE if part == "scales" else RANK * WIDE):
                        h = (h * 1664525 + 1013904223 + 2**31) % 2**32 - 2**31
                        out.append(h / 4294967295)
                    x = np.array(out)
                    yield pd.DataFrame({"name": n, "part": part, "pos": np.arange(len(x)), "v": x * 0.5 + 0.75 if part == "scales" else (x * 2 - 1) * 0.01})

    return seeds.mapInPandas(run, "name string, part string, pos bigint, v double")


def by_position(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``left`` with ``z``: pairs of the elements of its array ``a`` and of the array ``b`` of ``right`` (one row per key), to the shorter one."""
    joined = left.join(right, key)
    n = F.least(F.size(a), F.size(b))
    return joined.withColumn("z", F.arrays_zip(F.slice(a, F.lit(1), n).alias(a), F.slice(b, F.lit(1), n).alias(b)))


def weights(name: Column, n: int) -> Column:
    """``n`` small weights generated from a name: from -0.02 to 0."""
    return lcg(hash32(name), n, lambda x: (x * 2 - 1) * 0.01)


def scales(name: Column, n: int) -> Column:
    """``n`` scales generated from a name: from 0.5 to 1."""
    return lcg(hash32(name), n, lambda x: x * 0.5 + 0.75)


def scale_by_mode(values: Column, mode: Column) -> Column:
    factor = F.coalesce(*[F.when(mode == k, F.lit(v)) for k, v in MODE_SCALE.items()], F.lit(1.0))
    return F.transform(values, lambda v: v * factor)


def flatten_parts(a: Column, b: Column, s: Column) -> Column:
    return F.concat(F.flatten(a), F.flatten(b), s)


def gradients(params: Column, reward: Column, id_length: Column) -> Column:
    """abs(p) * 0.1 * reward + (sin(length of id + i) - 0.5) * 0.2."""
    return F.transform(params, lambda p, i: F.abs(p) * 0.1 * reward + (F.sin((id_length + i).cast("double")) - 0.5) * 0.2)


def fisher(grads: Column, reward: Column | None = None) -> Column:
    return F.transform(grads, lambda g: g * g if reward is None else g * g * (1 + reward))


def fisher_ema(old: Column, grads: Column) -> Column:
    return F.zip_with(old, grads, lambda f, g: 0.9 * f + 0.1 * g * g)


def importance(reward: Column, id_length: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.greatest(F.lit(0.0), 0.5 * reward + 0.5 + 0.1 * F.sin((id_length + i).cast("double"))))


def importance_summary(rows: DataFrame, reward: str, id_length: str, n: int) -> DataFrame:
    """``rows`` with ``mean``, ``least`` and ``greatest`` of :func:`importance` over ``n`` positions.

    The waves of a length of id are taken once; the reward shifts them, and only where that leads below 0 is an array written out.
    """
    waves = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: 0.1 * F.sin((F.col("__n") + i).cast("double")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    known = rows.select(F.col(id_length).alias("__n")).distinct().withColumn("__w", waves)
    known = known.select("__n", total("__w").alias("__mean"), F.array_min("__w").alias("__least"), F.array_max("__w").alias("__greatest"))
    base = 0.5 * F.col(reward) + 0.5
    both = rows.join(known, F.col(id_length) == F.col("__n"))
    mean = F.when(base + F.col("__least") >= 0, base + F.col("__mean")).otherwise(total(importance(F.col(reward), F.col(id_length), n)))
    floor = lambda c: F.greatest(F.lit(0.0), base + F.col(c))
    return both.select(*[F.col(c) for c in rows.columns], mean.alias("mean"), floor("__least").alias("least"), floor("__greatest").alias("greatest"))


def ewc_loss(current: DataFrame, anchors: DataFrame, lam: float = 10.0) -> DataFrame:
    """(key, loss): half the sum of lam * fisher * (current - anchor)^2 over the positions both have.

    ``current``: key, params; ``anchors``: key, params, fisher. Position-wise within a row after an equi-join.
    """
    joined = current.join(anchors.select("key", F.col("params").alias("anchor"), "fisher"), "key")
    n = F.least(F.size("params"), F.size("anchor"), F.size("fisher"))
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at("fisher", i) * F.pow(F.element_at("params", i) - F.element_at("anchor", i), F.lit(2.0)))
    return joined.select("key", F.when(n > 0, 0.5 * lam * F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0).alias("loss"))


def apply_lora(base: DataFrame, a: DataFrame, b: DataFrame, scale: DataFrame, alpha: float, rank: int) -> DataFrame:
    """(i, j, v) of base + alpha / rank * scale_i * (B A), matrices in long form (i, j, v) and scale (i, s); absent cells count 0."""
    low = b.select("i", F.col("j").alias("r"), F.col("v").alias("bv")).join(a.select(F.col("i").alias("r"), "j", F.col("v").alias("av")), "r")
    low = low.groupBy("i", "j").agg(F.sum(F.col("bv") * F.col("av")).alias("d")).join(scale, "i")
    out = base.join(low, ["i", "j"], "full")
    return out.select("i", "j", (F.coalesce("v", F.lit(0.0)) + alpha / rank * F.coalesce(F.col("s") * F.col("d"), F.lit(0.0))).alias("v"))


def judge(trajectories: DataFrame, patterns: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(id, success, support, pattern): success by reward, and the pattern of the same domain whose text overlaps most.

    ``trajectories``: id, domain, text, reward; ``patterns``: pattern, domain, text. Of equal overlaps the smaller pattern.
    """
    pairs = trajectories.join(patterns.select("domain", "pattern", F.col("text").alias("ptext")), "domain", "left")
    scored = pairs.withColumn("o", F.round(overlap(F.col("text"), F.col("ptext")), 9))
    best = scored.groupBy("id").agg(F.max("reward").alias("reward"), F.max("o").alias("support"), F.min_by("pattern", F.struct((-F.col("o")).alias("a"), F.col("pattern").alias("b"))).alias("pattern"))
    return best.select("id", (F.coalesce("reward", F.lit(0.0)) >= threshold).alias("success"), F.coalesce("support", F.lit(0.0)).alias("support"), "pattern")


def top_of_domain(memory: DataFrame, domain: str, k: int) -> DataFrame:
    """The ``k`` best rewarded consolidated entries of a domain, of equal ones those with the smaller id."""
    return memory.where((F.col("metadata.domain") == domain) & F.col("consolidated")).orderBy(F.desc_nulls_last("reward"), "id").limit(k)


def transfer(memory: DataFrame, source: str, target: str, k: int = 50) -> DataFrame:
    """``memory`` (id, reward, consolidated, metadata) with the best entries of a domain added to another, under new ids and not consolidated: (id, domain, moved_from, reward, consolidated)."""
    kept = memory.select("id", F.col("metadata.domain").alias("domain"), F.lit(None).cast("string").alias("moved_from"), "reward", "consolidated")
    moved = top_of_domain(memory, source, k).select(F.concat(F.lit("transfer-"), "id").alias("id"), F.lit(target).alias("domain"), F.lit(source).alias("moved_from"), "reward", F.lit(False).alias("consolidated"))
    return kept.unionByName(moved)
