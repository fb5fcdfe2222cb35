"""Scalar expressions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO31, TWO32 = 2**31, 2**32


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row; nested expressions would otherwise repeat it at each use."""
    return F.transform(F.array(value), body)[0]


def js_round(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + F.lit(0.5))


def int32(x: Column) -> Column:
    """A bigint wrapped to 32 bits, as bigint."""
    return F.pmod(x + F.lit(TWO31), F.lit(TWO32)) - F.lit(TWO31)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def hash32(text: Column) -> Column:
    """The rolling hash h * 31 + unit over UTF-16 units, wrapped to 32 bits at each step, without its sign."""
    point = lambda ch: F.ascii(ch).cast("bigint")  # noqa: E731  (the code point)
    high = lambda p: F.lit(0xD800) + F.shiftright(p - 0x10000, 10)
    low = lambda p: F.lit(0xDC00) + F.pmod(p - 0x10000, F.lit(1024))
    units = F.flatten(F.transform(F.split(text, ""), lambda ch: F.when(point(ch) < 0x10000, F.array(point(ch))).otherwise(F.array(high(point(ch)), low(point(ch))))))
    return F.abs(F.aggregate(F.when(text == "", F.array().cast("array<bigint>")).otherwise(units), F.lit(0).cast("bigint"), lambda h, c: int32(h * 31 + c)))


def base36(x: Column) -> Column:
    """A signed bigint in base 36, in lower case."""
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lower(F.conv(F.abs(x).cast("string"), 10, 36)))


def lcg(seed: Column, n: int, scale) -> Column:
    """``n`` values of h = h * 1664525 + 1013904223 (32 bits) from ``seed``, each through ``scale``."""
    start = F.struct(int32(seed).alias("h"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        h = int32(acc["h"] * 1664525 + 1013904223)
        return F.struct(h.alias("h"), F.concat(acc["out"], F.array(scale(h.cast("double") / 4294967295.0))).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda acc: acc["out"])


def normal_cdf(x: Column) -> Column:
    """A five-term polynomial of the normal distribution function (error below 1e-7)."""
    # fixed values: coefficients of the approximation
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + p * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = (poly + c) * t
    tail = F.lit(0.3989422804014327) * F.exp(-x * x / 2) * poly
    return F.when(x > 0, 1 - tail).otherwise(tail)


def two_proportion_z(a: Column, b: Column, n: Column) -> Column:
    """z of b against a with the pooled share (a + b) / 2; null where the error is 0."""
    pooled = (a + b) / 2
    return F.try_divide(F.abs(b - a), F.nullif(F.sqrt(pooled * (1 - pooled) * 2 / n), F.lit(0.0)))


def two_sided_p(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def ci95(a: Column, b: Column, n: Column) -> Column:
    """struct(lo, hi) of b - a."""
    half = 1.96 * F.sqrt((a * (1 - a) + b * (1 - b)) / n)
    return F.struct((b - a - half).alias("lo"), (b - a + half).alias("hi"))


def percent_delta(baseline: Column, current: Column) -> Column:
    """Change in percent; null where the baseline is 0."""
    return F.try_divide((current - baseline) * 100, F.nullif(baseline, F.lit(0.0)))


def severity(delta: Column, lower_is_better: Column, warning: float = 5.0, critical: float = 10.0) -> Column:
    """'critical', 'warning' or null, by the change in the bad direction."""
    worse = F.when(lower_is_better, delta).otherwise(-delta)
    return F.when(worse >= critical, "critical").when(worse >= warning, "warning")


def backoff(attempt: Column, kind: Column, base: float, most: float) -> Column:
    wait = F.when(kind == "exponential", base * F.pow(F.lit(2.0), attempt)).when(kind == "linear", base * (attempt + 1)).otherwise(F.lit(base))
    return F.least(wait, F.lit(most))


def maintainability(loc: Column, complexity: Column, volume: Column) -> Column:
    """The maintainability index, 0 at least; null where volume or lines are not above 0."""
    index = 171 - 5.2 * F.ln(volume) - 0.23 * complexity - 16.2 * F.ln(loc)
    return F.when((volume > 0) & (loc > 0), F.greatest(F.lit(0.0), index))


def softmax(scores: Column) -> Column:
    """Of an array of doubles, against overflow; null for a null or empty array."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    powers = lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
    shares = lambda s: let(powers(s), lambda p: let(total(p), lambda n: F.transform(p, lambda x: x / n)))
    return let(scores, lambda s: F.when(F.size(s) > 0, shares(s)))


def spread_penalty(scores: Column, lam: float = 0.1) -> Column:
    """Each score less lam times its deviation from the mean in population standard deviations."""
    mean = lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s)
    spread = lambda s, m: F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(s))
    less = lambda s: let(mean(s), lambda m: let(spread(s, m), lambda d: F.transform(s, lambda x: x - lam * (x - m) / (d + 1e-8))))
    return let(scores, lambda s: F.when(F.size(s) > 0, less(s)))
