"""Expressions on vectors (arrays of float or double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.numbers import base36, hash32, int32, js_round, let


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0."""
    return F.try_divide(dot(a, b), F.nullif(norm(a) * norm(b), F.lit(0.0)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def distance(a: Column, b: Column, space: str) -> Column:
    """'cosine', 'l2' (squared) or 'ip': smaller is nearer."""
    return {"cosine": lambda: 1 - cosine(a, b), "l2": lambda: F.pow(l2(a, b), F.lit(2.0)), "ip": lambda: 1 - dot(a, b)}[space]()


def quantise_binary(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x >= 0, 1).otherwise(-1))


def quantise_uniform(v: Column, bits: int) -> Column:
    """Each component to the nearest of 2**bits levels from -1 to 1, as its number; half way goes up."""
    top = float(2**bits - 1)
    return F.transform(doubles(v), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(top), js_round((x + 1) / 2 * top))).cast("int"))


def dequantise_uniform(codes: Column, bits: int) -> Column:
    return F.transform(codes, lambda c: c / float(2**bits - 1) * 2 - 1)


#: fixed values: bits a component and compression against 32-bit floats
LEVELS = {"none": (32, 1), "pq8": (8, 4), "pq4": (4, 8), "binary": (1, 32), "rabitq": (1, 32)}


def hash_vector(v: Column, dims: int = 100) -> Column:
    """A rolling 32-bit hash of the first components in thousandths, in base 36."""
    thousandths = F.transform(F.slice(doubles(v), 1, dims), lambda x: js_round(x * 1000).cast("bigint"))
    return base36(F.aggregate(thousandths, F.lit(0).cast("bigint"), lambda h, c: int32(h * 31 + c)))


def embed(text: Column, dims: int) -> Column:
    """A unit vector derived from the text's hash (not from its meaning), in single precision."""
    place = F.sequence(F.lit(0), F.lit(dims - 1))

    def unit(seed: Column) -> Column:
        raw = F.transform(place, lambda i: F.sin(seed + i) * 10000)
        return let(F.transform(raw, lambda x: (x - F.floor(x)).cast("float")), lambda f: let(norm(f), lambda n: F.transform(f, lambda x: (x.cast("double") / n).cast("float"))))

    return let(hash32(text).cast("double"), unit)


def max_similarity(v: Column, chosen: Column) -> Column:
    """Greatest cosine to any of an array of vectors, 0 at least."""
    return F.aggregate(chosen, F.lit(0.0), lambda m, c: F.greatest(m, F.coalesce(cosine(v, c), F.lit(0.0))))


def mean_vector(vectors: Column) -> Column:
    """Component-wise mean of an array of vectors of one length."""
    total = F.aggregate(F.slice(vectors, 2, 1_000_000), doubles(vectors[0]), lambda s, v: F.zip_with(s, doubles(v), lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(vectors))
