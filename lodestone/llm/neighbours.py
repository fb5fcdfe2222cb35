"""The most similar vectors of every vector, with a forest of hash-prefix trees.

Every tree hashes a vector to a long string of bits (the sides of random hyperplanes) and keeps all vectors in
one array sorted by it, so that those sharing a prefix of any length stand together. For a given vector

1. the descent finds in every tree how many others share how long a prefix with it, the longest match first;
2. the ascent goes up in all trees at once, a bit at a time, to the deepest level at which the trees together hold
   enough candidates, and each tree gives its vectors sharing a prefix of that length;
3. products with the candidates, on vectors in half precision, leave the best of each tree, and those are compared
   again with exact products.

A candidate list is a stretch of the sorted array, at most ``width`` places to either side. The array is cut into
blocks by place, each with ``width`` places of its neighbours, so a result depends on no partitioning.

What was searched is known: a tree scanned down to prefixes of length d holds a vector of similarity s with
probability (1 - acos(s) / pi)^d. The number of trees follows from it for the number of vectors at hand, and a vector
whose trees together reach less than ``recall`` (a prefix group wider than the window, a crowd of near copies, or
neighbours too far to share prefixes) is compared with every entry, in blocks of exact products.

Vectors of one direction (equal up to a power of two, in single precision) form a class and stand in the trees once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranking import in_order
from lodestone.plans.shared import stage

#: Places a side that a tree may search, hash bits, and rows of a block of the sorted arrays.
WIDTH, BITS, ROWS = 2048, 128, 32768
#: Wanted share of the neighbours at least TRUSTED similar; below that similarity no number of trees is worth its place.
RECALL, TRUSTED = 0.9, 0.9
#: Prefix lengths are reported at so many counts a tree; depth of a tree that could not be searched to the end.
GRAINS, UNSEARCHED = 16, 999
#: Similar candidates a vector may meet in a tree; in a denser crowd the nearest are not told by prefixes. How far half precision may be off.
MOST, HALF = 128, 1e-3
#: Rows a side of a block product, its cells at a time, and how far a product in single precision may be off.
BLOCK, CELLS, SLACK = 32768, 1 << 24, 1e-6


def trees_for(n: int, similarity: float, recall: float, width: int) -> int:
    """Trees needed for ``n`` vectors: the ascent ends about where ``width`` of them share a prefix, at a depth of log2(n / width), and one bit is
    allowed for as hyperplanes do not halve a collection exactly."""
    depth = math.log2(max(n, 1) / width) + 1
    share = (1 - math.acos(similarity) / math.pi) ** max(0.0, depth)
    return 1 if share >= recall else math.ceil(math.log(1 - recall) / math.log(1 - share))


def hyperplanes(dim: int, trees: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * BITS)).astype(np.float32)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _codes(column, dim: int, kind=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), dim)


def usable(vector: Column, dim: int) -> Column:
    """Vectors of ``dim`` finite components that are not all equal."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & finite & (F.array_min(vector) < F.array_max(vector))


# -- classes -----------------------------------------------------------------------------------------


def _scaled(dim: int):
    """(kind, id, vector) to vectors in single precision, by a power of two below 1: no digit is lost and such multiples are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column("vector"), dim).astype(np.float64)
            raw = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]).astype(np.float32).tobytes()
            codes = pa.array([raw[i * dim * 4 : (i + 1) * dim * 4] for i in range(len(x))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("id"), codes], names=["kind", "id", "code"])

    return run


def _classes(entries: DataFrame, queries: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Classes (num, code, head: the smallest id of an entry in it) and members (kind, id, class)."""
    v = F.col("vector")
    every = entries.select(F.lit("entry").alias("kind"), "id", "vector").unionByName(queries.select(F.lit("query").alias("kind"), "id", "vector"))
    scaled = every.where(F.col("id").isNotNull() & usable(v, dim)).mapInArrow(_scaled(dim), "kind string, id string, code binary")
    vectors = stage(scaled.withColumn("hash", F.unhex(F.md5("code"))), "vectors")
    head = F.min(F.when(F.col("kind") == "entry", F.col("id")))
    classes = stage(vectors.groupBy("hash").agg(F.first("code").alias("code"), head.alias("head")).withColumn("num", F.monotonically_increasing_id()), "classes")
    return classes, vectors.select("kind", "id", "hash").join(classes.select("hash", F.col("num").alias("class")), "hash").drop("hash")


def _lists(members: DataFrame, pairs: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """Ranked lists of the members, from the neighbours of their classes (their own class among them) and the ids of those."""
    best = Window.partitionBy("a").orderBy(F.desc("similarity"), "neighbour")
    targets = pairs.join(heads.select(F.col("class").alias("b"), F.col("id").alias("neighbour")), "b")
    # one place more than k, as a member of the class may find itself among them
    targets = targets.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).groupBy("a").agg(F.array_sort(F.collect_list(F.struct("n", "neighbour", "similarity"))).alias("list"))
    sources = members.select("kind", "id", F.col("class").alias("a")).distinct().join(targets, "a")
    others = F.filter("list", lambda t: (F.col("kind") == "query") | (t["neighbour"] != F.col("id")))
    ranked = sources.select("kind", "id", F.posexplode(F.slice(others, 1, k)).alias("pos", "t"))
    return ranked.select("kind", "id", F.col("t.neighbour").alias("neighbour"), F.col("t.similarity").cast("float").alias("similarity"), (F.col("pos") + 1).alias("rank"))


# -- the forest --------------------------------------------------------------------------------------


def _hash(dim: int, trees: int):
    """(num, head, code) to unit vectors in half precision and the keys of each tree: two words of 64 bits that sort like the bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = hyperplanes(dim, trees)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _codes(batch.column("code"), dim).astype(np.float64)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            words = np.packbits((x @ planes) >= 0, axis=1).view(">u8").astype(np.uint64).reshape(n, trees, BITS // 64) ^ np.uint64(1 << 63)
            places = pa.array(np.arange(0, n * trees + 1, trees, dtype=np.int32))
            keys = [pa.ListArray.from_arrays(places, pa.array(np.ascontiguousarray(words[:, :, i]).view(np.int64).ravel())) for i in (0, 1)]
            raw = x.astype(np.float16).tobytes()
            half = pa.array([raw[i * dim * 2 : (i + 1) * dim * 2] for i in range(n)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("num"), pc.is_valid(batch.column("head")), half, *keys], names=["num", "target", "half", "hi", "lo"])

    return run


def _arrays(coded: DataFrame) -> DataFrame:
    """(tree, hi, lo, num, g): the sorted arrays of all trees one after another, with the place ``g`` of each row in them."""
    each = coded.select("num", F.posexplode(F.arrays_zip("hi", "lo")).alias("tree", "key")).select("tree", "key.hi", "key.lo", "num")
    # equal keys stand in another order in every tree
    return in_order(each, ["tree", "hi", "lo", F.xxhash64("tree", "num"), "num"], "g")


def _blocks(rows: DataFrame, width: int, size: int) -> DataFrame:
    """Rows by block of places, those within ``width`` of a border in both blocks; ``own`` tells where a row belongs."""
    b = F.expr(f"g div {size}")
    in_blocks = F.array_distinct(F.array(F.expr(f"greatest(0, g - {width}) div {size}"), b, F.expr(f"(g + {width}) div {size}")))
    return rows.select("*", F.explode(in_blocks).alias("block")).withColumn("own", F.col("block") == b)


def _leading(x: np.ndarray) -> np.ndarray:
    """Leading zero bits of words of 64 bits."""
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])


def _prefixes(t: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For prefix lengths from the longest down: (greatest length, smallest length, start, end) with the same groups at all lengths between."""
    n = t.num_rows
    word = lambda c: t.column(c).to_numpy().view(np.uint64)
    hi, lo, tree = word("hi"), word("lo"), t.column("tree").to_numpy()
    x, y = hi[1:] ^ hi[:-1], lo[1:] ^ lo[:-1]
    shared = np.where(tree[1:] != tree[:-1], -1, np.where(x != 0, _leading(x), 64 + _leading(y)))
    top, at = BITS, np.arange(n)
    for length in [*np.unique(shared)[::-1], -1]:
        if top > length:
            cut = shared <= length  # groups at lengths above ``length``
            start = np.maximum.accumulate(np.concatenate(([0], np.where(cut, at[1:], 0))))
            end = np.minimum.accumulate(np.concatenate((np.where(cut, at[1:], n), [n]))[::-1])[::-1]
            yield top, max(int(length) + 1, 0), start, end
        top = int(length)
        if top < 0:
            return


def _descend(width: int):
    """(num, levels): the greatest prefix lengths that a sixteenth, two, three ... of the window's places share with a vector; -1 beyond the tree."""
    grain = max(1, 2 * width // GRAINS)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("g").combine_chunks()
        at, own = np.arange(t.num_rows), np.flatnonzero(t.column("own").to_numpy(zero_copy_only=False))
        levels = np.full((len(own), GRAINS), -1, dtype=np.int16)
        for top, _, start, end in _prefixes(t):
            count = (np.minimum(end, at + width + 1) - np.maximum(start, at - width) - 1)[own]
            levels[(np.arange(GRAINS) < (count // grain)[:, None]) & (levels < 0)] = top
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, levels.size + 1, GRAINS, dtype=np.int32)), pa.array(levels.ravel()))
        return pa.table({"num": t.column("num").take(pa.array(own)), "g": t.column("g").take(pa.array(own)), "levels": lists})

    return run


def _gather(dim: int, width: int, keep: int, floor: float):
    """(a, b, depth): candidates of each vector in a block; and without ``b`` the prefix length down to which the tree was searched."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("g").combine_chunks()
        n, at = t.num_rows, np.arange(t.num_rows)
        own = np.flatnonzero(t.column("own").to_numpy(zero_copy_only=False))
        level, target, num = t.column("level").to_numpy(), t.column("target").to_numpy(zero_copy_only=False), t.column("num").to_numpy()
        first, last, depth = at.copy(), at + 1, np.full(n, UNSEARCHED, dtype=np.int32)
        for top, least, start, end in _prefixes(t):
            on = level <= top
            first[on], last[on] = np.maximum(start, at - width)[on], np.minimum(end, at + width + 1)[on]
            whole = on & (at - start < width) & (end - at < width)
            depth[whole] = np.maximum(level, least)[whole]
        x = _codes(t.column("half"), dim, np.float16).astype(np.float32)
        out_a, out_b = [], []
        for s in range(0, len(own), 256):
            rows = own[s : s + 256]
            lo, hi = first[rows].min(), last[rows].max()
            sims = x[rows] @ x[lo:hi].T
            a, b = np.nonzero(sims >= floor - HALF)
            i, j, sim = rows[a], b + lo, sims[a, b]
            ok = (j >= first[i]) & (j < last[i]) & (i != j) & target[j]
            i, j, sim = i[ok], j[ok], sim[ok]
            order = np.lexsort((-sim, i))
            i, j, sim = i[order], j[order], sim[order]
            begins = np.searchsorted(i, i)
            place = np.arange(len(i)) - begins
            kth = np.minimum(begins + keep - 1, np.searchsorted(i, i, "right") - 1)
            good = sim >= sim[kth] - 2 * HALF if len(i) else place > 0  # the best, and those half precision cannot tell from them
            depth[i[place >= MOST]] = UNSEARCHED
            good &= place < MOST
            out_a.append(num[i[good]])
            out_b.append(num[j[good]])
        a, b = (np.concatenate([np.empty(0, np.int64), *o]) for o in (out_a, out_b))
        none = pa.nulls(len(own), pa.int64())
        return pa.table({
            "a": pa.concat_arrays([pa.array(a), pa.array(num[own])]), "b": pa.concat_arrays([pa.array(b), none]),
            "depth": pa.concat_arrays([pa.nulls(len(a), pa.int32()), pa.array(depth[own])]),
        })

    return run


def _compare(dim: int):
    """(a, b, code_a, code_b) to exact similarities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (_codes(batch.column(c), dim).astype(np.float64) for c in ("code_a", "code_b"))
            sims = (x / np.linalg.norm(x, axis=1, keepdims=True) * (y / np.linalg.norm(y, axis=1, keepdims=True))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.round(sims, 9))], names=["a", "b", "similarity"])

    return run


PAIR = "a bigint, b bigint, similarity double"


def _forest(classes: DataFrame, dim: int, k: int, floor: float, trees: int, width: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, similarity) of classes at least ``floor`` similar that the forest finds, and the classes ``a`` it is not sure of."""
    coded = stage(classes.select("num", "head", "code").mapInArrow(_hash(dim, trees), "num bigint, target boolean, half binary, hi array<bigint>, lo array<bigint>"), "hashed")
    arrays = _arrays(coded)
    size = max(ROWS, 4 * width)
    found = _blocks(arrays, width, size).groupBy("block").applyInArrow(_descend(width), "num bigint, g bigint, levels array<smallint>")
    # every element stands for a grain of candidates: the ascent is synchronous as the lengths of all trees are ordered together
    grain = max(1, 2 * width // GRAINS)
    wanted = max(1, trees * width // grain)
    all_levels = F.sort_array(F.flatten(F.collect_list("levels")), asc=False)
    level = F.greatest(F.lit(0), F.element_at(all_levels, F.least(F.lit(wanted), F.size(all_levels)))).cast("int")
    chosen = found.groupBy("num").agg(level.alias("level"), F.array_sort(F.collect_list("g")).alias("gs"))
    # the places of a vector in order are those of its trees in order
    rows = coded.join(chosen, "num").select("num", "target", "half", "level", F.posexplode(F.arrays_zip("hi", "lo", "gs")).alias("tree", "z"))
    rows = rows.select("num", "target", "half", "level", "tree", "z.hi", "z.lo", F.col("z.gs").alias("g"))
    got = stage(_blocks(rows, width, size).groupBy("block").applyInArrow(_gather(dim, width, k + 1, floor), "a bigint, b bigint, depth int"), "candidates")

    codes = classes.select("num", "code")
    pairs = got.where("b IS NOT NULL").select("a", "b").distinct()
    pairs = pairs.join(codes.select(F.col("num").alias("a"), F.col("code").alias("code_a")), "a").join(codes.select(F.col("num").alias("b"), F.col("code").alias("code_b")), "b")
    pairs = stage(pairs.mapInArrow(_compare(dim), PAIR).where(F.col("similarity") >= floor), "compared")

    kth = pairs.groupBy("a").agg(F.sort_array(F.collect_list("similarity"), asc=False).alias("l")).select("a", F.when(F.size("l") > k, F.col("l")[k]).alias("kth"))
    missed = F.sum(F.when(F.col("depth") > BITS, 0.0).otherwise(F.log1p(-F.pow(F.col("p"), F.col("depth")) * (1 - 1e-12))))
    at = F.least(F.coalesce("kth", F.lit(floor)), F.lit(1.0))
    searched = got.where("b IS NULL").select("a", "depth").join(kth, "a", "left").withColumn("p", 1 - F.acos(at) / math.pi)
    sure = searched.groupBy("a").agg(F.exp(missed).alias("missed"), F.count("kth").alias("n_full"))
    return pairs, sure.select("a", (F.col("missed") <= 1 - recall).alias("sure"), (F.col("n_full") > 0).alias("full"))


def neighbours(entries: DataFrame, queries: DataFrame, dim: int, k: int, min_similarity: float = -1.0, trees: int | None = None, width: int = WIDTH, recall: float = RECALL, trusted: float = TRUSTED) -> DataFrame:
    """(kind, id, neighbour, similarity, rank): for every entry and query the ``k`` most similar entries.

    ``entries`` and ``queries`` have columns ``id`` and ``vector``. Vectors that are not usable (see
    :func:`usable`) are left out. An entry is not its own neighbour; rows that repeat an id with the same
    vector count once, and an id with several vectors stands for each of them. Ties go to the smaller id.
    Neighbours below ``min_similarity`` are left out, before ranks are cut at ``k``. Similarities are exact, to nine decimals.

    A neighbour at least ``trusted`` similar is found with a probability of ``recall`` or more by ``trees`` trees (None:
    as many as that takes); a vector of which that cannot be said, or with less than ``k`` such neighbours where
    ``min_similarity`` asks for farther ones, is compared with all entries.
    """
    classes, members = _classes(entries, queries, dim)
    floor = max(min_similarity, trusted)
    n = classes.count()
    pairs, state = _forest(classes, dim, k, floor, trees or trees_for(n, floor, recall, width), width, recall)
    done = F.col("sure") if min_similarity >= trusted else F.col("sure") & F.col("full")
    open_classes = stage(classes.join(state.where(~done), F.col("num") == F.col("a"), "left_semi"), "open-classes")
    left = open_classes.count()
    if left:
        rest = _products(open_classes, left, classes.where("head IS NOT NULL"), dim, k, min_similarity, BLOCK)
        pairs = pairs.join(open_classes.select(F.col("num").alias("a")), "a", "left_anti").unionByName(rest)
    own = classes.where("head IS NOT NULL").select(F.col("num").alias("a"), F.col("num").alias("b"), F.lit(1.0).alias("similarity"))
    heads = _heads(members, k)
    return _lists(members, pairs.where("a <> b").unionByName(own), heads, k)


def _heads(members: DataFrame, k: int) -> DataFrame:
    """The first ids of each class, as many as a list may need."""
    ids = members.where("kind = 'entry'").select("class", "id").distinct()
    return ids.withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("n") <= k + 1)


# -- exact products ----------------------------------------------------------------------------------


def _block(dim: int, keep: int, floor: float):
    """The best ``keep`` targets of each source in one block: those of equal similarity by their smallest id."""

    def run(t: pa.Table) -> pa.Table:
        def matrix(part: pa.Table) -> np.ndarray:
            x = np.frombuffer(b"".join(part.column("code").to_pylist()), dtype=np.float32).reshape(part.num_rows, dim).astype(np.float64)
            return x / np.linalg.norm(x, axis=1, keepdims=True)

        sources, targets = t.filter(t.column("source")), t.filter(pc.invert(t.column("source"))).sort_by("head")
        x, y = matrix(sources), matrix(targets)
        x32, y32 = x.astype(np.float32), y.astype(np.float32)
        out_a, out_b, out_s = [], [], []
        step = max(1, CELLS // max(1, len(y)))
        for s in range(0, len(x) if len(y) else 0, step):
            sims = x32[s : s + step] @ y32.T
            least = np.full((len(sims), 1), floor, dtype=np.float32)
            if len(y) > keep:
                least = np.maximum(least, np.partition(sims, len(y) - keep, axis=1)[:, -keep][:, None])
            a, b = np.nonzero(sims >= least - SLACK)
            fine = np.empty(len(a))
            for i in range(0, len(a), 1 << 16):
                part = slice(i, i + (1 << 16))
                fine[part] = (x[s + a[part]] * y[b[part]]).sum(axis=1)
            fine = np.round(fine, 9)
            order = np.lexsort((b, -fine, a))
            a, b, fine = a[order], b[order], fine[order]
            best = (np.arange(len(a)) - np.searchsorted(a, a) < keep) & (fine >= floor)
            out_a.append(a[best] + s)
            out_b.append(b[best])
            out_s.append(fine[best])
        a, b, fine = (np.concatenate(o) if o else np.empty(0) for o in (out_a, out_b, out_s))
        take = lambda part, at: part.column("num").take(pa.array(at.astype(np.int64)))
        return pa.table({"a": take(sources, a), "b": take(targets, b), "similarity": pa.array(fine, pa.float64())})

    return run


def _products(sources: DataFrame, n_sources: int, targets: DataFrame, dim: int, k: int, floor: float, block: int) -> DataFrame:
    """Pairs (a, b, similarity): of each source the best targets, every one of them compared, in blocks of ``block`` a side."""
    n, m = max(2, -(-n_sources // block)), max(3, -(-targets.count() // block))
    left, right = F.pmod(F.xxhash64("num"), F.lit(n)).cast("int"), F.pmod(F.xxhash64("num"), F.lit(m)).cast("int")
    blocks = sources.select(left.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"), F.lit(True).alias("source"), "num", "code", "head").unionByName(
        targets.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), right.alias("j"), F.lit(False).alias("source"), "num", "code", "head")
    )
    # the k + 1 best classes of a block hold the k + 1 best ids, as they are ordered by their smallest ids
    return blocks.groupBy("i", "j").applyInArrow(_block(dim, k + 1, floor), PAIR)


def nearest(entries: DataFrame, queries: DataFrame, dim: int, k: int, min_similarity: float = -1.0, block: int = BLOCK) -> DataFrame:
    """What :func:`neighbours` describes, of every vector by products with every entry; the work grows with the square of the distinct vectors."""
    classes, members = _classes(entries, queries, dim)
    return _lists(members, _products(classes, classes.count(), classes.where("head IS NOT NULL"), dim, k, min_similarity, block), _heads(members, k), k)


# -- queries ---------------------------------------------------------------------------------------

DIM, K, SIMILAR = 128, 10, 0.90


def memory(entries: DataFrame, queries: DataFrame, min_similarity: float = -1.0) -> DataFrame:
    return neighbours(entries.select("id", F.col("embedding").alias("vector")), queries.select(F.col("query_id").alias("id"), "vector"), DIM, K, min_similarity)


def found(entries: DataFrame, queries: DataFrame) -> DataFrame:
    got = memory(entries, queries, SIMILAR)
    pair = F.when(F.col("kind") == "query", F.struct(F.col("id").alias("l"), F.col("neighbour").alias("r"))).otherwise(F.struct(F.least("id", "neighbour").alias("l"), F.greatest("id", "neighbour").alias("r")))
    return got.select(F.col("kind").alias("pair_kind"), pair.alias("p")).select("pair_kind", F.col("p.l").alias("left_id"), F.col("p.r").alias("right_id")).distinct()
