"""Long exact spans that records share.

Spans are hashed at places their own text chooses, and joined globally. Sentence ends alone would miss a stretch
that begins and ends within sentences, so the places are winnowed: of the ``ANCHOR``-character strings in each
window of ``run`` characters the one with the least hash owns the window. Equal windows have equal owners, so

1. windows can only be shared where their owners' hashes are shared by records (one join over all anchors);
2. an occurrence whose first and last own window are both shared is shared throughout (one join of those);
3. what is left are the edges of stretches: there every window's hash is compared, for the anchors concerned.

The result is exact up to collisions of 128 bits, and no step pairs up the records of a group: a hot group costs
its number of occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.shared import stage

RUN, ANCHOR = 200, 40
CHUNK = 1 << 19  # characters hashed at once; positions in it fit the 20 bits below
_POS = np.uint64((1 << 20) - 1)
ANCHORS = "h bigint, rid bigint, lo int, hi int, w_lo bigint, w_hi bigint"
WINDOWS = "h bigint, w bigint, rid bigint, lo int, at int"


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of all substrings of one length: polynomials modulo 2**64 from prefix sums, mixed."""

    def __init__(self, base: int, size: int):
        b = np.uint64(base | 1)
        inv = pow(int(b), -1, 1 << 64)
        self.up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, b))))
        self.down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, np.uint64(inv)))))

    def __call__(self, codes: np.ndarray, length: int) -> np.ndarray:
        n = len(codes)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * self.up[:n])))
        return _mix((sums[length:] - sums[: n - length + 1]) * self.down[: n - length + 1])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring keys, from running minima over blocks of that width."""
    n = len(keys)
    padded = np.concatenate((keys, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _chunks(rids: np.ndarray, texts: list[str], run: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end, up to CHUNK characters: code points, and of each text its first place in the chunk,
    its record and the place in the record that this is. A longer text is cut, with an overlap of run - 1."""
    parts: list[np.ndarray] = []
    rid: list[int] = []
    offset: list[int] = []
    size = 0

    def out():
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        return np.concatenate(parts), starts, np.array(rid, np.int64), np.array(offset, np.int64)

    for r, t in zip(rids, texts, strict=True):
        if t is None or len(t) < run:
            continue
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for a in range(0, len(codes) - run + 1, CHUNK - run + 1):
            piece = codes[a : a + CHUNK]
            if size + len(piece) > CHUNK:
                yield out()
                parts, rid, offset, size = [], [], [], 0
            parts.append(piece)
            rid.append(r)
            offset.append(a)
            size += len(piece)
    if parts:
        yield out()


def _owners(codes: np.ndarray, starts: np.ndarray, run: int, first: Hasher, second: Hasher):
    """Of each valid window: its start, the index of its text, its owner's place, and hashes of anchors and windows by place."""
    c = _mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    anchors = first(c, ANCHOR)
    windows = second(c, run)
    place = np.arange(len(anchors), dtype=np.uint64)
    least = _least((anchors & ~_POS) | (_POS - place), run - ANCHOR + 1)  # of equal hashes the last place wins
    owner = (_POS - (least & _POS)).astype(np.int64)
    at = np.arange(len(windows))
    text = np.searchsorted(starts, at, "right") - 1
    ends = np.append(starts[1:], len(codes))
    valid = at + run <= ends[text]
    return at[valid], text[valid], owner[valid], anchors, windows


def _anchors(run: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = Hasher(0x2545F4914F6CDD1D, CHUNK + 1), Hasher(0xD6E8FEB86659FD93, CHUNK + 1)
        for batch in batches:
            for codes, starts, rid, offset in _chunks(batch.column("rid").to_numpy(), batch.column("text").to_pylist(), run):
                at, text, owner, anchors, windows = _owners(codes, starts, run, first, second)
                if not len(at):
                    continue
                change = np.flatnonzero((owner[1:] != owner[:-1]) | (text[1:] != text[:-1]))
                lo, hi = np.concatenate(([0], change + 1)), np.concatenate((change, [len(at) - 1]))
                t = text[lo]
                move = offset[t] - starts[t]
                signed = lambda x: pa.array(x.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [signed(anchors[owner[lo]]), pa.array(rid[t]), pa.array((at[lo] + move).astype(np.int32)), pa.array((at[hi] + move).astype(np.int32)), signed(windows[at[lo]]), signed(windows[at[hi]])],
                    names=["h", "rid", "lo", "hi", "w_lo", "w_hi"],
                )

    return scan


def _windows(run: int):
    """Every own window of the occurrences listed with a text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = Hasher(0xD6E8FEB86659FD93, CHUNK + 1)
        for batch in batches:
            for rid, text, edges in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), batch.column("edges").to_pylist(), strict=True):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                out = []
                for e in edges:
                    lo, hi = e["lo"], e["hi"]
                    if hi + run > len(codes):  # another version of the record
                        continue
                    c = _mix(codes[lo : hi + run].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
                    w = second(c, run)
                    out.append((np.full(len(w), e["h"]), w.view(np.int64), np.full(len(w), rid), np.full(len(w), lo, np.int32), np.arange(lo, hi + 1, dtype=np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["h", "w", "rid", "lo", "at"])

    return scan


def _shared(df: DataFrame, *keys: str) -> DataFrame:
    """Keys held by more than one record, pre-aggregated before the shuffle. A table of its own, so that in a join with it both
    sides are read from plain shuffles and the occurrences of a hot key are split over tasks."""
    return stage(df.groupBy(*keys).agg(F.min("rid").alias("__a"), F.max("rid").alias("__b")).where("__a < __b").select(*keys), "shared-keys")


def stretches(records: DataFrame, run: int = RUN) -> DataFrame:
    """(``rid``, ``span_start``, ``span_end``): the maximal stretches of each record, in code points and end exclusive,
    made of runs of at least ``run`` characters that some other record holds verbatim. Runs that overlap or touch
    are one stretch.

    ``records`` has ``rid`` (bigint) and ``text``. Null and shorter texts share nothing. Rows that repeat a record
    count as one record; should their texts differ, the stretches of each are merged.
    """
    anchors = stage(records.select("rid", "text").where(F.length("text") >= run).mapInArrow(_anchors(run), ANCHORS), "anchors")
    common = stage(anchors.join(_shared(anchors, "h"), "h").distinct(), "shared-anchors")

    ends = common.select("h", "rid", F.explode(F.array("w_lo", "w_hi")).alias("w"))
    known = _shared(ends, "h", "w").withColumn("yes", F.lit(True))
    both = (
        common.join(known.withColumnRenamed("w", "w_lo").withColumnRenamed("yes", "yes_lo"), ["h", "w_lo"], "left")
        .join(known.withColumnRenamed("w", "w_hi").withColumnRenamed("yes", "yes_hi"), ["h", "w_hi"], "left")
        .select("h", "rid", "lo", "hi", (F.col("yes_lo").isNotNull() & F.col("yes_hi").isNotNull()).alias("whole"))
    )
    both = stage(both, "occurrences")
    open_h = stage(both.where("NOT whole").select("h").distinct(), "open-anchors")
    edges = both.join(open_h, "h", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("h", "lo", "hi")).alias("edges"))
    texts = records.select("rid", "text").where(F.length("text") >= run).join(edges, "rid")
    windows = stage(texts.mapInArrow(_windows(run), WINDOWS), "edge-windows")
    at_edges = windows.join(_shared(windows, "h", "w"), ["h", "w"]).groupBy("rid", "lo").agg(F.min("at").alias("a"), (F.max("at") + run).alias("b"))

    parts = both.where("whole").select("rid", F.col("lo").alias("a"), (F.col("hi") + run).alias("b")).unionByName(at_edges.select("rid", "a", "b"))
    return islands(parts, "rid", "a", "b").select("rid", F.col("a").alias("span_start"), F.col("b").alias("span_end"))


def islands(parts: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Intervals that overlap or touch, merged within ``key``."""
    by = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    numbered = parts.withColumn("__new", new).withColumn("__n", F.sum("__new").over(by))
    return numbered.groupBy(key, "__n").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__n")


# -- queries ---------------------------------------------------------------------------------------


def records(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(rid, rec_kind, rec_id, text) of both tables; rows without an id are left out."""
    both = entries.select(F.lit("memory_entry").alias("rec_kind"), F.col("id").alias("rec_id"), F.col("content").alias("text")).unionByName(
        files.select(F.lit("pr_file").alias("rec_kind"), F.col("pr_file_id").cast("string").alias("rec_id"), F.col("patch").alias("text"))
    )
    return both.where("rec_id IS NOT NULL").select(F.xxhash64("rec_kind", "rec_id").alias("rid"), "*")


def found(entries: DataFrame, files: DataFrame) -> DataFrame:
    every = records(entries, files)
    names = every.select("rid", "rec_kind", "rec_id").distinct()
    return stretches(every).join(names, "rid").select("rec_kind", "rec_id", "span_start", "span_end")


def shares(entries: DataFrame, files: DataFrame) -> DataFrame:
    """One row per record: its characters, those that other records hold too, their share and the number of stretches."""
    every = records(entries, files)
    spans = stretches(every).groupBy("rid").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count(F.lit(1)).alias("n_spans"))
    sizes = every.groupBy("rid", "rec_kind", "rec_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"))
    out = sizes.join(spans, "rid", "left").fillna(0, ["shared_chars", "n_spans"])
    return out.select("rec_kind", "rec_id", "n_chars", "shared_chars", F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)).alias("share"), "n_spans")


#: Sentences end at LF and after '.', '!' or '?' with a space; the pieces keep their ends, so that together they are the text.
SENTENCE = r"(?<=\n)|(?<=[.!?] )"


def _sentences(text: Column) -> Column:
    """Pieces (struct of ``raw`` and ``s``, trimmed) of a text; blank ones have an empty ``s``."""
    return F.transform(F.split(text, SENTENCE), lambda p: F.struct(p.alias("raw"), F.trim(F.regexp_replace(p, r"\n$", "")).alias("s")))


def _texts(entries: DataFrame, files: DataFrame) -> DataFrame:
    every = records(entries, files).where("text IS NOT NULL").select("rec_kind", "rec_id", "text").distinct()
    return every.select("rec_kind", "rec_id", _sentences(F.col("text")).alias("pieces"))


def sentence_runs(entries: DataFrame, files: DataFrame, length: int = 3) -> DataFrame:
    """Runs of ``length`` consecutive sentences (cut at LF and after '.', '!' or '?' with a space) held by several records.

    One row per occurrence: ``rec_kind, rec_id, sentence_no`` (from 0, blank sentences not counted), ``n_records``
    and ``first``, which marks the record whose copy would stay; a text is cleaned of repeats by removing the
    sentences that a run with ``first`` false covers. First is the smallest (rec_kind, rec_id). Null texts have no runs.
    """
    words = F.transform(F.filter("pieces", lambda p: p["s"] != ""), lambda p: p["s"])
    cut = _texts(entries, files).select("rec_kind", "rec_id", words.alias("s")).where(F.size("s") >= length)
    runs = cut.select("rec_kind", "rec_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("s") - length + 1), lambda i: F.slice("s", i, length))).alias("sentence_no", "run"))
    key = F.struct(F.xxhash64("run").alias("x"), F.xxhash64(F.lit(1), F.col("run")).alias("y"))
    hashed = stage(runs.select("rec_kind", "rec_id", "sentence_no", key.alias("k")).select("rec_kind", "rec_id", "sentence_no", "k.*"), "sentence-runs")
    held = hashed.select("x", "y", "rec_kind", "rec_id").distinct().groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_records"), F.min(F.struct("rec_kind", "rec_id")).alias("__first")).where("n_records > 1")
    held = stage(held, "shared-runs")  # a table of its own, as in _shared
    return hashed.join(held, ["x", "y"]).select("rec_kind", "rec_id", "sentence_no", "n_records", (F.struct("rec_kind", "rec_id") == F.col("__first")).alias("first"))


def without_repeats(entries: DataFrame, files: DataFrame, length: int = 3) -> DataFrame:
    """Texts without the sentences that a non-first repeated run covers: ``rec_kind, rec_id, n_sentences, n_removed, text``.

    One row per record and distinct text; what is kept is kept as it is, blank sentences among it. Null texts give no row.
    """
    runs = sentence_runs(entries, files, length).where("NOT first").groupBy("rec_kind", "rec_id").agg(F.collect_set("sentence_no").alias("at"))
    rows = _texts(entries, files).join(runs, ["rec_kind", "rec_id"], "left")
    none = F.array().cast("array<int>")
    filled = F.filter(F.sequence(F.lit(0), F.size("pieces") - 1), lambda i: F.col("pieces")[i]["s"] != "")  # the piece of each sentence
    covered = F.array_distinct(F.flatten(F.transform(F.coalesce("at", none), lambda i: F.slice("filled", i + 1, length))))
    rows = rows.withColumn("filled", filled).withColumn("gone", covered)
    out = rows.withColumn("kept", F.when(F.size("gone") == 0, F.col("pieces")).otherwise(F.filter("pieces", lambda p, i: ~F.array_contains("gone", i))))
    return out.select(
        "rec_kind", "rec_id", F.size("filled").alias("n_sentences"), F.size("gone").alias("n_removed"),
        F.array_join(F.transform("kept", lambda p: p["raw"]), "").alias("text"),
    )
