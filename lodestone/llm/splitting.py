"""Splitting oversized texts at natural boundaries, with an overlap.

Separators form a hierarchy: section, paragraph, sentence or line, word, character. A piece is packed as far
as the limit lets it, and ends at the last boundary of the highest level that still leaves it at least half
full; where no such level has one, at the last sentence or line boundary at all; only where a stretch has none,
between words, and between characters where there is no white space. Each further piece begins ``overlap`` tokens
before the cut; a boundary within the first ``overlap`` tokens of a piece is none, as the next piece would not get on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.measures import token_size

LEVELS = ("section", "paragraph", "sentence", "word", "character", "end")
CUT = "array<struct<start:int,stop:int,n_tokens:int,cut_level:string,longest_stretch:int>>"

_KIND = np.full(128, 2, dtype=np.int8)  # 0 white space, 1 word, 2 other
_KIND[[ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"]] = 1
_KIND[[ord(c) for c in " \t\n\r\f\v"]] = 0
_SECTION = re.compile(r"^(?=#{1,6} |={3,}$|-{3,}$|diff --git )", re.M)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str, int]]:
    """(start, stop, tokens, level of the cut that ends it, longest stretch of the text) of each piece, in code points.

    Pieces cover the text: each begins ``overlap`` tokens before the end of the one before, so that cutting
    the overlaps off gives the text back. A text without tokens is one piece.
    """
    codes = _codes(text)
    kind = np.where(codes < 128, _KIND[np.minimum(codes, 127)], 2)
    begins = np.flatnonzero((kind != 0) & (kind != np.concatenate(([0], kind[:-1]))))  # of the tokens
    n = len(begins)
    after_stop = (codes[1:] == 32) & np.isin(codes[:-1], [46, 33, 63])
    breaks = np.union1d(np.flatnonzero(codes == 10), np.flatnonzero(after_stop) + 1)
    # a boundary is the number of tokens before it; a cut there lies right before the next token's first character
    sentence = np.unique(np.searchsorted(begins, breaks, "right"))
    edges = np.concatenate(([0], sentence, [n]))
    longest = int(np.diff(edges).max()) if n else 0
    if n <= limit:
        return [(0, len(codes), n, "end", longest)]
    paragraph = np.unique(np.searchsorted(begins, [m.end() for m in re.finditer(r"\n\s*\n", text)], "left"))
    section = np.unique(np.searchsorted(begins, [m.start() for m in _SECTION.finditer(text)], "left"))
    ends = np.concatenate((begins[1:], [len(codes)]))
    word = np.flatnonzero(kind[ends[:-1] - 1] == 0) + 1  # white space stands before the token
    levels = [section, paragraph, sentence, word, np.arange(1, n)]

    def last(at: np.ndarray, low: int, high: int) -> int | None:
        i = int(np.searchsorted(at, high, "right")) - 1
        return int(at[i]) if i >= 0 and at[i] > low else None

    out, start = [], 0  # the piece's first token
    while True:
        low, high = start + overlap, start + limit  # up to ``low`` the text is covered already
        if high >= n:
            stop, level = n, 5
        else:
            half = max(low, start + limit // 2)
            picks = [(last(levels[k], half, high), k) for k in (0, 1, 2)] + [(last(levels[k], low, high), k) for k in (2, 3, 4)]
            stop, level = next(p for p in picks if p[0] is not None)
        a = 0 if start == 0 else int(begins[start])
        b = len(codes) if stop == n else int(begins[stop])
        out.append((a, b, stop - start, LEVELS[level], longest))
        if stop == n:
            return out
        start = stop - overlap


def split(df: DataFrame, text: str, limit: int = 800, overlap: int = 80, size: Column | None = None) -> DataFrame:
    """``df`` with one row per piece of each text of more than ``limit`` tokens, and ``piece_no`` (from 0),
    ``n_pieces``, ``piece_start``, ``piece_stop`` (code points, end exclusive), ``piece_tokens``, ``piece_text``,
    ``cut_level`` (what the piece's end is cut at) and ``cut_kind``: 'hard' if some stretch between
    neighbouring breaks (each LF, each space right after '.', '!' or '?') exceeds the limit itself, else 'soft'.

    Smaller and null texts give no rows. A column of ``df`` with one of these names gives way. ``overlap`` must
    be below half of ``limit``. Needs no shuffle.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be at least 0 and below half of limit")
    new = ["piece_no", "n_pieces", "piece_start", "piece_stop", "piece_tokens", "piece_text", "cut_level", "cut_kind"]

    @F.pandas_udf(CUT)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("start", "stop", "n_tokens", "cut_level", "longest_stretch")
        for texts in batches:
            yield pd.Series([None if t is None else [dict(zip(names, c, strict=True)) for c in cuts(t, limit, overlap)] for t in texts])

    over = df.where((token_size(F.col(text)) if size is None else size) > limit)
    kept = [F.col(c) for c in df.columns if c not in new]
    cut = over.select(*kept, F.col(text).alias("__text"), pieces(F.col(text)).alias("__cuts"))
    one = cut.select("*", F.posexplode("__cuts").alias("piece_no", "__c"))
    return one.select(
        *kept, "piece_no", F.size("__cuts").alias("n_pieces"), F.col("__c.start").alias("piece_start"), F.col("__c.stop").alias("piece_stop"),
        F.col("__c.n_tokens").alias("piece_tokens"), F.substring("__text", F.col("__c.start") + 1, F.col("__c.stop") - F.col("__c.start")).alias("piece_text"),
        F.col("__c.cut_level").alias("cut_level"), F.when(F.col("__c.longest_stretch") > limit, "hard").otherwise("soft").alias("cut_kind"),
    )


def found(docs: DataFrame) -> DataFrame:
    return split(docs.select("doc_id", "text"), "text").where("piece_no = 0").select("doc_id", "cut_kind")
