"""Sizes of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: One token: a run of ASCII word characters or a run of other characters that are not ASCII white space.
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]+"


def token_size(text: Column) -> Column:
    """Number of maximal matches of :data:`TOKEN`; null counts 0. Runs in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("int")


def vocabulary_size(text: Column, tokenizer_file: str) -> Column:
    """Size in tokens of a public tokenizer (a ``tokenizers`` JSON file every executor can read); null counts 0."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer_file)
        model.encode_special_tokens = True
        for texts in batches:
            sizes = model.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)
            yield pd.Series([len(x.ids) for x in sizes], dtype="int32")

    return count(text)
