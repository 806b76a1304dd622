"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files lie; they are never copied.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level vocabularies of this kind split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str) -> int:
    """Tokens of a whole text."""
    return len(_encoding(path).encode_ordinary(text))


def with_tokens(df: DataFrame, column: str, into: str = "n_tokens", vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """Adds ``into``: the number of tokens of ``column``; null for null, 0 for the empty text. Each Python worker loads the vocabulary
    once, from a path that every node has."""
    if into in df.columns:
        raise ValueError(f"column {into} is there already")

    @F.pandas_udf(T.LongType())
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda text: count_tokens(text, vocabulary), na_action="ignore").astype("Int64")

    return df.withColumn(into, tokens(F.col(column)))
