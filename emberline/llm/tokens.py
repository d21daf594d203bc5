"""Token counts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.common import spread_rows

#: Place of the vocabulary: rank file lines of base64 bytes and rank. Never part of this repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's own rule for cutting text before merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path.rpartition("/")[2], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | Column, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text; a null text has none."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in batch], dtype="int64")

    return counted(text)


def with_tokens(df: DataFrame, *columns: str, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``columns`` and ``tokens`` of each row; texts are spread if they lie in few files."""
    return spread_rows(df.select(*columns, text), columns[0]).select(*columns, token_count(F.col(text).cast("string"), path).alias("tokens"))
