"""Stable keys and canonical texts, where the JVM has no function for them."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: 64-bit FNV-1a
_OFFSET, _PRIME, _MASK = 0xCBF29CE484222325, 0x100000001B3, 0xFFFFFFFFFFFFFFFF


def fnv1a(data: bytes) -> int:
    h = _OFFSET
    for b in data:
        h = ((h ^ b) * _PRIME) & _MASK
    return h


def edge_key(src: str, dst: str, kind: str, valid_from: str) -> Column:
    """The unsigned 64-bit key of an edge as decimal text: FNV-1a over its names, each ended by a zero byte, and its start.

    For matching snapshots of other systems only; inside Spark ``xxhash64`` of the columns does.
    """

    @F.pandas_udf("string")
    def keyed(s: pd.Series, d: pd.Series, k: pd.Series, v: pd.Series) -> pd.Series:
        out = [str(fnv1a(f"{a}\0{b}\0{c}\0".encode() + np.int64(t).tobytes())) for a, b, c, t in zip(s, d, k, v)]
        return pd.Series(out, dtype=object)

    return keyed(src, dst, kind, valid_from)


def canonical_json(text: str | Column) -> Column:
    """JSON text with sorted keys and no spaces, numbers as written; null where it is no JSON. Runs in Python; where
    numbers may be put as they please use :func:`canonical`."""

    @F.pandas_udf("string")
    def canon(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                # numbers are kept as their text, which json would change
                value = json.loads(t, parse_float=_Number, parse_int=_Number) if t is not None else None
                out.append(None if t is None else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, cls=_Encoder))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return canon(text)


class _Number(float):
    def __new__(cls, text: str):
        self = super().__new__(cls, text)
        self.text = text
        return self

    def __repr__(self) -> str:
        return self.text


class _Encoder(json.JSONEncoder):
    def iterencode(self, o, _one_shot: bool = False):
        return json.encoder._make_iterencode(
            {}, self.default, json.encoder.encode_basestring, None, lambda x: repr(x), self.key_separator, self.item_separator, self.sort_keys, self.skipkeys, False
        )(o, 0)


def canonical(text: str | Column) -> Column:
    """JSON text with sorted keys and no spaces, so that equal values are equal texts (1.0 is 1); text that is no JSON,
    or has a key twice in an object, stays as it is."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)
