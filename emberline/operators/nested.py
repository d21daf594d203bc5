"""Flat, linked tables out of deeply nested records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.common import spread_rows
from emberline.functions.jsonindex import ARRAY, OBJECT, STRING, JsonIndex

#: Bytes of JSON text that are indexed together; a longer text is indexed alone.
INDEX_BYTES = 1 << 20

CHILD_SCHEMA = "rel string, record_id long, parent_pos long, pos long, child string"
_ARROW = pa.schema([("rel", pa.string()), ("record_id", pa.int64()), ("parent_pos", pa.int64()), ("pos", pa.int64()), ("child", pa.string())])


class _Rows:
    def __init__(self) -> None:
        self.columns: list[list] = [[], [], [], [], []]

    def add(self, rel: str, ids: np.ndarray, parents, places, children: list[str]) -> None:
        n = len(children)
        for column, values in zip(self.columns, ([rel] * n, ids, parents, places, children)):
            column.extend(values if isinstance(values, list) else values.tolist())

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, _ARROW)], schema=_ARROW)


def _lists(j: JsonIndex, objects: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Elements and places of the list under ``name``: an array's, or one object in its place."""
    return j.elements(j.of_kind(j.member(objects, name), ARRAY, OBJECT))


def _field_texts(j: JsonIndex, objects: np.ndarray, name: str) -> list[str]:
    """Each object's ``name`` as text, '' if absent or null."""
    found = j.member(objects, name)
    found = found[~j.is_null(found)]
    by = dict(zip(j.parent[found].tolist(), found.tolist()))
    return [j.text(by[o]) if o in by else "" for o in objects.tolist()]


def revisions(j: JsonIndex, ids: np.ndarray, out: _Rows) -> None:
    """``rev`` at the top of an object: a string or whole number, or the non-null elements of an array."""
    rev = j.member(j.of_kind(j.roots(), OBJECT), "rev")
    single = rev[(j.kind[rev] == STRING) | j.is_whole(rev)]
    nodes, places = j.elements(np.concatenate([single, j.of_kind(rev, ARRAY)]))
    keep = ~j.is_null(nodes)
    nodes, places = nodes[keep], places[keep]
    out.add("rev", ids[j.row[nodes]], [-1] * len(nodes), places, [j.text(i) for i in nodes])


def interfaces(j: JsonIndex, ids: np.ndarray, out: _Rows) -> None:
    """Interfaces at the top or in ``spec``, and their configs, which keep their interface's place."""
    top = j.of_kind(j.roots(), OBJECT)
    spec = j.of_kind(j.member(top, "spec"), OBJECT)
    nodes, places = _lists(j, np.concatenate([top, spec]), "interfaces")
    is_object = j.kind[nodes] == OBJECT
    nodes, places = nodes[is_object], places[is_object]
    out.add("iface", ids[j.row[nodes]], [-1] * len(nodes), places, _field_texts(j, nodes, "network"))

    place_of = np.zeros(len(j.kind), np.int64)
    place_of[nodes] = places
    under, at = _lists(j, nodes, "configs")
    is_object = j.kind[under] == OBJECT
    under, at = under[is_object], at[is_object]
    holder = j.parent[under]
    in_array = np.zeros(len(under), bool)
    in_array[holder >= 0] = j.kind[holder[holder >= 0]] == ARRAY
    holder = np.where(in_array, j.parent[holder], holder)
    out.add("config", ids[j.row[under]], place_of[holder], at, _field_texts(j, under, "endpoint"))


def _pieces(texts: list[bytes | None], most: int = INDEX_BYTES) -> Iterator[slice]:
    begin = held = 0
    for i, text in enumerate(texts):
        size = len(text or b"")
        if i > begin and held + size > most:
            yield slice(begin, i)
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield slice(begin, len(texts))


def _children(extract, reread: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for piece in _pieces(texts):
                out = _Rows()
                j = JsonIndex(texts[piece])
                extract(j, ids[piece], out)
                if reread and len(quoted := j.of_kind(j.roots(), STRING)):
                    again = JsonIndex([j.text(i).encode() for i in quoted])
                    extract(again, ids[piece][j.row[quoted]], out)
                yield out.batch()

    return run


def json_children(df: DataFrame, record_id: str, text: str, extract, reread: bool = False) -> DataFrame:
    """Child rows that ``extract`` takes from the index of each text; with ``reread`` a text that
    is a JSON string is read once more as the text it holds."""
    texts = df.select(F.col(record_id).cast("long"), F.col(text).cast("string")).where(F.col(record_id).isNotNull() & F.col(text).isNotNull())
    return spread_rows(texts, texts.columns[0]).mapInArrow(_children(extract, reread), CHILD_SCHEMA)


def _array_children(df: DataFrame, rel: str, record_id: str, array: str, child) -> DataFrame:
    flat = df.select(F.col(record_id).cast("long").alias("record_id"), F.posexplode(array).alias("_pos", "_x")).where("record_id IS NOT NULL")
    return flat.select(
        F.lit(rel).alias("rel"), "record_id", F.lit(-1).cast("long").alias("parent_pos"), F.col("_pos").cast("long").alias("pos"), child(F.col("_x")).alias("child")
    ).where("child IS NOT NULL")


def nested_children(inventory: DataFrame, assets: DataFrame) -> DataFrame:
    """(rel, record_id, parent_pos, pos, child): one distinct row for each nested child.

    ``edge`` and ``ancestor`` come from arrays, ``rev``, ``iface`` and ``config`` out
    of JSON text by :class:`JsonIndex`. ``pos`` is the place in the array as
    delivered, nulls counted; ``parent_pos`` is the interface's place for a config,
    else -1; a single object in place of an array is an array of one.

    Defined cases: a null record id, text, array or element gives no row; text that
    is no valid JSON or no object gives none; of a key written twice in an object
    the last counts; a record delivered twice counts once; a text of any length is
    read whole; empty tables give no rows, columns not named are not read.
    """
    parts = [
        _array_children(inventory, "edge", "record_id", "edges", lambda x: x["dst"]),
        json_children(inventory, "record_id", "props", revisions),
        _array_children(assets, "ancestor", "asset_id", "ancestors", lambda x: x),
        json_children(assets.select("asset_id", F.col("resource.data").alias("data")), "asset_id", "data", interfaces, reread=True),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()
