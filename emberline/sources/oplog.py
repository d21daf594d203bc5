"""Operations out of entity and asset records, and the graph out of operations.

An operation has (op, name, type, props, src, dst, kind, ts, origin) and an
``ord`` struct that orders the log. All tables are deterministic functions of it.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.common import T_MAX
from emberline.functions.jsonindex import STRING, JsonIndex
from emberline.functions.keys import canonical
from emberline.functions.weights import infer_type
from emberline.operators import temporal

OPS = "op string, name string, type string, props string, src string, dst string, kind string, ts long, origin string"
ENTITY = "name string, type string, props string, edges array<struct<dst:string,kind:string,dst_type:string>>, origin string"
ASSET = "name string, assetType string, ancestors array<string>, resource struct<data:string>"
#: Type of a target that nothing is known of.
UNKNOWN = "unknown/unknown"

_FIELDS = ("op", "name", "type", "props", "src", "dst", "kind")


def _op(op: str, **values: Column) -> Column:
    return F.struct(*[(F.lit(op) if f == "op" else values.get(f, F.lit(None)).cast("string")).alias(f) for f in _FIELDS])


def entity_ops(entities: DataFrame, ts: str | Column, order: list[str], origin: str | None = None) -> DataFrame:
    """One observation of each entity, then for each of its edges the target as a placeholder and the edge.

    A record lacks something if it has no name or type, or one of its edges no
    target or kind: it gives no operations. The record's origin goes before ``origin``.
    ``ord`` is ``order`` of the record and the operation's place in it.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    edges = F.coalesce("edges", F.array().cast("array<struct<dst:string,kind:string,dst_type:string>>"))
    whole = F.col("name").isNotNull() & F.col("type").isNotNull() & F.forall(edges, lambda e: e["dst"].isNotNull() & e["kind"].isNotNull())
    self_ = _op("observe_node", name=F.col("name"), type=F.col("type"), props=F.col("props"))
    pair = lambda e: F.array(
        _op("observe_placeholder", name=e["dst"], type=F.coalesce(e["dst_type"], F.lit(UNKNOWN))), _op("observe_edge", src=F.col("name"), dst=e["dst"], kind=e["kind"])
    )
    ops = F.concat(F.array(self_), F.flatten(F.transform(edges, pair)))
    rows = entities.where(F.coalesce(whole, F.lit(False))).select(
        *order, ts.alias("ts"), F.coalesce(F.col("origin"), F.lit(origin)).alias("origin"), F.posexplode(ops).alias("pos", "_o")
    )
    return rows.select(F.struct(*order, "pos").alias("ord"), "_o.*", "ts", "origin")


_MANAGER = "cloudresourcemanager.googleapis.com"  # fixed values: names of the containers in asset records


def _container(anc: Column) -> Column:
    first = F.substring_index(anc, "/", 1)
    kind = F.when(first == "projects", "Project").when(first == "folders", "Folder").when(first == "organizations", "Organization")
    return F.when(kind.isNotNull(), F.struct(F.concat(F.lit(f"//{_MANAGER}/"), anc).alias("name"), F.concat(F.lit(f"{_MANAGER}/"), kind).alias("type")))


def containment_ops(assets: DataFrame, ts: str | Column, order: list[str]) -> DataFrame:
    """The asset, then its chain of containers from leaf to root, each holding the one before.

    Ancestors of other kinds, nulls and the asset itself are skipped.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    chain = F.filter(F.transform(F.coalesce("ancestors", F.array().cast("array<string>")), _container), lambda c: c.isNotNull() & (c["name"] != F.col("name")))
    rows = assets.where("name IS NOT NULL AND assetType IS NOT NULL").withColumn("_chain", chain)
    step = lambda c, i: F.array(
        _op("observe_placeholder", name=c["name"], type=c["type"]),
        _op("observe_edge", src=c["name"], dst=F.when(i == 0, F.col("name")).otherwise(F.get(F.col("_chain"), i - 1)["name"]), kind=F.lit("CONTAINS")),
    )
    self_ = _op("observe_node", name=F.col("name"), type=F.col("assetType"), props=F.col("resource.data"))
    ops = F.concat(F.array(self_), F.flatten(F.transform("_chain", step)))
    flat = rows.select(*order, ts.alias("ts"), F.posexplode(ops).alias("pos", "_o"))
    return flat.select(F.struct(*order, "pos").alias("ord"), "_o.*", "ts", F.lit(None).cast("string").alias("origin"))


# fixed values: the forms in which records refer to resources
_LINK = re.compile(r"(//)(?=(?s:.*)\.googleapis\.com/)|https://(?:www|compute)\.googleapis\.com/compute/v1/")
#: Bytes of text that are indexed at once.
_INDEX_BYTES = 1 << 20
#: Place of an asset's first reference among its operations, after those of its chain.
_REFERENCES = 1_000_000


def _overwritten(j: JsonIndex, node: int, last: dict[int, dict[str, int]], members: dict[int, list[int]]) -> bool:
    """Whether the node lies under a key that its object has once more, further on."""
    while j.parent[node] >= 0:
        holder = int(j.parent[node])
        if j.key[node] >= 0:
            if holder not in last:
                last[holder] = {j.text(j.key[i]): i for i in members[holder]}
            if last[holder][j.text(j.key[node])] != node:
                return True
        node = holder
    return False


def links(texts: list[bytes | None]) -> list[list[str]]:
    """The resource names in the string values of each JSON text; see :func:`reference_names`."""
    out: list[dict[str, None]] = [{} for _ in texts]
    j = JsonIndex(texts)
    strings = j.of_kind(np.flatnonzero(j.is_value), STRING)
    first = np.frombuffer(j.buf, np.uint8)[j.frm[strings] + 1]
    found = [(int(i), m, s) for i in strings[np.isin(first, list(b"/h\\"))] if (m := _LINK.match(s := j.text(i)))]
    if not found:
        return [[] for _ in texts]
    held: dict[int, list[int]] = {}
    rows = np.zeros(j.n, bool)
    rows[[j.row[i] for i, _, _ in found]] = True
    for i in np.flatnonzero(j.is_value & (j.key >= 0) & rows[j.row]):
        held.setdefault(int(j.parent[i]), []).append(int(i))
    last: dict[int, dict[str, int]] = {}
    for i, m, s in found:
        if not _overwritten(j, i, last, held):
            out[j.row[i]][s if m[1] else "//compute.googleapis.com/" + s[m.end() :]] = None
    return [list(names) for names in out]


def _links(texts: pd.Series) -> pd.Series:
    raw = [None if t is None else t.encode() for t in texts]
    out: list[list[str]] = []
    begin = held = 0
    for i, text in enumerate(raw):
        held += len(text or b"")
        if held >= _INDEX_BYTES or i + 1 == len(raw):
            out += links(raw[begin : i + 1])
            begin, held = i + 1, 0
    return pd.Series(out, dtype=object)


def reference_names(text: str = "data") -> Column:
    """Full resource names in the string values of a JSON text, in order, without repeats.

    A name is what begins with // and holds a service of the cloud, or is one of two link forms of the compute service.
    However a string is written, its content counts; of a key written twice in an object the last counts. Text that is
    no valid JSON has none.
    """
    return F.pandas_udf(_links, "array<string>")(F.col(text))


def reference_ops(assets: DataFrame, ts: str | Column, order: list[str]) -> DataFrame:
    """A placeholder and an edge for each resource an asset's data refers to, itself left out."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    rows = assets.where("name IS NOT NULL").withColumn("data", F.col("resource.data")).select(*order, "name", ts.alias("ts"), reference_names().alias("_refs"))
    flat = rows.select(*order, "name", "ts", F.posexplode(F.filter("_refs", lambda r: r != F.col("name"))).alias("_i", "_r"))
    pair = F.array(_op("observe_placeholder", name=F.col("_r"), type=infer_type("_r")), _op("observe_edge", src=F.col("name"), dst=F.col("_r"), kind=F.lit("REFERENCES")))
    flat = flat.select(*order, "ts", "_i", F.posexplode(pair).alias("_j", "_o"))
    pos = (F.lit(_REFERENCES) + F.col("_i") * 2 + F.col("_j")).alias("pos")
    return flat.select(F.struct(*order, pos).alias("ord"), "_o.*", "ts", F.lit(None).cast("string").alias("origin"))


def asset_ops(assets: DataFrame, ts: str | Column, order: list[str]) -> DataFrame:
    """All that assets say: themselves and their chains of containers, then what their data refer to."""
    whole = assets.where("name IS NOT NULL AND assetType IS NOT NULL")
    return containment_ops(whole, ts, order).unionByName(reference_ops(whole, ts, order))


def asserting(batch: DataFrame) -> DataFrame:
    """A batch of :func:`asset_ops` without the targets of references: these are named, but not said to be there."""
    return batch.where((F.col("op") != "observe_placeholder") | (F.col("ord.pos") < _REFERENCES))


def parse_records(spark: SparkSession, path: str, schema: str = ENTITY) -> DataFrame:
    """Records of a JSON array or of JSON lines; blank lines are skipped, any bad record fails the whole read.

    ``props`` and ``data`` come as JSON text.
    """
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    multi = bool(first) and first[0][0].lstrip().startswith("[")
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multi).json(path)


# -- folding -----------------------------------------------------------------------


def node_events(ops: DataFrame) -> DataFrame:
    """(name, ord, sub, k, type, props, ts, origin): what each operation says of a node. An edge mentions its ends, source first."""
    direct = ops.where("name IS NOT NULL AND op IN ('observe_node', 'observe_placeholder', 'retire_node')").select(
        "name", "ord", F.lit(0).alias("sub"),
        F.when(F.col("op") == "observe_node", "observe").when(F.col("op") == "retire_node", "retire").otherwise("placeholder").alias("k"),
        "type", "props", "ts", "origin",
    )
    ends = ops.where("op = 'observe_edge' AND src IS NOT NULL AND dst IS NOT NULL").select(
        F.posexplode(F.array("src", "dst")).alias("sub", "name"), "ord", F.lit("mention").alias("k"), F.lit(UNKNOWN).alias("type"), F.lit(None).cast("string").alias("props"), "ts", "origin"
    )
    events = direct.unionByName(ends.select(*direct.columns))
    # only a name's first mention makes a placeholder; a retirement of an unknown name is none
    w = Window.partitionBy("name").orderBy("ord", "sub")
    known = F.count(F.when(F.col("k") != "retire", 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)) > 0
    events = events.withColumn("_known", known)
    events = events.where("(k <> 'mention' OR NOT _known) AND (k <> 'retire' OR _known)")
    return events.withColumn("k", F.when(F.col("k") == "mention", "placeholder").otherwise(F.col("k"))).drop("_known")


def fold_nodes(ops: DataFrame) -> DataFrame:
    """(name, type, placeholder, first_ord): one row per node. The type is the first real observation's,
    else the first placeholder's; a node first met for real is never a placeholder."""
    e = node_events(ops).where("k <> 'retire'")
    by = F.struct("ord", "sub")
    real = F.col("k") == "observe"
    out = e.groupBy("name").agg(
        F.min_by(F.when(real, F.col("type")), F.when(real, by)).alias("_t"), F.min_by("type", by).alias("_p"), F.max(real).alias("_real"), F.min(by).alias("first_ord")
    )
    return out.select("name", F.when(F.col("_real"), F.col("_t")).otherwise(F.col("_p")).alias("type"), (~F.col("_real")).alias("placeholder"), "first_ord")


def fold_versions(ops: DataFrame) -> DataFrame:
    """(name, seq, observed_at, retired_at, props, origin): versions of every node; see :func:`temporal.fold_node_versions`.
    Properties are the same if they are the same JSON value, however it is written."""
    out = temporal.fold_node_versions(node_events(ops), "name", ["ord", "sub"], "k", "props", "ts", canonical("props"), ("origin",))
    return out.withColumnRenamed("state", "props")


def fold_edges(ops: DataFrame) -> DataFrame:
    """(src, dst, kind, valid_from, valid_to, origin): intervals of every edge. Retiring a node ends all open
    edges at it: its retirements fan out to the edges that touch it by a join on the name."""
    edge = ops.where("op IN ('observe_edge', 'retire_edge') AND src IS NOT NULL AND dst IS NOT NULL").select(
        "src", "dst", "kind", "ord", (F.col("op") == "observe_edge").alias("opens"), "ts", "origin"
    )
    triples = edge.where("opens").select("src", "dst", "kind").distinct()
    retired = ops.where("op = 'retire_node'").select("name", "ord", "ts")
    null = F.lit(None).cast("string").alias("origin")
    closes = None
    for end in ("src", "dst"):
        c = triples.join(retired, triples[end] == retired["name"]).select("src", "dst", "kind", "ord", F.lit(False).alias("opens"), "ts", null)
        closes = c if closes is None else closes.unionByName(c)
    events = edge.unionByName(closes.distinct())
    return temporal.fold_edge_intervals(events, ["src", "dst", "kind"], ["ord"], F.col("opens"), ~F.col("opens"), "ts", ["origin"])


def reconcile_ops(ops: DataFrame, batch: DataFrame, asserted: DataFrame, ts: int, ord_: Column) -> DataFrame:
    """Retirements after a full snapshot ``batch`` (operations) on top of the log ``ops`` that includes it:
    open edges of its observed sources it asserts no more, then real nodes it does not assert."""
    edges = fold_edges(ops).where(F.col("valid_to") == T_MAX)
    again = batch.where("op = 'observe_edge'").select("src", "dst", "kind").distinct()
    observed = batch.where("op = 'observe_node'").select(F.col("name").alias("src")).distinct()
    stale_e = edges.select("src", "dst", "kind").join(observed, "src", "left_semi").join(again, ["src", "dst", "kind"], "left_anti")
    nodes = fold_versions(ops).where(F.col("retired_at") == T_MAX).join(fold_nodes(ops).where("NOT placeholder").select("name"), "name", "left_semi")
    said = asserted.select("name").unionByName(batch.where("op IN ('observe_node', 'observe_placeholder')").select("name")).distinct()
    stale_n = nodes.select("name").join(said, "name", "left_anti")
    null = F.lit(None).cast("string")
    e = stale_e.select(ord_.alias("ord"), F.lit("retire_edge").alias("op"), null.alias("name"), "src", "dst", "kind")
    n = stale_n.select(ord_.alias("ord"), F.lit("retire_node").alias("op"), "name", null.alias("src"), null.alias("dst"), null.alias("kind"))
    return e.unionByName(n).select("ord", "op", "name", null.alias("type"), null.alias("props"), "src", "dst", "kind", F.lit(ts).cast("long").alias("ts"), null.alias("origin"))
