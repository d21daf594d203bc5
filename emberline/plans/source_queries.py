"""Queries of the sources: operations out of records, the graph out of operations, terms out of texts, exports; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.common import T_MAX, load
from emberline.functions.weights import infer_type
from emberline.plans.graph_queries import CONFIG, T2, graph, versions
from emberline.sources import conversation, export, oplog


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.entity_ops(load(spark, sf_dir, "inventory"), "ts", ["received_at", "record_id"])


def entity_ops(spark, sf_dir):
    ops = _ops(spark, sf_dir).distinct()
    return ops.select("ord.record_id", "ord.received_at", F.col("ord.pos").cast("long").alias("pos"), "op", "name", "type", "src", "dst", "kind", "ts", "origin")


def node_table(spark, sf_dir):
    return oplog.fold_nodes(_ops(spark, sf_dir)).select("name", "type", "placeholder")


def versions_from_ops(spark, sf_dir):
    return oplog.fold_versions(_ops(spark, sf_dir)).select("name", "seq", "observed_at", "retired_at", "props")


def edges_from_ops(spark, sf_dir):
    return oplog.fold_edges(_ops(spark, sf_dir)).select("src", "dst", "kind", "valid_from", "valid_to", "origin")


def asset_containment_ops(spark, sf_dir):
    assets = load(spark, sf_dir, "cai_assets").withColumnRenamed("asset_type", "assetType")
    ops = oplog.containment_ops(assets, F.lit(T2), ["received_at", "asset_id"]).distinct()
    return ops.select("ord.asset_id", "ord.received_at", F.col("ord.pos").cast("long").alias("pos"), "op", "name", "type", "src", "dst", "kind")


def asset_ops(spark, sf_dir):
    assets = load(spark, sf_dir, "cai_assets").withColumnRenamed("asset_type", "assetType")
    ops = oplog.asset_ops(assets, F.lit(T2), ["received_at", "asset_id"]).distinct()
    return ops.select("ord.asset_id", "ord.received_at", F.col("ord.pos").cast("long").alias("pos"), "op", "name", "type", "src", "dst", "kind")


def inferred_types(spark, sf_dir):
    names = versions(spark, sf_dir).select("name").distinct()
    return names.select("name", infer_type("name").alias("inferred"))


def session_extractor(spark, sf_dir):
    terms = conversation.session_terms(load(spark, sf_dir, "documents"), "doc_id", "text")
    return conversation.session_edges(terms)


def export_nodes(spark, sf_dir):
    return export.export_tables(versions(spark, sf_dir), graph(spark, sf_dir), F.lit(0.0), T2)[0]


def export_edges(spark, sf_dir):
    weight = F.round(F.coalesce("weight", F.lit(CONFIG.w0)), 6)
    return export.export_tables(versions(spark, sf_dir), graph(spark, sf_dir), weight, T2)[1]


QUERIES = {
    f.__name__: f
    for f in (entity_ops, node_table, versions_from_ops, edges_from_ops, asset_containment_ops, asset_ops, inferred_types, session_extractor, export_nodes, export_edges)
}

_OPS = """
i AS (SELECT DISTINCT record_id, received_at, name, type, props, coalesce(edges, []) AS edges, origin, ts FROM inventory
  WHERE name IS NOT NULL AND type IS NOT NULL AND coalesce(len([x FOR x IN edges IF x.dst IS NULL OR x.kind IS NULL]), 0) = 0),
u AS (SELECT i.*, unnest(edges) AS x, unnest(range(len(edges))) AS k FROM i),
ops AS (SELECT record_id, received_at, 0::BIGINT AS pos, 'observe_node' AS op, name, type, props, NULL::VARCHAR AS src, NULL::VARCHAR AS dst, NULL::VARCHAR AS kind, ts, origin FROM i
  UNION ALL SELECT record_id, received_at, 2 * k + 1, 'observe_placeholder', x.dst, coalesce(x.dst_type, 'unknown/unknown'), NULL, NULL, NULL, NULL, ts, origin FROM u
  UNION ALL SELECT record_id, received_at, 2 * k + 2, 'observe_edge', NULL, NULL, NULL, name, x.dst, x.kind, ts, origin FROM u)"""
_ORD = "received_at, record_id, pos"

SQL = {
    "entity_ops": f"WITH {_OPS} SELECT record_id, received_at, pos, op, name, type, src, dst, kind, ts, origin FROM ops",
    "node_table": f"""WITH {_OPS}, m AS (SELECT name, coalesce(arg_min(type, ({_ORD})) FILTER (op = 'observe_node'), arg_min(type, ({_ORD}))) AS type, NOT bool_or(op = 'observe_node') AS placeholder
FROM ops WHERE name IS NOT NULL GROUP BY name) SELECT name, type, placeholder FROM m""",
    "versions_from_ops": f"""WITH {_OPS},
e AS (SELECT name, {_ORD}, ts, CASE op WHEN 'observe_node' THEN 'V' || coalesce(props, 'null') END AS lab FROM ops WHERE name IS NOT NULL),
w AS (SELECT *, last_value(lab IGNORE NULLS) OVER (PARTITION BY name ORDER BY {_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM e),
x AS (SELECT *, CASE WHEN lab IS NULL AND was IS NULL THEN 'Vnull' ELSE lab END AS lab2 FROM w),
y AS (SELECT *, lag(lab2) OVER (PARTITION BY name ORDER BY {_ORD}) AS prev FROM x WHERE lab2 IS NOT NULL),
z AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY name ORDER BY {_ORD}), {T_MAX}) AS ends FROM y WHERE prev IS NULL OR prev <> lab2)
SELECT name, row_number() OVER (PARTITION BY name ORDER BY {_ORD}) AS seq, ts AS observed_at, ends AS retired_at, substring(lab2, 2) AS props FROM z""",
    "edges_from_ops": f"""WITH {_OPS}, f AS (SELECT src, dst, kind, arg_min({{'t': ts, 'o': origin}}, ({_ORD})) AS a FROM ops WHERE op = 'observe_edge' GROUP BY src, dst, kind)
SELECT src, dst, kind, a.t AS valid_from, {T_MAX} AS valid_to, a.o AS origin FROM f""",
    "asset_containment_ops": """WITH a AS (SELECT DISTINCT asset_id, received_at, name, asset_type, coalesce(ancestors, []) AS anc FROM cai_assets WHERE name IS NOT NULL AND asset_type IS NOT NULL),
u AS (SELECT asset_id, received_at, name, unnest(anc) AS x, unnest(range(len(anc))) AS k FROM a),
c AS (SELECT *, '//cloudresourcemanager.googleapis.com/' || x AS full_, CASE split_part(x, '/', 1) WHEN 'projects' THEN 'Project' WHEN 'folders' THEN 'Folder' WHEN 'organizations' THEN 'Organization' END AS t FROM u),
d AS (SELECT *, row_number() OVER (PARTITION BY asset_id, received_at, name ORDER BY k) - 1 AS i, lag(full_) OVER (PARTITION BY asset_id, received_at, name ORDER BY k) AS below FROM c WHERE t IS NOT NULL AND full_ <> name)
SELECT asset_id, received_at, 0::BIGINT AS pos, 'observe_node' AS op, name, asset_type AS type, NULL::VARCHAR AS src, NULL::VARCHAR AS dst, NULL::VARCHAR AS kind FROM a
UNION ALL SELECT asset_id, received_at, 2 * i + 1, 'observe_placeholder', full_, 'cloudresourcemanager.googleapis.com/' || t, NULL, NULL, NULL FROM d
UNION ALL SELECT asset_id, received_at, 2 * i + 2, 'observe_edge', NULL, NULL, full_, coalesce(below, name), 'CONTAINS' FROM d""",
    "inferred_types": r"""WITH p AS (SELECT DISTINCT name, string_split(regexp_replace(name, '^/+', ''), '/') AS s FROM nodes)
SELECT name, s[1] || '/' || CASE WHEN len(s) >= 3 THEN s[len(s) - 1] ELSE 'unknown' END AS inferred FROM p""",
    "session_extractor": """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9_./-]{3,}') AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
u AS (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS k FROM t),
f AS (SELECT doc_id, w, min(k) AS k FROM u WHERE w NOT IN ('the', 'and', 'for', 'what', 'did', 'was', 'our', 'about', 'with', 'that', 'this', 'have', 'has', 'are', 'you', 'your', 'how', 'why', 'when') GROUP BY doc_id, w),
s AS (SELECT doc_id, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM f) WHERE r <= 16)
SELECT 'session/' || doc_id AS src, 'term/' || w AS dst, 'MENTIONS' AS kind FROM s
UNION ALL SELECT DISTINCT 'term/' || a.w, 'term/' || b.w, 'CO_OCCURS' FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.w <> b.w""",
    "export_nodes": f"SELECT name, type, placeholder, observed_at, nullif(retired_at, {T_MAX}) AS retired_at, origin, props FROM (SELECT DISTINCT name, type, placeholder, observed_at, retired_at, origin, props FROM nodes)",
    "export_edges": f"""WITH g AS (SELECT src, dst, kind, valid_from, arg_max({{'t': valid_to, 'w': weight, 'o': origin}}, loaded_at) AS v FROM edges
  WHERE dst IS NOT NULL AND exported_at = (SELECT max(exported_at) FROM edges WHERE dst IS NOT NULL) GROUP BY src, dst, kind, valid_from)
SELECT src, dst, kind, round(coalesce(v.w, {CONFIG.w0}), 6) AS weight, valid_from <= {T2} AND {T2} < coalesce(v.t, {T_MAX}) AS open, valid_from, nullif(v.t, {T_MAX}) AS valid_to, v.o AS origin FROM g""",
}

SQL["asset_ops"] = SQL["asset_containment_ops"] + r"""
UNION ALL
(WITH a AS (SELECT DISTINCT asset_id, received_at, name, resource.data AS data FROM cai_assets WHERE name IS NOT NULL AND asset_type IS NOT NULL),
j AS (SELECT * FROM a WHERE CASE WHEN json_valid(data) THEN true ELSE false END),
t AS (SELECT asset_id, received_at, name, x.id AS k, x.atom ->> '$' AS s FROM j, json_tree(CASE WHEN json_valid(j.data) THEN j.data ELSE 'null' END) x WHERE x.type = 'VARCHAR'),
f AS (SELECT *, CASE WHEN starts_with(s, '//') AND contains(s, '.googleapis.com/') THEN s
  WHEN regexp_matches(s, '^https://(www|compute)\.googleapis\.com/compute/v1/') THEN regexp_replace(s, '^https://(www|compute)\.googleapis\.com/compute/v1/', '//compute.googleapis.com/') END AS r FROM t),
g AS (SELECT asset_id, received_at, name, r, row_number() OVER (PARTITION BY asset_id, received_at, name ORDER BY min(k)) - 1 AS i, string_split(regexp_replace(r, '^/+', ''), '/') AS p
  FROM f WHERE r IS NOT NULL AND r <> name GROUP BY asset_id, received_at, name, r)
SELECT asset_id, received_at, 1000000 + 2 * i AS pos, 'observe_placeholder' AS op, r AS name, p[1] || '/' || CASE WHEN len(p) >= 3 THEN p[len(p) - 1] ELSE 'unknown' END AS type, NULL AS src, NULL AS dst, NULL AS kind FROM g
UNION ALL SELECT asset_id, received_at, 1000001 + 2 * i, 'observe_edge', NULL, NULL, name, r, 'REFERENCES' FROM g)"""
