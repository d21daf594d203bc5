"""Queries p1, p3, p4, p5 and p6 over the project's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.common import load, real_edges
from emberline.operators import nested, orphans, periods, skew, snapshots

EDGE_KEY = ["src", "dst", "kind", "valid_from"]
STATE = {"flags": ["open"], "numbers": ["weight"]}


# -- 1: nested records ---------------------------------------------------------


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.nested_children(load(spark, sf_dir, "inventory"), load(spark, sf_dir, "cai_assets"))


def p1_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records have children in each relation, how many children, and how far they reach."""
    found = p1_found(spark, sf_dir)
    per_record = found.groupBy("rel", "record_id").agg(F.count("*").alias("n"), F.max("pos").alias("last"))
    return per_record.groupBy("rel").agg(F.count("*").alias("n_records"), F.sum("n").alias("n_children"), F.max("last").alias("max_pos"))


# -- 3: orphan references ------------------------------------------------------


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_references(real_edges(load(spark, sf_dir, "edges")), load(spark, sf_dir, "nodes"), EDGE_KEY)


def p3_orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_counts(real_edges(load(spark, sf_dir, "edges")), load(spark, sf_dir, "nodes"), EDGE_KEY, "exported_at", "edges")


# -- 4: heavy keys -------------------------------------------------------------


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heavy_nodes(load(spark, sf_dir, "edges"))


def p4_node_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = skew.node_totals(real_edges(load(spark, sf_dir, "edges")))
    return totals.select("side", "node", "n_rows", "n_weights", F.round("total_weight", 4).alias("total_weight"), F.round("max_weight", 6).alias("max_weight"))


# -- 5: changes between snapshots ----------------------------------------------


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_changes(real_edges(load(spark, sf_dir, "edges")), EDGE_KEY, "exported_at", "loaded_at", **STATE)


def p5_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_intervals(real_edges(load(spark, sf_dir, "edges")), EDGE_KEY, "exported_at", "loaded_at", **STATE)


# -- 6: periods and gaps -------------------------------------------------------


def last_export(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges of the last export as its rows count, and the rows they come from."""
    edges = real_edges(load(spark, sf_dir, "edges"))
    last = edges.agg(F.max("exported_at")).first()[0]
    rows = edges.where(F.col("exported_at") == F.lit(last))
    return snapshots.latest_rows(rows, EDGE_KEY, ["valid_to"], "loaded_at"), rows


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, rows = last_export(spark, sf_dir)
    return periods.gaps(edges, ["src", "kind"], "valid_from", "valid_to", raw=rows)


def p6_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, rows = last_export(spark, sf_dir)
    return periods.periods(edges, ["src", "kind"], "valid_from", "valid_to", raw=rows)


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_child_counts, p3_found, p3_orphan_counts, p4_found, p4_node_totals, p5_found, p5_intervals, p6_found, p6_periods)
}

# -- SQL -----------------------------------------------------------------------

_P1 = """
WITH props AS (SELECT record_id, CASE WHEN json_valid(props) THEN props::JSON END j FROM inventory WHERE record_id IS NOT NULL),
rev AS (SELECT record_id, j->'$.rev' v FROM props WHERE json_type(j) = 'OBJECT'),
raw AS (SELECT asset_id record_id, CASE WHEN json_valid(resource.data) THEN resource.data::JSON END j FROM cai_assets WHERE asset_id IS NOT NULL),
again AS (SELECT record_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END ELSE j END j FROM raw),
tops AS (SELECT record_id, j FROM again WHERE json_type(j) = 'OBJECT'),
holders AS (SELECT record_id, j FROM tops UNION ALL SELECT record_id, j->'$.spec' FROM tops WHERE json_type(j, '$.spec') = 'OBJECT'),
lists AS (SELECT record_id, CASE json_type(j, '$.interfaces') WHEN 'ARRAY' THEN (j->'$.interfaces')::JSON[] WHEN 'OBJECT' THEN [j->'$.interfaces'] END l FROM holders),
faces AS (SELECT record_id, unnest(l) f, unnest(range(len(l))) pos FROM lists WHERE l IS NOT NULL),
face AS (SELECT record_id, f, pos FROM faces WHERE json_type(f) = 'OBJECT'),
confs AS (SELECT record_id, pos parent_pos, CASE json_type(f, '$.configs') WHEN 'ARRAY' THEN (f->'$.configs')::JSON[] WHEN 'OBJECT' THEN [f->'$.configs'] END l FROM face),
conf AS (SELECT record_id, parent_pos, unnest(l) c, unnest(range(len(l))) pos FROM confs WHERE l IS NOT NULL),
edge AS (SELECT record_id, unnest(edges) e, unnest(range(len(edges))) pos FROM inventory WHERE record_id IS NOT NULL AND edges IS NOT NULL),
anc AS (SELECT asset_id record_id, unnest(ancestors) a, unnest(range(len(ancestors))) pos FROM cai_assets WHERE asset_id IS NOT NULL AND ancestors IS NOT NULL),
revs AS (SELECT record_id, unnest(v::JSON[]) x, unnest(range(len(v::JSON[]))) pos FROM rev WHERE json_type(v) = 'ARRAY'),
found AS (
  SELECT 'edge' rel, record_id, -1::BIGINT parent_pos, pos::BIGINT pos, e.dst child FROM edge WHERE e.dst IS NOT NULL
  UNION SELECT 'ancestor', record_id, -1, pos, a FROM anc WHERE a IS NOT NULL
  UNION SELECT 'rev', record_id, -1, 0, v->>'$' FROM rev WHERE json_type(v) IN ('VARCHAR', 'BIGINT', 'UBIGINT')
  UNION SELECT 'rev', record_id, -1, pos, x->>'$' FROM revs WHERE x IS NOT NULL AND json_type(x) <> 'NULL'
  UNION SELECT 'iface', record_id, -1, pos, coalesce(f->>'$.network', '') FROM face
  UNION SELECT 'config', record_id, parent_pos, pos, coalesce(c->>'$.endpoint', '') FROM conf WHERE json_type(c) = 'OBJECT')
"""

_NODES = "n AS (SELECT name, placeholder, observed_at, coalesce(retired_at, 9223372036854775807) ends FROM nodes)"
_REASON = """CASE WHEN count(n.name) = 0 THEN 'missing' WHEN count(*) FILTER (NOT placeholder) = 0 THEN 'placeholder'
  WHEN count(*) FILTER (NOT placeholder AND observed_at > valid_from) > 0 THEN 'late' ELSE 'deleted' END"""
_DEAD = "count(*) FILTER (NOT placeholder AND observed_at <= valid_from AND valid_from < ends) = 0"

_STATES = """
d AS (SELECT src, dst, kind, valid_from, exported_at, arg_max({'o': open, 'w': weight}, loaded_at) v FROM edges WHERE dst IS NOT NULL GROUP BY ALL),
x AS (SELECT exported_at, lead(exported_at) OVER (ORDER BY exported_at) following, row_number() OVER (ORDER BY exported_at) AS r FROM (SELECT DISTINCT exported_at FROM d))
"""
_SAME = "(a.v.o IS NOT DISTINCT FROM b.v.o AND (a.v.w IS NULL) = (b.v.w IS NULL) AND coalesce(abs(a.v.w - b.v.w) <= 0.000001, TRUE))"

_LAST = """
WITH iv AS (SELECT src, kind, valid_from AS s, arg_max(coalesce(valid_to, 9223372036854775807), loaded_at) AS e FROM edges
  WHERE dst IS NOT NULL AND exported_at = (SELECT max(exported_at) FROM edges WHERE dst IS NOT NULL) GROUP BY src, dst, kind, valid_from),
m AS (SELECT *, max(e) OVER (PARTITION BY src, kind ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv WHERE e > s)
"""

SQL = {
    "p1_found": _P1 + "SELECT rel, record_id, parent_pos, pos, child FROM found",
    "p1_child_counts": _P1
    + """, per AS (SELECT rel, record_id, count(*) n, max(pos) AS last FROM found GROUP BY ALL)
SELECT rel, count(*) AS n_records, sum(n)::BIGINT AS n_children, max(last) AS max_pos FROM per GROUP BY rel""",
    "p3_found": f"""WITH e AS (SELECT DISTINCT src, dst, kind, valid_from FROM edges WHERE dst IS NOT NULL), {_NODES}
SELECT src, dst, kind, valid_from, {_REASON} AS reason FROM e LEFT JOIN n ON n.name = e.dst GROUP BY src, dst, kind, valid_from HAVING {_DEAD}""",
    "p3_orphan_counts": f"""WITH e AS (SELECT DISTINCT src, dst, kind, valid_from, exported_at FROM edges WHERE dst IS NOT NULL AND exported_at IS NOT NULL), {_NODES},
o AS (SELECT src, dst, kind, valid_from, exported_at, {_REASON} AS reason FROM e LEFT JOIN n ON n.name = e.dst GROUP BY src, dst, kind, valid_from, exported_at HAVING {_DEAD})
SELECT 'edges' AS table_name, exported_at, reason, count(*) AS n_edges FROM o GROUP BY exported_at, reason""",
    "p4_found": """SELECT 'src' AS side, src AS node FROM edges WHERE src IS NOT NULL GROUP BY src HAVING count(*) >= 0.02 * (SELECT count(*) FROM edges)
UNION ALL SELECT 'dst', dst FROM edges WHERE dst IS NOT NULL GROUP BY dst HAVING count(*) >= 0.02 * (SELECT count(*) FROM edges)""",
    "p4_node_totals": """WITH x AS (SELECT 'src' AS side, src AS node, weight FROM edges WHERE dst IS NOT NULL AND src IS NOT NULL
  UNION ALL SELECT 'dst', dst, weight FROM edges WHERE dst IS NOT NULL)
SELECT side, node, count(*) AS n_rows, count(weight) AS n_weights, round(sum(weight), 4) AS total_weight, round(max(weight), 6) AS max_weight FROM x GROUP BY side, node""",
    "p5_found": f"""WITH {_STATES},
b AS (SELECT d.*, r FROM d JOIN x USING (exported_at)),
a AS (SELECT d.src, d.dst, d.kind, d.valid_from, d.v, x.following FROM d JOIN x USING (exported_at) WHERE x.following IS NOT NULL)
SELECT coalesce(b.exported_at, a.following) AS exported_at, coalesce(b.src, a.src) AS src, coalesce(b.dst, a.dst) AS dst, coalesce(b.kind, a.kind) AS kind,
  coalesce(b.valid_from, a.valid_from) AS valid_from, CASE WHEN a.src IS NULL THEN 'added' WHEN b.src IS NULL THEN 'removed' ELSE 'changed' END AS diff
FROM (SELECT * FROM b WHERE r > 1) b FULL JOIN a ON a.src = b.src AND a.dst = b.dst AND a.kind = b.kind AND a.valid_from = b.valid_from AND a.following = b.exported_at
WHERE a.src IS NULL OR b.src IS NULL OR NOT {_SAME}""",
    "p5_intervals": f"""WITH {_STATES},
y AS (SELECT src, dst, kind, valid_from, exported_at, v, r, lag(r) OVER k AS r0, lag(v) OVER k AS v0 FROM d JOIN x USING (exported_at)
  WINDOW k AS (PARTITION BY src, dst, kind, valid_from ORDER BY r)),
z AS (SELECT *, CASE WHEN r0 = r - 1 AND v.o IS NOT DISTINCT FROM v0.o AND (v.w IS NULL) = (v0.w IS NULL) AND coalesce(abs(v.w - v0.w) <= 0.000001, TRUE) THEN 0 ELSE 1 END AS s FROM y),
i AS (SELECT *, sum(s) OVER (PARTITION BY src, dst, kind, valid_from ORDER BY r) AS island FROM z)
SELECT src, dst, kind, valid_from, min(exported_at) AS valid_since, max(exported_at) AS valid_until FROM i GROUP BY src, dst, kind, valid_from, island""",
    "p6_found": _LAST + "SELECT src, kind, reach AS gap_from, s AS gap_to FROM m WHERE reach < s",
    "p6_periods": _LAST
    + """, p AS (SELECT *, sum(CASE WHEN reach >= s THEN 0 ELSE 1 END) OVER (PARTITION BY src, kind ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT src, kind, min(s) AS period_from, nullif(max(e), 9223372036854775807) AS period_to FROM p GROUP BY src, kind, k""",
}
