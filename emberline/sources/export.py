"""Tables for a warehouse: nodes, edges with their salience at a time, traces, and the SQL that goes with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.common import T_MAX
from emberline.functions.weights import alive

SCHEMA = """CREATE TABLE {d}.nodes (name STRING, type STRING, placeholder BOOL, observed_at INT64, retired_at INT64, origin STRING, props STRING);
CREATE TABLE {d}.edges (src STRING, dst STRING, kind STRING, weight FLOAT64, open BOOL, valid_from INT64, valid_to INT64, origin STRING);
CREATE TABLE {d}.traces (trace_id INT64, t INT64, surfaced STRING, edges_fired INT64);
"""
QUERIES = """-- the strongest running edges of each kind
SELECT kind, src, dst, weight, valid_from FROM {d}.edges WHERE valid_to IS NULL
QUALIFY row_number() OVER (PARTITION BY kind ORDER BY weight DESC, src, dst) <= 5;
-- how far a node's neighbourhood reaches: nodes within three steps with the best product of weights on the way
WITH RECURSIVE walk AS (
  SELECT src AS origin, dst AS node, weight AS strength, 1 AS steps FROM {d}.edges WHERE valid_to IS NULL
  UNION ALL
  SELECT walk.origin, e.dst, walk.strength * e.weight, walk.steps + 1 FROM walk JOIN {d}.edges AS e ON e.src = walk.node AND e.valid_to IS NULL WHERE walk.steps < 3
)
SELECT origin, node, min(steps) AS steps, max(strength) AS strength FROM walk WHERE origin <> node GROUP BY origin, node;
-- how long edges last, by where they came from
SELECT origin, kind, count(*) AS edges, count(valid_to) AS ended, avg((valid_to - valid_from) / 86400000) AS mean_days FROM {d}.edges GROUP BY origin, kind;
-- nodes that retrievals bring up most often
SELECT json_value(s, '$.node') AS node, count(*) AS times FROM {d}.traces, UNNEST(json_query_array(surfaced)) AS s GROUP BY node ORDER BY times DESC;
"""


def ended(c: str) -> Column:
    """The end of an interval, null while it is open."""
    return F.when(F.coalesce(F.col(c), F.lit(T_MAX)) != T_MAX, F.col(c)).alias(c)


def export_tables(versions: DataFrame, edges: DataFrame, weight: Column, t: int) -> tuple[DataFrame, DataFrame]:
    """Node versions and all edge intervals, closed ones included, each edge with its weight at ``t`` and whether it is open then."""
    nodes = versions.select("name", "type", "placeholder", "observed_at", ended("retired_at"), "origin", "props")
    arcs = edges.select("src", "dst", "kind", weight.alias("weight"), alive("valid_from", "valid_to", t).alias("open"), "valid_from", ended("valid_to"), "origin")
    return nodes, arcs


def write_export(path: str, nodes: DataFrame, edges: DataFrame, traces: DataFrame, dataset: str = "memory") -> None:
    """JSON lines of each table under ``path``, in parts, and the statements for a warehouse as text."""
    for name, df in (("nodes", nodes), ("edges", edges), ("traces", traces)):
        df.write.mode("overwrite").json(f"{path}/{name}")
    spark = nodes.sparkSession
    for name, text in (("schema", SCHEMA), ("queries", QUERIES)):
        spark.createDataFrame([(text.format(d=dataset),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
