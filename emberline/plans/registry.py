"""All named queries of the core and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.plans import graph_queries, graph_sql, problems, source_queries

QUERIES = {**problems.QUERIES, **graph_queries.QUERIES, **source_queries.QUERIES}
SQL = {**problems.SQL, **graph_sql.SQL, **source_queries.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_queries.spread_two_hop(spark, sf_dir)
