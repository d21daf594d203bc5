"""Small stores beside the graph: traces kept up to a number, requests answered once, backups, databases, metrics text."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Traces and answered requests that are kept; hours a request counts as answered.
KEPT, WINDOW_HOURS = 4096, 24


def keep_latest(rows: DataFrame, order: str, most: int = KEPT) -> DataFrame:
    """The ``most`` rows with the greatest ``order``; each task passes no more than that on."""
    return rows.where(F.col(order).isNotNull()).orderBy(F.desc(order)).limit(most)


def put_once(store: DataFrame, requests: DataFrame, now: int, most: int = KEPT) -> DataFrame:
    """The store (endpoint, key, code, body, at_ms) with requests whose (endpoint, key) was not answered in the window; the first of repeats counts."""
    since = now - WINDOW_HOURS * 3_600_000
    live = store.where(F.col("at_ms") > since)
    columns = ["code", "body", "at_ms"]
    fresh = requests.groupBy("endpoint", "key").agg(F.min_by(F.struct(*columns), "at_ms").alias("_r")).select("endpoint", "key", "_r.*")
    return keep_latest(live.unionByName(fresh.join(live, ["endpoint", "key"], "left_anti")), "at_ms", most)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def list_databases(spark: SparkSession, root: str) -> list[str]:
    _, fs, at = _fs(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def drop_database(spark: SparkSession, root: str, name: str) -> bool:
    if not name or "/" in name or name.startswith("."):
        raise ValueError("no database name")
    _, fs, at = _fs(spark, f"{root}/{name}")
    return fs.delete(at, True) if fs.exists(at) else False


def backup(spark: SparkSession, root: str, name: str, target: str) -> dict:
    """Copy a database's files and write a manifest of them beside the copy."""
    jvm, fs, at = _fs(spark, f"{root}/{name}")
    _, to_fs, to = _fs(spark, f"{target}/{name}")
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, to_fs, to, False, True, spark.sparkContext._jsc.hadoopConfiguration())
    summary = to_fs.getContentSummary(to)
    manifest = {"database": name, "files": summary.getFileCount(), "bytes": summary.getLength()}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/{name}-manifest")
    return manifest


def metrics_text(gauges: Mapping[str, float], histogram: DataFrame, bounds: list[int], name: str = "requests") -> str:
    """Gauges and one histogram row per route (route, le_<bound>..., le_inf, total) in the text format of metric scrapers. Routes are few."""
    lines = [f"# TYPE {k} gauge\n{k} {v:g}" for k, v in gauges.items()]
    lines.append(f"# TYPE {name}_ms histogram")
    for r in histogram.orderBy("route").toLocalIterator():
        lines += [f'{name}_ms_bucket{{route="{r["route"]}",le="{b}"}} {r[f"le_{b}"]}' for b in bounds]
        lines += [f'{name}_ms_bucket{{route="{r["route"]}",le="+Inf"}} {r["le_inf"]}', f'{name}_ms_sum{{route="{r["route"]}"}} {r["total"]:g}', f'{name}_ms_count{{route="{r["route"]}"}} {r["le_inf"]}']
    return "\n".join(lines) + "\n"
