"""The operation log as a text file: framed lines with checksums, and older bare ones.

A framed line is eight hex digits of the CRC-32 of its JSON, a colon, the JSON. A
header line names the format's version and the log's id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Versions of the format this reads.
MOST_VERSION = 1
HEADER = re.compile(r"^#\w+-wal:v(\d+)(?: id=([0-9a-f]{16}))?")
_OP = "op string, name string, asset_type string, inferred_type string, props variant, src string, dst string, kind string, ts long, origin string"


def framed(json: str | Column) -> Column:
    json = F.col(json) if isinstance(json, str) else json
    return F.concat(F.lpad(F.lower(F.hex(F.crc32(json))), 8, "0"), F.lit(":"), json)


def write_wal(ops: DataFrame, path: str, log_id: str, name: str = "emberline") -> None:
    """One file of framed lines in ``ord`` order under a header. A log has a single writer."""
    keep = {"observe_node": "asset_type", "observe_placeholder": "inferred_type"}
    type_of = lambda k: F.when(F.col("op") == k, F.col("type"))
    props = F.when(F.col("op") == "observe_node", F.try_parse_json(F.coalesce("props", F.lit("null"))))
    body = F.to_json(F.struct("op", "name", type_of("observe_node").alias(keep["observe_node"]), type_of("observe_placeholder").alias(keep["observe_placeholder"]), props.alias("props"), "src", "dst", "kind", "ts", "origin"))
    head = ops.sparkSession.createDataFrame([(f"#{name}-wal:v{MOST_VERSION} id={log_id}",)], "value string").select(F.lit(0).alias("_k"), F.lit(None).cast(ops.schema["ord"].dataType).alias("ord"), "value")
    lines = head.unionByName(ops.select(F.lit(1).alias("_k"), "ord", framed(body).alias("value")))
    lines.coalesce(1).sortWithinPartitions("_k", "ord").select("value").write.mode("overwrite").text(path)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines counted from 0 through the file, by block: each is counted in place and moved by what lies before it."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    block = Window.partitionBy("_f", "_b").orderBy("_m")
    rows = raw.withColumn("_i", F.row_number().over(block) - 1)
    sizes = raw.groupBy("_f", "_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    sizes = sizes.select("_f", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return rows.join(F.broadcast(sizes), ["_f", "_b"]).select((F.col("_o") + F.col("_i")).alias("line"), "value")


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line, status, json): 'header', 'blank', 'framed', 'legacy' or 'bad' for each line."""
    v = F.col("value")
    is_frame = v.rlike(r"^[0-9a-fA-F]{8}:")
    json = F.when(is_frame, F.expr("substring(value, 10)")).otherwise(v)
    sums = F.lower(F.substring(v, 1, 8)) == F.lpad(F.lower(F.hex(F.crc32(F.expr("substring(value, 10)")))), 8, "0")
    valid = F.try_variant_get(F.try_parse_json(json), "$.op", "string").isNotNull()
    status = (
        F.when(v.startswith("#"), "header").when(F.trim(v) == "", "blank")
        .when(is_frame & sums & valid, "framed").when(~is_frame & valid, "legacy").otherwise("bad")
    )
    return lines.select("line", status.alias("status"), F.when(~v.startswith("#"), json).alias("json"), "value")


def check_header(lines: DataFrame) -> None:
    # all lines that may be headers, wherever they stand; the greatest version is all that comes back
    version = F.try_to_number(F.regexp_extract("value", HEADER.pattern, 1), F.lit("9999999999")).cast("long")
    newest = lines.where(F.col("value").startswith("#")).agg(F.max(version)).first()[0]
    if newest is not None and newest > MOST_VERSION:
        raise ValueError(f"log version {newest} is newer than {MOST_VERSION}")


def verify_wal(spark: SparkSession, path: str) -> DataFrame:
    """(framed, legacy, torn_tail, first_bad): a last line that is bad is a torn tail, any other corruption."""
    p = parse_lines(_numbered(spark, path)).where("status <> 'blank'")
    counts = p.agg(F.count_if(F.col("status") == "framed").alias("framed"), F.count_if(F.col("status") == "legacy").alias("legacy"), F.max("line").alias("_last"), F.max(F.when(F.col("status") == "bad", F.col("line"))).alias("_bad"), F.min(F.when(F.col("status") == "bad", F.col("line"))).alias("_first"))
    torn = F.coalesce(F.col("_bad") == F.col("_last"), F.lit(False))
    return counts.select("framed", "legacy", torn.alias("torn_tail"), F.when(F.col("_first") < F.col("_last"), F.col("_first")).alias("first_bad"))


def read_wal(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Operations of a log file with ``ord`` (line). ``strict`` refuses a log that is corrupt before its last line;
    otherwise bad lines are skipped. A newer version is refused either way."""
    lines = _numbered(spark, path)
    check_header(lines)
    if strict and (bad := verify_wal(spark, path).first()["first_bad"]) is not None:
        raise ValueError(f"line {bad} is corrupt")
    parsed = parse_lines(lines).where("status IN ('framed', 'legacy')").select("line", F.from_json("json", _OP).alias("o"))
    return parsed.select(
        F.struct(F.col("line").alias("line")).alias("ord"), "o.op", "o.name", F.coalesce("o.asset_type", "o.inferred_type").alias("type"),
        F.when(F.col("o.op") == "observe_node", F.coalesce(F.to_json("o.props"), F.lit("null"))).alias("props"),
        "o.src", "o.dst", "o.kind", "o.ts", "o.origin",
    )
