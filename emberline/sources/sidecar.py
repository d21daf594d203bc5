"""Learned state as files: JSON snapshots of older systems, and versioned tables of our own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.keys import edge_key

MOST_VERSION = 2


def read_sidecar(spark: SparkSession, path: str, edges: DataFrame) -> DataFrame:
    """``edges`` with weight, t_last and dead from a snapshot, matched by the stable key.

    Version 2 names edges by key; version 1 counts on their order, which ``edges``
    must then give as ``edge_id``. Edges the snapshot lacks keep their own values.
    """
    # one row a file, parsed where it is read; only its version and whether it has keys come to the driver
    text = F.col("value")
    doc = F.from_json(text, "w array<double>, t_last array<bigint>, dead array<boolean>, keys array<string>")
    docs = spark.read.text(path, wholetext=True).select(F.regexp_extract(text, r'"\w*_sidecar"\s*:\s*(\d+)', 1).alias("_version"), doc.alias("_doc"))
    about = docs.select(F.max(F.expr("try_cast(_version AS int)")), F.max(F.col("_doc.keys").isNotNull()), F.max(F.col("_doc.w").isNull())).first()
    if about[0] is not None and about[0] > MOST_VERSION:
        raise ValueError(f"snapshot version {about[0]} is newer than {MOST_VERSION}")
    if about[2] is None or about[2]:
        raise ValueError("no snapshot of learned state")
    by_key = bool(about[1])
    flat = docs.select("_doc.*").select(F.posexplode(F.arrays_zip(F.col("w"), F.col("t_last"), F.coalesce("dead", F.array().cast("array<boolean>")), F.coalesce("keys", F.array().cast("array<string>")))).alias("_i", "_x"))
    state = flat.select((F.col("_x.3") if by_key else F.col("_i").cast("long")).alias("_k"), F.col("_x.w").alias("_w"), F.col("_x.t_last").alias("_t"), F.coalesce(F.col("_x.2"), F.lit(False)).alias("_d"))
    keyed = edges.withColumn("_k", edge_key("src", "dst", "kind", "valid_from")) if by_key else edges.withColumn("_k", F.col("edge_id"))
    out = keyed.join(state, "_k", "left")
    own = set(edges.columns)
    keep = [c for c in edges.columns if c not in ("weight", "t_last", "dead")]
    had = lambda c, other: F.col(c) if c in own else other
    return out.select(
        *keep,
        F.coalesce("_w", had("weight", F.lit(None).cast("double"))).alias("weight"),
        F.coalesce("_t", had("t_last", F.col("valid_from"))).alias("t_last"),
        F.coalesce("_d", had("dead", F.lit(False))).alias("dead"),
    )


def save_version(df: DataFrame, root: str, name: str) -> str:
    """Write ``df`` beside the current version and make it current in one step: readers see the old or the new one whole."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/{name}/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{root}/{name}/_next")
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    fs = hadoop(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop(f"{root}/{name}/_current"), True)
    fs.rename(hadoop(f"{root}/{name}/_next"), hadoop(f"{root}/{name}/_current"))
    return version


def load_version(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The current version of a table, or None where there is none."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    fs = hadoop(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for pointer in ("_current", "_next"):
        if fs.exists(hadoop(f"{root}/{name}/{pointer}")):
            version = spark.read.text(f"{root}/{name}/{pointer}").first()
            if version:
                return spark.read.option("recursiveFileLookup", True).parquet(f"{root}/{name}/{version[0]}")
    return None


def append_rows(df: DataFrame, root: str, name: str) -> None:
    """Add rows to the current version of a table without rewriting it: they are written where no reader looks and
    come into sight by one rename. A job that fails leaves the table as it was."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    fs = hadoop(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    pointer = next((p for p in ("_current", "_next") if fs.exists(hadoop(f"{root}/{name}/{p}"))), None)
    version = spark.read.text(f"{root}/{name}/{pointer}").first() if pointer else None
    if not version:
        save_version(df, root, name)
        return
    part = uuid.uuid4().hex
    df.write.parquet(f"{root}/{name}/_{part}")
    fs.rename(hadoop(f"{root}/{name}/_{part}"), hadoop(f"{root}/{name}/{version[0]}/added-{part}"))
