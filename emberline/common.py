"""Session, loading and checkpoint helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Open end of a half-open interval in the stored tables.
T_MAX = 9223372036854775807

#: Most rows a table may have to be sent to every executor.
BROADCAST_ROWS = 200_000


def build_session(app: str = "emberline", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is developed with."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, whatever their working folder holds."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="emberline-")  # read by the driver only, which serves it to all executors
    with zipfile.ZipFile(os.path.join(folder, "emberline_package.zip"), "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(z.filename)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _SHIPPED.add(context.applicationId)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that setting is absent
    it is a folder in the warehouse, if that is one which all machines see, or on a
    single machine, as in tests, one of this process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return warehouse.rstrip("/") + "/_emberline"
    return os.path.join(tempfile.gettempdir(), f"emberline-{os.getpid()}")


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in :func:`shared_dir`."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a checkpoint that keeps
    the columns' statistics and lets later scans prune columns. It is deleted when
    the application ends."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.parquet(path)


def small_enough(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than needed."""
    return df.limit(most + 1).count() <= most


def broadcast_checked(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its row count is proven to be small."""
    return F.broadcast(df) if small_enough(df, most) else df


def in_order(df: DataFrame, order: list[str], rank: str) -> DataFrame:
    """``df`` with the place of each row, 1.., in the order of columns, no matter how many rows: it is written
    in ranges, each of which is numbered and moved by the sizes of those before it."""
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ordered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order)
    placed = ranged.withColumn("_in", F.row_number().over(inside)).join(F.broadcast(sizes), "_range")
    return placed.select(*df.columns, (F.col("_before") + F.col("_in")).alias(rank))


def in_chunks(df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """``df`` with ``_range`` and ``_chunk``: runs of rows in the order of a group, whose runs come in the order of both.
    No run has more than ``size`` rows, and no task sorts more than a range, however many rows a group has."""
    ranged = written(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "chunks")
    w = Window.partitionBy("_range").orderBy(*group, *order)
    return ranged.withColumn("_chunk", F.floor((F.row_number().over(w) - 1) / size))


def fold_in_order(df: DataFrame, group: list[str], order: list[str], values: list[str], start: tuple, step, result: str) -> DataFrame:
    """(group, n, result) of each group: ``step(state, *lists)`` takes the state over a run of rows' ``values`` in order, for
    folds that have no form in which parts could be put together.

    A group's rows go to one task, which reads them sorted, batch by batch, and holds a batch and one state: a group may
    be larger than its memory, though not faster than one core. A null in a group is a value."""
    names = list(dict.fromkeys([*group, *order, *values]))
    sorted_ = df.select(*names).repartition(*group).sortWithinPartitions(*group, *order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*group).schema)

    def run(batches):
        import pandas as pd

        key, state, n, rows = None, start, 0, []
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[group].astype(object).where(pdf[group].notna(), None)
            new = (keys != keys.shift()).any(axis=1) & ~(keys.isna() & keys.shift().isna()).all(axis=1)
            cuts = [0, *[i for i in new.to_numpy().nonzero()[0].tolist() if i], len(pdf)]
            lists = [pdf[v].tolist() for v in values]
            for a, b in zip(cuts, cuts[1:]):
                mine = tuple(keys.iloc[a])
                if mine != key:
                    if key is not None:
                        rows.append((*key, n, *state))
                    key, state, n = mine, start, 0
                state, n = step(state, *[x[a:b] for x in lists]), n + b - a
            if len(rows) >= 10_000:
                yield pd.DataFrame(rows, columns=[*group, "n", *fields])
                rows = []
        if key is not None:
            rows.append((*key, n, *state))
        yield pd.DataFrame(rows, columns=[*group, "n", *fields])

    fields = [f.strip().split(" ")[0] for f in result.split(",")]
    return sorted_.mapInPandas(run, f"{kinds}, n long, {result}")


def spread_rows(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work in Python that costs far more than
    moving its rows. A scan of many files has enough and stays as it is; only a few small files are spread."""
    ship(df.sparkSession)
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # a scan of less is read by fewer tasks; nothing of the plan is run to know its size
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
    least = spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    # each file counts as so much more, so a small table in many files has tasks enough
    few = size < cores * least and size + len(df.inputFiles()) * least < cores * least
    return df.repartition(cores, *keys) if few else df


def real_edges(edges: DataFrame) -> DataFrame:
    """Rows of ``edges`` that are edges: those with a target."""
    return edges.where(F.col("dst").isNotNull())
