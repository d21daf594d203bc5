import random

from pyspark.sql import functions as F

from emberline.sources import oplog, wal
from emberline.streaming import jobs


def history(spark, ts, n=400):
    """Observations and retirements whose fold depends on their order: the times say nothing of it."""
    rng = random.Random(ts)
    rows = []
    for i in range(n):
        k, origin = rng.randrange(9), f"o:{i % 3}"
        if k < 4:
            rows.append(((i,), "observe_node", f"n{rng.randrange(12)}", f"t{i}", '{"a":%d,"s":"x/y"}' % rng.randrange(3), None, None, None, ts, origin))
        elif k < 6:
            rows.append(((i,), "observe_edge", None, None, None, f"n{rng.randrange(12)}", f"n{rng.randrange(20)}", "CALLS", ts, origin))
        elif k < 8:
            rows.append(((i,), "retire_edge", None, None, None, f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", "CALLS", ts + i, None))
        else:
            rows.append(((i,), "retire_node", f"n{rng.randrange(12)}", None, None, None, None, None, ts + i, None))
    return spark.createDataFrame(rows, "ord struct<i:int>, " + oplog.OPS)


def tables(ops):
    folds = oplog.fold_nodes(ops).drop("first_ord"), oplog.fold_versions(ops), oplog.fold_edges(ops)
    return [sorted(map(str, f.collect())) for f in folds]


def test_streamed_log_folds_as_the_read_one(spark, tmp_path):
    log, bad = tmp_path / "log", "00000000:{}"
    for k in (1, 0):  # the later segment arrives first, each in a batch of its own
        wal.write_wal(history(spark, 1000 * (1 + k)), str(tmp_path / f"w{k}"), "0" * 16)
        (part,) = (tmp_path / f"w{k}").glob("part-*")
        log.mkdir(exist_ok=True)
        (log / f"segment-{k}.txt").write_text(part.read_text() + bad + "\n")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # several blocks a segment
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            jobs.append_batches(jobs.tail_log(spark, str(log)), str(tmp_path / "ops"), str(tmp_path / "c")).awaitTermination(120)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    table = spark.read.parquet(str(tmp_path / "ops"))
    assert table.select("batch").distinct().count() == 2 and table.where("ord.block > 0").count() > 0
    assert table.select("ord").distinct().count() == table.count() == 802
    streamed = table.where("status <> 'bad'")
    read = wal.read_wal(spark, str(log), strict=False)
    assert tables(streamed) == tables(read)
    assert streamed.where(F.col("props").contains('"s":"x/y"')).count() == read.where("op = 'observe_node'").count() > 0
