import pytest
from pyspark.sql import functions as F

from emberline.config import Config
from emberline.operators import learn
from emberline.sources import wal
from emberline.streaming import jobs
from tests_helpers import some_ops


def run(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_log_tail_appends_once(spark, tmp_path):
    wal.write_wal(some_ops(spark), str(tmp_path / "log"), "0" * 16)
    for _ in range(2):
        jobs.append_batches(jobs.tail_log(spark, str(tmp_path / "log")), str(tmp_path / "ops"), str(tmp_path / "c")).awaitTermination(120)
    back = spark.read.parquet(str(tmp_path / "ops"))
    assert back.where("status = 'framed'").count() == 4 and back.where("status = 'bad'").count() == 0


def test_streamed_touches_are_the_fold(spark, tmp_path):
    rows = [(f"e{i % 3}", 1000 * i, i, (-1) ** i * 0.7) for i in range(60)]
    schema = "edge_key string, t long, seq long, r double"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    last = {}
    for r in run(jobs.touch_states(stream, Config(), 1e-4), "update", "touched"):
        last[r["edge_key"]] = max(last.get(r["edge_key"], (0, 0)), (r["n"], r["w"]))
    fold = learn.touch_fold(spark.createDataFrame(rows, schema), "edge_key", ["t", "seq"], "t", "r", 0.5, 1e-4, Config())
    assert {k: v[1] for k, v in last.items()} == pytest.approx({r["edge_key"]: r["w"] for r in fold.collect()})


def test_once_per_day_and_rates(spark, tmp_path):
    rows = [("k", 0), ("k", 5), ("j", 5)]
    spark.createDataFrame(rows, "key string, s long").select("key", F.timestamp_seconds(F.col("s")).alias("at")).write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema("key string, at timestamp").parquet(str(tmp_path / "r"))
    assert sorted(r["key"] for r in run(jobs.once_per_day(stream, ["key"]), "append", "daily")) == ["j", "k"]
    spark.createDataFrame([("d", t) for t in (0, 1, 2, 60_000, 119_999, 120_001)], "db string, t long").write.parquet(str(tmp_path / "q"))
    rates = run(jobs.rate_windows(spark.readStream.schema("db string, t long").parquet(str(tmp_path / "q")), 2), "append", "rates")
    assert sorted((r["t"], r["allowed"]) for r in rates) == [(0, True), (1, True), (2, False), (60_000, True), (119_999, True), (120_001, True)]
