"""What lies beyond the bounds up to which small forms are used gives the same results."""

import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import orphans, periods, snapshots


def test_more_snapshots_than_are_kept_in_a_plan(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"k{k}", t, float(rng.randrange(2)), t) for k in range(20) for t in range(40) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "k string, at long, weight double, loaded_at long").withColumn("loaded_at", F.timestamp_seconds("loaded_at"))
    run = lambda: sorted(map(tuple, snapshots.snapshot_changes(df, ["k"], "at", "loaded_at", numbers=["weight"]).collect()))
    want = run()
    monkeypatch.setattr(snapshots, "MOST_SNAPSHOTS", 3)
    assert run() == want and len(want) > 100


def test_more_heavy_keys_than_are_listed(spark, monkeypatch):
    refs = spark.createDataFrame([("s", f"d{i % 7}", "K", i) for i in range(200)], "src string, dst string, kind string, valid_from long")
    nodes = spark.createDataFrame([("d1", False, 50, None), ("d2", True, 0, None), ("d3", False, 0, 100)], "name string, placeholder boolean, observed_at long, retired_at long")
    run = lambda share: sorted(map(tuple, orphans.orphan_references(refs, nodes, ["src", "dst", "kind", "valid_from"], heavy_share=share).collect()))
    want = run(2.0)
    monkeypatch.setattr(orphans, "LISTED_KEYS", 0)
    assert run(1 / 100) == want and want


@pytest.mark.parametrize("ranks", [1, 4])
def test_periods_that_end_beyond_a_tasks_ranks(spark, monkeypatch, ranks):
    rng = random.Random(ranks)
    rows = [(e, s, s + rng.randrange(1, 9)) for e in ("a", "b", None) for s in (rng.randrange(400) for _ in range(60))]
    df = spark.createDataFrame(rows, "e string, s long, t long")
    run = lambda: sorted(map(str, periods.periods(df, ["e"], "s", "t").collect()))
    want = run()
    monkeypatch.setattr(periods, "RANKS", ranks)
    assert run() == want
