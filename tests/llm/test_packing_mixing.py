import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import mixing, packing, tokens


def test_best_fit_respects_every_dimension():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 100, 3000)
    at = packing.best_fit(sizes, 100, 5, 4000.0)
    for b in np.unique(at):
        inside = sizes[at == b]
        assert inside.sum() <= 100 and len(inside) <= 5
        assert len(inside) == 1 or (inside.astype(float) ** 2).sum() <= max(4000.0, inside.max() ** 2)
    assert len(np.unique(packing.best_fit(np.array([60, 60, 40, 40]), 100, 9, 1e9))) == 2
    assert len(packing.best_fit(np.zeros(0, np.int64), 10, 2, 1.0)) == 0


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, tokens long, container string, _n int")


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(2)
    sizes = {i: rng.choice([rng.randrange(40), rng.randrange(300), 1000]) for i in range(1500)}
    sizes[7], sizes[8], sizes[9] = 2500, 256, 0
    out = packing.pack(docs(spark, [(i, n, "clash", 1) for i, n in sizes.items()]), [(1, 256), (2, 1024), (3, None), (4, 0)], block_items=400)
    rows = out.collect()
    assert {r["pack_id"] for r in rows} == {1, 2}
    for pack, capacity in ((1, 256), (2, 1024)):
        mine = [r for r in rows if r["pack_id"] == pack]
        pieces, room = {}, {}
        for r in mine:
            pieces.setdefault(r["doc_id"], []).append((r["piece"], r["first_token"], r["tokens"]))
            room[r["container"]] = room.get(r["container"], 0) + r["tokens"]
        for i, n in sizes.items():
            parts = sorted(pieces[i])
            assert sum(t for _, _, t in parts) == n and [f for _, f, _ in parts] == [capacity * k for k in range(len(parts))]
            assert len(parts) == max(1, -(-n // capacity))
        assert max(room.values()) <= capacity
        assert len(room) <= 1.05 * sum(sizes.values()) / capacity + 5
    report = {r["pack_id"]: r for r in packing.fill_report(out, [(1, 256), (2, 1024)]).collect()}
    assert report[1]["n_tokens"] == sum(sizes.values()) and report[1]["fill"] > 0.95


def test_packing_edges(spark):
    assert packing.pack(docs(spark, []), [(1, 10)]).count() == 0
    odd = packing.pack(docs(spark, [(None, 3, None, None), (1, None, None, None), (1, -4, None, None), (2, 5, None, None), (2, 5, None, None)]), [(1, 10)])
    assert sorted((r["doc_id"], r["tokens"]) for r in odd.collect()) == [(1, 0), (1, 0), (2, 5), (2, 5)]
    assert packing.pack(docs(spark, [(1, 3, None, None)]), []).count() == 0


def test_attention_limits_the_company():
    sizes = np.array([50] * 10)
    assert len(np.unique(packing.best_fit(sizes, 100, 10, 2500.0))) == 10
    assert len(np.unique(packing.best_fit(sizes, 100, 10, 5000.0))) == 5


TARGETS = "source string, target_share double, max_repeats int, tokens string"


def test_mixing_reaches_the_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 100)
    rng = random.Random(3)
    sizes = {"big": 3000, "mid": 900, "small": 60}
    rows = [(f"{s}", i * 10 + k, rng.randrange(1, 60), "clash") for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(None, -1, 5, None), ("big", None, 5, None), ("other", -2, 5, None), ("big", -3, 0, None), ("big", -4, None, None)]
    df = spark.createDataFrame(rows, "source string, doc_id long, tokens long, position string").repartition(4)
    targets = spark.createDataFrame([("big", 0.6, 1, "x"), ("mid", 0.25, 2, "x"), ("small", 0.15, 4, "x"), ("empty", 0.1, 2, "x"), (None, 0.1, 1, "x"), ("zero", 0.0, 1, "x")], TARGETS)
    mixed = mixing.mix(df, targets)
    got = mixed.orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, len(got) + 1))
    total, uses, running = {}, {}, 0
    for r in got:
        running += r["tokens"]
        assert r["total_tokens"] == running
        total[r["source"]] = total.get(r["source"], 0) + r["tokens"]
        uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
    assert set(total) == {"big", "mid", "small"} and max(uses.values()) == 4
    for s, w in (("big", 0.6), ("mid", 0.25), ("small", 0.15)):
        assert total[s] / running == pytest.approx(w, abs=0.005)
    half = got[: len(got) // 2]
    assert sum(r["tokens"] for r in half if r["source"] == "big") / sum(r["tokens"] for r in half) == pytest.approx(0.6, abs=0.02)
    report = {r["source"]: r for r in mixing.mix_report(mixed, targets).collect()}
    assert report["empty"]["n_tokens"] == 0 and report["big"]["actual_share"] == pytest.approx(0.6, abs=0.005)
    assert mixing.mix(df, targets, budget=1000).agg(F.sum("tokens")).first()[0] <= 1000
    assert mixing.mix(df, targets).collect() and sorted(map(tuple, mixing.mix(df.repartition(7), targets).collect())) == sorted(map(tuple, got))


def test_mixing_nothing(spark):
    df = spark.createDataFrame([], "source string, doc_id long, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1, "x")], TARGETS)
    assert mixing.mix(df, targets).count() == 0
    assert mixing.mix_report(mixing.mix(df, targets), targets).first()["n_tokens"] == 0


def test_token_counts_round_trip(spark):
    texts = ["", None, "Hello, world!", "色は少し暗いです。", "a" * 50_000, " \n\t x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.with_tokens(df, "doc_id").collect()}
    enc = tokens.encoder()
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i] == len(ids) and enc.decode(ids) == (t or "")


def test_large_containers_are_full_and_alike():
    rng = np.random.default_rng(6)
    sizes = np.minimum(rng.lognormal(4.2, 1.3, 20_000).astype(np.int64) + 1, 8192)
    squares = sizes.astype(float) ** 2
    for capacity in (8192, 65_536):
        fewest = -(-int(sizes.sum()) // capacity)
        most, cost = int(packing.DOCS_SLACK * len(sizes) / fewest), packing.ATTENTION_SLACK * squares.sum() / fewest
        at = packing.best_fit(sizes, capacity, most, cost, costs=np.where(squares > cost, 0.0, squares))
        n = at.max() + 1
        # where pieces are as long as containers, the limits cost room
        assert fewest / n >= (0.95 if capacity == 8192 else 0.99)
        count = np.bincount(at)
        assert count.max() <= most
        assert np.bincount(at, weights=np.where(squares > cost, 0.0, squares)).max() <= cost
        assert capacity > 8192 or count.max() == most  # the limit binds


def test_packing_rules_are_counted(spark):
    rows = [(i, 40 + i % 90, "clash", 1) for i in range(300)]
    df = docs(spark, rows)
    packed = packing.pack(df, [(1, 256)])
    assert packing.broken_rules(packed, df, [(1, 256)]).first()[1:] == (300, 0, 0, 0, 0, 0)
    lost = packing.broken_rules(packed.where("doc_id <> 7"), df, [(1, 256)]).first()
    assert lost["lost_docs"] == 1
    assert packing.broken_rules(packed.withColumn("container", F.lit("0-0")), df, [(1, 256)]).first()["over_capacity"] == 1


def test_mixing_has_no_most_sources(spark):
    n = 12_000  # more than were once allowed
    df = spark.range(n * 2).select((F.col("id") % n).cast("string").alias("source"), F.col("id").alias("doc_id"), F.lit(10).cast("long").alias("tokens"))
    targets = spark.range(n).select(F.col("id").cast("string").alias("source"), F.lit(1.0 / n).alias("target_share"), F.lit(1).alias("max_repeats"))
    mixed = mixing.mix(df, targets)
    assert mixed.count() == 2 * n
    assert mixing.broken_rules(mixed, df, targets).agg(F.sum(F.col("over_used") + F.col("foreign") + F.col("share_off"))).first()[0] == 0
