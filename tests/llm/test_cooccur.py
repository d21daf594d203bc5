import itertools
import random
from collections import Counter

import pytest

from emberline.llm import cooccur

SCHEMA = "db string, trace_id long, surfaced array<struct<node:string,activation:double>>, n long, grp string"


def brute(rows, least):
    baskets = {}
    for db, trace, items in rows:
        if db is not None and trace is not None:
            baskets.setdefault((db, trace), set()).update(x for x in items or () if x is not None)
    n, one, two = Counter(), Counter(), Counter()
    for (db, _), items in baskets.items():
        n[db] += 1
        one.update((db, x) for x in items)
        two.update((db, a, b) for a, b in itertools.combinations(sorted(items), 2))
    return {(db, a, b): (k, one[db, a], one[db, b], n[db]) for (db, a, b), k in two.items() if k >= least}


def run(spark, rows, **options):
    data = [(db, t, None if items is None else [(x, 0.1) for x in items] + [None] * (t == 3), 9, "clash") for db, t, items in rows]
    out = cooccur.cooccurrence(spark.createDataFrame(data, SCHEMA).repartition(3), "db", "trace_id", "surfaced", "node", **options)
    return {(r["grp"], r["node_a"], r["node_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in out.collect()}, out


def sample(seed, giants=0):
    rng = random.Random(seed)
    rows = []
    for db in ("x", "y"):
        for t in range(250):
            items = [f"i{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(8))]
            rows.append((db, t, items))
        for t in range(giants):
            rows.append((db, 1000 + t, [f"i{i}" for i in range(60)] + [f"g{i}" for i in range(40)]))
    rows += rows[:20] + [("x", 5000, None), ("x", 5001, []), ("x", 5002, [None, "i1", "i1"]), (None, 1, ["i1", "i2"]), ("x", None, ["i1", "i2"])]
    return rows


@pytest.mark.parametrize("heavy", [{}, {"heavy_share": 2.0}, {"heavy_share": 0.0}, {"most_heavy": 3, "heavy_share": 0.0}])
def test_every_way_counts_the_same(spark, heavy):
    rows = sample(1)
    assert run(spark, rows, min_count=3, **heavy)[0] == brute(rows, 3)


@pytest.mark.parametrize("giants", [2, 6])
def test_very_long_baskets(spark, giants):
    rows = sample(2, giants)
    assert run(spark, rows, min_count=4, heavy_share=0.2, list_items=10)[0] == brute(rows, 4)


def test_lift_and_nothing(spark):
    rows = [("d", t, ["a", "b"] if t < 5 else []) for t in range(20)]
    _, out = run(spark, rows, min_count=5)
    assert out.first()["lift"] == pytest.approx(4.0)
    assert run(spark, [], min_count=1)[0] == {}


def test_more_items_than_can_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "small_enough", lambda df: False)
    rows = sample(3)
    assert run(spark, rows, min_count=3, heavy_share=0.1)[0] == brute(rows, 3)


def test_lift_is_compared_exactly(spark):
    # n_ab * n against 3 * n_a * n_b at the limit, far beyond 64 bits
    rows = [(k, n, ab, a, b) for k, n, ab, a, b in [(1, 9 * 10**17, 10**17, 3 * 10**16, 10**18 - 1), (2, 3 * 10**17, 10**17, 10**17, 10**17), (3, 3 * 10**17 - 1, 10**17, 10**17, 10**17)]]
    df = spark.createDataFrame(rows, "k int, n long, n_ab long, n_a long, n_b long")
    want = [k for k, n, ab, a, b in rows if ab * n >= 3 * a * b]
    assert [r["k"] for r in cooccur.lift_at_least(df, 3).orderBy("k").collect()] == want and 2 in want and 3 not in want
