"""Edge cases of the record-processing operators."""

import datetime
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.common import T_MAX
from emberline.functions.jsonindex import ARRAY, OBJECT, JsonIndex
from emberline.operators import nested, orphans, periods, skew, snapshots

DAY = datetime.datetime(2025, 1, 1)


# -- nested records ----------------------------------------------------------------


def _any(rng, depth=0):
    r = rng.random()
    if depth < 4 and r < 0.3:
        return {rng.choice(["rev", "a", "b\\", 'q"', "é", "interfaces", "spec"]): _any(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if depth < 4 and r < 0.6:
        return [_any(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([None, True, 1, -2, 0.5, 1e10, "", "x", 'a"b', "back\\", "{[,:]}", "\n\t"])


def _strict(text):
    def refuse(_):
        raise ValueError

    try:
        return True, json.loads(text.decode(), parse_constant=refuse)
    except (ValueError, UnicodeDecodeError):
        return False, None


def test_index_agrees_with_a_parser_on_good_and_broken_texts():
    rng = random.Random(4)
    texts = []
    for _ in range(3000):
        b = bytearray(json.dumps(_any(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode())
        if rng.random() < 0.6:
            p = rng.randrange(len(b) + 1)
            b[p:p] = rng.choice([b'"', b"\\", b"{", b"}", b"[", b"]", b",", b":", b"1", b"x", b"\n", b"\\u12"])
        try:
            bytes(b).decode()
        except UnicodeDecodeError:
            continue
        texts.append(bytes(b))
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        j = JsonIndex(part)
        kids = {}
        for v in np.flatnonzero(j.is_value & (j.parent >= 0)):
            kids.setdefault(int(j.parent[v]), []).append(v)

        def build(v):
            if j.kind[v] == OBJECT:
                return {json.loads(j.buf[j.frm[j.key[c]] : j.to[j.key[c]]]): build(c) for c in kids.get(int(v), [])}
            if j.kind[v] == ARRAY:
                assert [j.pos[c] for c in kids.get(int(v), [])] == list(range(len(kids.get(int(v), []))))
                return [build(c) for c in kids.get(int(v), [])]
            return json.loads(j.raw(v))

        roots = {int(j.row[r]): r for r in j.roots()}
        for i, text in enumerate(part):
            good, value = _strict(text)
            assert good == bool(j.valid[i]), text
            if good:
                assert build(roots[i]) == value


INVENTORY = "record_id long, props string, edges array<struct<dst:string,kind:string,dst_type:string>>, child string, _pos int"
ASSETS = "asset_id long, ancestors array<string>, resource struct<data:string>, rel string"


def children(spark, inventory=(), assets=()):
    found = nested.nested_children(spark.createDataFrame(list(inventory), INVENTORY), spark.createDataFrame(list(assets), ASSETS))
    return sorted(tuple(r) for r in found.collect())


def test_nested_cases(spark):
    inventory = [
        (1, '{"rev": "a\\u00e9", "meta": {"rev": "no"}, "note": "\\"rev\\": 9"}', [("x", "K", None), None, (None, "K", None), ("y", None, None)], "clash", 3),
        (2, '{"rev": [null, "b", 7, 1.5, {"c": [1]}]}', None, None, None),
        (3, '{"rev": 1.5}', [], None, None),
        (4, '{"rev": "lost"', None, None, None),
        (5, '["rev"]', None, None, None),
        (6, None, None, None, None),
        (7, '{"rev": null}', None, None, None),
        (8, '{"rev": "old", "rev": "new"}', None, None, None),
        (8, '{"rev": "old", "rev": "new"}', None, None, None),
        (9, "", None, None, None),
        (10, '{"\\u0072ev": 12}', None, None, None),
        (None, '{"rev": 1}', [("x", "K", None)], None, None),
    ]
    assert children(spark, inventory) == [
        ("edge", 1, -1, 0, "x"), ("edge", 1, -1, 3, "y"), ("rev", 1, -1, 0, "aé"), ("rev", 2, -1, 1, "b"), ("rev", 2, -1, 2, "7"),
        ("rev", 2, -1, 3, "1.5"), ("rev", 2, -1, 4, '{"c": [1]}'), ("rev", 8, -1, 0, "new"), ("rev", 10, -1, 0, "12"),
    ]


def test_interfaces_and_configs(spark):
    deep = '{"interfaces": [null, {"network": "n", "configs": [null, {"endpoint": "e"}, 3, {}]}, {"configs": {"endpoint": null}}]}'
    assets = [
        (1, ["projects/p", None, "organizations/o"], (deep,), "clash"),
        (2, None, (json.dumps('{"spec": {"interfaces": {"network": "m", "x": {"interfaces": [{}]}}}}'),), None),
        (3, [], (json.dumps(json.dumps("twice")),), None),
        (4, None, None, None),
        (5, None, (None,), None),
        (6, None, ('{"disks": [{"interfaces": [{"network": "no"}]}]}',), None),
    ]
    assert children(spark, assets=assets) == [
        ("ancestor", 1, -1, 0, "projects/p"), ("ancestor", 1, -1, 2, "organizations/o"),
        ("config", 1, 1, 1, "e"), ("config", 1, 1, 3, ""), ("config", 1, 2, 0, ""),
        ("iface", 1, -1, 1, "n"), ("iface", 1, -1, 2, ""), ("iface", 2, -1, 0, "m"),
    ]


def test_nested_long_and_empty(spark):
    long = '{"pad": "' + "x\\n" * 1_000_000 + '", "rev": "end"}'
    assert children(spark, [(1, long, None, None, None)]) == [("rev", 1, -1, 0, "end")]
    assert children(spark) == []


# -- orphans --------------------------------------------------------------------


REF = "src string, dst string, kind string, valid_from long, reason string, _name string"
NODE = "name string, placeholder boolean, observed_at long, retired_at long, dst string"
EDGE_KEY = ["src", "dst", "kind", "valid_from"]


@pytest.mark.parametrize("share", [1 / 500, 1 / 3, 2.0])
@pytest.mark.parametrize("most", [200_000, 0])
def test_orphan_reasons(spark, share, most):
    refs = [("s", d, "K", t, "clash", "clash") for d, t in [("gone", 5), ("ph", 5), ("late", 5), ("late", 12), ("dead", 15), ("dead", 5), ("back", 25), ("back", 15), ("open", 99), ("none", 5), (None, 5), ("late", None)]]
    refs += refs[:3] + [("s", "gone", "K", 5, None, None)] * 40
    nodes = [
        ("ph", True, 0, None, None), ("late", False, 10, None, None), ("late", True, 0, 10, None), ("dead", False, 0, 10, None), ("dead", False, 3, 3, None),
        ("back", False, 0, 10, None), ("back", False, 20, T_MAX, None), ("open", False, 0, None, None), ("open", False, 0, None, None), ("none", None, 0, None, None), (None, False, 0, None, None),
    ]
    found = orphans.orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(nodes, NODE), EDGE_KEY, heavy_share=share, most_broadcast=most)
    got = sorted((r["dst"], r["valid_from"], r["reason"]) for r in found.collect() if r["valid_from"] is not None)
    assert got == [("back", 15, "late"), ("dead", 15, "deleted"), ("gone", 5, "missing"), ("late", 5, "late"), ("none", 5, "placeholder"), ("ph", 5, "placeholder")]
    assert found.where("valid_from IS NULL").count() == 1


def test_orphans_of_empty_tables(spark):
    refs, nodes = spark.createDataFrame([("s", "d", "K", 1, None, None)], REF), spark.createDataFrame([], NODE)
    assert [r["reason"] for r in orphans.orphan_references(refs, nodes, EDGE_KEY).collect()] == ["missing"]
    assert orphans.orphan_references(refs.limit(0), nodes, EDGE_KEY).count() == 0


# -- heavy keys --------------------------------------------------------------------


def test_salted_aggregate_is_plain_aggregate(spark):
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.1 else "hot" if rng.random() < 0.6 else f"k{rng.randrange(50)}", rng.random() if rng.random() < 0.9 else None) for _ in range(5000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = skew.salted_aggregate(df, ["k"], {"n": F.count("*"), "m": F.max("v"), "c": F.count("v")}, {"n": F.sum("n"), "m": F.max("m"), "c": F.sum("c")})
    want = df.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"), F.count("v").alias("c"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert skew.guess_heavy(df, ["k"]) and skew.salted_aggregate(df.limit(0), ["k"], {"n": F.count("*")}, {"n": F.sum("n")}).count() == 0


def test_heavy_nodes(spark):
    rows = [("a", None, 1.0)] * 3 + [("a", "x", None)] * 30 + [(f"s{i}", f"d{i}", 1.0) for i in range(67)]
    df = spark.createDataFrame(rows, "src string, dst string, weight double").withColumn("side", F.lit("clash"))
    assert sorted(map(tuple, skew.heavy_nodes(df).collect())) == [("dst", "x"), ("src", "a")]
    assert skew.heavy_nodes(df.limit(0)).count() == 0


# -- snapshots ----------------------------------------------------------------------


SNAP = "k string, at long, open boolean, weight double, loaded_at timestamp_ntz, diff string"


def snap(k, at, open_=True, weight=1.0, loaded=0):
    return (k, at, open_, weight, DAY + datetime.timedelta(seconds=loaded), "clash")


def changes(spark, rows):
    out = snapshots.snapshot_changes(spark.createDataFrame(rows, SNAP), ["k"], "at", "loaded_at", flags=["open"], numbers=["weight"])
    return sorted(((r["k"] or "", r["at"], r["diff"]) for r in out.collect()))


def test_snapshot_changes(spark):
    rows = [snap("pad", t) for t in (1, 2, 3, 5)]
    rows += [snap("back", 1), snap("back", 3), snap("gone", 1), snap("gone", 2), snap("new", 5)]
    rows += [snap("noise", 1), snap("noise", 2, weight=1.0 + 9e-7), snap("noise", 3, weight=1.0 + 18e-7), snap("noise", 5, weight=1.0 + 3e-6)]
    rows += [snap("null", 1, weight=None), snap("null", 2), snap("null", 3), snap("null", 5, weight=None)]
    rows += [snap("flag", 1), snap("flag", 2, open_=False), snap("flag", 3, open_=None), snap("flag", 5, open_=None)]
    rows += [snap("late", 1), snap("late", 2, weight=9.0), snap("late", 2, weight=1.0, loaded=5), snap("late", 3), snap("late", 5)]
    rows += [snap(None, 2), snap("untimed", None)]
    assert changes(spark, rows + rows[:7]) == [
        ("", 2, "added"), ("", 3, "removed"), ("back", 2, "removed"), ("back", 3, "added"), ("back", 5, "removed"),
        ("flag", 2, "changed"), ("flag", 3, "changed"), ("gone", 3, "removed"), ("new", 5, "added"),
        ("noise", 5, "changed"), ("null", 2, "changed"), ("null", 5, "changed"),
    ]


def test_snapshots_few(spark):
    assert changes(spark, [snap("a", 1)]) == []
    assert changes(spark, []) == []


def test_intervals_cover_the_snapshots(spark):
    rng = random.Random(3)
    rows = [snap(f"k{k}", t, open_=rng.random() < 0.5, weight=float(rng.randrange(2))) for k in range(30) for t in range(8) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, SNAP)
    got = snapshots.snapshot_intervals(df, ["k"], "at", "loaded_at", flags=["open"], numbers=["weight"])
    want = []
    for k in range(30):
        state = {r[1]: r[2:4] for r in rows if r[0] == f"k{k}"}
        t = 0
        while t < 8:
            if t in state:
                first = t
                while t + 1 in state and state[t + 1] == state[t]:
                    t += 1
                want.append((f"k{k}", first, t))
            t += 1
    assert sorted(map(tuple, got.collect())) == sorted(want)


# -- periods --------------------------------------------------------------------------


def plain_periods(intervals):
    out = []
    for s, e in sorted((s, T_MAX if e is None else e) for s, e in intervals if s is not None):
        if s < e:
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
    return out


@pytest.mark.parametrize("slices", [1, 7, 64])
def test_periods_and_gaps(spark, slices, monkeypatch):
    monkeypatch.setattr(periods, "SLICES", slices)
    rng = random.Random(slices)
    data = {}
    for e in ["hot"] * 300 + [f"e{i % 20}" for i in range(150)] + [None] * 9:
        s = rng.randrange(2000)
        data.setdefault(e, []).append((s, rng.choice([s + rng.randrange(-3, 12), s, s + 1, None if rng.random() < 0.02 else s + 2])))
    data["nulls"] = [(None, 5), (3, None), (3, T_MAX), (1, 2), (1, 2), (2, 3)]
    rows = [(e, s, t, 1) for e, v in data.items() for s, t in v]
    df = spark.createDataFrame(rows, "e string, s long, t long, gap_from int")
    want_p = sorted((e or "", s, None if t == T_MAX else t) for e, v in data.items() for s, t in plain_periods(v))
    want_g = sorted((e or "", a[1], b[0]) for e, v in data.items() for a, b in zip(plain_periods(v), plain_periods(v)[1:]))
    got_p = sorted(((r["e"] or "", r["period_from"], r["period_to"]) for r in periods.periods(df, ["e"], "s", "t").collect()), key=str)
    assert got_p == sorted(want_p, key=str)
    assert sorted((r["e"] or "", r["gap_from"], r["gap_to"]) for r in periods.gaps(df, ["e"], "s", "t").collect()) == want_g


def test_no_periods(spark):
    df = spark.createDataFrame([], "e string, s long, t long")
    assert periods.periods(df, ["e"], "s", "t").count() == 0 and periods.gaps(df, ["e"], "s", "t").count() == 0
