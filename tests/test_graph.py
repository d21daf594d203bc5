"""Temporal graph, spreading, learning and upkeep on small graphs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.common import T_MAX
from emberline.config import Config
from emberline.functions.keys import canonical_json, fnv1a
from emberline.functions.weights import effective, infer_type, name_tokens, trust
from emberline.memory import Memory
from emberline.operators import learn, maintain, match, spread, temporal, traverse
from emberline.sources import conversation, oplog, wal
from tests_helpers import some_ops

GOLDEN = [("gateway", d, "CALLS") for d in ("orders", "billing", "search", "profile", "recs")] + [
    ("orders", "pg-main", "CONNECTS"), ("orders", "redis", "CONNECTS"), ("billing", "pg-main", "CONNECTS"), ("billing", "stripe", "CALLS"),
    ("search", "elastic", "CONNECTS"), ("profile", "pg-main", "CONNECTS"), ("recs", "redis", "CONNECTS"),
]
EDGE = "src string, dst string, kind string, valid_from long, valid_to long, weight double, t_last long, origin string"


def edge_frame(spark, edges, t0=0, weight=None, origin=None):
    return spark.createDataFrame([(s, d, k, t0, T_MAX, weight, t0, origin) for s, d, k in edges], EDGE)


def node_frame(spark, edges):
    return spark.createDataFrame([(n,) for n in sorted({x for e in edges for x in e[:2]})], "name string")


def seeds(spark, *names, query="q"):
    return spark.createDataFrame([(query, n) for n in names], "query string, node string")


def activation(result):
    return {r["node"]: r["act"] for r in result.activation.collect()}


def test_spread_of_the_golden_corpus(spark):
    edges = spread.weighted_edges(edge_frame(spark, GOLDEN), 1000, Config())
    out = spread.spread(edges, node_frame(spark, GOLDEN), seeds(spark, "gateway", "no-such"), Config(), depth=2)
    act = activation(out)
    assert out.mass().first()["mass"] == pytest.approx(0.855044, abs=2e-6)
    want = {"gateway": 1.0, "orders": 0.126715, "billing": 0.126715, "recs": 0.126715, "pg-main": 0.092355, "redis": 0.064556, "elastic": 0.036758, "stripe": 0.027798}
    assert {k: act[k] for k in want} == pytest.approx(want, abs=2e-6)
    assert [r["node"] for r in out.top(3).orderBy("rank").collect()] == ["gateway", "billing", "orders"]


def test_order_dependence_is_told_and_replayed(spark):
    line = [("0", "1", "K"), ("1", "2", "K")]
    edges = spread.weighted_edges(edge_frame(spark, line), 0, Config())
    names = node_frame(spark, line)
    together = activation(spread.spread(edges, names, seeds(spark, "0", "1"), Config(), depth=1))
    assert together["2"] == pytest.approx(0.3) and together["1"] == pytest.approx(1.3)
    ordered = spark.createDataFrame([("q", 0, "0"), ("q", 1, "1"), ("r", 0, "1"), ("r", 1, "0")], "query string, pos int, node string")
    acts = {(r["query"], r["node"]): r["act"] for r in spread.sequential_spread(edges, ordered, Config(), depth=1).collect()}
    assert acts["q", "2"] == pytest.approx(0.39) and acts["r", "2"] == pytest.approx(0.3)
    assert spread.has_order_dependence(edges, names, seeds(spark, "0", "1"), 1).count() == 1
    assert spread.has_order_dependence(edges, names, seeds(spark, "0"), 1).count() == 0


def test_sequential_equals_batched_on_layers(spark):
    edges = spread.weighted_edges(edge_frame(spark, GOLDEN), 1000, Config())
    one = activation(spread.spread(edges, node_frame(spark, GOLDEN), seeds(spark, "gateway"), Config(), depth=2))
    ordered = spark.createDataFrame([("q", 0, "gateway")], "query string, pos int, node string")
    two = {r["node"]: r["act"] for r in spread.sequential_spread(edges, ordered, Config(), depth=2).collect()}
    assert one == pytest.approx(two)


def test_trust_masks_and_restores(spark):
    rows = [("hub", "clean", "REL", 0, T_MAX, None, 0, None), ("hub", "tainted", "BAD", 0, T_MAX, None, 0, "evil:1")]
    df = spark.createDataFrame(rows, EDGE)
    names = spark.createDataFrame([("hub",), ("clean",), ("tainted",)], "name string")
    for value, seen in ((0.0, False), (1.0, True)):
        c = Config(trust_by_origin={"evil": value, "evil:1": value})
        act = activation(spread.spread(spread.weighted_edges(df, 0, c), names, seeds(spark, "hub"), c, depth=1))
        assert ("tainted" in act) is seen and "clean" in act
    got = df.select(trust("origin", {"evil": 0.25, "evil:1": -3.0}).alias("t")).collect()
    assert sorted(r["t"] for r in got) == [0.0, 1.0]


def test_decay_and_authority(spark):
    df = spark.createDataFrame([(0.5, 1000)], "w double, t long")
    value = df.select(effective("w", "t", F.lit(0.05), 2000).alias("e"), effective("w", "t", F.lit(0.05), 0).alias("before")).first()
    assert value["e"] == pytest.approx(0.5 * math.exp(-0.05)) and value["before"] == 0.5
    c = Config(lambda_base=0.2, authority_by_kind={"STRONG": 9.0})
    out = {r["dst"]: r["w"] for r in spread.weighted_edges(edge_frame(spark, [("x", "y", "WEAK"), ("x", "z", "STRONG")]), 30_000, c).collect()}
    assert out["y"] < 0.01 and out["z"] > 0.25


def test_credit_reaches_the_path(spark):
    edges = [("hub", x, "CALLS") for x in "abcde"] + [("a", "f", "CALLS")]
    c = Config()
    result = spread.spread(spread.weighted_edges(edge_frame(spark, edges), 0, c), node_frame(spark, edges), seeds(spark, "hub"), c, depth=2)
    credit = learn.credit_nodes(spark.createDataFrame([("q", "f", 1.0), ("q", "nobody", 1.0)], "query string, node string, score double"), node_frame(spark, edges))
    r, cred = learn.assign_credit(result, credit, 2, c)
    by = {(x["src"], x["dst"]): x["r"] for x in r.collect()}
    assert by == pytest.approx({("a", "f"): 1.0, ("hub", "a"): 0.5})
    report = learn.feedback_report(r, cred).first()
    assert (report["edges_reinforced"], report["hits"], report["misses"]) == (2, 3, 0)
    surfaced = result.top(10).select("query", "node", "act")
    assert learn.credit_uniform(surfaced, 1.0).agg(F.sum("cred")).first()[0] == pytest.approx(1.0)
    assert learn.credit_by_activation(surfaced, -0.5).agg(F.sum("cred")).first()[0] == pytest.approx(-0.5)
    missed = learn.miss_penalty(credit, surfaced, 0.2).where("cred < 0")
    assert missed.count() == surfaced.count() - 1 and learn.miss_penalty(credit, surfaced, 0.0).where("cred < 0").count() == 0


def test_touch_arithmetic(spark):
    c = Config()
    e = spark.createDataFrame([("k", 1000, 0, 0.0), ("k", 2000, 1, 7.0), ("n", 0, 0, -1.0), ("n", 1000, 1, float("nan"))], "k string, t long, s long, r double")
    fold = {r["k"]: r["w"] for r in learn.touch_fold(e, "k", ["t", "s"], "t", "r", 0.5, 0.05, c).collect()}
    assert fold == pytest.approx({"k": 0.5256147, "n": 0.45}, abs=1e-7)
    linear = {r["k"]: r["w"] for r in learn.touch_linear(e.where("k = 'k'"), "k", "t", "r", 0.5, "first", 0.05, c).collect()}
    assert linear == pytest.approx({"k": fold["k"]})


def test_controller_stays_in_bounds():
    rng = random.Random(2)
    out = spread.homeostat((rng.choice([0.0, 1e6, rng.random() * 10]) for _ in range(5000)), Config())
    assert all(0.25 <= s <= 8.0 for _, _, s in out) and all(-500 <= i <= 500 for _, i, _ in out)


def test_consolidate_keeps_the_budget_and_finds_conflicts(spark):
    rows = [("p", "q", "SERVES", 0, T_MAX, 0.9, 0, None), ("p", "r", "SERVES", 0, T_MAX, 0.5, 0, None), ("p", "weak", "NOTE", 0, T_MAX, 0.01, 0, None), ("z", "y", "NOTE", 0, 5, 0.3, 0, None)]
    c = Config(theta=0.05, lambda_base=0.0, functional_kinds=["SERVES"])
    before = spark.createDataFrame(rows, EDGE)
    after = maintain.consolidate(before, 1000, c)
    counts = maintain.consolidation_counts(before, after).first()
    assert (counts["live_edges"], counts["pruned"], counts["renormalized_sources"]) == (3, 1, 2)
    for row in after.where("NOT dead").groupBy("src").agg(F.sum("weight").alias("s")).collect():
        assert row["s"] == pytest.approx(1.0)
    assert [tuple(r) for r in maintain.conflicts(after, ["SERVES"]).collect()] == [("p", "SERVES", "r", "q")]


def test_sleep_protects_the_top_and_ties(spark):
    edges = [("hub", x, "CALLS") for x in "abcde"]
    c = Config(sleep_downscale=0.5, sleep_theta=0.2, protect_top_frac=0.25, lambda_base=0.0)
    weights = {"a": 1.0, "e": 0.3}
    df = edge_frame(spark, edges).withColumn("weight", F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("dst")], F.lit(0.5)))
    state, threshold = maintain.sleep(df, 1000, c)
    dead = {r["dst"]: r["dead"] for r in state.collect()}
    assert threshold == 0.5 and dead == {"a": False, "b": False, "c": False, "d": False, "e": True}
    same, _ = maintain.sleep(edge_frame(spark, edges), 0, c)
    assert same.where("dead").count() == 0
    assert maintain.kth_smallest(df, "weight", 4) == 1.0 and maintain.kth_smallest(df, "weight", 9) is None


# -- folding --------------------------------------------------------------------------


def model(ops):
    """The log read one operation after the other."""
    nodes, versions, edges = {}, {}, []
    last = lambda n: versions.setdefault(n, [])

    def placeholder(n, ts):
        nodes.setdefault(n, True)
        if not last(n) or last(n)[-1][1] != T_MAX:
            last(n).append([ts, T_MAX, "null"])

    for o in ops:
        op, ts = o["op"], o["ts"]
        if op == "observe_node":
            nodes[o["name"]] = False if nodes.get(o["name"], True) else nodes[o["name"]]
            v = last(o["name"])
            if v and v[-1][1] == T_MAX:
                if v[-1][2] == o["props"]:
                    continue
                v[-1][1] = ts
            v.append([ts, T_MAX, o["props"]])
        elif op == "observe_placeholder":
            placeholder(o["name"], ts)
        elif op == "retire_node" and o["name"] in nodes:
            v = last(o["name"])
            if v and v[-1][1] == T_MAX:
                v[-1][1] = ts
            for e in edges:
                if o["name"] in e[:2] and e[4] == T_MAX:
                    e[4] = ts
        elif op == "observe_edge":
            for n in (o["src"], o["dst"]):
                if n not in nodes:
                    placeholder(n, ts)
            if not any(e[:3] == [o["src"], o["dst"], o["kind"]] and e[4] == T_MAX for e in edges):
                edges.append([o["src"], o["dst"], o["kind"], ts, T_MAX, o["origin"]])
        elif op == "retire_edge":
            for e in edges:
                if e[:3] == [o["src"], o["dst"], o["kind"]] and e[4] == T_MAX:
                    e[4] = ts
    return nodes, versions, edges


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_is_the_log_read_in_order(spark, seed):
    rng = random.Random(seed)
    names, log = [f"n{i}" for i in range(6)], []
    for i in range(400):
        op = rng.choice(["observe_node", "observe_node", "observe_placeholder", "retire_node", "observe_edge", "observe_edge", "retire_edge"])
        row = dict.fromkeys(("name", "type", "props", "src", "dst", "kind", "origin")) | {"op": op, "ts": 10 * i}
        if op.endswith("edge"):
            row |= {"src": rng.choice(names), "dst": rng.choice(names), "kind": rng.choice("KL"), "origin": rng.choice([None, "o1", "o2"])}
        else:
            row |= {"name": rng.choice(names), "type": f"t{i}", "props": rng.choice(['{"a":1}', '{"a":2}'])}
        log.append(row)
    schema = "ord struct<i:int>, " + oplog.OPS
    fields = [c.strip().split()[0] for c in oplog.OPS.split(",")]
    df = spark.createDataFrame([((i,), *[o[f] for f in fields]) for i, o in enumerate(log)], schema).repartition(5)
    nodes, versions, edges = model(log)
    got = {r["name"]: r["placeholder"] for r in oplog.fold_nodes(df).collect()}
    assert got == nodes
    want = sorted((n, i + 1, *v) for n, vs in versions.items() for i, v in enumerate(vs))
    assert sorted(tuple(r) for r in oplog.fold_versions(df).select("name", "seq", "observed_at", "retired_at", "props").collect()) == want
    found = oplog.fold_edges(df).select("src", "dst", "kind", "valid_from", "valid_to", "origin").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str(tuple(e)) for e in edges)


# -- traversal and matching -------------------------------------------------------------


def test_blast_radius_ends_in_cycles_and_keeps_the_first_path(spark):
    edges = [("a", "b", "PEERS"), ("b", "a", "PEERS"), ("b", "c", "X"), ("a", "d", "Y"), ("d", "c", "X")]
    df, names = edge_frame(spark, edges), node_frame(spark, edges)
    down = {r["node"]: (r["depth"], r["path"]) for r in traverse.blast_radius(df, names, "a", "down", 10).collect()}
    assert down == {"b": (1, "a -[PEERS]-> b"), "d": (1, "a -[Y]-> d"), "c": (2, "a -[PEERS]-> b -[X]-> c")}
    both = traverse.blast_radius(edge_frame(spark, edges[:2]), names.where("name IN ('a', 'b')"), "a", "both", 10)
    assert [r["node"] for r in both.collect()] == ["b"]
    assert traverse.blast_radius(df, names.where("name <> 'a'"), "a", "down", 2).count() == 0
    members, among = traverse.neighborhood(df, names, ["d"], 1)
    assert {r["node"] for r in members.collect()} == {"d", "c"} and among.count() == 1


def test_matching(spark):
    names = spark.createDataFrame([("svc/metering-api",), ("svc/billing",), ("db/metrics-store",), (None,)], "name string")
    index = match.token_index(names)
    assert [r[0] for r in match.match_tokens(index, ["met"]).collect()] == ["db/metrics-store", "svc/metering-api"]
    assert match.match_tokens(index, ["eter", "m"]).count() == 0
    assert [r[0] for r in match.match_substring(names, ["ETER"]).collect()] == ["svc/metering-api"]
    vectors = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [2.0, 0.0]), (8, [float("nan"), 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in match.match_vector(df, [1.0, 0.0], 9).collect()] == [1, 7, 2, 3]
    with pytest.raises(ValueError):
        match.match_vector(df, [0.0, 0.0], 3)
    tokens = names.where("name LIKE 'svc/m%'").select(name_tokens("name").alias("t")).first()["t"]
    assert tokens == ["svc", "metering", "api"]


def test_scalar_texts(spark):
    assert fnv1a(b"x\0y\0CALLS\0" + (1000).to_bytes(8, "little")) == 2231632903708260618
    df = spark.createDataFrame([('{"b": 1.0, "a": [1, null, "é"]}',), ("{",), (None,)], "j string")
    assert [r[0] for r in df.select(canonical_json("j")).collect()] == ['{"a":[1,null,"é"],"b":1.0}', None, None]
    names = spark.createDataFrame([("//compute.googleapis.com/projects/p/global/networks/n",), ("x",)], "n string")
    assert [r[0] for r in names.select(infer_type("n")).collect()] == ["compute.googleapis.com/networks", "x/unknown"]
    data = '{"a": ["https://www.googleapis.com/compute/v1/projects/p", "//run.googleapis.com/x"], "//run.googleapis.com/k": "//run.googleapis.com/x"}'
    refs = spark.createDataFrame([(data,)], "data string").select(oplog.reference_names().alias("r")).first()["r"]
    assert refs == ["//compute.googleapis.com/projects/p", "//run.googleapis.com/x"]
    c = Config(trust_by_origin={"a": 0.5})
    assert Config.from_json(c.to_json()[:-1] + ', "_comment": "x"}') == c


def test_session_terms(spark):
    df = spark.createDataFrame([(1, "The api and the API of svc/db, ok"), (2, None)], "id long, text string")
    terms = conversation.session_terms(df, "id", "text")
    assert {r["session"]: r["terms"] for r in terms.collect()} == {1: ["api", "svc/db"], 2: []}
    assert conversation.session_edges(terms).count() == 4


# -- log files -----------------------------------------------------------------------


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    wal.write_wal(some_ops(spark), path, "0123456789abcdef")
    back = wal.read_wal(spark, path)
    assert [(r["op"], r["name"], r["props"], r["dst"], r["ts"]) for r in back.orderBy("ord").collect()] == [
        ("observe_node", "n0", '{"a":1}', None, 0), ("observe_node", "n1", '{"a":1}', None, 1), ("observe_node", "n2", '{"a":1}', None, 2), ("observe_edge", None, None, "n1", 9),
    ]
    report = wal.verify_wal(spark, path).first()
    assert tuple(report) == (4, 0, False, None)


def test_damaged_logs(spark, tmp_path):
    wal.write_wal(some_ops(spark), str(tmp_path / "log"), "0" * 16)
    lines = next((tmp_path / "log").glob("part-*.txt")).read_text().splitlines()

    def at(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    torn = at("torn", "\n".join([*lines, lines[1][:20]]))
    assert tuple(wal.verify_wal(spark, torn).first()) == (4, 0, True, None) and wal.read_wal(spark, torn).count() == 4
    bad = at("bad", "\n".join([lines[0], lines[1].replace("n0", "n9"), *lines[2:]]) + "\n")
    assert wal.verify_wal(spark, bad).first()["first_bad"] == 1
    with pytest.raises(ValueError):
        wal.read_wal(spark, bad)
    assert wal.read_wal(spark, bad, strict=False).count() == 3
    mixed = at("mixed", "\n".join([lines[1][9:], "", *lines[2:]]) + "\n")
    assert tuple(wal.verify_wal(spark, mixed).first())[:2] == (3, 1)
    with pytest.raises(ValueError):
        wal.read_wal(spark, at("future", "#x-wal:v2 id=" + "0" * 16 + "\n"))


def test_records_all_or_nothing(spark, tmp_path):
    good = '{"name": "a", "type": "T", "edges": [{"dst": "b", "kind": "K"}]}'
    (tmp_path / "lines").write_text(good + "\n\n" + good)
    (tmp_path / "array").write_text(f"[{good},\n{good}]")
    (tmp_path / "bad").write_text(good + '\n{"name": ')
    assert [oplog.parse_records(spark, str(tmp_path / n)).count() for n in ("lines", "array")] == [2, 2]
    with pytest.raises(Exception):
        oplog.parse_records(spark, str(tmp_path / "bad")).collect()


# -- a database ----------------------------------------------------------------------


def test_memory(spark, tmp_path):
    m = Memory(spark, str(tmp_path))
    entity = "rec long, name string, type string, props string, edges array<struct<dst:string,kind:string,dst_type:string>>, origin string"
    home = lambda target: spark.createDataFrame([(0, "sensor", "S", "{}", [("hub", "PAIRED_WITH", None), (target, "TRIGGERS", None)], None), (1, "kitchen-lights", "A", "{}", [], None), (2, "alarm", "A", "{}", [], None)], entity)
    m.ingest(home("kitchen-lights"), 1000, reconcile=True)
    m.ingest(home("alarm"), 2000, reconcile=True)
    nodes, edges = m.diff(1500, 2500)
    assert nodes.count() == 0
    assert sorted(map(tuple, edges.collect())) == [("sensor -[TRIGGERS]-> alarm", "added"), ("sensor -[TRIGGERS]-> kitchen-lights", "removed")]
    assert [r["node"] for r in m.blast_radius("sensor", 2500).orderBy("node").collect()] == ["alarm", "hub"]
    report = m.feedback(["sensor"], 3000, used=["alarm"]).first()
    assert report["edges_reinforced"] == 1
    top = [r["node"] for r in m.retrieve(["sensor"], 3000, adapt=True).collect()]
    assert top == ["sensor", "alarm", "hub"] and m.ewma is not None
    assert m.consolidate(4000).first()["pruned"] == 0
    m.ingest(spark.createDataFrame([(0, "secret", "S", "{}", [("hub", "REL", None)], "user:a/1")], entity), 5000)
    m.purge("user:a")
    assert "secret" not in {r["name"] for r in m.versions().collect()} and m.edges().where("src = 'secret'").count() == 0
    before = {(r["src"], r["dst"]) for r in m.edges().collect()}
    m.checkpoint()
    assert {(r["src"], r["dst"]) for r in m.edges().collect()} == before
    with pytest.raises(ValueError):
        Memory(spark, str(tmp_path), "No")
    m.quarantine("x", 0.0)
    assert Memory(spark, str(tmp_path)).config.trust_by_origin == {"x": 0.0}


def test_versions_are_of_values_not_of_texts(spark, tmp_path):
    from emberline.memory import Memory

    m = Memory(spark, str(tmp_path), config=Config(lambda_base=0.0))
    schema = "name string, type string, props string, edges array<struct<dst:string,kind:string,dst_type:string>>, origin string"
    say = lambda props, ts, origin=None: m.ingest(spark.createDataFrame([("x", "t", props, None, origin)], schema), ts)
    say('{"a": 1, "b": {"c": [1, 2], "d": null}}', 1000, "first")
    say('{"b":{"d":null,"c":[1,2]},"a":1}', 2000, "again")
    assert [(r["observed_at"], r["origin"]) for r in m.versions().collect()] == [(1000, "first")]
    say('{"a": 1, "b": {"c": [2, 1], "d": null}}', 3000, "other")
    m.retire("x", 4000)
    say('{"a": 1}', 5000)
    say("no json", 6000)
    say("no json", 7000)
    got = sorted((r["observed_at"], r["retired_at"], r["origin"]) for r in m.versions().collect())
    assert got == [(1000, 3000, "first"), (3000, 4000, "other"), (5000, 6000, None), (6000, T_MAX, None)]
    added, changed = m.diff(1500, 2500)[0].collect(), m.diff(1500, 3500)[0].collect()
    assert added == [] and [tuple(r) for r in changed] == [("x", "changed")]


def test_the_log_is_appended_to_and_the_controller_kept(spark, tmp_path):
    from emberline.memory import Memory

    m = Memory(spark, str(tmp_path), config=Config(lambda_base=0.0))
    schema = "name string, type string, props string, edges array<struct<dst:string,kind:string,dst_type:string>>, origin string"
    rows = [(f"n{i:02}", "t", None, [(f"n{i + 1:02}", "CALLS", "t")], None) for i in (5, 3, 9, 1)]
    m.ingest(spark.createDataFrame(rows, schema).coalesce(1), 1000)
    files = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "main" / "ops").rglob("*.parquet")}
    m.ingest(spark.createDataFrame(rows[:1], schema), 2000)
    now = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "main" / "ops").rglob("*.parquet")}
    assert files.items() <= now.items() and len(now) > len(files)  # nothing was written again
    said = m.ops().where("op = 'observe_node' AND ord.batch = 0").orderBy("ord").collect()
    assert [r["name"] for r in said] == ["n05", "n03", "n09", "n01"]  # as they came
    m.retrieve(["n05"], 3000, adapt=True)
    again = Memory(spark, str(tmp_path))
    assert (again.lambda_scale, again.integral, again.ewma) == (m.lambda_scale, m.integral, m.ewma) and again.ewma is not None


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_folds_do_not_depend_on_the_runs(spark, size):
    rng = random.Random(size)
    c = Config(alpha=0.3, r_clip=1.0)
    rows = [("hot", t, i, rng.uniform(-2, 2)) for i, t in enumerate(rng.randrange(50_000) for _ in range(900))] + [("one", 5, 1, -9.0), (None, 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, t long, s long, r double").repartition(5)
    want, last = 0.5, None
    for _, t, _, r in sorted((x for x in rows if x[0] == "hot"), key=lambda x: (x[1], x[2])):
        want = max(0.0, want * math.exp(-1e-2 * max(t - (t if last is None else last), 0) / 1000) + 0.3 * max(-1.0, min(1.0, r)))
        last = t
    got = {x["k"]: x for x in learn.touch_fold(df, "k", ["t", "s"], "t", "r", 0.5, 1e-2, c, fold_rows=size).collect()}
    assert got["hot"]["w"] == pytest.approx(want) and got["hot"]["n"] == 900 and got["hot"]["t_last"] == last
    assert got["one"]["w"] == pytest.approx(0.2) and set(got) == {"hot", "one"}


def test_rank_among_equal_values(spark):
    df = spark.createDataFrame([(0.5,)] * 5000 + [(0.1,)] * 3 + [(0.9,)] * 2 + [(None,)], "w double").repartition(4)
    assert [maintain.kth_smallest(df, "w", k) for k in (0, 2, 3, 5002, 5003, 5004, 5005)] == [0.1, 0.1, 0.5, 0.5, 0.9, 0.9, None]


def test_streamed_folds_keep_groups_apart(spark):
    from emberline.common import fold_in_order

    rows = [(g, i, float(i)) for g in ("a", "b", None) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, v double").repartition(3)
    step = lambda state, vs: (state[0] * 0.0 + vs[-1], state[1] + sum(vs))
    got = {r["g"]: (r["n"], r["last"], r["total"]) for r in fold_in_order(df, ["g"], ["i"], ["v"], (0.0, 0.0), step, "last double, total double").collect()}
    assert got == dict.fromkeys(("a", "b", None), (300, 299.0, 299.0 * 150))
