import json

import pytest

from emberline.sources import export, sidecar, stores


def test_capped_and_answered_once(spark):
    rows = spark.createDataFrame([(i,) for i in range(20)] + [(None,)], "id long")
    assert sorted(r[0] for r in stores.keep_latest(rows, "id", 3).collect()) == [17, 18, 19]
    schema = "endpoint string, key string, code int, body string, at_ms long"
    now = 100_000_000
    store = spark.createDataFrame([("/i", "a", 200, "old", now - 5), ("/i", "b", 200, "gone", now - 86_400_001)], schema)
    asked = spark.createDataFrame([("/i", "a", 500, "new", now), ("/i", "b", 201, "again", now), ("/i", "b", 202, "later", now + 1)], schema)
    assert sorted((r["key"], r["body"]) for r in stores.put_once(store, asked, now).collect()) == [("a", "old"), ("b", "again")]


def test_databases(spark, tmp_path):
    root = str(tmp_path / "root")
    df = spark.createDataFrame([(1,)], "x int")
    assert stores.list_databases(spark, root) == [] and sidecar.load_version(spark, f"{root}/a", "t") is None
    sidecar.save_version(df, f"{root}/a", "t")
    sidecar.save_version(df.union(df), f"{root}/a", "t")
    assert sidecar.load_version(spark, f"{root}/a", "t").count() == 2
    manifest = stores.backup(spark, root, "a", str(tmp_path / "copy"))
    assert manifest["files"] > 2 and sidecar.load_version(spark, str(tmp_path / "copy" / "a"), "t").count() == 2
    assert stores.drop_database(spark, root, "a") and stores.list_databases(spark, root) == []
    with pytest.raises(ValueError):
        stores.drop_database(spark, root, "../x")


def test_learned_state_of_other_systems(spark, tmp_path):
    edges = spark.createDataFrame([("x", "y", "CALLS", 1000, 0), ("y", "z", "REFS", 1000, 1), ("z", "x", "NEW", 5, 2)], "src string, dst string, kind string, valid_from long, edge_id long")
    doc = {"some_sidecar": 2, "keys": [10027217847970045053, 2231632903708260618], "w": [0.25, 0.75], "t_last": [7, 8], "dead": [True, False]}
    (tmp_path / "v2.json").write_text(json.dumps(doc))
    got = {r["src"]: (r["weight"], r["t_last"], r["dead"]) for r in sidecar.read_sidecar(spark, str(tmp_path / "v2.json"), edges).collect()}
    assert got == {"x": (0.75, 8, False), "y": (0.25, 7, True), "z": (None, 5, False)}
    (tmp_path / "v1.json").write_text(json.dumps({"w": [0.1, 0.2], "t_last": [1, 2]}))
    old = {r["src"]: r["weight"] for r in sidecar.read_sidecar(spark, str(tmp_path / "v1.json"), edges).collect()}
    assert old == {"x": 0.1, "y": 0.2, "z": None}
    (tmp_path / "v3.json").write_text(json.dumps(doc | {"some_sidecar": 3}))
    with pytest.raises(ValueError):
        sidecar.read_sidecar(spark, str(tmp_path / "v3.json"), edges)


def test_export_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "name string, x int")
    export.write_export(str(tmp_path), df, df, df, "lake")
    assert spark.read.json(str(tmp_path / "edges")).count() == 1
    assert "lake.edges" in "".join(p.read_text() for p in (tmp_path / "queries").glob("part-*"))
    histogram = spark.createDataFrame([("/r", 1, 3, 4, 9.5)], "route string, le_1 long, le_5 long, le_inf long, total double")
    text = stores.metrics_text({"live": 2.0}, histogram, [1, 5])
    assert 'requests_ms_bucket{route="/r",le="5"} 3' in text and "live 2" in text
