import json

import duckdb

from emberline.memory import Memory
from emberline.plans import registry
from emberline.sources import oplog

NET, DISK = "//compute.googleapis.com/projects/p/global/networks/n", "//compute.googleapis.com/projects/p/zones/z/disks/d"
VM, BUCKET = "//compute.googleapis.com/projects/p/zones/z/instances/v", "//storage.googleapis.com/b"
PROJECT = "//cloudresourcemanager.googleapis.com/projects/1"
ASSETS = "name string, assetType string, ancestors array<string>, resource struct<data:string>"


def slashed(value):
    return json.dumps(value).replace("/", "\\/")


def test_links_however_they_are_written(spark):
    self_link = "https://www.googleapis.com/compute/v1/" + NET.split("/", 3)[3]
    texts = [
        slashed({"a": [self_link, {"b": DISK}], "c": DISK}),
        json.dumps({"q": VM + '/say "é\\"', DISK: 1, "x": "//elsewhere.org/y", "y": " " + NET}),
        '{"a": "%s", "\\u0061": {"b": "%s"}, "k": ["%s"], "k": 1}' % (NET, DISK, BUCKET),
        json.dumps(NET), "{" + json.dumps(NET), None, "\\u002f", '"\\u002f/storage.googleapis.com/b"',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, data string")
    found = {r["i"]: r["r"] for r in df.select("i", oplog.reference_names().alias("r")).collect()}
    assert [found[i] for i in range(len(texts))] == [[NET, DISK], [VM + '/say "é\\"'], [DISK], [NET], [], [], [], [BUCKET]]


def test_query_and_sql_on_assets_with_links(spark, tmp_path):
    rows = [(i, f"//x/{i}", "t", ["projects/1", "folders/2"], (text,), "2024-01-01") for i, text in enumerate([slashed([NET, DISK, NET]), json.dumps({"n": NET, "me": "//x/1"}), "{", None])]
    schema = "asset_id long, name string, asset_type string, ancestors array<string>, resource struct<data:string>, received_at string"
    df = spark.createDataFrame(rows + rows[:1], schema).selectExpr("* EXCEPT (received_at)", "cast(received_at AS timestamp_ntz) AS received_at")
    df.coalesce(1).write.parquet(str(tmp_path / "cai_assets.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW cai_assets AS FROM '{tmp_path}/cai_assets.parquet/*.parquet'")
    mine = registry.QUERIES["asset_ops"](spark, str(tmp_path))
    rel = con.sql(registry.SQL["asset_ops"])
    mine_rows, sql_rows = ([tuple(map(str, r)) for r in x] for x in (mine.select(*rel.columns).collect(), rel.fetchall()))
    assert sorted(mine_rows) == sorted(sql_rows)
    edges = {(r["src"], r["dst"]) for r in mine.where("kind = 'REFERENCES'").collect()}
    assert edges == {("//x/0", NET), ("//x/0", DISK), ("//x/1", NET)}


def test_snapshots_reconcile(spark, tmp_path):
    m = Memory(spark, str(tmp_path))

    def ingest(t, *assets):
        m.ingest_assets(spark.createDataFrame([(n, "t", ["projects/1"], (slashed(d),)) for n, d in assets], ASSETS), t)

    def open_edges():
        return {(r["src"], r["dst"], r["kind"]) for r in m.edges().where("valid_to = 9223372036854775807").collect()}

    contains = lambda *names: {(PROJECT, n, "CONTAINS") for n in names}
    ingest(1000, (VM, {"disk": DISK, "net": NET}), (DISK, {}))
    assert open_edges() == contains(VM, DISK) | {(VM, DISK, "REFERENCES"), (VM, NET, "REFERENCES")}
    ingest(2000, (VM, {"disk": DISK}))  # no network any more; the disk is named, but is not there
    assert (VM, NET, "REFERENCES") not in open_edges() and (VM, DISK, "REFERENCES") not in open_edges()
    names = lambda t: {r["name"] for r in m.names(t).collect()}
    assert names(1500) == {VM, DISK, NET, PROJECT} and names(2500) == {VM, NET, PROJECT}
