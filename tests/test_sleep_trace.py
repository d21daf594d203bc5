import pytest

from emberline.config import Config
from emberline.memory import Memory
from emberline.operators import maintain
from test_graph import edge_frame


def test_sleep_report(spark):
    c = Config(sleep_downscale=0.5, sleep_theta=0.2, protect_top_frac=0.25, lambda_base=0.0, norm_target=1.0)
    df = edge_frame(spark, [("hub", x, "CALLS") for x in "abcde"]).selectExpr("* EXCEPT (weight)", "CASE dst WHEN 'a' THEN 1.0D WHEN 'e' THEN 0.3D ELSE 0.5D END AS weight")
    state, _ = maintain.sleep(df, 1000, c)
    report = maintain.sleep_report(maintain.materialised(maintain.with_state(df, c), 1000, c), state).first()
    assert tuple(report)[:5] == (5, 1, 4, 1, 4)
    assert tuple(report)[5:] == pytest.approx((2.8 / 5, 1 / 4))


def test_feedback_by_trace_id(spark, tmp_path):
    m = Memory(spark, str(tmp_path), config=Config(lambda_base=0.0))
    schema = "name string, type string, props string, edges array<struct<dst:string,kind:string,dst_type:string>>, origin string"
    m.ingest(spark.createDataFrame([("a", "t", None, [("b", "CALLS", "t")], None), ("c", "t", None, [("b", "CALLS", "t")], None)], schema), 1000)
    first, shown = m.retrieve_traced(["a"], 2000)
    assert first == 1 and {r["node"] for r in shown.collect()} == {"a", "b"}
    m.retire("a", 2500)  # from its seeds the retrieval gives nothing any more
    assert m.feedback_trace(first, 3000, used=["b"]).first()["edges_reinforced"] == 1
    weights = {r["src"]: r["weight"] for r in m.edges().collect()}
    assert weights["a"] > weights["c"]
    with pytest.raises(KeyError):
        m.feedback_trace(7, 3000, used=["b"])
