from emberline.llm import queries
from test_cooccur import brute


def test_pairs_of_few_traces_come_out(spark, sf_dir):
    traces = spark.read.parquet(f"{sf_dir}/traces.parquet").select("db", "trace_id", "surfaced.node").collect()
    expected = brute([tuple(r) for r in traces], 1)
    out = {(r["db"], r["node_a"], r["node_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in queries.p2_all_pairs(spark, sf_dir).collect()}
    assert out == expected and min(n for n, *_ in out.values()) == 1
