import pytest

from emberline.llm import queries
from emberline.plans import registry


def test_kept_traces_are_the_newest_4096(spark, tmp_path):
    spark.range(5000).selectExpr("id AS trace_id", "id % 7 AS edges_fired").write.parquet(str(tmp_path / "traces.parquet"))
    kept = {r["trace_id"] for r in registry.QUERIES["trace_retention_kept"](spark, str(tmp_path)).collect()}
    assert kept == set(range(904, 5000))


def test_too_many_capacities_are_refused(spark, tmp_path):
    sizes = lambda n: spark.range(n).selectExpr("cast(id AS int) AS pack_id", "id + 1 AS capacity_tokens").write.mode("overwrite").parquet(str(tmp_path / "pack_sizes.parquet"))
    sizes(1000)
    assert len(queries._sizes(spark, str(tmp_path))) == 1000
    sizes(1001)
    with pytest.raises(ValueError):
        queries._sizes(spark, str(tmp_path))
