from emberline.sources import oplog


def some_ops(spark):
    """Three nodes and an edge."""
    rows = [((i,), "observe_node", f"n{i}", "t", '{"a":1}', None, None, None, i, None) for i in range(3)] + [((9,), "observe_edge", None, None, None, "n0", "n1", "CALLS", 9, "o:1")]
    return spark.createDataFrame(rows, "ord struct<i:int>, " + oplog.OPS)
