"""Per-key results where a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows looked at to guess which keys are heavy. Only the salting depends on the guess, no result does.
GUESS_ROWS = 200_000
#: Share of the looked-at rows that makes a key heavy.
GUESS_SHARE = 1 / 200
#: Parts a heavy key is cut into.
SALTS = 64


def task_share(spark: SparkSession, most: float = GUESS_SHARE) -> float:
    """The share of all rows that is too much for a task: half of what one of a shuffle's tasks gets on
    average, and ``most`` at most, so that more and smaller tasks make more keys heavy."""
    return min(most, 0.5 / int(spark.conf.get("spark.sql.shuffle.partitions")))


def guess_heavy(df: DataFrame, keys: list[str], share: float = GUESS_SHARE, rows: int = GUESS_ROWS, total: int | None = None) -> list[tuple]:
    """Keys that seem heavy in a bounded sample of rows; at most ``1 / share`` of them. Of a key right at
    the share 100 rows at least are looked at."""
    total = df.count() if total is None else total
    rows = max(rows, int(100 / share))
    if not total:
        return []
    looked = df.select(*keys) if total <= rows else df.select(*keys).sample(rows / total, seed=7)
    top = looked.groupBy(*keys).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), *keys).limit(int(1 / share)).collect()
    least = share * min(total, rows)
    return [tuple(row[k] for k in keys) for row in top if row["_n"] >= least]


def salted_aggregate(
    df: DataFrame,
    keys: list[str],
    partial: Mapping[str, Column],
    merge: Mapping[str, Column],
    salts: int = SALTS,
    share: float = GUESS_SHARE,
    total: int | None = None,
) -> DataFrame:
    """Aggregate per ``keys`` in two stages, heavy keys cut by a salt.

    ``partial`` names the aggregates of a key's part, ``merge`` those that make one
    result of a key's parts, over the names in ``partial``. The salt of a heavy
    key's row is its position in its scan task modulo ``salts``: as even as a random
    one, also over copies of one row, and the same when a lost task runs again.

    Defined cases: a null in a key is a key of its own; nulls in aggregated columns
    as in the aggregates given; an empty input gives no rows; keys that the guess
    misses are still summed map-side first, as all are.
    """
    heavy = guess_heavy(df, keys, share, total=total)
    salt = F.lit(0)
    if heavy:
        test = F.lit(False)
        by_rest: dict[tuple, list] = {}
        for key in heavy:
            by_rest.setdefault(key[:-1], []).append(key[-1])
        for rest, last in by_rest.items():
            same = F.col(keys[-1]).isin([x for x in last if x is not None])
            if any(x is None for x in last):
                same = F.coalesce(same, F.lit(False)) | F.col(keys[-1]).isNull()
            for name, value in zip(keys, rest):
                same = same & F.col(name).eqNullSafe(F.lit(value))
            test = test | same
        salt = F.when(test, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    parts = df.withColumn("_salt", salt).groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    return parts.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])


def endpoint_rows(edges: DataFrame, with_weight: bool = True) -> DataFrame:
    """(side, node[, weight]) for both ends of each row, from one scan; null nodes left out."""
    weight = [F.col("weight").alias("weight")] if with_weight else []
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(name).alias("node"), *weight)
    return edges.select(F.explode(F.array(side("src"), side("dst"))).alias("_x")).select("_x.*").where("node IS NOT NULL")


def node_totals(edges: DataFrame, total: int | None = None) -> DataFrame:
    """Per (side, node): rows, rows with a weight, total and greatest weight."""
    return salted_aggregate(
        endpoint_rows(edges),
        ["side", "node"],
        {"n": F.count("*"), "n_w": F.count("weight"), "s": F.sum("weight"), "m": F.max("weight")},
        {"n_rows": F.sum("n"), "n_weights": F.sum("n_w"), "total_weight": F.sum("s"), "max_weight": F.max("m")},
        total=None if total is None else 2 * total,
    )


def heavy_nodes(edges: DataFrame, share: float = 0.02) -> DataFrame:
    """(side, node) for nodes that stand in at least ``share`` of all rows of ``edges``.

    Rows count as they lie in the table; a row without ``dst`` has no node on that
    side but still is a row. An empty table has no heavy nodes.
    """
    total = edges.count()
    counts = salted_aggregate(
        endpoint_rows(edges, with_weight=False), ["side", "node"], {"n": F.count("*")}, {"n_rows": F.sum("n")}, total=2 * total
    )
    least = F.lit(str(share)).cast("decimal(18,9)") * F.lit(total)  # exact, for nodes right at the share
    return counts.where(F.col("n_rows") >= least).select("side", "node")
