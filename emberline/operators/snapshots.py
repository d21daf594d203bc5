"""Changes between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.common import broadcast_checked, in_order

#: Most snapshots whose times are kept in a plan; more are ranked in a table.
MOST_SNAPSHOTS = 100_000
#: Weights nearer than this are the same.
TOLERANCE = 0.000001


def snapshot_ranks(df: DataFrame, snapshot: str, most: int | None = None) -> tuple[DataFrame, int]:
    """(snapshot, _rank) with ranks 0.. in time order, and their number."""
    most = most or MOST_SNAPSHOTS
    times = df.select(snapshot).where(F.col(snapshot).isNotNull()).distinct()
    first = sorted(row[0] for row in times.limit(most + 1).collect())
    if len(first) > most:
        ranks = in_order(times, [snapshot], "_rank")
        return ranks.select(snapshot, (F.col("_rank") - 1).cast("int").alias("_rank")), ranks.count()
    schema = T.StructType([T.StructField(snapshot, df.schema[snapshot].dataType), T.StructField("_rank", T.IntegerType())])
    return df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(first)], schema), len(first)


def latest_rows(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """One row per ``keys``: the ``values`` of the row with the greatest ``order``, a null one last.

    ``max_by`` over primitive buffers keeps this a hash aggregate that is combined
    before the shuffle, so a key delivered a billion times moves as one row a task.
    Rows that tie in ``order`` are taken to say the same; where they don't, each
    value is that of one of them.
    """
    by = F.coalesce(F.col(order).cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz"))
    return df.groupBy(*keys).agg(*[F.max_by(v, by).alias(v) for v in values])


def differs(flags: Sequence[str], numbers: Sequence[str], was: str, tolerance: float) -> Column:
    """Whether a row differs from the one before it, whose columns have the prefix ``was``.

    The rows' hashes decide when they are equal; where they are not, the exact
    comparison does, which lets numbers be ``tolerance`` apart.
    """
    names = [*flags, *numbers]
    test = F.lit(False)
    for name in flags:
        test = test | ~F.col(name).eqNullSafe(F.col(was + name))
    for name in numbers:
        a, b = F.col(name), F.col(was + name)
        far = ~a.eqNullSafe(b) & (a.isNull() | b.isNull() | (F.abs(a - b) > F.lit(tolerance)))
        test = test | F.coalesce(far, F.lit(False))
    return (F.xxhash64(*names) != F.xxhash64(*[was + n for n in names])) & test


def validity_intervals(
    df: DataFrame,
    keys: Sequence[str],
    snapshot: str,
    order: str,
    flags: Sequence[str] = (),
    numbers: Sequence[str] = (),
    tolerance: float = TOLERANCE,
) -> tuple[DataFrame, DataFrame, int]:
    """Islands of consecutive snapshots in which a key's row says the same.

    Gives (keys, _first, _last, _joins, _joined): the ranks of the island's first
    and last snapshot and whether an island of the same key lies right before or
    after it; with the ranks' times and number.

    One shuffle makes the rows of a snapshot one per key (combined before it), a
    second brings a key's snapshots together; a key has at most one row a snapshot
    by then, so no task gets more than that for any key. Both windows share one sort.
    """
    keys = list(keys)
    ranks, n = snapshot_ranks(df, snapshot)
    rows = df.select(*keys, snapshot, order, *flags, *numbers).join(broadcast_checked(ranks), snapshot)
    rows = latest_rows(rows, [*keys, "_rank"], [*flags, *numbers], order)
    w = Window.partitionBy(*keys).orderBy("_rank")
    names = ["_rank", *flags, *numbers]
    rows = rows.select("*", *[F.lag(c).over(w).alias(f"_was_{c}") for c in names], F.lead("_rank").over(w).alias("_next"))
    gap = F.col("_was__rank").isNull() | (F.col("_was__rank") != F.col("_rank") - 1)
    starts = gap | differs(flags, numbers, "_was_", tolerance)
    ends = F.col("_next").isNull() | (F.col("_next") != F.col("_rank") + 1)
    # an island ends where the next one starts right after it, or at a gap
    marks = rows.select(*keys, "_rank", "_was__rank", starts.alias("_starts"), ends.alias("_ends")).where("_starts OR _ends")
    marks = marks.select(
        "*",
        F.lead("_starts").over(w).alias("_after_starts"),
        F.lead("_rank").over(w).alias("_after"),
        F.lead("_was__rank").over(w).alias("_after_was"),
    )
    # the mark after a start is either the end of its island or the start of the next
    last = F.when(F.col("_ends") | F.col("_after").isNull(), F.col("_rank")).when(F.col("_after_starts"), F.col("_after_was")).otherwise(F.col("_after"))
    islands = marks.where("_starts").select(
        *keys,
        F.col("_rank").alias("_first"),
        last.alias("_last"),
        F.coalesce(F.col("_was__rank") == F.col("_rank") - 1, F.lit(False)).alias("_joins"),
        (~F.col("_ends") & F.coalesce(F.col("_after_starts"), F.lit(False))).alias("_joined"),
    )
    return islands, ranks, n


def snapshot_changes(df: DataFrame, keys: Sequence[str], snapshot: str, order: str, **options) -> DataFrame:
    """(snapshot, keys, diff): 'added', 'removed' or 'changed' from each snapshot to the next.

    A validity interval that begins right after another of its key is a change,
    one that begins otherwise an addition, one that ends with none right after it
    a removal at the next snapshot. Nothing is said of the first snapshot.

    Defined cases: rows without a snapshot time are left out; nulls in a key are
    values like others; of several rows of a key in a snapshot the one with the
    greatest ``order`` counts; one snapshot or an empty table gives no rows; other
    columns are not read.
    """
    islands, ranks, n = validity_intervals(df, keys, snapshot, order, **options)
    event = lambda when, what: F.struct(when.cast("int").alias("_rank"), what.alias("diff"))
    begins = F.when(F.col("_first") > 0, event(F.col("_first"), F.when(F.col("_joins"), F.lit("changed")).otherwise(F.lit("added"))))
    stops = F.when(~F.col("_joined") & (F.col("_last") < n - 1), event(F.col("_last") + 1, F.lit("removed")))
    events = islands.select(*keys, F.explode(F.array_compact(F.array(begins, stops))).alias("_e")).select(*keys, "_e.*")
    return events.join(broadcast_checked(ranks), "_rank").select(snapshot, *keys, "diff")


def snapshot_intervals(df: DataFrame, keys: Sequence[str], snapshot: str, order: str, **options) -> DataFrame:
    """(keys, valid_since, valid_until): first and last snapshot of each validity interval."""
    islands, ranks, _ = validity_intervals(df, keys, snapshot, order, **options)
    first = ranks.select(F.col("_rank").alias("_first"), F.col(snapshot).alias("valid_since"))
    last = ranks.select(F.col("_rank").alias("_last"), F.col(snapshot).alias("valid_until"))
    return islands.join(broadcast_checked(first), "_first").join(broadcast_checked(last), "_last").select(*keys, "valid_since", "valid_until")
