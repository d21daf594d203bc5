"""References whose target does not exist when the reference begins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.common import BROADCAST_ROWS, T_MAX
from emberline.operators.skew import task_share

#: A key with at least this share of all references is heavy, or with half of what a shuffle's task
#: gets on average if that is less.
HEAVY_SHARE = 1 / 500
#: Most heavy keys that stand in a condition; more are told by a broadcast table.
LISTED_KEYS = 1000
#: Copies of a heavy target's rows if they are too many to broadcast.
FALLBACK_SALTS = 64


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> list:
    """Values of ``key`` in at least ``share`` of the rows of ``df``; never null.

    One column is read, counted map-side first. No more than ``1 / share`` values
    can reach the share, so that many of the largest are all that is collected.
    """
    total = df.count()
    if not total:
        return []
    top = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("_n"))
        .orderBy(F.desc("_n"), key)
        .limit(int(1 / share) + 1)
        .collect()
    )
    return [row[0] for row in top if row["_n"] >= share * total]


def target_frames(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (name, placeholder, observed_at, retired_at): the spans in which a
    name is really there, and one row per name with what is known of it."""
    t = targets.where(F.col("name").isNotNull()).select(
        F.col("name").alias("_name"),
        F.coalesce(~F.col("placeholder"), F.lit(False)).alias("_real"),
        F.col("observed_at").alias("_from"),
        F.coalesce("retired_at", F.lit(T_MAX)).alias("_to"),
    )
    alive = t.where("_real AND _from < _to").groupBy("_name", "_from").agg(F.max("_to").alias("_to"))
    known = t.groupBy("_name").agg(
        F.max("_real").alias("_any_real"),
        F.max(F.when(F.col("_real"), F.col("_from"))).alias("_last_from"),
    )
    return alive, known


def orphan_references(
    refs: DataFrame,
    targets: DataFrame,
    columns: Sequence[str],
    key: str = "dst",
    time: str = "valid_from",
    heavy_share: float | None = None,
    most_broadcast: int = BROADCAST_ROWS,
) -> DataFrame:
    """Distinct ``columns`` of ``refs`` whose ``key`` names no real target alive at ``time``, with the reason.

    ``targets`` has (name, placeholder, observed_at, retired_at), one row per
    version; it is alive in [observed_at, retired_at), a null end never comes.
    ``reason`` is the first that applies of ``missing`` (no row of that name),
    ``placeholder`` (only placeholder rows), ``late`` (a real row observed after
    ``time``), ``deleted``.

    Plan: references are counted per key, map-side first; the heavy keys (at most
    ``1 / heavy_share``, by default twice as many as a shuffle has tasks, or 500) have
    their references reduced map-side and checked against a broadcast of their own
    targets, so no task gets a heavy key. All others are shuffled once by key, made
    distinct there and anti-joined in that partitioning; to make them distinct before
    would take a shuffle more. Both parts are united. If the heavy targets' versions
    are more than ``most_broadcast`` rows, they are copied over salts and joined by
    shuffle.

    Defined cases: a null key is no reference; a null ``time`` or a null
    placeholder flag proves nothing (orphan, and not real); repeated rows count
    once; empty ``refs`` give no rows, empty ``targets`` make all ``missing``;
    other columns of either table, whatever their names, are not looked at.
    """
    columns = list(columns)
    refs = refs.where(F.col(key).isNotNull()).select(*columns)
    alive, known = target_frames(targets)
    heavy = heavy_keys(refs, key, heavy_share or task_share(refs.sparkSession, HEAVY_SHARE))
    light = _of(refs, key, heavy, False).repartition(key).distinct()
    found = _unmatched(light, alive, known, key, time)
    if heavy:
        hot = _of(refs, key, heavy, True).distinct()
        hot_alive, hot_known = (_of(x, "_name", heavy, True) for x in (alive, known))
        if hot_alive.limit(most_broadcast + 1).count() <= most_broadcast:
            hot_found = _unmatched(hot, F.broadcast(hot_alive), F.broadcast(hot_known), key, time)
        else:
            salt = F.pmod(F.xxhash64(*columns), F.lit(FALLBACK_SALTS)).cast("int")
            every = F.explode(F.sequence(F.lit(0), F.lit(FALLBACK_SALTS - 1)))
            hot_found = _unmatched(
                hot.withColumn("_salt", salt), hot_alive.withColumn("_salt_", every), F.broadcast(hot_known), key, time, salted=True
            ).drop("_salt")
        found = found.unionByName(hot_found)
    return found


def _of(df: DataFrame, key: str, values: list, inside: bool) -> DataFrame:
    """Rows whose ``key``, which is not null, is among ``values``, or is not."""
    if len(values) <= LISTED_KEYS:
        test = F.col(key).isin(values) if values else F.lit(False)
        return df.where(test if inside else ~test)
    listed = df.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField(key, df.schema[key].dataType)]))
    return df.join(F.broadcast(listed), key, "left_semi" if inside else "left_anti").select(*df.columns)


def _unmatched(refs: DataFrame, alive: DataFrame, known: DataFrame, key: str, time: str, salted: bool = False) -> DataFrame:
    on = (F.col(key) == F.col("_name")) & (F.col("_from") <= F.col(time)) & (F.col(time) < F.col("_to"))
    if salted:
        on = on & (F.col("_salt") == F.col("_salt_"))
    orphans = refs.join(alive, on, "left_anti")
    reason = (
        F.when(F.col("_name").isNull(), "missing")
        .when(~F.col("_any_real"), "placeholder")
        .when(F.col("_last_from") > F.col(time), "late")
        .otherwise("deleted")
    )
    return orphans.join(known, F.col(key) == F.col("_name"), "left").select(*refs.columns, reason.alias("reason"))


def orphan_counts(refs: DataFrame, targets: DataFrame, columns: Sequence[str], period: str, table: str, **options) -> DataFrame:
    """Orphans per period and reason: (table_name, period, reason, n_edges).

    ``columns`` identify a reference; one that stands in several periods counts in
    each. References are made distinct per key and period before the check.
    """
    found = orphan_references(refs.where(F.col(period).isNotNull()), targets, [*columns, period], **options)
    return found.groupBy(F.lit(table).alias("table_name"), period, "reason").agg(F.count("*").alias("n_edges"))
