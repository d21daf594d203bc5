"""Continuous periods and gaps of overlapping intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.common import T_MAX, broadcast_checked
from emberline.operators.skew import guess_heavy, task_share

#: Time slices that a heavy entity's starts, and its ends, are cut into.
SLICES = 64
#: Ranks of an entity that one task looks through for the end of a period.
RANKS = 500_000


def _proper(df: DataFrame, entity: Sequence[str], start: str, end: str) -> DataFrame:
    to = F.coalesce(F.col(end), F.lit(T_MAX))
    return df.select(*entity, F.col(start).alias("_from"), to.alias("_to")).where("_from < _to")


def ranked_bounds(intervals: DataFrame, entity: Sequence[str], slices: int | None = None, raw: DataFrame | None = None) -> DataFrame:
    """(entity, _i, _end, _start): the i-th end of an entity and the start of rank i + 1, from (entity, _from, _to).

    Starts and ends are sorted independently. ``_end`` is null at rank 0 and ``_start``
    at the last one. Without heavy entities one shuffle by entity serves the sort and
    the pairing. A heavy entity's starts and its ends are cut into slices of time by
    its own quantiles, sorted slice by slice, and moved by what the slices before
    hold; pairs are then made by entity and rank, so no task gets more of it than a
    slice. Where the slices lie changes no result: ``raw``, if given, is a cheaper frame
    with ``entity``, ``_from`` and ``_to`` to find heavy entities and slices from.
    """
    entity, slices = list(entity), slices or SLICES
    raw = intervals if raw is None else raw
    heavy = guess_heavy(raw, entity, task_share(intervals.sparkSession))
    at = lambda t, end: F.struct(F.lit(end).alias("_ends"), F.col(t).alias("_t"))
    both = lambda df: df.select(*entity, F.explode(F.array(at("_from", False), at("_to", True))).alias("_x")).select(*entity, "_x.*")
    i = F.col("_r") - F.when(F.col("_ends"), 0).otherwise(1)
    pair = [F.max(F.when(F.col("_ends"), F.col("_t"))).alias("_end"), F.max(F.when(~F.col("_ends"), F.col("_t"))).alias("_start")]
    if not heavy:
        w = Window.partitionBy(*entity, "_ends").orderBy("_t")
        ranked = both(intervals).repartition(*entity).withColumn("_r", F.row_number().over(w).cast("long"))
        return ranked.groupBy(*entity, i.alias("_i")).agg(*pair)

    hot = F.broadcast(intervals.sparkSession.createDataFrame(heavy, intervals.select(*entity).schema))  # at most 1 / share rows
    same = lambda a, b, *more: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in [*entity, *more]]
    of_hot = lambda df: df.alias("m").join(hot.alias("h"), same("m", "h"), "left_semi")
    cut = [k / slices for k in range(1, slices)] or [1.0]
    cuts = of_hot(both(raw)).groupBy(*entity, "_ends").agg(F.percentile_approx("_t", cut, 1000).alias("_cuts"))
    marks = both(intervals).alias("m").join(F.broadcast(cuts).alias("c"), same("m", "c", "_ends"), "left").select("m.*", "c._cuts")
    slice_ = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("_cuts", lambda x: x < F.col("_t"))))
    marks = marks.withColumn("_slice", slice_).drop("_cuts")
    earlier = Window.partitionBy(*entity, "_ends").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    held = of_hot(marks).groupBy(*entity, "_ends", "_slice").agg(F.count("*").alias("_n"))
    held = held.select(*entity, "_ends", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*entity, "_ends", "_slice").orderBy("_t")
    ranked = marks.withColumn("_in", F.row_number().over(within)).alias("m")
    ranked = ranked.join(F.broadcast(held).alias("b"), same("m", "b", "_ends", "_slice"), "left")  # at most 2 * slices rows for each heavy entity
    ranked = ranked.select("m.*", (F.col("_in") + F.coalesce("_before", F.lit(0))).alias("_r"))
    return ranked.groupBy(*entity, i.alias("_i")).agg(*pair)


def _bounds(df: DataFrame, entity: Sequence[str], start: str, end: str, raw: DataFrame | None) -> DataFrame:
    raw = None if raw is None else _proper(raw, entity, start, end)
    return ranked_bounds(_proper(df, entity, start, end), list(entity), raw=raw)


def gaps(df: DataFrame, entity: Sequence[str], start: str, end: str, raw: DataFrame | None = None) -> DataFrame:
    """(entity, gap_from, gap_to): the longest spans between two covered periods of an entity.

    With starts and ends sorted independently, there is a gap behind the i-th end
    where the start of rank i + 1 is later: as many intervals are over by then as had
    begun.

    Intervals are half-open; a null or greatest ``end`` never comes. Those with
    ``end`` <= ``start`` or a null ``start`` cover nothing. Periods that touch leave
    no gap. Repeated and nested intervals change nothing, nulls in ``entity`` are
    values, an empty table has no gaps, other columns are not read.
    """
    found = _bounds(df, entity, start, end, raw).where("_start > _end")
    return found.select(*entity, F.col("_end").alias("gap_from"), F.col("_start").alias("gap_to"))


def periods(df: DataFrame, entity: Sequence[str], start: str, end: str, raw: DataFrame | None = None) -> DataFrame:
    """(entity, period_from, period_to): the continuous periods an entity is covered; ``period_to`` null if it never ends.

    Cases as in :func:`gaps`. A period begins at the first start or behind a gap, and
    ends at the end before the next gap or at the last one: between two neighbouring
    ranks with a gap or nothing on one side. These are looked for among ``RANKS`` ranks
    in one task; where there are none behind a start, those of later ranks tell.
    """
    entity = list(entity)
    breaks = _bounds(df, entity, start, end, raw).where("_start > _end OR _start IS NULL OR _end IS NULL")
    breaks = breaks.withColumn("_bucket", F.floor(F.col("_i") / RANKS))
    inside = Window.partitionBy(*entity, "_bucket").orderBy("_i")
    breaks = breaks.withColumn("_until", F.lead("_end").over(inside))
    firsts = breaks.groupBy(*entity, "_bucket").agg(F.min_by("_end", "_i").alias("_first"))
    over = Window.partitionBy(*entity).orderBy("_bucket")  # a row per RANKS intervals
    nexts = firsts.withColumn("_later", F.lead("_first").over(over)).where("_later IS NOT NULL")
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"n.{c}")) for c in [*entity, "_bucket"]]
    flat = breaks.alias("k").join(broadcast_checked(nexts).alias("n"), same, "left").select("k.*", "n._later")
    until = F.coalesce("_until", "_later")
    return flat.where("_start IS NOT NULL").select(*entity, F.col("_start").alias("period_from"), F.when(until != T_MAX, until).alias("period_to"))
