"""Upkeep of learned weights: consolidation, conflicts, sleep, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.common import T_MAX, written
from emberline.config import Config
from emberline.functions.weights import decay_rate, effective
from emberline.operators.spread import EDGE


def with_state(edges: DataFrame, config: Config) -> DataFrame:
    """Edges with learned state, seeded where there is none: weight, t_last, dead."""
    have = set(edges.columns)
    out = edges.withColumn("weight", F.coalesce("weight", F.lit(config.w0)))
    out = out.withColumn("t_last", F.coalesce("t_last", "valid_from") if "t_last" in have else F.col("valid_from"))
    return out.withColumn("dead", F.coalesce("dead", F.lit(False)) if "dead" in have else F.lit(False))


def renormalised(state: DataFrame, target: float) -> DataFrame:
    """Live weights scaled so that each source's sum to ``target``. Edges that ended still count:
    truth and salience are kept apart. The sums are combined before their shuffle."""
    sums = state.where("NOT dead").groupBy("src").agg(F.sum("weight").alias("_sum")).where("_sum > 0")
    out = state.join(sums, "src", "left")
    w = F.when(~F.col("dead") & F.col("_sum").isNotNull(), F.col("weight") * (F.lit(target) / F.col("_sum"))).otherwise(F.col("weight"))
    return out.withColumn("weight", w).drop("_sum")


def materialised(state: DataFrame, t: int, config: Config, scale: float = 1.0) -> DataFrame:
    rate = decay_rate("kind", config.lambda_base, config.beta, config.authority_by_kind, config.authority_default)
    w = effective("weight", "t_last", rate, t, scale, F.col("dead"))
    return state.withColumn("weight", w).withColumn("t_last", F.when(F.col("dead"), F.col("t_last")).otherwise(F.lit(t)))


def consolidate(edges: DataFrame, t: int, config: Config, scale: float = 1.0) -> DataFrame:
    """Decay made real at ``t``, weights below theta dead, the rest of each source scaled to the norm."""
    state = materialised(with_state(edges, config), t, config, scale)
    state = state.withColumn("dead", F.col("dead") | (F.col("weight") < config.theta))
    state = state.withColumn("weight", F.when(F.col("dead"), 0.0).otherwise(F.col("weight")))
    return renormalised(state, config.norm_target)


def consolidation_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(live_edges, pruned, renormalized_sources) of a consolidation."""
    was = F.coalesce("dead", F.lit(False)) if "dead" in before.columns else F.lit(False)
    dead_before = before.agg(F.count_if(was).alias("_d"))
    now = after.agg(F.count_if(~F.col("dead")).alias("live_edges"), F.count_if("dead").alias("_dead"), F.countDistinct(F.when(~F.col("dead") & (F.col("weight") > 0), F.col("src"))).alias("renormalized_sources"))
    return now.crossJoin(F.broadcast(dead_before)).select("live_edges", (F.col("_dead") - F.col("_d")).alias("pruned"), "renormalized_sources")  # one row each


def conflicts(state: DataFrame, kinds: list[str]) -> DataFrame:
    """(src, kind, dst, winner_dst): edges to retire, where a functional kind has several open edges from one source.

    The greatest weight wins, of equal ones the first in edge order; a dead edge weighs 0 but takes part.
    The winner comes from an aggregate, so a source with many edges is reduced before the shuffle.
    """
    open_ = state.where(F.col("kind").isin(kinds) & (F.coalesce("valid_to", F.lit(T_MAX)) == T_MAX))
    w = F.when(F.col("dead"), 0.0).otherwise(F.col("weight"))
    rank = F.struct((-w).alias("w"), F.col("valid_from"), F.col("dst"))
    best = open_.groupBy("src", "kind").agg(F.count("*").alias("_n"), F.min(rank).alias("_best")).where("_n >= 2")
    losers = open_.join(best, ["src", "kind"]).where(~((F.col("dst") == F.col("_best.dst")) & (F.col("valid_from") == F.col("_best.valid_from"))))
    return losers.select("src", "kind", "dst", F.col("_best.dst").alias("winner_dst"))


def kth_smallest(df: DataFrame, value: str, k: int) -> float | None:
    """The value of rank ``k`` (from 0). Rows are counted per value, map-side first, so equal ones are one row; values are
    range partitioned, the ranges' sums tell which holds the rank, and only that one is sorted. Nulls have no rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    ranged = written(counts.repartitionByRange(value).withColumn("_range", F.spark_partition_id()), "ranged")
    for part, n in sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.sum("_n").alias("n")).collect()):
        if k < n:
            rows = ranged.where(F.col("_range") == part)
            w = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
            return rows.withColumn("_upto", F.sum("_n").over(w)).where(F.col("_upto") > k).agg(F.min(value)).first()[0]
        k -= n
    return None


def sleep(edges: DataFrame, t: int, config: Config, scale: float = 1.0) -> tuple[DataFrame, float | None]:
    """Down-scaled state after sleep and the protection threshold.

    Weights at or above the nearest-rank (1 - protect_top_frac) quantile are
    protected; all are scaled down, then unprotected ones below the sleep threshold die.
    """
    state = materialised(with_state(edges, config), t, config, scale)
    live = state.where("NOT dead")
    n = live.count()
    frac = min(max(config.protect_top_frac, 0.0), 1.0)
    rank = int((1 - frac) * max(n - 1, 0) + 0.5)
    threshold = kth_smallest(live, "weight", rank) if n else None
    protected = F.col("weight") >= F.lit(threshold if threshold is not None else float("inf"))
    low = F.col("weight") * config.sleep_downscale
    dies = ~F.col("dead") & (low < config.sleep_theta) & ~protected
    state = state.select(*EDGE, *[c for c in state.columns if c not in (*EDGE, "weight", "dead")], F.when(F.col("dead") | dies, 0.0).otherwise(low).alias("weight"), (F.col("dead") | dies).alias("dead"), (~F.col("dead") & protected).alias("protected"))
    return renormalised(state, config.norm_target), threshold


def sleep_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(downscaled, pruned, protected, renormalized_sources, live_after, mean_weight_before, mean_weight_after) of a sleep:
    ``before`` with decay made real (:func:`materialised`), ``after`` as :func:`sleep` gives it."""
    live = lambda of: F.when(~F.col("dead"), of)
    mean = F.coalesce(F.avg(live(F.col("weight"))), F.lit(0.0))
    was = before.agg(F.count(live(F.lit(1))).alias("downscaled"), mean.alias("mean_weight_before"))
    now = after.agg(
        F.count_if("protected").alias("protected"),
        F.countDistinct(live(F.when(F.col("weight") > 0, F.col("src")))).alias("renormalized_sources"),
        F.count(live(F.lit(1))).alias("live_after"),
        mean.alias("mean_weight_after"),
    )
    both = now.crossJoin(F.broadcast(was))  # one row each
    return both.select("downscaled", (F.col("downscaled") - F.col("live_after")).alias("pruned"), "protected", "renormalized_sources", "live_after", "mean_weight_before", "mean_weight_after")


def stats(state: DataFrame) -> DataFrame:
    """(edges_total, edges_live, edges_dead, nodes, weight_min, weight_max, weight_mean) over stored weights, in one pass."""
    live = F.when(~F.col("dead"), F.col("weight"))
    ends = state.select(F.explode(F.array("src", "dst")).alias("n")).distinct().agg(F.count("*").alias("nodes"))
    sums = state.agg(
        F.count("*").alias("edges_total"),
        F.count(live).alias("edges_live"),
        F.count_if("dead").alias("edges_dead"),
        F.coalesce(F.min(live), F.lit(0.0)).alias("weight_min"),
        F.coalesce(F.max(live), F.lit(0.0)).alias("weight_max"),
        F.coalesce(F.avg(live), F.lit(0.0)).alias("weight_mean"),
    )
    return sums.crossJoin(F.broadcast(ends))  # one row each


def concentration(edges: DataFrame, top: int = 20) -> DataFrame:
    """(src, live_edges, top_weight, concentration): where weight gathers, the ``top`` sources."""
    per = edges.groupBy("src").agg(F.count("*").alias("live_edges"), F.max("weight").alias("_m"), F.sum("weight").alias("_s"))
    per = per.select("src", "live_edges", F.round("_m", 4).alias("top_weight"), F.round(F.try_divide("_m", "_s"), 3).alias("concentration"))
    return per.orderBy(F.desc("top_weight"), "src").limit(top)
