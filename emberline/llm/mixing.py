"""Mixing sources to target shares by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.common import broadcast_checked, written

#: Documents of a source that one task puts in order.
BUCKET_DOCS = 50_000


def running_total(df: DataFrame, group: str, order: str, value: str, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """``df`` with ``_upto``: the sum of ``value`` over the rows of ``group`` up to this one, in the order of the
    long ``order``, evenly spread over all longs. Each group is cut into ranges of ``order``; a task sorts one
    range, and what the ranges before it hold is added from a small table."""
    most = df.groupBy(group).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 1
    cuts = max(1, -(-most // bucket_docs))
    bucket = F.least(F.floor((F.col(order) / F.lit(2.0**64) + 0.5) * cuts), F.lit(cuts - 1)).cast("int")
    rows = df.withColumn("_bucket", bucket)
    within = Window.partitionBy(group, "_bucket").orderBy(order, "doc_id", value).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(group, "_bucket").agg(F.sum(value).alias("_s")).select(group, "_bucket", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_in", F.sum(value).over(within))
    return ranked.join(before, [group, "_bucket"]).withColumn("_upto", F.col("_before") + F.col("_in")).drop("_bucket", "_in", "_before")


def clean_targets(targets: DataFrame) -> DataFrame:
    """(source, _share, _most) of the targets that ask for something, one row per source."""
    rows = targets.where("source IS NOT NULL AND target_share > 0")
    most = F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(1)).cast("int")
    return rows.select(F.col("source").cast("string"), F.col("target_share").cast("double").alias("_share"), most.alias("_most"))


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17) -> DataFrame:
    """(position, source, doc_id, pass_no, tokens, total_tokens): a selection in which every source has its share.

    Each source's documents are shuffled by a hash of id and ``seed`` and queued;
    a document's virtual finish time is the source's tokens up to its end, over all
    passes so far, divided by the source's share. In the order of finish times the
    shares hold at every point; the order is cut at the total budget, by default
    the most tokens at which no source must be used more often than it may.
    ``position`` and ``total_tokens`` count the selection in that order: it is range
    sorted, and the ranges' sums are added up from a table with a row per range.

    Defined cases: documents with a null id, a null source, one that ``targets``
    lacks, or no tokens are not selected; targets with a null source or no positive
    share ask for nothing, a null or smaller ``max_repeats`` means 1; sources with
    a target but no documents get nothing and don't hold the others back; equal
    finish times go by source, id and pass; an empty table gives no rows; other
    columns are not read.
    """
    wanted = clean_targets(targets)
    rows = docs.where("doc_id IS NOT NULL AND tokens > 0").select("source", F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("long").alias("tokens"))
    totals = rows.where("source IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("_total"))
    limits = written(wanted.join(totals, "source"), "limits")  # a row per source
    most = limits.agg(F.min(F.col("_total") * F.col("_most") / F.col("_share"))).first()[0] or 0.0
    reach = most if budget is None else min(most, float(budget))

    # passes that can begin before the end, at most max_repeats
    passes = F.least(F.col("_most"), F.ceil(F.col("_share") * F.lit(reach) / F.col("_total")).cast("int"))
    plan = broadcast_checked(limits.select("source", "_share", "_total", passes.alias("_passes")))
    queue = running_total(rows.join(plan.select("source"), "source", "left_semi").withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")), "source", "_h", "tokens")
    queue = queue.join(plan, "source").where("_passes > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("_passes") - 1)).alias("pass_no"))
    queue = queue.withColumn("_finish", (F.col("pass_no") * F.col("_total") + F.col("_upto")) / F.col("_share"))
    chosen = queue.where(F.col("_finish") <= F.lit(reach * (1 + 1e-12)))
    order = ["_finish", "source", "doc_id", "pass_no"]
    # a prefix of this order is cut at the budget, so ranges are put in order where they lie
    ranged = written(chosen.select(*order, "tokens").repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mixed")
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.sum("tokens").alias("_t")).select(
        "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t")
    )
    placed = ranged.select("*", F.row_number().over(w).alias("_i"), F.sum("tokens").over(w).alias("_s")).join(F.broadcast(before), "_range")
    placed = placed.select((F.col("_n") + F.col("_i")).alias("position"), "source", "doc_id", "pass_no", "tokens", (F.col("_t") + F.col("_s")).alias("total_tokens"))
    return placed.where(F.col("total_tokens") <= F.lit(reach * (1 + 1e-12)))


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_uses, n_tokens, actual_share) for every target."""
    per = mixed.groupBy("source").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_uses"), F.sum("tokens").alias("n_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = targets.select("source", "target_share", "max_repeats").join(F.broadcast(per), "source", "left").select("source", "target_share", "max_repeats", zero("n_docs"), zero("n_uses"), zero("n_tokens"))
    everything = Window.partitionBy()  # a row per target
    return out.withColumn("actual_share", F.round(F.coalesce(F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(everything)), F.lit(0.0)), 6))


def broken_rules(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """What a mix must keep, for every source with a target: (source, over_used, foreign, share_off); all 0.
    No document is used more often than it may or is not in its source, and the source's tokens are off its
    share of all by no more than one document, the longest of all."""
    wanted = clean_targets(targets)
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("_uses"), F.sum("tokens").alias("_t"))
    real = docs.select("source", "doc_id", F.lit(1).alias("_real")).where("doc_id IS NOT NULL").distinct()
    uses = uses.join(real, ["source", "doc_id"], "left")
    longest = docs.agg(F.max("tokens").alias("_longest"))
    per = uses.join(broadcast_checked(wanted), "source", "left").groupBy("source").agg(
        F.count(F.when(F.col("_uses") > F.col("_most"), 1)).alias("over_used"), F.count(F.when(F.col("_real").isNull() | F.col("_share").isNull(), 1)).alias("foreign"), F.sum("_t").alias("_tokens")
    )
    shares = per.join(wanted.select("source", "_share"), "source").join(F.broadcast(longest))  # one row
    everything = Window.partitionBy()  # a row per source
    off = F.abs(F.col("_tokens") - F.sum("_tokens").over(everything) * F.col("_share") / F.sum("_share").over(everything)) > F.col("_longest")
    shares = shares.select("source", "over_used", "foreign", off.cast("long").alias("share_off"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return wanted.select("source").join(shares, "source", "left").select("source", zero("over_used"), zero("foreign"), zero("share_off"))
