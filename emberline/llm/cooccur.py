"""How often items occur together, by splitting them into frequent and rare ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.common import broadcast_checked, small_enough, written

#: An item in at least this share of its group's baskets is frequent, if among the first of them.
HEAVY_SHARE = 1 / 64
MOST_HEAVY = 512
#: Baskets whose bits stand in one matrix.
BLOCK_BASKETS = 8192
#: Rare items of a basket that are paired in place; one with more is cut into lists of about so many.
LIST_ITEMS = 256
#: Copies of the frequent items if all items are too many to broadcast.
SALTS = 32

_PAIR = "p long, q long, n long"


def _baskets(df: DataFrame, group: str, basket: str, items: str) -> DataFrame:
    base = df.select(F.col(group).cast("string").alias("_g"), F.col(basket).alias("_b"), F.col(items).alias("_items"))
    return base.where("_g IS NOT NULL AND _b IS NOT NULL").withColumn("_gid", F.xxhash64(F.lit(0), "_g"))


def _exploded(base: DataFrame, field: str | None) -> DataFrame:
    """(_g, _gid, _b, _x, _id): each item of each delivery. An item of a group goes by a number from here on."""
    rows = base.select("_g", "_gid", "_b", F.explode("_items").alias("_i")).select("_g", "_gid", "_b", (F.col(f"_i.{field}") if field else F.col("_i")).cast("string").alias("_x"))
    return rows.where("_x IS NOT NULL").withColumn("_id", F.xxhash64("_g", "_x"))


def _names(rows: DataFrame) -> DataFrame:
    """(_id, _g, _x) of each item; that no two items or groups have one number is made sure of."""
    names = written(rows.select("_id", "_g", "_x").distinct(), "names")
    groups = names.select("_g").distinct().agg(F.count("*"), F.count_distinct(F.xxhash64(F.lit(0), "_g"))).first()
    if groups[0] != groups[1] or names.groupBy("_id").agg(F.count("*").alias("_k")).where("_k > 1").limit(1).count():
        raise ArithmeticError("two items or groups have the same 64-bit number")
    return names


def _popcounts(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of frequent items in one block of baskets: AND of bit rows, popcount."""
    baskets, column = np.unique(pdf["_b"].to_numpy(), return_inverse=True)
    items, row = np.unique(pdf["_id"].to_numpy(), return_inverse=True)
    dense = np.zeros((len(items), -(-len(baskets) // 64) * 64), bool)
    dense[row, column] = True
    bits = np.packbits(dense, axis=1).view(np.uint64)
    p, q, counts = [], [], []
    for a in range(len(items) - 1):
        n = np.bitwise_count(bits[a] & bits[a + 1 :]).sum(axis=1)
        at = np.flatnonzero(n)
        p.append(np.full(len(at), items[a]))
        q.append(items[a + 1 :][at])
        counts.append(n[at])
    join = lambda x: np.concatenate(x).astype("int64") if x else np.zeros(0, "int64")
    return pd.DataFrame({"p": join(p), "q": join(q), "n": join(counts)})


def cooccurrence(
    df: DataFrame,
    group: str,
    basket: str,
    items: str,
    field: str | None = None,
    min_count: int = 5,
    heavy_share: float = HEAVY_SHARE,
    most_heavy: int = MOST_HEAVY,
    list_items: int = LIST_ITEMS,
) -> DataFrame:
    """(grp, node_a, node_b, n_ab, n_a, n_b, n, lift) for pairs with n_ab >= ``min_count``, node_a < node_b.

    ``n`` counts a group's distinct baskets, ``n_a`` those with the item, ``n_ab``
    those with both; lift is n_ab * n / (n_a * n_b). An item in fewer than
    ``min_count`` baskets can be in no such pair and is left out, which is exact.

    Frequent items (at most ``most_heavy`` a group, each in ``heavy_share`` of its
    baskets) are counted among each other by popcounts of a bit matrix per block of
    baskets; rare ones by hashing the pairs of each basket's rare list; a frequent
    and a rare one by probing the basket's frequent list with each rare item. A
    basket with very many rare items is cut into lists. If such baskets are fewer
    than ``min_count``, a pair must also be in another basket, so only pairs found
    there are looked up in them; otherwise lists are paired with lists, in many tasks.

    Defined cases: a basket delivered again counts once with all items it was
    delivered with, an item listed twice once; null items, groups and basket ids
    are left out; null and empty lists are baskets without items; an empty table
    gives no rows; other columns are not read.
    """
    base = _baskets(df, group, basket, items)
    # delivered items are at least as many as different ones, so none of the other lists is longer than list_items
    held = base.groupBy("_gid", "_b").agg(F.sum(F.coalesce(F.size("_items"), F.lit(0))).alias("_m"))
    sizes = broadcast_checked(held.groupBy("_gid").agg(F.count("*").alias("_n")))
    big = broadcast_checked(held.where(F.col("_m") > list_items).select("_gid", "_b", F.ceil(F.col("_m") / list_items).alias("_parts")))
    rows = _exploded(base, field)
    names = _names(rows)
    marks = written(rows.select("_gid", "_b", "_id").distinct(), "marks")

    counts = marks.groupBy("_gid", "_id").agg(F.count("*").alias("_c")).where(F.col("_c") >= min_count).join(sizes, "_gid")
    dense = counts.where(F.col("_c") >= heavy_share * F.col("_n"))
    rank = Window.partitionBy("_gid").orderBy(F.desc("_c"), "_id")
    heavy = dense.withColumn("_k", F.row_number().over(rank)).where(F.col("_k") <= most_heavy).select("_id", F.lit(True).alias("_heavy"))
    counts = written(counts.join(heavy, "_id", "left").withColumn("_heavy", F.coalesce("_heavy", F.lit(False))), "counts")

    # every basket's frequent and rare items; a big basket's rare ones are cut into lists, each with all frequent ones
    marked = _with_counts(marks, counts.select("_id", "_heavy", "_n")).join(big, ["_gid", "_b"], "left")
    last = F.coalesce(F.col("_parts"), F.lit(1)).cast("int") - 1
    own = F.pmod(F.xxhash64(F.lit(1), "_id"), F.coalesce(F.col("_parts"), F.lit(1))).cast("int")
    part = F.explode(F.when(F.col("_heavy"), F.sequence(F.lit(0), last)).otherwise(F.array(own))).alias("_part")
    lists = written(
        marked.select("_gid", "_b", "_id", "_heavy", "_n", F.col("_parts").isNotNull().alias("_big"), part)
        .groupBy("_gid", "_b", "_part", "_big", "_n")
        .agg(F.collect_list(F.when(F.col("_heavy"), F.col("_id"))).alias("_ids"), F.sort_array(F.collect_list(F.when(~F.col("_heavy"), F.col("_id")))).alias("_list")),
        "lists",
    )

    blocks = F.ceil(F.col("_n") / BLOCK_BASKETS)
    hh = (
        lists.where((F.col("_part") == 0) & (F.size("_ids") > 1))
        .select("_gid", "_b", F.pmod(F.xxhash64("_b"), blocks).alias("_block"), F.explode("_ids").alias("_id"))
        .groupBy("_gid", "_block").applyInPandas(_popcounts, _PAIR)
        .groupBy("p", "q").agg(F.sum("n").alias("n_ab"))
    )
    lh = lists.select("_ids", F.explode("_list").alias("p")).select("p", F.explode("_ids").alias("q")).groupBy("p", "q").agg(F.count("*").alias("n_ab"))
    pairs = hh.unionByName(lh).where(F.col("n_ab") >= min_count).unionByName(_rare_pairs(lists, min_count))

    items_ = counts.select("_id", "_c", "_n").join(names, "_id")
    item = lambda k, x, c: items_.select(F.col("_id").alias(k), F.col("_x").alias(x), F.col("_c").alias(c), F.col("_g").alias("grp"), F.col("_n").alias("n"))
    pairs = pairs.join(item("p", "x", "cx"), "p").join(item("q", "y", "cy").drop("grp", "n"), "q")
    ordered = F.col("x") < F.col("y")
    pick = lambda a, b: F.when(ordered, F.col(a)).otherwise(F.col(b))
    out = pairs.select("grp", pick("x", "y").alias("node_a"), pick("y", "x").alias("node_b"), "n_ab", pick("cx", "cy").alias("n_a"), pick("cy", "cx").alias("n_b"), "n")
    return out.withColumn("lift", F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))


def lift_at_least(pairs: DataFrame, least: int) -> DataFrame:
    """``pairs`` whose items are together at least ``least`` times as often as chance has it, compared exactly:
    counts have up to 18 figures, products of two of them 36."""
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    return pairs.where(whole("n_ab") * whole("n") >= F.lit(least).cast("decimal(1,0)") * (whole("n_a") * whole("n_b")))


def _with_counts(marks: DataFrame, counts: DataFrame) -> DataFrame:
    """Marks of the items in ``counts``. If these are too many to broadcast they are shuffled in ``SALTS`` copies,
    as a frequent item has very many marks."""
    if small_enough(counts):
        return marks.join(F.broadcast(counts), "_id")
    salted = marks.withColumn("_salt", F.pmod(F.xxhash64("_b"), F.lit(SALTS)).cast("int"))
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1)))
    frequent = counts.where("_heavy").select("*", F.explode(copies).alias("_salt"))
    found = salted.join(frequent, ["_id", "_salt"], "left")
    rare = counts.where("NOT _heavy").select("_id", F.col("_heavy").alias("_rare"), F.col("_n").alias("_rare_n"))
    # a frequent item's marks are done; only the others go on, so that no key is hot
    done = found.where("_heavy").select("_gid", "_b", "_id", "_heavy", "_n")
    rest = found.where("_heavy IS NULL").select("_gid", "_b", "_id").join(rare, "_id")
    return done.unionByName(rest.select("_gid", "_b", "_id", F.col("_rare").alias("_heavy"), F.col("_rare_n").alias("_n")))


def _in_list(lists: DataFrame) -> DataFrame:
    left = lists.select("_list", F.posexplode("_list").alias("_i", "p"))
    return left.select("p", F.explode(F.expr("slice(_list, _i + 2, size(_list))")).alias("q"))


def _rare_pairs(lists: DataFrame, min_count: int) -> DataFrame:
    counted = lambda pairs: pairs.groupBy("p", "q").agg(F.count("*").alias("n_ab"))
    parts = lists.where(F.col("_big") & (F.size("_list") > 0)).select("_gid", "_b", "_part", "_list")
    most = parts.select("_gid", "_b").distinct().groupBy("_gid").agg(F.count("*").alias("_k")).agg(F.max("_k")).first()[0] or 0
    small = _in_list(lists.where("NOT _big"))
    if not most:
        return counted(small).where(F.col("n_ab") >= min_count)
    if most < min_count:
        found = counted(small).where(F.col("n_ab") >= min_count - most)
        within = parts.select("_gid", "_b", F.explode("_list").alias("_id"))
        more = (
            found.select("p", "q").join(within.select("_gid", "_b", F.col("_id").alias("p")), "p")
            .join(within.withColumnRenamed("_id", "q"), ["_gid", "_b", "q"]).groupBy("p", "q").agg(F.count("*").alias("_more"))
        )
        total = found.join(more, ["p", "q"], "left").withColumn("n_ab", F.col("n_ab") + F.coalesce("_more", F.lit(0)))
        return total.drop("_more").where(F.col("n_ab") >= min_count)
    # each two lists of a basket meet in a task of their own, chosen by both
    ends = parts.groupBy("_gid", "_b").agg(F.max("_part").alias("_last"))
    parts = parts.join(ends, ["_gid", "_b"])
    left = parts.where("_part < _last").select("_gid", "_b", F.col("_part").alias("_i"), F.explode(F.sequence(F.col("_part") + 1, F.col("_last"))).alias("_j"), "_list")
    right = parts.where("_part > 0").select("_gid", "_b", F.explode(F.sequence(F.lit(0), F.col("_part") - 1)).alias("_i"), F.col("_part").alias("_j"), F.col("_list").alias("_list2"))
    across = left.join(right, ["_gid", "_b", "_i", "_j"]).select(F.explode("_list").alias("_u"), "_list2").select("_u", F.explode("_list2").alias("_v"))
    across = across.select(F.least("_u", "_v").alias("p"), F.greatest("_u", "_v").alias("q"))
    return counted(small.unionByName(_in_list(parts)).unionByName(across)).where(F.col("n_ab") >= min_count)
