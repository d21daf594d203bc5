"""Filling containers of fixed capacity with documents, by vector best fit."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Containers' worth of pieces that are packed together, as each such block leaves about one container
#: part empty; and the fewest and most pieces of a block.
BLOCK_CONTAINERS, BLOCK_ITEMS, MOST_ITEMS = 256, 1024, 500_000
#: How many times the pieces, and the attention cost (sum of squared lengths), of an average full container
#: one may hold. The cost of a piece that is over that limit by itself is left out, as nothing can lower it.
DOCS_SLACK, ATTENTION_SLACK = 6.0, 2.0
#: Weights of the tokens, pieces and attention cost in the dot product that picks a container.
WEIGHTS = (1.0, 1.0, 1.0)
#: Share of the capacity from which on an item is placed by the room it leaves, as it has few places to go.
LARGE = 0.125

_OUT = "pack_id int, container string, doc_id long, piece int, first_token long, tokens long"


def best_fit(sizes: np.ndarray, capacity: int, max_items: int, attention: float, weights: Iterable[float] = WEIGHTS, costs: np.ndarray | None = None) -> np.ndarray:
    """The container of each item, largest items first.

    As many containers as the items must at least have are open from the start. Among
    those with room in every dimension an item of at least ``LARGE`` of the capacity
    goes where the least room stays free, a smaller one where the weighted dot product
    of what it takes and what is free is greatest, so that containers fill up alike in
    tokens, items and cost and small items are left for all of them; ties go to the
    oldest. Without one it opens a new container, alone in which any item is allowed.
    ``costs`` are the squares of the sizes if not given.
    """
    n = len(sizes)
    out = np.empty(n, np.int64)
    order = np.lexsort((np.arange(n), -sizes))
    squares = sizes.astype(float) ** 2 if costs is None else costs
    live = opened = int(min(n, max(1, -(-int(sizes.sum()) // capacity)))) if n else 0
    least = int(sizes.min()) if n else 0
    whole = np.array([capacity, max_items, attention], float)
    scale = np.array(list(weights)) / whole / whole
    free = np.empty((3, max(n, 1)))
    free[:, :live] = whole[:, None]
    names = np.arange(max(n, 1))
    for count, k in enumerate(order.tolist()):
        need = np.array([float(sizes[k]), 1.0, min(squares[k], attention)])
        now = free[:, :live]
        score = -now[0] if need[0] >= LARGE * capacity else (need * scale) @ now
        score[(now < need[:, None]).any(axis=0)] = -np.inf
        at = int(score.argmax()) if live else 0
        if not live or score[at] == -np.inf:
            at = live
            free[:, at], names[at] = whole, opened
            live += 1
            opened += 1
        free[:, at] -= need
        out[k] = names[at]
        if count % 512 == 511:  # containers that nothing fits into any more need no look
            keep = np.flatnonzero((free[0, :live] >= least) & (free[1, :live] >= 1))
            free[:, : len(keep)] = free[:, keep]
            names[: len(keep)] = names[keep]
            live = len(keep)
    return out


def pack(
    docs: DataFrame,
    capacities: Iterable[tuple[int, int]],
    doc_id: str = "doc_id",
    tokens: str = "tokens",
    block_items: int = BLOCK_ITEMS,
    attention_slack: float = ATTENTION_SLACK,
    docs_slack: float = DOCS_SLACK,
    block_containers: int = BLOCK_CONTAINERS,
    most_items: int = MOST_ITEMS,
) -> DataFrame:
    """(pack_id, container, doc_id, piece, first_token, tokens): where each document goes, for each (pack_id, capacity).

    Documents longer than the capacity are cut into full pieces and a rest; no
    other is cut. A container may hold no more tokens than its capacity, and no more
    pieces or attention cost than ``docs_slack`` and ``attention_slack`` times what a
    full one has on average, so that containers cost about the same to train on.
    Pieces are spread by hash over blocks of about ``block_containers`` containers,
    of ``block_items`` pieces at least and ``most_items`` at most, and packed block
    by block, largest first: no task holds more than a block whatever the data's
    shape, and the work grows with the data.

    Defined cases: a null id gives no row, null or negative tokens count as 0; an
    empty document takes a place and no room; equal sizes go by id; a repeated id is
    packed each time; a capacity that is null or below 1 is left out; an empty table
    gives no rows; other columns are not read.
    """
    packs = [(int(p), int(c)) for p, c in capacities if c is not None and c >= 1]
    base = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("_doc"), F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long").alias("_n")
    )
    sizes = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).cast("long").alias("c")) for p, c in packs]) if packs else F.expr("array(named_struct('p', 0, 'c', 0L))")
    items = base.select("_n", "_doc", F.explode(sizes).alias("_s")).where("_s.c > 0").select("_doc", "_n", "_s.*")
    last = F.greatest(F.ceil(F.col("_n") / F.col("c")).cast("int") - 1, F.lit(0))
    rest = F.col("_n") - last.cast("long") * F.col("c")
    square = last * F.col("c").cast("double") * F.col("c") + rest.cast("double") * rest
    sums = items.groupBy("p", "c").agg(F.sum(last.cast("long") + 1), F.sum("_n"), F.sum(square)).collect()  # a row per capacity
    limits = {}
    for p, c, n, tokens_, cost in sums:
        full = max(tokens_ / c, 1e-9)
        block = min(max(block_containers * n / full, block_items), most_items)
        limits[p] = (max(1, -(-n // int(block))), max(1, int(docs_slack * n / full)), attention_slack * cost / full)
    blocks = F.lit(1)
    for p, (b, _, _) in limits.items():
        blocks = F.when(F.col("p") == p, F.lit(b)).otherwise(blocks)
    pieces = items.select("*", F.explode(F.sequence(F.lit(0), last)).alias("_piece")).select(
        "p", "c", "_doc", "_piece",
        (F.col("_piece").cast("long") * F.col("c")).alias("_first"),
        F.least(F.col("c"), F.col("_n") - F.col("_piece").cast("long") * F.col("c")).alias("_size"),
        F.pmod(F.xxhash64("_doc", "_piece"), blocks).alias("_block"),
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_size", "_doc", "_piece"], ascending=[False, True, True], kind="stable")
        _, most, cost = limits[int(key[0])]
        sizes = pdf["_size"].to_numpy(np.int64)
        squares = sizes.astype(float) ** 2
        at = best_fit(sizes, int(key[1]), most, max(cost, 1.0), costs=np.where(squares > cost, 0.0, squares))
        names = [f"{key[2]}-{a}" for a in at]
        return pd.DataFrame({"pack_id": key[0], "container": names, "doc_id": pdf["_doc"].to_numpy(), "piece": pdf["_piece"].to_numpy(), "first_token": pdf["_first"].to_numpy(), "tokens": pdf["_size"].to_numpy()})

    return pieces.groupBy("p", "c", "_block").applyInPandas(run, _OUT)


def fill_report(packed: DataFrame, capacities: Iterable[tuple[int, int]]) -> DataFrame:
    """Per pack: containers, pieces, tokens, fewest containers possible, the share of room used, and how far the
    fullest containers are from the average in pieces and in attention cost."""
    square = F.sum(F.col("tokens").cast("double") * F.col("tokens"))
    per = packed.groupBy("pack_id", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"), square.alias("a"))
    total = per.groupBy("pack_id").agg(
        F.count("*").alias("n_containers"), F.sum("k").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.max("t").alias("max_tokens"),
        F.round(F.max("k") / F.avg("k"), 3).alias("max_pieces_to_mean"), F.round(F.max("a") / F.avg("a"), 3).alias("max_cost_to_mean"),
    )
    size = F.lit(None).cast("long")
    for p, c in capacities:
        size = F.when(F.col("pack_id") == p, F.lit(c).cast("long")).otherwise(size)
    total = total.withColumn("capacity_tokens", size)
    return total.select(
        "pack_id", "capacity_tokens", "n_containers", "n_pieces", "n_tokens", "max_tokens",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("fewest_containers"),
        F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill"),
        "max_pieces_to_mean", "max_cost_to_mean",
    )


def broken_rules(packed: DataFrame, docs: DataFrame, capacities: Iterable[tuple[int, int]], doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """Per pack what a packing must keep: (pack_id, n_docs, lost_docs, lost_tokens, over_capacity, needless_cuts,
    pieces_apart). All but the first two are 0: each document of ``docs``, ids of which differ, has all its
    tokens placed once and in order, no container is over its capacity, and only longer documents are cut."""
    size = F.lit(None).cast("long")
    for p, c in capacities:
        size = F.when(F.col("pack_id") == p, F.lit(c).cast("long")).otherwise(size)
    over = packed.groupBy("pack_id", "container").agg(F.sum("tokens").alias("t")).groupBy("pack_id").agg(F.count(F.when(F.col("t") > size, 1)).alias("over_capacity"))
    per = packed.groupBy("pack_id", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"), F.max(F.col("first_token") + F.col("tokens")).alias("e"), F.count_distinct("piece").alias("d"))
    want = docs.select(F.col(doc_id).alias("doc_id"), F.col(tokens).alias("_n"))
    both = per.join(want, "doc_id", "left")
    needed = F.greatest(F.ceil(F.col("_n") / size), F.lit(1))
    wrong = lambda test: F.count(F.when(test, 1))
    checks = both.groupBy("pack_id").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("_n") - F.col("t")).alias("lost_tokens"), wrong(F.col("k") > needed).alias("needless_cuts"),
        wrong((F.col("e") != F.col("t")) | (F.col("d") != F.col("k"))).alias("pieces_apart"), wrong(F.col("_n").isNull()).alias("_strange"),
    )
    total = want.where("doc_id IS NOT NULL").agg(F.count("*").alias("_all"))
    out = checks.join(over, "pack_id").join(F.broadcast(total))  # one row
    return out.select("pack_id", "n_docs", (F.col("_all") - F.col("n_docs") + F.col("_strange")).alias("lost_docs"), "lost_tokens", "over_capacity", "needless_cuts", "pieces_apart")
