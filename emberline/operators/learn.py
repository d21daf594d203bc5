"""Reinforcement of edges: touches, credit modes, credit assignment along fired edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.common import in_chunks
from emberline.config import Config
from emberline.operators.spread import EDGE, Spread


def clipped(r: str | Column, config: Config) -> Column:
    r = F.col(r) if isinstance(r, str) else r
    return F.least(F.greatest(r, F.lit(-config.r_clip)), F.lit(config.r_clip))


def touch_linear(events: DataFrame, key: str, t: str, r: str, w0: float, t0: int | str, rate: float, config: Config) -> DataFrame:
    """(key, n, w, t_last) after all touches of a key, when no R is negative: the fold is then a sum
    of decayed parts, aggregated map-side. Touches before ``t0`` or out of order are not for this form."""
    e = events.where(F.col(r).isNotNull() & ~F.isnan(F.col(r).cast("double")))
    last = e.groupBy(key).agg(F.max(t).alias("t_last"), F.min(t).alias("_first"), F.count("*").alias("n"))
    part = F.lit(config.alpha) * clipped(r, config) * F.exp(-F.lit(rate) * (F.col("t_last") - F.col(t)) / 1000)
    joined = e.join(last, key)
    start = F.col("_first") if isinstance(t0, str) else F.lit(t0)
    base = F.lit(w0) * F.exp(-F.lit(rate) * (F.col("t_last") - start) / 1000)
    return joined.groupBy(key, "n", "t_last", "_first").agg(F.sum(part).alias("_s")).select(key, "n", (base + F.col("_s")).alias("w"), "t_last")


#: Touches of a key that are folded in one row.
FOLD_ROWS = 4096


def touch_fold(events: DataFrame, key: str, order: list[str], t: str, r: str, w0: float, rate: float, config: Config, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(key, n, w, t_last): each touch in order decays the weight to its time, adds alpha times the
    clipped R and stops at 0. Time never runs backwards for decay, but the last time is taken as it comes.

    What a run of touches makes of a weight w is the greater of a c and a w + b, and so is what two runs make of it
    one after the other. A key's touches are cut into runs of ``fold_rows`` in order, each run is folded to its
    (a, b, c), and these few are folded per key."""
    e = events.where(F.col(key).isNotNull() & F.col(r).isNotNull() & ~F.isnan(F.col(r).cast("double"))).select(key, *dict.fromkeys([*order, t]), F.col(r).cast("double").alias("r_"))
    shape = "struct<a:double,b:double,c:double,first:bigint,t:bigint>"
    none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("-inf")).alias("c"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("t")).cast(shape)
    decay = lambda since, now: F.exp(-F.lit(rate) * F.greatest(now - F.coalesce(since, now), F.lit(0)) / 1000)

    def step(acc, x):
        d, add = decay(acc["t"], x["t_"]), F.lit(config.alpha) * clipped(x["r_"], config)
        return F.struct((acc["a"] * d).alias("a"), (acc["b"] * d + add).alias("b"), F.greatest(acc["c"] * d + add, F.lit(0.0)).alias("c"), F.coalesce(acc["first"], x["t_"]).alias("first"), x["t_"].alias("t")).cast(shape)

    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(t).cast("long").alias("t_"), "r_")))
    runs = in_chunks(e, [key], order, fold_rows).groupBy(key, "_range", "_chunk").agg(F.count("*").alias("n"), F.aggregate(rows, none, step).alias("_f"))

    def join(acc, x):
        w = acc["w"] * decay(acc["t"], x["_f"]["first"])
        return F.struct(F.greatest(x["_f"]["c"], x["_f"]["a"] * w + x["_f"]["b"]).alias("w"), x["_f"]["t"].alias("t")).cast("struct<w:double,t:bigint>")

    start = F.struct(F.lit(float(w0)).alias("w"), F.lit(None).cast("long").alias("t")).cast("struct<w:double,t:bigint>")
    in_turn = F.array_sort(F.collect_list(F.struct("_range", "_chunk", "_f")))
    return runs.groupBy(key).agg(F.sum("n").alias("n"), F.aggregate(in_turn, start, join).alias("_s")).select(key, "n", F.col("_s.w").alias("w"), F.col("_s.t").alias("t_last"))


# -- credit modes: each gives (query, node, cred) ----------------------------------


def credit_nodes(scores: DataFrame, known: DataFrame) -> DataFrame:
    """Explicit scores (query, node, score), summed per node; unknown names ignored."""
    named = scores.join(known.select(F.col("name").alias("node")).distinct(), "node", "left_semi")
    return named.groupBy("query", "node").agg(F.sum("score").alias("cred"))


def credit_uniform(surfaced: DataFrame, reward: float) -> DataFrame:
    """An episode's reward in equal parts over what surfaced."""
    n = F.count("*").over(Window.partitionBy("query"))
    return surfaced.select("query", "node", (F.lit(reward) / n).alias("cred"))


def credit_by_activation(surfaced: DataFrame, reward: float) -> DataFrame:
    """An episode's reward in parts by activation."""
    total = F.sum("act").over(Window.partitionBy("query"))
    return surfaced.select("query", "node", (F.lit(reward) * F.col("act") / total).alias("cred"))


def miss_penalty(credit: DataFrame, surfaced: DataFrame, penalty: float) -> DataFrame:
    """Surfaced nodes without credit get ``-penalty``, if that is positive."""
    if penalty <= 0:
        return credit
    none = surfaced.select("query", "node").join(credit.where("cred <> 0"), ["query", "node"], "left_anti")
    return credit.where("cred <> 0").unionByName(none.select("query", "node", F.lit(-penalty).alias("cred")))


def assign_credit(result: Spread, credit: DataFrame, depth: int, config: Config) -> tuple[DataFrame, DataFrame]:
    """R per (query, edge) and the final credit per (query, node).

    From the last hop back, a fired edge gets its target's credit times its share of
    what came in there; its source gets gamma times that. Credit is read as it was
    at the hop's start; one join and one sum per hop.
    """
    cred, r_all = credit, None
    for hop in range(depth, 0, -1):
        fired = result.fired.where(F.col("hop") == hop)
        hit = fired.join(cred.where("cred <> 0").select("query", F.col("node").alias("dst"), "cred"), ["query", "dst"])
        hit = hit.join(result.incoming.select("query", F.col("node").alias("dst"), "incoming"), ["query", "dst"]).where("incoming > 0")
        r = hit.select("query", *EDGE, (F.col("cred") * (F.col("delta") / F.col("incoming"))).alias("r"))
        r_all = r if r_all is None else r_all.unionByName(r)
        back = r.groupBy("query", F.col("src").alias("node")).agg((F.lit(config.feedback_gamma) * F.sum("r")).alias("cred"))
        cred = cred.unionByName(back).groupBy("query", "node").agg(F.sum("cred").alias("cred"))
    return r_all.groupBy("query", *EDGE).agg(F.sum("r").alias("r")), cred


def feedback_report(r: DataFrame, cred: DataFrame) -> DataFrame:
    """(query, edges_reinforced, total_positive_r, total_negative_r, hits, misses) as of after propagation."""
    edges = r.groupBy("query").agg(
        F.count("*").alias("edges_reinforced"),
        F.sum(F.when(F.col("r") >= 0, F.col("r")).otherwise(0.0)).alias("total_positive_r"),
        F.sum(F.when(F.col("r") < 0, F.col("r")).otherwise(0.0)).alias("total_negative_r"),
    )
    nodes = cred.groupBy("query").agg(F.count_if(F.col("cred") > 0).alias("hits"), F.count_if(F.col("cred") < 0).alias("misses"))
    return edges.join(nodes, "query", "full").na.fill(0)


def apply_touches(edges: DataFrame, r: DataFrame, weight: Column, t: int, config: Config) -> DataFrame:
    """Edges with their new weight and time: those with an R are decayed to ``t`` (``weight``) and moved by it."""
    moved = F.greatest(weight + F.lit(config.alpha) * clipped("r", config), F.lit(0.0))
    joined = edges.join(r.select(*EDGE, "r"), EDGE, "left")
    hit = F.col("r").isNotNull() & ~F.isnan("r")
    columns = [c for c in edges.columns if c not in ("weight", "t_last")]
    return joined.select(*columns, F.when(hit, moved).otherwise(F.col("weight")).alias("weight"), F.when(hit, F.lit(t)).otherwise(F.col("t_last")).alias("t_last"))


def rag_citation_credit(cited: DataFrame, surfaced: DataFrame, hit: float = 1.0) -> DataFrame:
    """Cited results (query, node) that did surface, each with the credit of a hit."""
    return cited.distinct().join(surfaced.select("query", "node"), ["query", "node"], "left_semi").withColumn("cred", F.lit(hit))


def outcome_credit(surfaced: DataFrame, success: bool, good: float = 1.0, bad: float = -0.25) -> DataFrame:
    """A task's outcome as an episodic reward."""
    return credit_uniform(surfaced, good if success else bad)


def click_credit(clicked: DataFrame, skipped: DataFrame) -> DataFrame:
    """Preference: +1 for what was chosen, -1 for what was passed over."""
    both = clicked.select("query", "node", F.lit(1.0).alias("cred")).unionByName(skipped.select("query", "node", F.lit(-1.0).alias("cred")))
    return both.groupBy("query", "node").agg(F.sum("cred").alias("cred"))
