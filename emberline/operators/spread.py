"""Weighted spreading activation, batched over many queries in one plan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.common import fold_in_order
from emberline.config import Config
from emberline.functions.weights import alive, decay_rate, effective, trust

EDGE = ["src", "dst", "kind", "valid_from"]


def weighted_edges(edges: DataFrame, t: int, config: Config, scale: float = 1.0, dead: bool = False) -> DataFrame:
    """Edges alive at ``t`` with ``w``, their decayed and trusted weight, and ``mass``, their source's sum of it.

    ``edges`` has src, dst, kind, valid_from, valid_to, weight, t_last, origin, and
    dead if ``dead``. A null weight is one never learned: ``w0``. An edge of an
    untrusted origin weighs nothing. The sum per source is combined before its
    shuffle and joined back by source, so a source with very many edges is summed
    in many tasks.
    """
    c = config
    rate = decay_rate("kind", c.lambda_base, c.beta, c.authority_by_kind, c.authority_default)
    live = edges.where(alive("valid_from", "valid_to", t)).withColumn("weight", F.coalesce("weight", F.lit(c.w0)))
    w = F.greatest(effective("weight", "t_last", rate, t, scale, F.col("dead") if dead else None) * trust("origin", c.trust_by_origin), F.lit(0.0))
    live = live.select(*EDGE, w.alias("w"))
    mass = live.groupBy("src").agg(F.sum("w").alias("mass")).where("mass > 0")
    return live.join(mass, "src")


@dataclass
class Spread:
    """What a batch of retrievals gives: activation (query, node, act), fired edges
    (query, hop, edge, delta), incoming (query, node, incoming)."""

    activation: DataFrame
    fired: DataFrame
    incoming: DataFrame

    def mass(self) -> DataFrame:
        return self.fired.groupBy("query").agg(F.sum("delta").alias("mass"))

    def top(self, k: int) -> DataFrame:
        """The ``k`` most activated nodes of each query; ties by name."""
        w = Window.partitionBy("query").orderBy(F.desc("act"), "node")
        return self.activation.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def spread(edges: DataFrame, alive_nodes: DataFrame, seeds: DataFrame, config: Config, depth: int | None = None, fan: float | None = None) -> Spread:
    """Spread activation from ``seeds`` (query, node) over :func:`weighted_edges`.

    Per hop a frontier node passes ``act * fan * M / (1 + M)`` on, split by weight
    (M: its source's mass), where a share is above the least activation. A node
    spreads once, after its first activation, with what it had at the hop's start.
    Seeds that are no alive nodes are dropped; one named twice fires twice; seeds
    start at 1 and are ranked too. All queries advance together: a hop is one join
    by source and one sum by (query, node).
    """
    depth = config.depth if depth is None else depth
    fan = config.fan if fan is None else fan
    seeds = seeds.join(alive_nodes.select(F.col("name").alias("node")).distinct(), "node", "left_semi")
    activation = seeds.distinct().withColumn("act", F.lit(1.0))
    frontier = seeds.withColumn("act", F.lit(1.0))
    fired_all = None
    for hop in range(1, depth + 1):
        outflow = F.col("act") * F.lit(fan) * F.col("mass") / (1 + F.col("mass"))
        fired = (
            frontier.join(edges, F.col("node") == F.col("src"))
            .select("query", F.lit(hop).alias("hop"), *EDGE, (outflow * (F.col("w") / F.col("mass"))).alias("delta"))
            .where(F.col("delta") > F.lit(config.activation_epsilon))
        )
        fired_all = fired if fired_all is None else fired_all.unionByName(fired)
        gained = fired.groupBy("query", F.col("dst").alias("node")).agg(F.sum("delta").alias("act"))
        if hop < depth:
            frontier = gained.join(activation.select("query", "node"), ["query", "node"], "left_anti")
        activation = activation.unionByName(gained).groupBy("query", "node").agg(F.sum("act").alias("act"))
    if fired_all is None:
        fired_all = edges.select(F.lit("").alias("query"), F.lit(0).alias("hop"), *EDGE, F.col("w").alias("delta")).limit(0)
    incoming = fired_all.groupBy("query", F.col("dst").alias("node")).agg(F.sum("delta").alias("incoming"))
    return Spread(activation, fired_all, incoming)


def has_order_dependence(edges: DataFrame, alive_nodes: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(query, hop): hops in which one frontier node has an edge to another, where the result of processing
    nodes one after the other may differ from :func:`spread`; self-loops are included."""
    frontier = seeds.join(alive_nodes.select(F.col("name").alias("node")).distinct(), "node", "left_semi").distinct()
    reached, out = frontier, None
    for hop in range(1, depth + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select("query", F.col("dst").alias("node")).distinct()
        inside = step.join(frontier, ["query", "node"], "left_semi").select("query", F.lit(hop).alias("hop")).distinct()
        out = inside if out is None else out.unionByName(inside)
        frontier = step.join(reached, ["query", "node"], "left_anti")
        reached = reached.unionByName(frontier)
    return out


def sequential_spread(edges: DataFrame, seeds: DataFrame, config: Config, depth: int | None = None, fan: float | None = None) -> DataFrame:
    """(query, node, act) with nodes processed one after the other, as a single-threaded engine would.

    Each query's bounded neighbourhood is pulled by joins on edges only and
    replayed by one kernel per query, nodes in seed and edge order.
    ``seeds`` has (query, pos, node).
    """
    depth = config.depth if depth is None else depth
    fan = config.fan if fan is None else fan
    reach = seeds.select("query", "node").distinct()
    frontier, pulled = reach, None
    for _ in range(depth):
        step = frontier.join(edges, F.col("node") == F.col("src")).select("query", *EDGE, "w", "mass")
        pulled = step if pulled is None else pulled.unionByName(step)
        frontier = step.select("query", F.col("dst").alias("node")).distinct().join(reach, ["query", "node"], "left_anti")
        reach = reach.unionByName(frontier)
    columns = ["query", "pos", *EDGE, "w", "mass"]
    null = {"src": "string", "dst": "string", "kind": "string", "valid_from": "long", "w": "double", "mass": "double"}
    seed_rows = seeds.select("query", F.col("pos").cast("long").alias("pos"), F.col("node").alias("src"), *[F.lit(None).cast(t).alias(c) for c, t in null.items() if c != "src"])
    rows = pulled.withColumn("pos", F.lit(-1).cast("long")).select(*columns).unionByName(seed_rows.select(*columns))
    epsilon = config.activation_epsilon

    def replay(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        named = pdf[pdf["pos"] >= 0].sort_values("pos")["src"].tolist()
        arcs = pdf[pdf["pos"] < 0].drop_duplicates(EDGE).sort_values(["valid_from", "src", "dst", "kind"])
        out: dict[str, list] = {}
        for src, dst, w, mass in zip(arcs["src"], arcs["dst"], arcs["w"], arcs["mass"]):
            out.setdefault(src, []).append((dst, w, mass))
        act = dict.fromkeys(named, 1.0)
        front = named
        for _ in range(depth):
            following = []
            for u in front:
                had = act[u]  # what its own loops add counts from its next turn on
                for dst, w, mass in out.get(u, ()):
                    delta = had * fan * mass / (1 + mass) * (w / mass)
                    if delta > epsilon:
                        if act.get(dst, 0.0) == 0.0:
                            following.append(dst)
                        act[dst] = act.get(dst, 0.0) + delta
            front = following
        return pd.DataFrame({"query": key[0], "node": list(act), "act": list(act.values())})

    return rows.groupBy("query").applyInPandas(replay, "query string, node string, act double")


def homeostat(masses: Iterator[float], config: Config, integral: float = 0.0, ewma: float | None = None) -> list[tuple[float, float, float]]:
    """(ewma, integral, scale) after each retrieval's mass, in order: an integral controller with clamps."""
    c, out = config, []
    for mass in masses:
        ewma = mass if ewma is None else c.ewma_beta * ewma + (1 - c.ewma_beta) * mass
        integral = min(max(integral + ewma - c.setpoint, c.integral_min), c.integral_max)
        out.append((ewma, integral, min(max(1 + c.k_i * integral, c.scale_min), c.scale_max)))
    return out


def homeostat_series(df: DataFrame, group: str, order: list[str], mass: str, config: Config) -> DataFrame:
    """(group, n, ewma, integral, lambda_scale) after all of a group's masses: the clamped fold has no closed
    form, so a group's masses are streamed in order; groups are independent. A null mass stops the state: it is left out."""

    def step(state: tuple, masses: list[float]) -> tuple:
        return homeostat(masses, config, state[1], state[0])[-1]

    rows = df.where(F.col(mass).isNotNull()).withColumn("_m", F.col(mass).cast("double"))
    return fold_in_order(rows, [group], order, ["_m"], (None, 0.0, 1.0), step, "ewma double, integral double, lambda_scale double")
