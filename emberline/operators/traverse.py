"""Breadth-first reads: impact analysis, neighbourhoods, bounded paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.common import checkpoint

#: Hops after which a traversal's plan is cut by a checkpoint.
CUT_EVERY = 4


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """(from, to, dir, valid_from, kind): one row per way an alive edge may be taken."""
    down = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), F.lit(0).alias("_dir"), "valid_from", "kind")
    up = edges.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), F.lit(1).alias("_dir"), "valid_from", "kind")
    return {"down": down, "up": up}.get(direction, down.unionByName(up))


def blast_radius(edges: DataFrame, alive_nodes: DataFrame, origin: str, direction: str = "down", max_depth: int = 2) -> DataFrame:
    """(node, depth, path): what is reached from ``origin`` over alive edges and nodes.

    ``edges`` and ``alive_nodes`` (name) are as of one time. The first path found
    wins: hops by the order in which their starts were found, outgoing before
    incoming, then by edge order (valid_from, kind, other end). That order is
    carried as a sortable list, so no hop needs a global numbering. Cycles end, for
    a node is reached once; the origin itself is not reported. A hop joins the
    frontier with the edges by key; the frontier is the small side.
    """
    names = alive_nodes.select(F.col("name").alias("_to")).distinct()
    steps = _steps(edges, direction).where("_from <> _to").join(names, "_to", "left_semi")
    order = F.struct(F.col("_dir"), F.col("valid_from"), F.col("kind"), F.col("_to"))
    start = alive_nodes.where(F.col("name") == origin).select("name").distinct()
    empty = F.array().cast("array<struct<_dir:int,valid_from:bigint,kind:string,_to:string>>")
    frontier = start.select(F.col("name").alias("node"), F.lit(0).alias("depth"), F.col("name").alias("path"), empty.alias("_ord"))
    seen = frontier
    for hop in range(1, max_depth + 1):
        found = frontier.join(steps, F.col("node") == F.col("_from"))
        arrow = F.when(F.col("_dir") == 0, F.concat(F.lit(" -["), F.col("kind"), F.lit("]-> "))).otherwise(F.concat(F.lit(" <["), F.col("kind"), F.lit("]- ")))
        found = found.select(
            F.col("_to").alias("node"), F.lit(hop).alias("depth"), F.concat("path", arrow, "_to").alias("path"), F.concat("_ord", F.array(order)).alias("_ord")
        )
        # the least in order for each node, combined before the shuffle
        best = found.groupBy("node").agg(F.min(F.struct("_ord", "depth", "path")).alias("_b")).select("node", "_b.depth", "_b.path", "_b._ord")
        frontier = best.join(seen.select("node"), "node", "left_anti")
        seen = seen.unionByName(frontier)
        if hop % CUT_EVERY == 0 and hop < max_depth:
            seen, frontier = checkpoint(seen), checkpoint(frontier)
    return seen.where("depth > 0").select("node", "depth", "path")


def neighborhood(edges: DataFrame, alive_nodes: DataFrame, seeds: list[str], depth: int) -> tuple[DataFrame, DataFrame]:
    """Members within ``depth`` outgoing hops of the seeds and all alive edges among them."""
    names = alive_nodes.select(F.col("name").alias("node")).distinct()
    members = names.where(F.col("node").isin(seeds))
    frontier = members
    for hop in range(1, depth + 1):
        found = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = found.join(names, "node", "left_semi").join(members, "node", "left_anti")
        members = members.unionByName(frontier)
        if hop % CUT_EVERY == 0 and hop < depth:
            members, frontier = checkpoint(members), checkpoint(frontier)
    among = edges
    for end in ("src", "dst"):
        among = among.join(members.withColumnRenamed("node", end), end, "left_semi")
    return members, among


def paths(edges: DataFrame, start: str, most_hops: int = 3, top: int = 10) -> DataFrame:
    """The ``top`` heaviest walks of 1 to ``most_hops`` edges from a node: (dep_path, hops, total_weight)."""
    e = edges.select("src", "dst", "weight")
    walk = e.where(F.col("src") == start).select(F.array("dst").alias("_nodes"), F.col("dst").alias("_at"), F.lit(1).alias("hops"), F.col("weight").alias("_w"))
    out = walk
    for hop in range(2, most_hops + 1):
        walk = walk.join(e, F.col("_at") == F.col("src")).select(
            F.concat("_nodes", F.array("dst")).alias("_nodes"), F.col("dst").alias("_at"), F.lit(hop).alias("hops"), (F.col("_w") + F.col("weight")).alias("_w")
        )
        out = out.unionByName(walk)
    text = F.concat(F.lit(start), F.lit(" > "), F.array_join("_nodes", " > "))
    return out.select(text.alias("dep_path"), "hops", F.round("_w", 6).alias("total_weight")).orderBy(F.desc("total_weight"), "dep_path").limit(top)


def graph_dump(edges: DataFrame, most: int = 500) -> DataFrame:
    """The first edges in (src, valid_from, kind, dst) order, as a picture needs them."""
    return edges.select("src", "dst", "kind", "valid_from").orderBy("src", "valid_from", "kind", "dst").limit(most)
