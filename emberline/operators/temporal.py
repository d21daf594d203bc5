"""Temporal graph: versions and intervals out of operations, reads as of a time, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.common import T_MAX
from emberline.functions.keys import canonical
from emberline.functions.weights import alive


def fold_node_versions(ops: DataFrame, key: str, order: list[str], kind: str, state: str, ts: str, same: Column | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, seq, observed_at, retired_at, state, extra) out of ordered operations of a node.

    ``kind`` is 'observe', 'placeholder' or 'retire'. An observation opens a version
    unless the open one has the same state, or the same value of ``same`` if that is
    given; ``extra`` are columns of the one that opens it; a placeholder opens one with state
    'null' only if none is open; a retirement closes the open one. Order decides,
    times only stamp. One window pass per key; keys are spread by hash.

    Defined cases: a null key is left out; a null state is a state like others;
    operations that change nothing leave no trace.
    """
    w = Window.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    label = F.when(F.col(kind) == "retire", F.lit("C")).when(F.col(kind) == "observe", F.concat(F.lit("V"), F.coalesce(F.col(state) if same is None else same, F.lit("null"))))
    rows = ops.where(F.col(key).isNotNull()).withColumn("_label", label)
    rows = rows.withColumn("_was", F.last("_label", ignorenulls=True).over(before))
    # a placeholder while nothing is open opens a version; while one is open it does nothing
    opens = (F.col(kind) == "placeholder") & F.coalesce(F.col("_was") == "C", F.lit(True))
    rows = rows.withColumn("_label", F.when(opens, "Vnull").otherwise(F.col("_label"))).where("_label IS NOT NULL")
    rows = rows.withColumn("_prev", F.lag("_label").over(w)).where("_prev IS NULL OR _prev <> _label")
    rows = rows.withColumn("_next_ts", F.lead(ts).over(w)).where("_label <> 'C'")
    return rows.select(
        key,
        F.row_number().over(w).alias("seq"),
        F.col(ts).alias("observed_at"),
        F.coalesce("_next_ts", F.lit(T_MAX)).alias("retired_at"),
        F.when(F.col(kind) == "placeholder", "null").otherwise(F.coalesce(F.col(state), F.lit("null"))).alias("state"),
        *extra,
    )


def fold_edge_intervals(events: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column, ts: str, extra: list[str] | None = None) -> DataFrame:
    """(keys, valid_from, valid_to, extra) out of ordered open and close events of an edge.

    An observation while the interval is open changes nothing, so the first one's
    time and ``extra`` stay. Segments between closings are the islands.
    """
    extra = extra or []
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = events.withColumn("_o", opens).withColumn("_c", closes)
    rows = rows.withColumn("_seg", F.sum(F.when(F.col("_c"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_seg", F.coalesce("_seg", F.lit(0)))
    by = F.struct(*order)
    first = lambda c: F.min_by(F.when(F.col("_o"), F.col(c)), F.when(F.col("_o"), by))
    out = rows.groupBy(*keys, "_seg").agg(
        F.count(F.when(F.col("_o"), 1)).alias("_n"),
        first(ts).alias("valid_from"),
        F.max(F.when(F.col("_c"), F.col(ts))).alias("_end"),
        *[first(c).alias(c) for c in extra],
    )
    return out.where("_n > 0").select(*keys, "valid_from", F.coalesce("_end", F.lit(T_MAX)).alias("valid_to"), *extra)


def versions_at(versions: DataFrame, t: int, key: str = "name") -> DataFrame:
    """The version of each node alive at ``t``; of several, the one observed last."""
    live = versions.where(alive("observed_at", "retired_at", t) & F.col(key).isNotNull())
    columns = [c for c in versions.columns if c != key]
    return live.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("observed_at", "retired_at", "props")).alias("_v")).select(key, "_v.*")


def edges_at(edges: DataFrame, t: int) -> DataFrame:
    return edges.where(alive("valid_from", "valid_to", t))


def diff_nodes(versions: DataFrame, t1: int, t2: int) -> DataFrame:
    """(name, change): real nodes 'added', 'removed' or 'changed' (other props) between two times, in one pass."""
    at = lambda t: alive("observed_at", "retired_at", t)
    props = F.coalesce("props", F.lit("null"))
    latest = lambda t: F.max_by(F.when(at(t), props), F.when(at(t), F.struct("observed_at", "retired_at", "props")))
    rows = versions.where("NOT placeholder").groupBy("name").agg(latest(t1).alias("_a"), latest(t2).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    differ = ~F.col("_a").eqNullSafe(F.col("_b")) & ~canonical("_a").eqNullSafe(canonical("_b"))
    return rows.where("_a IS NOT NULL OR _b IS NOT NULL").where(differ).select("name", change.alias("change"))


def rendered(src: str = "src", kind: str = "kind", dst: str = "dst") -> Column:
    return F.concat(F.col(src), F.lit(" -["), F.col(kind), F.lit("]-> "), F.col(dst))


def diff_edges(edges: DataFrame, t1: int, t2: int) -> DataFrame:
    """(edge, change): edges alive at one of two times only, as text."""
    a, b = alive("valid_from", "valid_to", t1), alive("valid_from", "valid_to", t2)
    per = edges.groupBy("src", "kind", "dst").agg(F.max(a).alias("_a"), F.max(b).alias("_b")).where("_a <> _b")
    return per.select(rendered().alias("edge"), F.when(F.col("_b"), "added").otherwise("removed").alias("change"))


def stale_nodes(versions: DataFrame, asserted: DataFrame, t: int) -> DataFrame:
    """Names alive at ``t``, real, and not asserted by a full snapshot."""
    live = versions.where(alive("observed_at", "retired_at", t) & ~F.col("placeholder")).select("name").distinct()
    return live.join(asserted.select("name").where("name IS NOT NULL").distinct(), "name", "left_anti")


def stale_edges(edges: DataFrame, batch_edges: DataFrame, observed: DataFrame, t: int) -> DataFrame:
    """Open edges of sources the snapshot observed that it asserts no more."""
    live = edges.where(alive("valid_from", "valid_to", t)).select("src", "dst", "kind").distinct()
    again = live.join(observed.select(F.col("name").alias("src")).where("src IS NOT NULL").distinct(), "src", "left_semi")
    return again.join(batch_edges.select("src", "dst", "kind").distinct(), ["src", "dst", "kind"], "left_anti")


def open_state(versions: DataFrame, edges: DataFrame) -> DataFrame:
    """Operations that rebuild the open state with its original times: (op, name, src, dst, kind, ts, origin)."""
    still = lambda c: F.coalesce(F.col(c), F.lit(T_MAX)) == T_MAX
    null = F.lit(None).cast("string")
    op = F.when(F.col("placeholder"), "observe_placeholder").otherwise("observe_node")
    nodes = versions.where(still("retired_at")).select(op.alias("op"), "name", null.alias("src"), null.alias("dst"), null.alias("kind"), F.col("observed_at").alias("ts"), "origin")
    arcs = edges.where(still("valid_to")).select(F.lit("observe_edge").alias("op"), null.alias("name"), "src", "dst", "kind", F.col("valid_from").alias("ts"), "origin")
    return nodes.unionByName(arcs).distinct()


def purge(versions: DataFrame, edges: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Open nodes and open edges that stay when all from origins with ``prefix`` go:
    nodes whose open version is from there, edges from there, edges that touch such a node."""
    if not prefix:
        raise ValueError("an empty prefix would match everything")
    still = lambda c: F.coalesce(F.col(c), F.lit(T_MAX)) == T_MAX
    theirs = F.coalesce(F.col("origin").startswith(prefix), F.lit(False))
    open_nodes = versions.where(still("retired_at"))
    gone = open_nodes.where(theirs).select("name").distinct()
    kept_nodes = open_nodes.join(gone, "name", "left_anti")
    kept = edges.where(still("valid_to") & ~theirs)
    for end in ("src", "dst"):
        kept = kept.join(gone.withColumnRenamed("name", end), end, "left_anti")
    return kept_nodes, kept


def byte_estimate(versions: DataFrame, edges: DataFrame, tokens: Column) -> DataFrame:
    """(part, n, bytes): a structural estimate of memory for nodes, tokens, versions and edges."""
    # fixed values: bytes of a node, a token, a version, an edge and its learned state
    node, token, version, edge, learned = 160, 28, 72, 104, 33
    names = versions.select("name").distinct()
    nodes = names.agg(F.count("*").alias("n"), F.sum(node + 2 * F.octet_length("name")).alias("bytes"))
    parts = names.select(F.explode(F.array_distinct(tokens)).alias("t")).agg(F.count("*").alias("n"), F.sum(token + F.octet_length("t")).alias("bytes"))
    vers = versions.agg(F.count("*").alias("n"), F.sum(version + F.coalesce(F.octet_length("props"), F.lit(4))).alias("bytes"))
    arcs = edges.agg(F.count("*").alias("n"), (F.count("*") * (edge + learned)).alias("bytes"))
    out = None
    for part, df in (("nodes", nodes), ("tokens", parts), ("versions", vers), ("edges", arcs)):
        df = df.select(F.lit(part).alias("part"), "n", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
        out = df if out is None else out.unionByName(df)
    return out
