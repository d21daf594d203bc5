"""Queries of the temporal graph and its learned layer over the project's tables, each with its SQL.

The graph is the last export in ``edges`` with the rows that count, and the
versions in ``nodes``. Learned weights are the exported ones, last touched when
the edge began.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.common import T_MAX, fold_in_order, load, real_edges
from emberline.config import Config
from emberline.functions.weights import alive, decay_rate, effective, millis, name_tokens, trust
from emberline.operators import learn, maintain, match, snapshots, spread, temporal, traverse
from emberline.sources import stores

KEY = ["src", "dst", "kind", "valid_from"]
T1, T2 = 1_715_000_000_000, 1_735_000_000_000
HUB, SINK, PREFIX = "svc/identity-broker", "queue/main-intake", "user:op-1"
SEEDS = [("a", "svc/identity-broker"), ("b", "cache/session-ring"), ("b", "svc/config-hub")]
CONFIG = Config(
    lambda_base=2e-8,
    authority_by_kind={"CONTAINS": 9.0, "RUNS_ON": 3.0},
    trust_by_origin={"agent": 0.5, "user:op-1": 0.25, "user:op-13": 0.0, "feed:assets": 0.8},
    functional_kinds=["RUNS_ON", "PLACED_IN"],
    theta=0.12,
    sleep_theta=0.15,
)


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the last export: (src, dst, kind, valid_from, valid_to, weight, origin, t_last)."""
    edges = real_edges(load(spark, sf_dir, "edges"))
    last = edges.agg(F.max("exported_at")).first()[0]
    rows = snapshots.latest_rows(edges.where(F.col("exported_at") == F.lit(last)), KEY, ["valid_to", "weight", "origin"], "loaded_at")
    return rows.withColumn("valid_to", F.coalesce("valid_to", F.lit(T_MAX))).withColumn("t_last", F.col("valid_from"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nodes").drop("node_id").distinct()


def names_at(spark: SparkSession, sf_dir: str, t: int) -> DataFrame:
    return versions(spark, sf_dir).where(alive("observed_at", "retired_at", t)).select("name").distinct()


# -- temporal reads ------------------------------------------------------------


def asof_nodes(spark, sf_dir):
    return temporal.versions_at(versions(spark, sf_dir), T2).select("name", "placeholder", "observed_at", "props")


def asof_edges(spark, sf_dir):
    return temporal.edges_at(graph(spark, sf_dir), T1).select(*KEY, F.coalesce("origin", F.lit("")).alias("origin"))


def diff_nodes(spark, sf_dir):
    return temporal.diff_nodes(versions(spark, sf_dir), T1, T2)


def diff_edges(spark, sf_dir):
    return temporal.diff_edges(graph(spark, sf_dir), T1, T2)


def open_edge_lookup(spark, sf_dir):
    """Open intervals of each (src, dst, kind): how many, since when."""
    open_ = graph(spark, sf_dir).where(F.col("valid_to") == T_MAX)
    return open_.groupBy("src", "dst", "kind").agg(F.count("*").alias("n_open"), F.min("valid_from").alias("since"))


def _blast(direction, depth, origin=HUB):
    def query(spark, sf_dir):
        edges = temporal.edges_at(graph(spark, sf_dir), T2)
        return traverse.blast_radius(edges, names_at(spark, sf_dir, T2), origin, direction, depth)

    query.__name__ = f"blast_radius_{direction}"
    return query


blast_radius_down, blast_radius_up, blast_radius_both = _blast("down", 2), _blast("up", 2, SINK), _blast("both", 1)


def neighborhood_edges(spark, sf_dir):
    edges = temporal.edges_at(graph(spark, sf_dir), T2).select(*KEY)
    return traverse.neighborhood(edges, names_at(spark, sf_dir, T2), [HUB], 2)[1]


def graph_dump(spark, sf_dir):
    return traverse.graph_dump(graph(spark, sf_dir))


# -- learned weights -------------------------------------------------------------


def effective_weight(spark, sf_dir):
    c = CONFIG
    rate = decay_rate("kind", c.lambda_base, c.beta, c.authority_by_kind, c.authority_default)
    w = effective("w", "t_last", rate, T2)
    return graph(spark, sf_dir).withColumn("w", F.coalesce("weight", F.lit(c.w0))).select(*KEY, F.round(w, 6).alias("eff"))


def trust_mask(spark, sf_dir):
    rows = graph(spark, sf_dir).withColumn("trust", trust("origin", CONFIG.trust_by_origin))
    return rows.groupBy(F.coalesce("origin", F.lit("")).alias("origin"), "trust").agg(F.count("*").alias("n_edges"))


def _spread(spark, sf_dir, depth=2):
    edges = spread.weighted_edges(graph(spark, sf_dir), T2, CONFIG)
    seeds = spark.createDataFrame(SEEDS, "query string, node string")
    return spread.spread(edges, names_at(spark, sf_dir, T2), seeds, CONFIG, depth=depth)


def spread_activation(spark, sf_dir):
    return _spread(spark, sf_dir).activation.select("query", "node", F.round("act", 6).alias("act"))


def spread_three_hop_topk(spark, sf_dir):
    top = _spread(spark, sf_dir, 3).top(20)
    return top.select("query", "rank", "node", F.round("act", 6).alias("act"))


def spread_trace_fired(spark, sf_dir):
    return _spread(spark, sf_dir).fired.select("query", "hop", *KEY, F.round("delta", 6).alias("delta"))


def spread_mass(spark, sf_dir):
    return _spread(spark, sf_dir).mass().select("query", F.round("mass", 6).alias("mass"))


def trace_explain(spark, sf_dir):
    """Fired edges as text with what they passed on."""
    return _spread(spark, sf_dir, 1).fired.select("query", temporal.rendered().alias("edge"), "valid_from", F.round("delta", 6).alias("delta"))


def salience_stats(spark, sf_dir):
    s = maintain.stats(maintain.with_state(graph(spark, sf_dir), CONFIG))
    return s.select("edges_total", "edges_live", "edges_dead", "nodes", *[F.round(c, 6).alias(c) for c in ("weight_min", "weight_max", "weight_mean")])


def consolidate(spark, sf_dir):
    return maintain.consolidate(graph(spark, sf_dir), T2, CONFIG).select(*KEY, F.round("weight", 6).alias("weight"), "dead")


def consolidate_counts(spark, sf_dir):
    edges = graph(spark, sf_dir)
    return maintain.consolidation_counts(edges, maintain.consolidate(edges, T2, CONFIG))


def conflicts_functional(spark, sf_dir):
    state = maintain.consolidate(graph(spark, sf_dir), T2, CONFIG)
    return maintain.conflicts(state, CONFIG.functional_kinds).groupBy("src", "kind").agg(F.count("*").alias("n_superseded"))


def sleep(spark, sf_dir):
    state, _ = maintain.sleep(graph(spark, sf_dir), T2, CONFIG)
    return state.select(*KEY, F.round("weight", 6).alias("weight"), "dead", "protected")


def sleep_report(spark, sf_dir):
    edges = graph(spark, sf_dir)
    state, _ = maintain.sleep(edges, T2, CONFIG)
    r = maintain.sleep_report(maintain.materialised(maintain.with_state(edges, CONFIG), T2, CONFIG), state)
    return r.select(*r.columns[:5], *[F.round(c, 6).alias(c) for c in r.columns[5:]])


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations hold customers, customers placed orders: a graph out of the star schema."""
    customer = load(spark, sf_dir, "customer")
    held = customer.select(F.concat(F.lit("nation/"), "c_nationkey").alias("src"), F.concat(F.lit("customer/"), "c_custkey").alias("dst"), F.lit("HAS_CUSTOMER").alias("kind"), F.lit(0).cast("long").alias("valid_from"), F.lit(T_MAX).alias("valid_to"))
    orders = load(spark, sf_dir, "orders").withColumn("t", millis("o_orderdate"))
    ends = F.when(F.col("o_orderstatus") == "F", F.col("t") + 90 * 86_400_000).otherwise(T_MAX)
    placed = orders.select(F.concat(F.lit("customer/"), "o_custkey").alias("src"), F.concat(F.lit("order/"), "o_orderkey").alias("dst"), F.lit("PLACED").alias("kind"), F.col("t").alias("valid_from"), ends.alias("valid_to"))
    both = held.unionByName(placed)
    return both.select("*", F.lit(None).cast("double").alias("weight"), F.col("valid_from").alias("t_last"), F.lit(None).cast("string").alias("origin"))


T_STAR = 883_612_800_000  # 1998-01-01


def spread_two_hop(spark, sf_dir):
    """Customers and orders most activated from the nations of region 1."""
    config = Config(lambda_base=1e-9)
    edges = star_edges(spark, sf_dir)
    nations = load(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.lit("r1").alias("query"), F.concat(F.lit("nation/"), "n_nationkey").alias("node"))
    names = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    out = spread.spread(spread.weighted_edges(edges, T_STAR, config), names, nations, config, depth=2)
    return out.activation.select("node", F.round("act", 6).alias("act"))


def semantic_seed_spread(spark, sf_dir):
    """Nodes a vector resolves to, united with a named one, as seeds; a node's vector is that of its id."""
    vectors = load(spark, sf_dir, "embeddings")
    top = match.match_vector(vectors, _vector(spark, sf_dir), 4)
    ids = load(spark, sf_dir, "nodes").select(F.col("node_id").alias("vec_id"), F.col("name").alias("node")).distinct()
    resolved = ids.join(F.broadcast(top.select("vec_id")), "vec_id").select("node")
    seeds = resolved.unionByName(spark.createDataFrame([(HUB,)], "node string")).distinct().select(F.lit("v").alias("query"), "node")
    edges = spread.weighted_edges(graph(spark, sf_dir), T2, CONFIG)
    out = spread.spread(edges, names_at(spark, sf_dir, T2), seeds, CONFIG, depth=1)
    return out.activation.select("node", F.round("act", 6).alias("act"))


def spread_batch(spark, sf_dir):
    """A retrieval from every node alive, all in one plan: how many nodes each activates and with what mass."""
    names = names_at(spark, sf_dir, T2)
    seeds = names.select(F.col("name").alias("query"), F.col("name").alias("node"))
    edges = spread.weighted_edges(graph(spark, sf_dir), T2, CONFIG)
    out = spread.spread(edges, names, seeds, CONFIG, depth=2)
    return out.incoming.groupBy("query").agg(F.count("*").alias("n_reached"), F.round(F.sum("incoming"), 6).alias("mass"))


def order_dependent_hops(spark, sf_dir):
    """Hops in which processing nodes one after the other could give another result."""
    seeds = spark.createDataFrame(SEEDS, "query string, node string")
    edges = spread.weighted_edges(graph(spark, sf_dir), T2, CONFIG)
    return spread.has_order_dependence(edges, names_at(spark, sf_dir, T2), seeds, 2)


def parity_spread_kernel(spark, sf_dir):
    """The seeds' retrievals with nodes processed one after the other."""
    seeds = spark.createDataFrame([(q, i, n) for i, (q, n) in enumerate(SEEDS)], "query string, pos int, node string")
    edges = spread.weighted_edges(graph(spark, sf_dir), T2, CONFIG)
    live = seeds.join(names_at(spark, sf_dir, T2).withColumnRenamed("name", "node"), "node", "left_semi")
    return spread.sequential_spread(edges, live, CONFIG, depth=2).select("query", "node", F.round("act", 6).alias("act"))


def trace_retention(spark, sf_dir):
    """The newest 256 traces as a capped store keeps them."""
    traces = load(spark, sf_dir, "traces").select("trace_id", "edges_fired").distinct()
    return stores.keep_latest(traces, "trace_id", 256)


def trace_retention_kept(spark, sf_dir):
    """The traces that a store of the default size keeps."""
    traces = load(spark, sf_dir, "traces").select("trace_id", "edges_fired").distinct()
    return stores.keep_latest(traces, "trace_id")


# -- feedback ----------------------------------------------------------------------


def _feedback(make, name):
    def query(spark, sf_dir):
        result = _spread(spark, sf_dir)
        r, _ = learn.assign_credit(result, make(spark, sf_dir, result), 2, CONFIG)
        return r.select("query", *KEY, F.round("r", 6).alias("r"))

    query.__name__ = name
    return query


def _surfaced(result):
    return result.top(25).select("query", "node", "act")


def _scores(spark):
    return spark.createDataFrame(
        [("a", "db/ledger-primary", 1.0), ("a", "net/shared-backbone-vpc", -0.5), ("b", "queue/main-intake", 0.25), ("b", "no/such-node", 1.0)],
        "query string, node string, score double",
    )


feedback_graded = _feedback(lambda s, d, r: learn.credit_nodes(_scores(s), names_at(s, d, T2)), "feedback_graded")
feedback_episodic_uniform = _feedback(lambda s, d, r: learn.credit_uniform(_surfaced(r), 1.0), "feedback_episodic_uniform")
feedback_episodic_activation = _feedback(lambda s, d, r: learn.credit_by_activation(_surfaced(r), 1.0), "feedback_episodic_activation")
feedback_miss_penalty = _feedback(
    lambda s, d, r: learn.miss_penalty(learn.credit_nodes(_scores(s), names_at(s, d, T2)), _surfaced(r), 0.1), "feedback_miss_penalty"
)


def feedback_report(spark, sf_dir):
    result = _spread(spark, sf_dir)
    r, cred = learn.assign_credit(result, learn.credit_nodes(_scores(spark), names_at(spark, sf_dir, T2)), 2, CONFIG)
    report = learn.feedback_report(r, cred)
    return report.select("query", "edges_reinforced", F.round("total_positive_r", 6).alias("total_positive_r"), F.round("total_negative_r", 6).alias("total_negative_r"), "hits", "misses")


# -- matching --------------------------------------------------------------------


def match_tokens_prefix(spark, sf_dir):
    return match.match_tokens(match.token_index(versions(spark, sf_dir)), ["led", "session"], 50)


def match_substring(spark, sf_dir):
    return match.match_substring(versions(spark, sf_dir), ["relay", "EDGE-gate"], 50)


def name_token_counts(spark, sf_dir):
    return match.token_index(versions(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("n_names"))


def _vector(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


def match_vector_topk(spark, sf_dir):
    top = match.match_vector(load(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 10)
    return top.select("vec_id", F.round("score", 6).alias("score"))


# -- state upkeep ------------------------------------------------------------------


def reconcile_stale_nodes(spark, sf_dir):
    """Real nodes alive at T2 that no inventory record names."""
    return temporal.stale_nodes(versions(spark, sf_dir), load(spark, sf_dir, "inventory"), T2)


def _batch_edges(spark, sf_dir):
    rows = load(spark, sf_dir, "inventory").select(F.col("name").alias("src"), F.explode("edges").alias("e"))
    return rows.select("src", "e.dst", "e.kind").where("src IS NOT NULL AND dst IS NOT NULL AND kind IS NOT NULL")


def reconcile_stale_edges(spark, sf_dir):
    observed = load(spark, sf_dir, "inventory").select("name")
    return temporal.stale_edges(graph(spark, sf_dir), _batch_edges(spark, sf_dir), observed, T2)


def purge_by_origin(spark, sf_dir):
    nodes, edges = temporal.purge(versions(spark, sf_dir), graph(spark, sf_dir), PREFIX)
    kept = nodes.select(F.lit("node").alias("part"), "name").unionByName(edges.select(F.lit("edge").alias("part"), temporal.rendered().alias("name")))
    return kept.distinct()


def checkpoint_open_state(spark, sf_dir):
    return temporal.open_state(versions(spark, sf_dir), graph(spark, sf_dir))


def byte_estimate(spark, sf_dir):
    return temporal.byte_estimate(versions(spark, sf_dir), graph(spark, sf_dir), name_tokens("name"))


# -- analytics export ---------------------------------------------------------------


def _exported(spark, sf_dir):
    c = CONFIG
    rate = decay_rate("kind", c.lambda_base, c.beta, c.authority_by_kind, c.authority_default)
    edges = graph(spark, sf_dir).withColumn("w", F.coalesce("weight", F.lit(c.w0)))
    w = effective("w", "t_last", rate, T2) * trust("origin", c.trust_by_origin)
    return edges.where(F.col("valid_to") == T_MAX).select("src", "dst", "kind", "valid_from", F.round(w, 6).alias("weight"))


def export_top_salient(spark, sf_dir):
    e = _exported(spark, sf_dir)
    return e.orderBy(F.desc("weight"), "src", "dst", "kind", "valid_from").limit(20)


def export_concentration(spark, sf_dir):
    return maintain.concentration(_exported(spark, sf_dir))


def export_paths_1_3(spark, sf_dir):
    # parallel edges are one step, by their greatest weight
    e = _exported(spark, sf_dir).where(F.col("kind").isin("RUNS_ON", "CONTAINS")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    return traverse.paths(e, HUB, 3, 10)


# -- event-driven state ---------------------------------------------------------------


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumn("t", millis("ts"))


def node_versions_scd2(spark, sf_dir):
    """Versions of users: an error retires one, a view only mentions it, any other event observes it with its props."""
    kind = F.when(F.col("event_type") == "error", "retire").when(F.col("event_type") == "view", "placeholder").otherwise("observe")
    return temporal.fold_node_versions(_events(spark, sf_dir).withColumn("k", kind), "user_id", ["ts", "event_id"], "k", "props", "t")


def edge_intervals_islands(spark, sf_dir):
    """Intervals in which a user does clicks, views or purchases; an error ends all of a user's, a signup the purchases."""
    e = _events(spark, sf_dir)
    ends = F.when(F.col("event_type") == "error", F.array(F.lit("click"), F.lit("view"), F.lit("purchase"))).when(F.col("event_type") == "signup", F.array(F.lit("purchase")))
    about = F.when(F.col("event_type").isin("click", "view", "purchase"), F.array("event_type")).otherwise(ends)
    rows = e.select("user_id", "ts", "event_id", "t", "event_type", F.explode(about).alias("what"))
    opens = F.col("event_type") == F.col("what")
    return temporal.fold_edge_intervals(rows, ["user_id", "what"], ["ts", "event_id"], opens, ~opens, "t")


def _r():
    """What an event says of its edge."""
    return F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "click", 0.5).when(F.col("event_type") == "view", 0.1).when(F.col("event_type") == "signup", 0.0)


def touch_linear(spark, sf_dir):
    e = _events(spark, sf_dir).where("event_type <> 'error'").withColumn("r", _r())
    out = learn.touch_linear(e, "user_id", "t", "r", 0.5, "first", 1e-6, CONFIG)
    return out.select("user_id", "n", F.round("w", 6).alias("w"), "t_last")


def touch_ordered_fold(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("r", F.coalesce(_r(), F.lit(-0.5)))
    out = learn.touch_fold(e, "user_id", ["ts", "event_id"], "t", "r", 0.5, 1e-6, CONFIG)
    return out.select("user_id", "n", F.round("w", 6).alias("w"), "t_last")


def homeostat_series(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("mass", F.col("value") / 100)
    out = spread.homeostat_series(e, "event_type", ["ts", "event_id"], "mass", CONFIG)
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("ewma", "integral", "lambda_scale")])


def ratcheted_clock(spark, sf_dir):
    """Per user, events in order of id with a clock that never runs back: distinct times and the largest step back."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = _events(spark, sf_dir).withColumn("clock", F.max("t").over(w))
    return rows.groupBy("user_id").agg(F.countDistinct("clock").alias("n_times"), F.max(F.col("clock") - F.col("t")).alias("most_back"))


def request_histogram(spark, sf_dir):
    """Cumulative latency buckets and status classes per route."""
    bounds = [1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000]  # fixed values: milliseconds
    e = load(spark, sf_dir, "events")
    buckets = [F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in bounds]
    return e.groupBy(F.col("event_type").alias("route")).agg(F.count("*").alias("le_inf"), *buckets, F.round(F.sum("value"), 4).alias("total"))


def idempotent_dedup(spark, sf_dir):
    """Per user and event type, the first request of each 24 hours since the request that opened them counts."""
    def step(state, times):
        n, opened = state
        for t in times:
            if opened is None or t - opened >= 86_400_000:
                n, opened = n + 1, t
        return n, opened

    per = fold_in_order(_events(spark, sf_dir), ["user_id", "event_type"], ["t"], ["t"], (0, None), step, "n_executed long, opened long")
    return per.select("user_id", "event_type", F.col("n").alias("n_requests"), "n_executed")


_NAMES = """asof_nodes asof_edges diff_nodes diff_edges open_edge_lookup blast_radius_down blast_radius_up blast_radius_both neighborhood_edges graph_dump
effective_weight trust_mask spread_activation spread_three_hop_topk spread_trace_fired spread_mass trace_explain salience_stats consolidate consolidate_counts
conflicts_functional sleep sleep_report feedback_graded feedback_episodic_uniform feedback_episodic_activation feedback_miss_penalty feedback_report match_tokens_prefix
match_substring name_token_counts match_vector_topk reconcile_stale_nodes reconcile_stale_edges purge_by_origin checkpoint_open_state byte_estimate
export_top_salient export_concentration export_paths_1_3 node_versions_scd2 edge_intervals_islands touch_linear touch_ordered_fold homeostat_series
ratcheted_clock request_histogram idempotent_dedup spread_two_hop spread_batch semantic_seed_spread order_dependent_hops parity_spread_kernel trace_retention trace_retention_kept""".split()
QUERIES = {name: globals()[name] for name in _NAMES}
