"""One memory database: its log and learned state in a directory, its operators as methods."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.common import T_MAX
from emberline.config import Config
from emberline.functions.weights import alive, decay_rate, effective
from emberline.operators import learn, maintain, match, spread, temporal, traverse
from emberline.sources import oplog
from emberline.sources.sidecar import append_rows, load_version, save_version
from emberline.sources.stores import KEPT, keep_latest

_NAME = re.compile(r"[a-z0-9_-]{1,64}")
_ORD = "struct<batch:bigint,rec:bigint,pos:int>"
_FIRED = "hop int, src string, dst string, kind string, valid_from long, delta double"
_TRACE = f"trace_id long, t long, depth int, surfaced array<struct<node string, act double>>, fired array<struct<{_FIRED}>>"
_STATE = "src string, dst string, kind string, valid_from long, weight double, t_last long, dead boolean"


class Memory:
    """A database under ``root/name``. There is one writer; readers see whole versions.

    Operations are appended to the log; other tables are written as new versions
    beside the old ones and made current in one step, so a job that fails leaves
    everything as it was. The controller's state is kept with them.
    """

    def __init__(self, spark: SparkSession, root: str, name: str = "main", config: Config | None = None):
        if not _NAME.fullmatch(name):
            raise ValueError("a database's name has 1 to 64 of a-z, 0-9, _ and -")
        self.spark, self.root = spark, f"{root}/{name}"
        self.config = config or self._stored_config() or Config()
        held = load_version(spark, self.root, "controller")
        self.lambda_scale, self.integral, self.ewma = tuple(held.first()) if held is not None else (1.0, 0.0, None)

    # -- state ---------------------------------------------------------------

    def _stored_config(self) -> Config | None:
        row = load_version(self.spark, self.root, "config")
        return Config.from_json(row.first()[0]) if row is not None else None

    def set_config(self, config: Config) -> None:
        """Replace the settings; the controller keeps its state."""
        self.config = config
        save_version(self.spark.createDataFrame([(config.to_json(),)], "json string"), self.root, "config")

    def quarantine(self, prefix: str, trust: float = 0.0) -> None:
        """Set the trust of everything whose origin begins with ``prefix``; nothing is forgotten."""
        if not prefix or not 0 <= trust < float("inf"):
            raise ValueError("needs a prefix and a finite trust of 0 or more")
        self.config.trust_by_origin[prefix] = trust
        self.set_config(self.config)

    def ops(self) -> DataFrame:
        ops = load_version(self.spark, self.root, "ops")
        return self.spark.createDataFrame([], f"ord {_ORD}, {oplog.OPS}") if ops is None else ops

    def state(self) -> DataFrame:
        state = load_version(self.spark, self.root, "salience")
        return self.spark.createDataFrame([], _STATE) if state is None else state

    def edges(self) -> DataFrame:
        """All edge intervals with their learned state, seeded where nothing was learned yet."""
        seed = self.config.w0
        joined = oplog.fold_edges(self.ops()).join(self.state(), ["src", "dst", "kind", "valid_from"], "left")
        return joined.withColumn("weight", F.coalesce("weight", F.lit(seed))).withColumn("t_last", F.coalesce("t_last", "valid_from")).withColumn("dead", F.coalesce("dead", F.lit(False)))

    def versions(self) -> DataFrame:
        kinds = oplog.fold_nodes(self.ops()).select("name", "type", "placeholder")
        return oplog.fold_versions(self.ops()).join(kinds, "name")

    def names(self, t: int) -> DataFrame:
        return self.versions().where(alive("observed_at", "retired_at", t)).select("name").distinct()

    # -- writing -------------------------------------------------------------

    def _append(self, ops: DataFrame) -> None:
        append_rows(ops.select(*self.ops().columns), self.root, "ops")

    def _next_batch(self) -> int:
        last = self.ops().agg(F.max("ord.batch")).first()[0]
        return 0 if last is None else last + 1

    def _numbered(self, ops: DataFrame, batch: int) -> DataFrame:
        cols = [c.strip().split(" ")[0] for c in oplog.OPS.split(",")]
        return ops.select(F.struct(F.lit(batch).cast("long").alias("batch"), F.col("ord.rec").cast("long").alias("rec"), F.col("ord.pos").cast("int").alias("pos")).cast(_ORD).alias("ord"), *cols)

    def ingest(self, entities: DataFrame, ts: int, reconcile: bool = False, origin: str | None = None) -> None:
        """Observe entities (name, type, props, edges, origin[, rec]); with ``reconcile`` they are the whole truth,
        and what they assert no more is retired. Without ``rec`` records keep the order of the frame."""
        batch = self._next_batch()
        rec = F.col("rec") if "rec" in entities.columns else F.monotonically_increasing_id()
        ops = self._numbered(oplog.entity_ops(entities.withColumn("rec", rec.cast("long")), F.lit(ts).cast("long"), ["rec"], origin), batch)
        self._append(ops)
        if reconcile:
            self._reconcile(batch, self.ops().where(F.col("ord.batch") == batch), ts)

    def ingest_assets(self, assets: DataFrame, ts: int) -> None:
        """Observe a whole snapshot of cloud assets (name, assetType, ancestors, resource[, rec]); what it asserts no more is
        retired. An asset asserts itself and its containers, not what it refers to."""
        batch = self._next_batch()
        rec = F.col("rec") if "rec" in assets.columns else F.monotonically_increasing_id()
        self._append(self._numbered(oplog.asset_ops(assets.withColumn("rec", rec.cast("long")), F.lit(ts).cast("long"), ["rec"]), batch))
        self._reconcile(batch, oplog.asserting(self.ops().where(F.col("ord.batch") == batch)), ts)

    def _reconcile(self, batch: int, mine: DataFrame, ts: int) -> None:
        now = self.ops()
        mark = F.struct(F.lit(batch + 1).cast("long").alias("batch"), F.lit(0).cast("long").alias("rec"), F.lit(0).alias("pos")).cast(_ORD)
        self._append(oplog.reconcile_ops(now, mine, mine.where("op = 'observe_node'").select("name"), ts, mark).select(*now.columns))

    def retire(self, name: str, ts: int) -> None:
        row = self.spark.createDataFrame([("retire_node", name, ts)], "op string, name string, ts long")
        for c in ("type", "props", "src", "dst", "kind", "origin"):
            row = row.withColumn(c, F.lit(None).cast("string"))
        row = row.withColumn("ord", F.struct(F.lit(0).alias("rec"), F.lit(0).alias("pos")))
        self._append(self._numbered(row, self._next_batch()))

    def _keep(self, edges: DataFrame) -> None:
        save_version(edges.select("src", "dst", "kind", "valid_from", "weight", "t_last", "dead"), self.root, "salience")

    # -- reading -------------------------------------------------------------

    def diff(self, t1: int, t2: int) -> tuple[DataFrame, DataFrame]:
        return temporal.diff_nodes(self.versions(), t1, t2), temporal.diff_edges(self.edges(), t1, t2)

    def blast_radius(self, origin: str, t: int, direction: str = "down", depth: int = 2) -> DataFrame:
        return traverse.blast_radius(temporal.edges_at(self.edges(), t), self.names(t), origin, direction, depth)

    def neighborhood(self, seeds: list[str], depth: int, t: int) -> tuple[DataFrame, DataFrame]:
        return traverse.neighborhood(temporal.edges_at(self.edges(), t), self.names(t), seeds, depth)

    def match(self, tokens: list[str], limit: int = 16, mode: str = "token") -> DataFrame:
        names = self.versions().select("name").distinct()
        return match.match_substring(names, tokens, limit) if mode == "substring" else match.match_tokens(match.token_index(names), tokens, limit)

    def match_vector(self, query: list[float], k: int = 4) -> DataFrame:
        """Names whose open version's ``props.embedding`` is most like the query."""
        open_ = self.versions().where(F.col("retired_at") == T_MAX)
        vec = F.try_variant_get(F.try_parse_json("props"), "$.embedding", "array<double>")
        return match.match_vector(open_.select("name", vec.alias("v")).where("v IS NOT NULL"), query, k, "name", "v")

    def spread(self, seeds: DataFrame, t: int, depth: int | None = None, fan: float | None = None) -> spread.Spread:
        edges = spread.weighted_edges(self.edges(), t, self.config, self.lambda_scale, dead=True)
        return spread.spread(edges, self.names(t), seeds, self.config, depth, fan)

    def retrieve(self, seeds: list[str], t: int, top_k: int = 10, depth: int | None = None, adapt: bool = False, vector: list[float] | None = None, seed_k: int = 4) -> DataFrame:
        """The ``top_k`` most activated nodes, from named seeds and those a vector resolves to. With ``adapt`` the mass moves the controller."""
        if vector is not None:
            seeds = seeds + [r[0] for r in self.match_vector(vector, seed_k).collect() if r[0] not in seeds]
        result = self.spread(self.spark.createDataFrame([("q", s) for s in seeds], "query string, node string"), t, depth)
        if adapt:
            mass = result.mass().first()
            (self.ewma, self.integral, self.lambda_scale) = spread.homeostat([mass["mass"] if mass else 0.0], self.config, self.integral, self.ewma)[0]
            save_version(self.spark.createDataFrame([(self.lambda_scale, self.integral, self.ewma)], "lambda_scale double, integral double, ewma double"), self.root, "controller")
        return result.top(top_k).orderBy("rank").select("node", "act")

    # -- learning ------------------------------------------------------------

    def feedback(self, seeds: list[str], t: int, used: list[str] | None = None, reward: float | None = None, scores: dict[str, float] | None = None, top_k: int = 10, by_activation: bool = False) -> DataFrame:
        """Credit what a retrieval surfaced: graded scores go before a reward, a reward before used names. Gives the report."""
        result = self.spread(self.spark.createDataFrame([("q", s) for s in seeds], "query string, node string"), t)
        return self._learn(result, result.top(top_k).select("query", "node", "act"), self.config.depth, t, used, reward, scores, by_activation)

    def traces(self) -> DataFrame:
        traces = load_version(self.spark, self.root, "traces")
        return self.spark.createDataFrame([], _TRACE) if traces is None else traces

    def retrieve_traced(self, seeds: list[str], t: int, top_k: int = 10, depth: int | None = None) -> tuple[int, DataFrame]:
        """A retrieval whose trace is kept for later feedback: its id and what surfaced. The latest ``KEPT`` traces stay."""
        depth = self.config.depth if depth is None else depth
        result = self.spread(self.spark.createDataFrame([("q", s) for s in seeds], "query string, node string"), t, depth)
        held = self.traces()
        trace_id = (held.agg(F.max("trace_id")).first()[0] or 0) + 1
        surfaced = result.top(top_k).agg(F.sort_array(F.collect_list(F.struct("rank", "node", "act"))).alias("s")).select(F.expr("transform(s, x -> struct(x.node, x.act))").alias("surfaced"))
        fired = result.fired.agg(F.collect_list(F.struct("hop", *spread.EDGE, "delta")).alias("fired"))
        trace = surfaced.crossJoin(fired).select(F.lit(trace_id).cast("long").alias("trace_id"), F.lit(t).cast("long").alias("t"), F.lit(depth).alias("depth"), "surfaced", "fired")  # one row each
        save_version(keep_latest(held.unionByName(trace.to(held.schema)), "trace_id", KEPT), self.root, "traces")
        return trace_id, self.traces().where(F.col("trace_id") == trace_id).select(F.inline("surfaced"))

    def feedback_trace(self, trace_id: int, t: int, used: list[str] | None = None, reward: float | None = None, scores: dict[str, float] | None = None, by_activation: bool = True) -> DataFrame:
        """Credit what a kept retrieval surfaced, along the edges it fired then, whatever they weigh now."""
        trace = self.traces().where(F.col("trace_id") == trace_id)
        found = trace.select("depth").first()
        if found is None:
            raise KeyError(f"trace {trace_id} is unknown: no longer kept or never given")
        fired = trace.select(F.lit("q").alias("query"), F.inline("fired"))
        surfaced = trace.select(F.lit("q").alias("query"), F.inline("surfaced"))
        incoming = fired.groupBy("query", F.col("dst").alias("node")).agg(F.sum("delta").alias("incoming"))
        return self._learn(spread.Spread(surfaced, fired, incoming), surfaced, found[0], t, used, reward, scores, by_activation)

    def _learn(self, result: spread.Spread, surfaced: DataFrame, depth: int, t: int, used: list[str] | None, reward: float | None, scores: dict[str, float] | None, by_activation: bool) -> DataFrame:
        if scores is None and reward is not None:
            credit = (learn.credit_by_activation if by_activation else learn.credit_uniform)(surfaced, reward)
        else:
            graded = scores or dict.fromkeys(used or [], self.config.feedback_hit)
            rows = self.spark.createDataFrame([("q", n, float(s)) for n, s in graded.items()], "query string, node string, score double")
            credit = learn.credit_nodes(rows, self.versions())
        credit = learn.miss_penalty(credit, surfaced, self.config.feedback_miss_penalty)
        r, cred = learn.assign_credit(result, credit, depth, self.config)
        report = learn.feedback_report(r, cred)
        row = report.collect()
        self._touch(r, t)
        return self.spark.createDataFrame(row, report.schema)

    def _touch(self, r: DataFrame, t: int) -> None:
        c = self.config
        rate = decay_rate("kind", c.lambda_base, c.beta, c.authority_by_kind, c.authority_default)
        r = r.groupBy("src", "dst", "kind", "valid_from").agg(F.sum("r").alias("r"))
        now = effective("weight", "t_last", rate, t, self.lambda_scale)
        self._keep(learn.apply_touches(self.edges(), r, now, t, c))

    def touch(self, touches: DataFrame, t: int) -> None:
        """Reinforce open edges (src, dst, kind, r) by name; unknown ones are missed."""
        open_ = self.edges().where((F.col("valid_to") == T_MAX) & ~F.col("dead")).select("src", "dst", "kind", "valid_from")
        self._touch(open_.join(touches, ["src", "dst", "kind"]).select("src", "dst", "kind", "valid_from", "r"), t)

    def consolidate(self, t: int, apply_conflicts: bool = False) -> DataFrame:
        before = self.edges()
        after = maintain.consolidate(before, t, self.config, self.lambda_scale)
        report = maintain.consolidation_counts(before, after).collect()
        losers = maintain.conflicts(after, self.config.functional_kinds)
        if apply_conflicts and self.config.functional_kinds:
            rows = losers.select(F.lit("retire_edge").alias("op"), *[F.lit(None).cast("string").alias(c) for c in ("name", "type", "props")], "src", "dst", "kind", F.lit(t).cast("long").alias("ts"), F.lit(None).cast("string").alias("origin"), F.struct(F.lit(0).alias("rec"), F.lit(0).alias("pos")).alias("ord"))
            retire = self._numbered(rows, self._next_batch())
            self._append(retire)
        self._keep(after)
        return self.spark.createDataFrame(report)

    def sleep(self, t: int) -> DataFrame:
        """Scale all weights down and prune; gives the report, with the protection threshold."""
        edges = self.edges()
        state, threshold = maintain.sleep(edges, t, self.config, self.lambda_scale)
        before = maintain.materialised(maintain.with_state(edges, self.config), t, self.config, self.lambda_scale)
        report = maintain.sleep_report(before, state).withColumn("threshold", F.lit(threshold).cast("double"))
        row = report.collect()
        self._keep(state)
        return self.spark.createDataFrame(row, report.schema)

    def stats(self) -> DataFrame:
        return maintain.stats(self.edges())

    # -- upkeep of the log ---------------------------------------------------

    def purge(self, prefix: str) -> None:
        """Forget all that came from origins with ``prefix``, and closed history."""
        if not prefix:
            raise ValueError("an empty prefix would match everything")
        open_n = self._open_node_ops()
        theirs = F.coalesce(F.col("origin").startswith(prefix), F.lit(False))
        gone = open_n.where(theirs).select("name").distinct()
        nodes = open_n.join(gone, "name", "left_anti")
        edges = self._open_edge_ops().where(~theirs)
        for end in ("src", "dst"):
            edges = edges.join(gone.withColumnRenamed("name", end), end, "left_anti")
        self._rewrite(nodes, edges)

    def checkpoint(self) -> None:
        """Rewrite the log to what rebuilds the open state, times kept; the older versions stay as files."""
        self._rewrite(self._open_node_ops(), self._open_edge_ops())

    def _open_node_ops(self) -> DataFrame:
        open_ = oplog.fold_versions(self.ops()).where(F.col("retired_at") == T_MAX)
        rows = open_.join(oplog.fold_nodes(self.ops()), "name")
        op = F.when(F.col("placeholder"), "observe_placeholder").otherwise("observe_node")
        null = F.lit(None).cast("string")
        return rows.select("first_ord", op.alias("op"), "name", "type", "props", null.alias("src"), null.alias("dst"), null.alias("kind"), F.col("observed_at").alias("ts"), "origin")

    def _open_edge_ops(self) -> DataFrame:
        null = F.lit(None).cast("string")
        open_ = oplog.fold_edges(self.ops()).where(F.col("valid_to") == T_MAX)
        return open_.select(F.lit("observe_edge").alias("op"), *[null.alias(c) for c in ("name", "type", "props")], "src", "dst", "kind", F.col("valid_from").alias("ts"), "origin")

    def _rewrite(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Nodes in the order they were first met, then edges; both keep their place by a struct, so nothing is numbered globally."""
        o = lambda b, r, p: F.struct(b.cast("long").alias("batch"), r.cast("long").alias("rec"), p.cast("int").alias("pos")).cast(_ORD).alias("ord")
        n = nodes.withColumn("ord", o(F.col("first_ord.ord.batch") - F.lit(1 << 40), F.col("first_ord.ord.rec"), F.col("first_ord.ord.pos") * 2 + F.col("first_ord.sub")))
        e = edges.withColumn("ord", o(F.lit(-1), F.col("ts"), F.lit(0)))
        columns = self.ops().columns
        save_version(n.select(*columns).unionByName(e.select(*columns)), self.root, "ops")
