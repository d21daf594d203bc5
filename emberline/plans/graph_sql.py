"""SQL that gives the rows of :mod:`emberline.plans.graph_queries` in an independent database."""

from __future__ import annotations

from emberline.common import T_MAX
from emberline.plans.graph_queries import CONFIG, HUB, PREFIX, SEEDS, SINK, T1, T2, T_STAR

C = CONFIG
_G = f"""
g AS (SELECT src, dst, kind, valid_from, coalesce(v.t, {T_MAX}) AS valid_to, v.w AS weight, v.o AS origin FROM (
  SELECT src, dst, kind, valid_from, arg_max({{'t': valid_to, 'w': weight, 'o': origin}}, loaded_at) AS v FROM edges
  WHERE dst IS NOT NULL AND exported_at = (SELECT max(exported_at) FROM edges WHERE dst IS NOT NULL) GROUP BY src, dst, kind, valid_from))"""
_V = "v AS (SELECT DISTINCT name, type, placeholder, observed_at, retired_at, origin, props FROM nodes)"


def _alive(t: int, a: str = "observed_at", b: str = "retired_at") -> str:
    return f"({a} <= {t} AND {t} < coalesce({b}, {T_MAX}))"


_NAMES = f"names AS (SELECT DISTINCT name FROM nodes WHERE {_alive(T2)})"
_ALIVE_EDGES = _alive(T2, "valid_from", "valid_to")
_RATE = f"({C.lambda_base} / (1 + {C.beta} * CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.authority_by_kind.items()) + f" ELSE {C.authority_default} END))"
_TRUST = "CASE " + " ".join(f"WHEN starts_with(coalesce(origin, ''), '{p}') THEN {C.trust_by_origin[p]}" for p in sorted(C.trust_by_origin, key=lambda p: -len(p))) + " ELSE 1.0 END"
_EFF = f"(coalesce(weight, {C.w0}) * exp(-{_RATE} * (greatest({T2} - valid_from, 0) / 1000)))"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _spread(depth: int, seeds: str = "") -> list[str]:
    seeds = seeds or "SELECT query, node FROM (VALUES " + ", ".join(f"('{q}', '{n}')" for q, n in SEEDS) + ") s(query, node)"
    parts = [
        _G,
        _NAMES,
        f"w AS (SELECT src, dst, kind, valid_from, greatest({_EFF} * {_TRUST}, 0) AS w FROM g WHERE {_ALIVE_EDGES})",
        "e AS (SELECT w.*, m.mass FROM w JOIN (SELECT src, sum(w) AS mass FROM w GROUP BY src) m USING (src) WHERE m.mass > 0)",
        f"s AS (SELECT query, node FROM ({seeds}) WHERE node IN (SELECT name FROM names))",
        "a0 AS (SELECT DISTINCT query, node, 1.0::DOUBLE AS act FROM s)",
        "q1 AS (SELECT query, node, 1.0::DOUBLE AS act FROM s)",
    ]
    for h in range(1, depth + 1):
        parts += [
            f"f{h} AS (SELECT query, {h} AS hop, src, dst, kind, valid_from, act * {C.fan} * mass / (1 + mass) * (w / mass) AS delta "
            f"FROM q{h} JOIN e ON e.src = q{h}.node WHERE act * {C.fan} * mass / (1 + mass) * (w / mass) > {C.activation_epsilon})",
            f"g{h} AS (SELECT query, dst AS node, sum(delta) AS act FROM f{h} GROUP BY query, dst)",
            f"a{h} AS (SELECT query, node, sum(act) AS act FROM (FROM a{h - 1} UNION ALL FROM g{h}) GROUP BY query, node)",
            f"q{h + 1} AS (SELECT * FROM g{h} WHERE (query, node) NOT IN (SELECT (query, node) FROM a{h - 1}))",
        ]
    fired = " UNION ALL ".join(f"FROM f{h}" for h in range(1, depth + 1))
    return [*parts, f"fired AS ({fired})", "inc AS (SELECT query, dst AS node, sum(delta) AS incoming FROM fired GROUP BY query, dst)"]


_SCORES = """scores AS (SELECT * FROM (VALUES ('a', 'db/ledger-primary', 1.0), ('a', 'net/shared-backbone-vpc', -0.5),
  ('b', 'queue/main-intake', 0.25), ('b', 'no/such-node', 1.0)) s(query, node, score))"""
_GRADED = "SELECT query, node, sum(score)::DOUBLE AS cred FROM scores WHERE node IN (SELECT name FROM names) GROUP BY query, node"
_SURFACED = "surf AS (SELECT query, node, act FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY act DESC, node) AS k FROM a2) WHERE k <= 25)"


def _credit(credit: str) -> list[str]:
    return [
        *_spread(2),
        _SURFACED,
        _SCORES,
        f"c2 AS ({credit})",
        "r2 AS (SELECT f.query, src, dst, kind, valid_from, cred * (delta / incoming) AS r FROM f2 f JOIN c2 ON c2.query = f.query AND c2.node = f.dst AND cred <> 0 JOIN inc ON inc.query = f.query AND inc.node = f.dst)",
        f"c1 AS (SELECT query, node, sum(cred) AS cred FROM (FROM c2 UNION ALL SELECT query, src, {C.feedback_gamma} * sum(r) FROM r2 GROUP BY query, src) GROUP BY query, node)",
        "r1 AS (SELECT f.query, src, dst, kind, valid_from, cred * (delta / incoming) AS r FROM f1 f JOIN c1 ON c1.query = f.query AND c1.node = f.dst AND cred <> 0 JOIN inc ON inc.query = f.query AND inc.node = f.dst)",
        f"c0 AS (SELECT query, node, sum(cred) AS cred FROM (FROM c1 UNION ALL SELECT query, src, {C.feedback_gamma} * sum(r) FROM r1 GROUP BY query, src) GROUP BY query, node)",
        "rr AS (SELECT query, src, dst, kind, valid_from, sum(r) AS r FROM (FROM r1 UNION ALL FROM r2) GROUP BY ALL)",
    ]


_R_ROWS = "SELECT query, src, dst, kind, valid_from, round(r, 6) AS r FROM rr"

_CONS = [
    _G,
    f"m AS (SELECT *, {_EFF} AS w FROM g)",
    f"p AS (SELECT *, w < {C.theta} AS dead FROM m)",
    f"state AS (SELECT src, dst, kind, valid_from, valid_to, CASE WHEN dead THEN 0 ELSE w * ({C.norm_target} / sum(CASE WHEN NOT dead THEN w END) OVER (PARTITION BY src)) END AS weight, dead FROM p)",
]

_SLEEP = [
    _G,
    f"m AS (SELECT *, {_EFF} AS w FROM g)",
    f"q AS (SELECT *, row_number() OVER (ORDER BY w) - 1 AS i, count(*) OVER () AS n FROM m)",
    f"thr AS (SELECT w FROM q WHERE i = floor({1 - C.protect_top_frac} * (n - 1) + 0.5))",
    f"p AS (SELECT *, w >= (SELECT w FROM thr) AS protected, w * {C.sleep_downscale} AS low FROM m)",
    f"d AS (SELECT *, low < {C.sleep_theta} AND NOT protected AS dead FROM p)",
]

_STEPS = {
    "down": "SELECT src AS f, dst AS t, 0 AS d, valid_from, kind FROM e",
    "up": "SELECT dst AS f, src AS t, 1 AS d, valid_from, kind FROM e",
}


def _blast(direction: str, depth: int, origin: str = HUB) -> str:
    steps = _STEPS.get(direction) or " UNION ALL ".join(_STEPS.values())
    parts = [
        _G,
        _NAMES,
        f"e AS (SELECT * FROM g WHERE {_ALIVE_EDGES})",
        f"st AS (SELECT * FROM ({steps}) WHERE f <> t AND t IN (SELECT name FROM names))",
        f"h0 AS (SELECT name AS node, 0 AS depth, name AS path, []::STRUCT(d INTEGER, v BIGINT, k VARCHAR, t VARCHAR)[] AS ord FROM names WHERE name = '{origin}')",
        "s0 AS (FROM h0)",
    ]
    for h in range(1, depth + 1):
        parts += [
            f"x{h} AS (SELECT t AS node, {h} AS depth, path || CASE d WHEN 0 THEN ' -[' || kind || ']-> ' ELSE ' <[' || kind || ']- ' END || t AS path, "
            f"list_append(ord, {{'d': d, 'v': valid_from, 'k': kind, 't': t}}) AS ord FROM h{h - 1} JOIN st ON st.f = h{h - 1}.node)",
            f"h{h} AS (SELECT node, depth, path, ord FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ord) AS k FROM x{h}) WHERE k = 1 AND node NOT IN (SELECT node FROM s{h - 1}))",
            f"s{h} AS (FROM s{h - 1} UNION ALL FROM h{h})",
        ]
    return _with(*parts) + f"SELECT node, depth, path FROM s{depth} WHERE depth > 0"


_EXP = [_G, f"x AS (SELECT src, dst, kind, valid_from, round({_EFF} * {_TRUST}, 6) AS weight FROM g WHERE valid_to = {T_MAX})"]
_EV = "ev AS (SELECT *, epoch_us(ts) // 1000 AS t FROM events)"
_SIZE = "octet_length(encode({0}))"
_TOKENS = r"list_distinct([x FOR x IN regexp_split_to_array(lower(name), '[^\p{L}\p{M}\p{N}]+') IF octet_length(encode(x)) >= 2])"
_RCASE = "CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.1 WHEN 'signup' THEN 0.0 END"

SQL = {
    "asof_nodes": _with(_V) + f"SELECT name, a.p AS placeholder, a.o AS observed_at, a.j AS props FROM (SELECT name, arg_max({{'p': placeholder, 'o': observed_at, 'j': props}}, observed_at) AS a FROM v WHERE {_alive(T2)} AND name IS NOT NULL GROUP BY name)",
    "asof_edges": _with(_G) + f"SELECT src, dst, kind, valid_from, coalesce(origin, '') AS origin FROM g WHERE {_alive(T1, 'valid_from', 'valid_to')}",
    "diff_nodes": _with(_V, f"""d AS (SELECT name, arg_max(coalesce(props, 'null'), observed_at) FILTER ({_alive(T1)}) AS a, arg_max(coalesce(props, 'null'), observed_at) FILTER ({_alive(T2)}) AS b
  FROM v WHERE NOT placeholder GROUP BY name)""") + "SELECT name, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'changed' END AS change FROM d WHERE a IS DISTINCT FROM b",
    "diff_edges": _with(_G, f"d AS (SELECT src, kind, dst, bool_or({_alive(T1, 'valid_from', 'valid_to')}) AS a, bool_or({_alive(T2, 'valid_from', 'valid_to')}) AS b FROM g GROUP BY src, kind, dst)")
    + "SELECT src || ' -[' || kind || ']-> ' || dst AS edge, CASE WHEN b THEN 'added' ELSE 'removed' END AS change FROM d WHERE a <> b",
    "open_edge_lookup": _with(_G) + f"SELECT src, dst, kind, count(*) AS n_open, min(valid_from) AS since FROM g WHERE valid_to = {T_MAX} GROUP BY src, dst, kind",
    "blast_radius_down": _blast("down", 2),
    "blast_radius_up": _blast("up", 2, SINK),
    "blast_radius_both": _blast("both", 1),
    "neighborhood_edges": _with(_G, _NAMES, f"e AS (SELECT * FROM g WHERE {_ALIVE_EDGES})", f"m0 AS (SELECT name AS node FROM names WHERE name = '{HUB}')",
      *[f"m{h} AS (SELECT node FROM m{h - 1} UNION SELECT dst FROM e WHERE src IN (SELECT node FROM m{h - 1}) AND dst IN (SELECT name FROM names))" for h in (1, 2)])
    + "SELECT src, dst, kind, valid_from FROM e WHERE src IN (SELECT node FROM m2) AND dst IN (SELECT node FROM m2)",
    "graph_dump": _with(_G) + "SELECT src, dst, kind, valid_from FROM g ORDER BY src, valid_from, kind, dst LIMIT 500",
    "effective_weight": _with(_G) + f"SELECT src, dst, kind, valid_from, round({_EFF}, 6) AS eff FROM g",
    "trust_mask": _with(_G) + f"SELECT coalesce(origin, '') AS origin, ({_TRUST})::DOUBLE AS trust, count(*) AS n_edges FROM g GROUP BY 1, 2",
    "spread_activation": _with(*_spread(2)) + "SELECT query, node, round(act, 6) AS act FROM a2",
    "spread_three_hop_topk": _with(*_spread(3)) + "SELECT query, rank, node, round(act, 6) AS act FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY act DESC, node) AS rank FROM a3) WHERE rank <= 20",
    "spread_trace_fired": _with(*_spread(2)) + "SELECT query, hop, src, dst, kind, valid_from, round(delta, 6) AS delta FROM fired",
    "spread_mass": _with(*_spread(2)) + "SELECT query, round(sum(delta), 6) AS mass FROM fired GROUP BY query",
    "trace_explain": _with(*_spread(1)) + "SELECT query, src || ' -[' || kind || ']-> ' || dst AS edge, valid_from, round(delta, 6) AS delta FROM fired",
    "salience_stats": _with(_G) + f"""SELECT count(*) AS edges_total, count(*) AS edges_live, 0::BIGINT AS edges_dead, (SELECT count(*) FROM (SELECT src FROM g UNION SELECT dst FROM g)) AS nodes,
  round(min(coalesce(weight, {C.w0})), 6) AS weight_min, round(max(coalesce(weight, {C.w0})), 6) AS weight_max, round(avg(coalesce(weight, {C.w0})), 6) AS weight_mean FROM g""",
    "consolidate": _with(*_CONS) + "SELECT src, dst, kind, valid_from, round(weight, 6) AS weight, dead FROM state",
    "consolidate_counts": _with(*_CONS) + "SELECT count(*) FILTER (NOT dead) AS live_edges, count(*) FILTER (dead) AS pruned, count(DISTINCT src) FILTER (NOT dead) AS renormalized_sources FROM state",
    "conflicts_functional": _with(*_CONS) + f"SELECT src, kind, count(*) - 1 AS n_superseded FROM state WHERE valid_to = {T_MAX} AND kind IN ('RUNS_ON', 'PLACED_IN') GROUP BY src, kind HAVING count(*) >= 2",
    "sleep": _with(*_SLEEP) + f"""SELECT src, dst, kind, valid_from, round(CASE WHEN dead THEN 0 ELSE low * ({C.norm_target} / sum(CASE WHEN NOT dead THEN low END) OVER (PARTITION BY src)) END, 6) AS weight,
  dead, protected FROM d""",
    "sleep_report": _with(*_SLEEP) + f"""SELECT count(*) AS downscaled, count(*) FILTER (dead) AS pruned, count(*) FILTER (protected) AS protected, count(DISTINCT src) FILTER (NOT dead AND low > 0) AS renormalized_sources,
  count(*) FILTER (NOT dead) AS live_after, round(coalesce(avg(w), 0), 6) AS mean_weight_before, round(coalesce(avg(after) FILTER (NOT dead), 0), 6) AS mean_weight_after
FROM (SELECT *, low * ({C.norm_target} / sum(CASE WHEN NOT dead THEN low END) OVER (PARTITION BY src)) AS after FROM d)""",
    "feedback_graded": _with(*_credit(_GRADED)) + _R_ROWS,
    "feedback_episodic_uniform": _with(*_credit("SELECT query, node, 1.0 / count(*) OVER (PARTITION BY query) AS cred FROM surf")) + _R_ROWS,
    "feedback_episodic_activation": _with(*_credit("SELECT query, node, act / sum(act) OVER (PARTITION BY query) AS cred FROM surf")) + _R_ROWS,
    "feedback_miss_penalty": _with(*_credit(f"SELECT * FROM ({_GRADED}) c WHERE cred <> 0 UNION ALL SELECT query, node, -0.1 FROM surf WHERE (query, node) NOT IN (SELECT (query, node) FROM ({_GRADED}) z WHERE cred <> 0)")) + _R_ROWS,
    "feedback_report": _with(*_credit(_GRADED)) + """SELECT query, edges_reinforced, round(p, 6) AS total_positive_r, round(n, 6) AS total_negative_r, hits, misses
FROM (SELECT query, count(*) AS edges_reinforced, sum(CASE WHEN r >= 0 THEN r ELSE 0 END) AS p, sum(CASE WHEN r < 0 THEN r ELSE 0 END) AS n FROM rr GROUP BY query)
FULL JOIN (SELECT query, count(*) FILTER (cred > 0) AS hits, count(*) FILTER (cred < 0) AS misses FROM c0 GROUP BY query) USING (query)""",
    "match_tokens_prefix": f"SELECT DISTINCT name FROM (SELECT name, unnest({_TOKENS}) AS token FROM nodes) WHERE starts_with(token, 'led') OR starts_with(token, 'session') ORDER BY name LIMIT 50",
    "match_substring": "SELECT DISTINCT name FROM nodes WHERE contains(lower(name), 'relay') OR contains(lower(name), 'edge-gate') ORDER BY name LIMIT 50",
    "name_token_counts": f"SELECT token, count(*) AS n_names FROM (SELECT unnest({_TOKENS}) AS token FROM (SELECT DISTINCT name FROM nodes WHERE name IS NOT NULL)) GROUP BY token",
    "match_vector_topk": """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
x AS (SELECT vec_id, embedding::DOUBLE[] AS e, q FROM embeddings, q)
SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS s FROM x) ORDER BY s DESC, vec_id LIMIT 10""",
    "reconcile_stale_nodes": f"SELECT DISTINCT name FROM nodes WHERE {_alive(T2)} AND NOT placeholder AND name NOT IN (SELECT name FROM inventory WHERE name IS NOT NULL)",
    "reconcile_stale_edges": _with(_G, "b AS (SELECT name AS src, unnest(edges) AS x FROM inventory WHERE name IS NOT NULL)", "again AS (SELECT DISTINCT src, x.dst AS dst, x.kind AS kind FROM b)")
    + f"SELECT DISTINCT src, dst, kind FROM g WHERE {_ALIVE_EDGES} AND src IN (SELECT name FROM inventory WHERE name IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM again a WHERE a.src = g.src AND a.dst = g.dst AND a.kind = g.kind)",
    "purge_by_origin": _with(_G, _V, f"o AS (SELECT * FROM v WHERE coalesce(retired_at, {T_MAX}) = {T_MAX})", f"gone AS (SELECT DISTINCT name FROM o WHERE starts_with(origin, '{PREFIX}'))")
    + f"""SELECT DISTINCT 'node' AS part, name FROM o WHERE name NOT IN (SELECT name FROM gone)
UNION SELECT 'edge', src || ' -[' || kind || ']-> ' || dst FROM g WHERE valid_to = {T_MAX} AND NOT starts_with(coalesce(origin, ''), '{PREFIX}') AND src NOT IN (SELECT name FROM gone) AND dst NOT IN (SELECT name FROM gone)""",
    "checkpoint_open_state": _with(_G, _V)
    + f"""SELECT DISTINCT CASE WHEN placeholder THEN 'observe_placeholder' ELSE 'observe_node' END AS op, name, NULL::VARCHAR AS src, NULL::VARCHAR AS dst, NULL::VARCHAR AS kind, observed_at AS ts, origin
FROM v WHERE coalesce(retired_at, {T_MAX}) = {T_MAX} UNION ALL SELECT 'observe_edge', NULL, src, dst, kind, valid_from, origin FROM g WHERE valid_to = {T_MAX}""",
    "byte_estimate": _with(_G, _V, "nm AS (SELECT DISTINCT name FROM v)")
    + f"""SELECT 'nodes' AS part, count(*) AS n, sum(160 + 2 * {_SIZE.format('name')})::BIGINT AS bytes FROM nm
UNION ALL SELECT 'tokens', count(*), sum(28 + {_SIZE.format('t')})::BIGINT FROM (SELECT unnest({_TOKENS}) AS t FROM nm)
UNION ALL SELECT 'versions', count(*), sum(72 + coalesce({_SIZE.format('props')}, 4))::BIGINT FROM v
UNION ALL SELECT 'edges', count(*), (count(*) * 137)::BIGINT FROM g""",
    "export_top_salient": _with(*_EXP) + "SELECT src, dst, kind, valid_from, weight FROM x ORDER BY weight DESC, src, dst, kind, valid_from LIMIT 20",
    "export_concentration": _with(*_EXP) + "SELECT src, count(*) AS live_edges, round(max(weight), 4) AS top_weight, round(max(weight) / nullif(sum(weight), 0), 3) AS concentration FROM x GROUP BY src ORDER BY top_weight DESC, src LIMIT 20",
    "export_paths_1_3": _with(*_EXP, "y AS (SELECT src, dst, max(weight) AS weight FROM x WHERE kind IN ('RUNS_ON', 'CONTAINS') GROUP BY src, dst)",
      f"p1 AS (SELECT '{HUB} > ' || dst AS p, dst AS a, weight AS w, 1 AS hops FROM y WHERE src = '{HUB}')",
      *[f"p{h} AS (SELECT p || ' > ' || dst AS p, dst AS a, w + weight AS w, {h} AS hops FROM p{h - 1} JOIN y ON y.src = a)" for h in (2, 3)])
    + "SELECT p AS dep_path, hops, round(w, 6) AS total_weight FROM (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3) ORDER BY total_weight DESC, dep_path LIMIT 10",
    "node_versions_scd2": _with(_EV,
      "l AS (SELECT *, CASE event_type WHEN 'error' THEN 'C' WHEN 'view' THEN NULL ELSE 'V' || coalesce(props, 'null') END AS lab FROM ev)",
      "w AS (SELECT *, last_value(lab IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM l)",
      "x AS (SELECT *, CASE WHEN event_type = 'view' AND coalesce(was = 'C', TRUE) THEN 'Vnull' ELSE lab END AS lab2 FROM w)",
      "y AS (SELECT *, lag(lab2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM x WHERE lab2 IS NOT NULL)",
      f"z AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY ts, event_id), {T_MAX}) AS ends FROM y WHERE prev IS NULL OR prev <> lab2)")
    + "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, t AS observed_at, ends AS retired_at, substring(lab2, 2) AS state FROM z WHERE lab2 <> 'C'",
    "edge_intervals_islands": _with(_EV,
      "x AS (SELECT *, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN [event_type] WHEN event_type = 'error' THEN ['click', 'view', 'purchase'] ELSE ['purchase'] END AS l FROM ev)",
      "y AS (SELECT user_id, unnest(l) AS what, ts, event_id, t, event_type FROM x)",
      "z AS (SELECT *, coalesce(sum((event_type <> what)::INT) OVER (PARTITION BY user_id, what ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM y)")
    + f"""SELECT user_id, what, arg_min(t, (ts, event_id)) FILTER (event_type = what) AS valid_from, coalesce(max(t) FILTER (event_type <> what), {T_MAX}) AS valid_to
FROM z GROUP BY user_id, what, seg HAVING count(*) FILTER (event_type = what) > 0""",
    "touch_linear": _with(_EV, f"e AS (SELECT user_id, t, {_RCASE} AS r FROM ev WHERE event_type <> 'error')", "l AS (SELECT user_id, max(t) AS tl, min(t) AS tf, count(*) AS n FROM e GROUP BY user_id)")
    + f"SELECT user_id, n, round(0.5 * exp(-1e-6 * (tl - tf) / 1000) + sum({C.alpha} * least(greatest(r, -1), 1) * exp(-1e-6 * (tl - t) / 1000)), 6) AS w, tl AS t_last FROM e JOIN l USING (user_id) GROUP BY user_id, n, tl, tf",
    "touch_ordered_fold": "WITH RECURSIVE " + ",\n".join([_EV,
      f"o AS (SELECT user_id, t, coalesce({_RCASE}, -0.5)::DOUBLE AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM ev)",
      f"f AS (SELECT user_id, k, t, greatest(0.5 + {C.alpha} * r, 0)::DOUBLE AS w FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.t, greatest(f.w * exp(-1e-6 * (greatest(o.t - f.t, 0) / 1000)) + {C.alpha} * o.r, 0) FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)"])
    + " SELECT user_id, k AS n, round(w, 6) AS w, t AS t_last FROM f WHERE (user_id, k) IN (SELECT (user_id, max(k)) FROM o GROUP BY user_id)",
    "homeostat_series": "WITH RECURSIVE " + ",\n".join([
      "o AS (SELECT event_type, value / 100 AS m, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events)",
      f"""f AS (SELECT event_type, k, m AS e, least(greatest(m - {C.setpoint}, {C.integral_min}), {C.integral_max}) AS i FROM o WHERE k = 1
UNION ALL SELECT o.event_type, o.k, {C.ewma_beta} * f.e + {1 - C.ewma_beta} * o.m, least(greatest(f.i + {C.ewma_beta} * f.e + {1 - C.ewma_beta} * o.m - {C.setpoint}, {C.integral_min}), {C.integral_max})
FROM f JOIN o ON o.event_type = f.event_type AND o.k = f.k + 1)"""])
    + f" SELECT event_type, k AS n, round(e, 6) AS ewma, round(i, 6) AS integral, round(least(greatest(1 + {C.k_i} * i, {C.scale_min}), {C.scale_max}), 6) AS lambda_scale FROM f WHERE (event_type, k) IN (SELECT (event_type, max(k)) FROM o GROUP BY event_type)",
    "ratcheted_clock": _with(_EV, "c AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS clock FROM ev)")
    + "SELECT user_id, count(DISTINCT clock) AS n_times, max(clock - t) AS most_back FROM c GROUP BY user_id",
    "request_histogram": "SELECT event_type AS route, count(*) AS le_inf, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{b}" for b in (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000)) + ", round(sum(value), 4) AS total FROM events GROUP BY event_type",
    "spread_two_hop": f"""WITH e AS (SELECT 'nation/' || c_nationkey AS src, 'customer/' || c_custkey AS dst, 0::BIGINT AS f, {T_MAX} AS t FROM customer
  UNION ALL SELECT 'customer/' || o_custkey, 'order/' || o_orderkey, epoch_us(o_orderdate) // 1000, CASE o_orderstatus WHEN 'F' THEN epoch_us(o_orderdate) // 1000 + 7776000000 ELSE {T_MAX} END FROM orders),
w AS (SELECT src, dst, 0.5 * exp(-1e-9 * (greatest({T_STAR} - f, 0) / 1000)) AS w FROM e WHERE f <= {T_STAR} AND {T_STAR} < t),
m AS (SELECT *, sum(w) OVER (PARTITION BY src) AS mass FROM w),
s AS (SELECT 'nation/' || n_nationkey AS node, 1.0::DOUBLE AS act FROM nation WHERE n_regionkey = 1 AND 'nation/' || n_nationkey IN (SELECT src FROM e)),
h1 AS (SELECT dst AS node, sum(d) AS act FROM (SELECT dst, act * 0.9 * mass / (1 + mass) * (w / mass) AS d FROM s JOIN m ON src = node) WHERE d > 1e-6 GROUP BY dst),
h2 AS (SELECT dst AS node, sum(d) AS act FROM (SELECT dst, act * 0.9 * mass / (1 + mass) * (w / mass) AS d FROM h1 JOIN m ON src = node) WHERE d > 1e-6 GROUP BY dst)
SELECT node, round(sum(act), 6) AS act FROM (FROM s UNION ALL FROM h1 UNION ALL FROM h2) GROUP BY node""",
    "semantic_seed_spread": _with("vq AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)",
      "vx AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS sc FROM embeddings, vq)",
      "vt AS (SELECT vec_id FROM vx ORDER BY sc DESC, vec_id LIMIT 4)",
      *_spread(1, f"SELECT DISTINCT 'v' AS query, node FROM (SELECT name AS node FROM nodes WHERE node_id IN (SELECT vec_id FROM vt) UNION ALL SELECT '{HUB}')"))
    + "SELECT node, round(act, 6) AS act FROM a1",
    "spread_batch": _with(*_spread(2, "SELECT name AS query, name AS node FROM names")) + "SELECT query, count(*) AS n_reached, round(sum(incoming), 6) AS mass FROM inc GROUP BY query",
    "order_dependent_hops": _with(*_spread(2),
      "k1 AS (SELECT DISTINCT query, dst AS node FROM s JOIN e ON e.src = s.node)", "d0 AS (SELECT DISTINCT query, node FROM s)",
      "n1 AS (SELECT * FROM k1 WHERE (query, node) NOT IN (SELECT (query, node) FROM d0))", "k2 AS (SELECT DISTINCT query, dst AS node FROM n1 JOIN e ON e.src = n1.node)")
    + "SELECT DISTINCT query, 1 AS hop FROM k1 WHERE (query, node) IN (SELECT (query, node) FROM d0) UNION ALL SELECT DISTINCT query, 2 FROM k2 WHERE (query, node) IN (SELECT (query, node) FROM n1)",
    "trace_retention": "SELECT DISTINCT trace_id, edges_fired FROM traces WHERE trace_id IS NOT NULL ORDER BY trace_id DESC LIMIT 256",
    "trace_retention_kept": "SELECT DISTINCT trace_id, edges_fired FROM traces WHERE trace_id IS NOT NULL ORDER BY trace_id DESC LIMIT 4096",
    "idempotent_dedup": "WITH RECURSIVE " + ",\n".join([_EV,
      "o AS (SELECT user_id, event_type, t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t) AS k FROM ev)",
      """f AS (SELECT user_id, event_type, k, t AS s, 1 AS n FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_type, o.k, CASE WHEN o.t - f.s >= 86400000 THEN o.t ELSE f.s END,
f.n + CASE WHEN o.t - f.s >= 86400000 THEN 1 ELSE 0 END FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.k = f.k + 1)"""])
    + " SELECT user_id, event_type, max(k) AS n_requests, max(n)::BIGINT AS n_executed FROM f GROUP BY user_id, event_type",
}
