"""Queries p2, p7, p8 and p9 over the project's tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.common import load, written
from emberline.llm import cooccur, mixing, packing, quality, textstats, tokens

#: A pair counts from so many traces, at so many times what chance gives.
MIN_TRACES, MIN_LIFT = 5, 3
#: Most capacities that are read; more are refused.
MOST_SIZES = 1000


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccur.cooccurrence(load(spark, sf_dir, "traces"), "db", "trace_id", "surfaced", "node", min_count=MIN_TRACES)
    return pairs.select(F.col("grp").alias("db"), "node_a", "node_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


def p2_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair that surfaces together, once or more; p2_pairs has only those in MIN_TRACES traces."""
    pairs = cooccur.cooccurrence(load(spark, sf_dir, "traces"), "db", "trace_id", "surfaced", "node", min_count=1)
    return pairs.select(F.col("grp").alias("db"), "node_a", "node_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccur.cooccurrence(load(spark, sf_dir, "traces"), "db", "trace_id", "surfaced", "node", min_count=MIN_TRACES)
    return cooccur.lift_at_least(pairs, MIN_LIFT).select(F.col("grp").alias("db"), "node_a", "node_b")


def _sizes(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    rows = load(spark, sf_dir, "pack_sizes").select("pack_id", "capacity_tokens").limit(MOST_SIZES + 1).collect()
    if len(rows) > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} capacities")
    return [tuple(r) for r in rows]


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(tokens.with_tokens(load(spark, sf_dir, "documents"), "doc_id"), "tokens")
    return packing.pack(docs, _sizes(spark, sf_dir))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document goes, for every capacity."""
    return _packed(spark, sf_dir)


def p7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the packing must keep, counted over all its rows."""
    docs = written(tokens.with_tokens(load(spark, sf_dir, "documents"), "doc_id"), "tokens")
    sizes = _sizes(spark, sf_dir)
    return packing.broken_rules(written(packing.pack(docs, sizes), "packed"), docs, sizes)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir), _sizes(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(tokens.with_tokens(load(spark, sf_dir, "documents"), "doc_id", "source"), "tokens")
    return mixing.mix(docs, load(spark, sf_dir, "mix_targets"))


def p8_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection, in its order."""
    return _mixed(spark, sf_dir)


def p8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the selection must keep, counted over all its rows."""
    docs = written(tokens.with_tokens(load(spark, sf_dir, "documents"), "doc_id", "source"), "tokens")
    targets = load(spark, sf_dir, "mix_targets")
    return mixing.broken_rules(written(mixing.mix(docs, targets), "mix"), docs, targets)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_mixed(spark, sf_dir), load(spark, sf_dir, "mix_targets"))


def p9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(load(spark, sf_dir, "documents"))


def p9_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that SQL can count, too."""
    q = quality.quality(load(spark, sf_dir, "documents"))
    ratios = ("mean_word_length", "symbol_ratio", "end_punct_share", "common_share")
    return q.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ratios])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(load(spark, sf_dir, "documents")).where("NOT is_prose").select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_pairs, p2_all_pairs, p7_packed, p7_fill, p7_rules, p8_mixed, p8_shares, p8_rules, p9_found, p9_quality, p9_ratios)}

_PAIRS = """
WITH m AS (SELECT DISTINCT db, trace_id, unnest(surfaced).node AS node FROM traces WHERE db IS NOT NULL AND trace_id IS NOT NULL),
k AS (SELECT * FROM m WHERE node IS NOT NULL),
n AS (SELECT db, count(DISTINCT trace_id) AS n FROM traces WHERE db IS NOT NULL GROUP BY db),
c AS (SELECT db, node, count(*) AS c FROM k GROUP BY db, node),
p AS (SELECT a.db, a.node AS node_a, b.node AS node_b, count(*) AS n_ab FROM k a JOIN k b ON a.db = b.db AND a.trace_id = b.trace_id AND a.node < b.node
  GROUP BY a.db, a.node, b.node HAVING count(*) >= 5),
o AS (SELECT p.db, node_a, node_b, n_ab, x.c AS n_a, y.c AS n_b, n FROM p JOIN n ON p.db = n.db
  JOIN c x ON x.db = p.db AND x.node = node_a JOIN c y ON y.db = p.db AND y.node = node_b)
"""

_ALL_PAIRS = _PAIRS.replace("HAVING count(*) >= 5", "")

SQL = {
    "p2_all_pairs": _ALL_PAIRS + "SELECT db, node_a, node_b, n_ab, n_a, n_b, n, round(n_ab * n / (n_a::DOUBLE * n_b), 6) AS lift FROM o",
    "p2_pairs": _PAIRS + "SELECT db, node_a, node_b, n_ab, n_a, n_b, n, round(n_ab * n / (n_a::DOUBLE * n_b), 6) AS lift FROM o",
    "p2_found": _PAIRS + "SELECT db, node_a, node_b FROM o WHERE n_ab * n >= 3 * n_a * n_b",
}

_UNSPACED = r"\x{3005}-\x{3007}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}"
_BLANK = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_CLOSING = rf"""[\x22'”’»)\]）」』*_~\x{{200B}}{_BLANK}]*$"""
_RATIOS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
u AS (SELECT doc_id, t, regexp_replace(t, '[{_UNSPACED}]', ' ', 'g') AS s FROM d),
w AS (SELECT doc_id, t, list_filter(regexp_extract_all(s, '[\p{{L}}\p{{M}}]+'), lambda x: regexp_matches(x, '\p{{L}}')) AS words FROM u),
c AS (SELECT doc_id, len(words) AS n, list_sum(list_transform(words, lambda x: len(regexp_replace(x, '\p{{M}}', '', 'g')))) AS letters,
  len(list_filter(words, lambda x: lower(x) IN (%s))) AS common,
  len(regexp_replace(t, '[^{_UNSPACED}]', '', 'g')) AS unspaced,
  len(regexp_replace(t, '[{_BLANK}]', '', 'g')) AS solid,
  len(regexp_replace(t, '[{_BLANK}\p{{L}}\p{{M}}\p{{Nd}}]', '', 'g')) AS symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[{_BLANK}]', '', 'g') <> '') AS lines FROM w)
SELECT doc_id, n + ceil(unspaced / 2.2)::BIGINT AS n_words,
  round(CASE WHEN n > 0 THEN letters / n ELSE 0 END, 6) AS mean_word_length,
  round(CASE WHEN solid > 0 THEN symbols / solid ELSE 0 END, 6) AS symbol_ratio,
  round(CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: regexp_matches(regexp_replace(x, '{_CLOSING.replace("'", "''")}', ''), '[.!?…‽؟۔।॥։።፧᠃。！？｡．]$'))) / len(lines) ELSE 0 END, 6) AS end_punct_share,
  round(CASE WHEN n > 0 THEN common / n ELSE 0 END, 6) AS common_share
FROM c
"""

SQL |= {
    "p7_rules": """
SELECT pack_id, (SELECT count(DISTINCT doc_id) FROM documents) AS n_docs, 0 AS lost_docs, 0 AS lost_tokens, 0 AS over_capacity, 0 AS needless_cuts, 0 AS pieces_apart
FROM pack_sizes WHERE capacity_tokens >= 1""",
    "p8_rules": "SELECT source, 0 AS over_used, 0 AS foreign, 0 AS share_off FROM mix_targets WHERE source IS NOT NULL AND target_share > 0",
    "p9_ratios": _RATIOS % ", ".join("'" + w + "'" for w in sorted(textstats.COMMON)),
}
