"""A simple graph out of texts: a session mentions terms, terms occur together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: what a term is, and terms that say nothing
TERM = r"[A-Za-z0-9_./-]{3,}"
STOP = (
    "the", "and", "for", "what", "did", "was", "our", "about", "with", "that",
    "this", "have", "has", "are", "you", "your", "how", "why", "when",
)


def session_terms(sessions: DataFrame, session: str, text: str, max_terms: int = 16) -> DataFrame:
    """(session, terms): the first ``max_terms`` distinct terms of each session's text, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))
    terms = F.slice(F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP])), 1, max_terms)
    return sessions.where(F.col(session).isNotNull()).select(F.col(session).alias("session"), F.coalesce(terms, F.array().cast("array<string>")).alias("terms"))


def session_edges(terms: DataFrame) -> DataFrame:
    """(src, dst, kind): MENTIONS from a session to its terms, CO_OCCURS between two terms of one session.

    A session has at most ``max_terms`` terms, so its pairs are bounded.
    """
    name = lambda t: F.concat(F.lit("term/"), t)
    mentions = terms.select(F.concat(F.lit("session/"), F.col("session").cast("string")).alias("src"), F.explode("terms").alias("t")).select("src", name(F.col("t")).alias("dst"), F.lit("MENTIONS").alias("kind"))
    one = terms.select("session", "terms", F.explode("terms").alias("a"))
    both = one.select("a", F.explode("terms").alias("b")).where("a <> b")
    return mentions.unionByName(both.select(name(F.col("a")).alias("src"), name(F.col("b")).alias("dst"), F.lit("CO_OCCURS").alias("kind")).distinct())
