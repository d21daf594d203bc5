"""Scalar expressions over times, intervals and learned weights."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.common import T_MAX


def alive(start: str | Column, end: str | Column, t: int | Column) -> Column:
    """Whether the half-open interval holds ``t``; a null end never comes."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    t = F.lit(t) if isinstance(t, int) else t
    return (start <= t) & (t < F.coalesce(end, F.lit(T_MAX)))


def millis(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, rounded down, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def by_key(values: Mapping[str, float], key: str | Column, default: float) -> Column:
    """The value configured for a key. Tables of a configuration are small, so this stays an expression."""
    key = F.col(key) if isinstance(key, str) else key
    out = None
    for k, v in sorted(values.items()):
        out = F.when(key == k, float(v)) if out is None else out.when(key == k, float(v))
    return F.lit(float(default)) if out is None else out.otherwise(float(default))


def decay_rate(kind: str, lambda_base: float, beta: float, authority: Mapping[str, float], default: float = 0.0) -> Column:
    return F.lit(lambda_base) / (1 + F.lit(beta) * by_key(authority, kind, default))


def effective(w: str, t_last: str, rate: Column, t: int, scale: float = 1.0, dead: Column | None = None) -> Column:
    """The stored weight decayed from its last touch to ``t``; time before the touch counts as none."""
    seconds = F.greatest(F.lit(t) - F.col(t_last), F.lit(0)) / 1000
    value = F.col(w) * F.exp(-rate * scale * seconds)
    return value if dead is None else F.when(dead, 0.0).otherwise(value)


def trust(origin: str, by_prefix: Mapping[str, float]) -> Column:
    """Trust of the longest configured prefix of the origin; 1 without one, never below 0."""
    origin_ = F.coalesce(F.col(origin), F.lit(""))
    out = None
    for prefix in sorted(by_prefix, key=lambda p: (-len(p), p)):
        value = max(0.0, float(by_prefix[prefix]))
        test = origin_.startswith(prefix)
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit(1.0) if out is None else out.otherwise(1.0)


def name_tokens(name: str) -> Column:
    """Lower-case alphanumeric runs of at least two bytes."""
    return F.filter(F.split(F.lower(name), r"[^\p{IsAlphabetic}\p{N}]+"), lambda x: F.octet_length(x) >= 2)


def infer_type(name: str) -> Column:
    """service/collection of a full resource name, the collection being the last but one segment."""
    parts = F.split(F.regexp_replace(name, "^/+", ""), "/")
    n = F.size(parts)
    return F.when(n >= 3, F.concat_ws("/", parts[0], F.element_at(parts, -2))).otherwise(F.concat(parts[0], F.lit("/unknown")))
