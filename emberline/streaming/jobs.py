"""Continuous ingestion and feedback as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberline.config import Config
from emberline.sources.wal import _OP, parse_lines


def _count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, file, block, line): lines counted from 0 in their block, which one task reads from its start, in order."""
    seen: dict[tuple, int] = {}
    for batch in batches:
        at = pd.DataFrame({c: batch.column(c).to_pandas() for c in ("file", "block")})
        line = at.groupby(["file", "block"], sort=False).cumcount().to_numpy(dtype=np.int64, copy=True)
        for key, rows in at.groupby(["file", "block"], sort=False).indices.items():
            line[rows] += seen.get(key, 0)
            seen[key] = seen.get(key, 0) + len(rows)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(line)], [*batch.schema.names, "line"])


def tail_log(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """Operations of log segments as they arrive in ``path``: framed or bare lines, bad ones with status 'bad'.

    Each segment is a file that does not change once it is there; the checkpoint
    keeps the offsets, so a restart goes on where it stopped. ``ord`` (file, block,
    line) is the order of the log, as :func:`wal.read_wal` reads it, whatever the
    order of arrival. What a bad line says is not to be folded.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.mapInArrow(_count_lines, "value string, file string, block long, line long")
    parsed = parse_lines(lines.withColumn("line", F.struct("file", "block", "line"))).where("status IN ('framed', 'legacy', 'bad')")
    return parsed.select("line", "status", F.from_json("json", _OP).alias("o")).select(
        F.col("line").alias("ord"), "status", "o.op", "o.name", F.coalesce("o.asset_type", "o.inferred_type").alias("type"),
        F.when(F.col("o.op") == "observe_node", F.coalesce(F.to_json("o.props"), F.lit("null"))).alias("props"),
        "o.src", "o.dst", "o.kind", "o.ts", "o.origin",
    )


def append_batches(stream: DataFrame, table: str, checkpoint: str):
    """Append each micro-batch to a table exactly once: a batch is written under its own id, so a repeated one replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def touch_states(touches: DataFrame, config: Config, rate: float) -> DataFrame:
    """(edge_key, n, w, t_last) after each batch of touches (edge_key, t, seq, r), as a stream of updates.

    One state per edge; a batch's touches of an edge are folded in the order of
    (t, seq). A late touch is not dropped: its decay counts as none and its time is
    taken, as the fold over a stored table does.
    """
    out = "edge_key string, n long, w double, t_last long"
    state = "n long, w double, t_last long"
    alpha, clip, w0 = config.alpha, config.r_clip, config.w0

    def fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        n, w, last = held.get if held.exists else (0, w0, None)
        rows = pd.concat(list(batches)).sort_values(["t", "seq"])
        for t, r in zip(rows["t"], rows["r"]):
            if r != r or r in (float("inf"), float("-inf")):
                continue
            gone = max(t - last, 0) / 1000 if last is not None else 0.0
            w = max(w * exp(-rate * gone) + alpha * min(max(r, -clip), clip), 0.0)
            n, last = n + 1, int(t)
        held.update((n, w, last))
        yield pd.DataFrame({"edge_key": [key[0]], "n": [n], "w": [w], "t_last": [last]})

    return touches.groupBy("edge_key").applyInPandasWithState(fold, out, state, "update", GroupStateTimeout.NoTimeout)


def once_per_day(requests: DataFrame, key: list[str], time: str = "at") -> DataFrame:
    """Requests without repeats of a key within 24 hours; state older than that is forgotten."""
    return requests.withWatermark(time, "24 hours").dropDuplicatesWithinWatermark(key)


def rate_windows(requests: DataFrame, limit: int, millis: int = 60_000) -> DataFrame:
    """(db, t, allowed): a counter per database whose window begins with the first request after the last one ended."""
    out, state = "db string, t long, allowed boolean", "begun long, n long"

    def admit(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        begun, n = held.get if held.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("t")
        allowed = []
        for t in rows["t"]:
            if begun is None or t - begun >= millis:
                begun, n = int(t), 0
            n += 1
            allowed.append(n <= limit)
        held.update((begun, n))
        yield pd.DataFrame({"db": key[0], "t": rows["t"].to_numpy(), "allowed": allowed})

    return requests.groupBy("db").applyInPandasWithState(admit, out, state, "append", GroupStateTimeout.NoTimeout)
