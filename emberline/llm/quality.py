"""Text quality statistics and the prose rule, for documents of any length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.common import spread_rows
from emberline.llm.textstats import COUNTS, JUDGED, PLAIN, STRETCH, UNSPACED_WORD, count_texts, judge, prose_rule, sentence_words

#: Characters of a piece; a longer text is counted piece by piece. No result depends on it.
CHUNK_CHARS = 1 << 13

_DOUBLES = pa.list_(pa.float64())
_PIECE = pa.schema(
    [("_id", pa.int64()), ("_row", pa.int64()), ("_chunk", pa.int64()), *[(c, pa.float64()) for c in COUNTS]]
    + [("_head", _DOUBLES), ("_tail", _DOUBLES), ("_cut", pa.bool_())]
)
_PIECE_DDL = ", ".join(["_id long", "_row long", "_chunk long", *[f"{c} double" for c in COUNTS], "_head array<double>", "_tail array<double>", "_cut boolean"])


def _vectors(values: np.ndarray, missing: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.ravel()), mask=pa.array(missing))


def _pieces(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for rows, chunks, counted, whole in count_texts(batch.column(2).cast(pa.binary()).to_pylist(), chunk):
                values = np.hstack([counted.plain, counted.judged])
                known = [pa.array(ids[rows]), pa.array(places[rows]), pa.array(chunks)]
                ends = [_vectors(counted.head, whole), _vectors(counted.tail, whole), pa.array(counted.cut, mask=whole)]
                yield pa.RecordBatch.from_arrays([*known, *[pa.array(v) for v in values.T], *ends], schema=_PIECE)

    return run


def text_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row of counts per document: (doc_id, counts).

    A text is cut into pieces of ``chunk_chars``, and each piece is counted with as
    many characters around it as its counts can depend on. The counts of pieces are
    summed map-side, then per document, which is a tree of sums. A stretch of text
    that a cut goes through is given as sums on both sides, which are added up in the
    pieces' order before the stretch is judged. So every count is that of the whole
    text, wherever it is cut. A text's pieces are counted in the task that reads it,
    which keeps the numbers of its shingles until it knows how many differ.
    """
    docs = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    docs = spread_rows(docs, "_id").select("_id", F.monotonically_increasing_id().alias("_row"), "_text")
    return merge_pieces(docs.mapInArrow(_pieces(chunk_chars), _PIECE_DDL)).withColumnRenamed("_id", doc_id)


def _pick(test: Column, value: Column) -> Column:
    return F.when(test, value).otherwise(0.0)


def merge_pieces(pieces: DataFrame) -> DataFrame:
    end = F.when(F.col("_head").isNotNull(), F.struct("_row", "_chunk", "_head", "_tail", "_cut"))
    sums = pieces.groupBy("_id").agg(*[F.sum(c).alias(c) for c in COUNTS], F.array_sort(F.collect_list(end)).alias("_ends"))
    zeros = lambda names: F.array(*[F.lit(0.0)] * len(names))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)

    def step(state: Column, e: Column) -> Column:
        def put_together(stretch: Column) -> Column:
            said = F.array(*[x.cast("double") for x in judge([stretch[i] for i in range(len(STRETCH))], _pick)])
            return F.struct(F.when(e["_cut"], e["_tail"]).otherwise(stretch).alias("open"), F.when(e["_cut"], plus(state["judged"], said)).otherwise(state["judged"]).alias("judged"))

        # an array of one gives the sum of what lies on both sides of a cut a name
        return F.transform(F.array(plus(state["open"], e["_head"])), put_together)[0]

    none = F.struct(zeros(STRETCH).alias("open"), zeros(JUDGED).alias("judged"))
    across = F.when(F.size("_ends") > 0, F.aggregate("_ends", none, step)["judged"]).otherwise(zeros(JUDGED))
    sums = sums.withColumn("_across", across)
    judged = [(F.col(c) + F.col("_across")[i]).alias(c) for i, c in enumerate(JUDGED)]
    return sums.select("_id", *PLAIN, *judged)


def quality(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, mean_word_length, symbol_ratio, end_punct_share, bullet_share, common_share, sentence_share, repeated_share, is_prose).

    Words are runs of letters of any script; in scripts without spaces about two
    characters make one. ``common_share`` is of function words of six languages,
    ``repeated_share`` that of runs of five words which stand earlier in the text.
    ``is_prose`` is whether the text is made up mostly of sentences, or is a short
    phrase of natural words; lists, tables, and junk (no words, words in no order,
    one thing over and over) are not. What a sentence is does not depend on the
    language: see :func:`emberline.llm.textstats.judge`.

    Defined cases: a null or empty text has no words, ratios of 0 and is no prose;
    a null ``doc_id`` gives no row; the counts of a repeated ``doc_id`` are added up; a
    text of any length is read whole; an empty table gives no rows; other columns are
    not read.
    """
    c = text_counts(df, doc_id, text, **options)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    counts = {name: F.col(name) for name in COUNTS}
    return c.select(
        doc_id,
        (F.col("n_words") + F.ceil(F.col("n_unspaced") / UNSPACED_WORD)).cast("long").alias("n_words"),
        share(F.col("n_word_chars"), F.col("n_words")).alias("mean_word_length"),
        share(F.col("n_symbols"), F.col("n_chars") - F.col("n_spaces")).alias("symbol_ratio"),
        share(F.col("n_end_lines"), F.col("n_lines")).alias("end_punct_share"),
        share(F.col("n_bullet_lines"), F.col("n_lines")).alias("bullet_share"),
        share(F.col("n_common"), F.col("n_words")).alias("common_share"),
        share(sentence_words(counts, _pick), F.col("unit_words")).alias("sentence_share"),
        share(F.col("n_shingles") - F.col("n_distinct_shingles"), F.col("n_shingles")).alias("repeated_share"),
        prose_rule(counts, _pick).alias("is_prose"),
    )
