"""Operator 1: token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm import bpe


def token_count(text: Column, vocabulary: str) -> Column:
    """Tokens of each text (null counts as empty: 0) under a byte-level BPE file.

    ``vocabulary`` is a path that exists on every executor. Texts travel in Arrow batches; each
    worker keeps a bounded store of merged pieces, and nothing is shared between rows.
    """

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        count = bpe.loaded(vocabulary).count
        return pa.array([count(t.as_py()) for t in texts], pa.int64())

    return counted(F.coalesce(text.cast("string"), F.lit("")))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    Null text is empty (0 bytes, 0 tokens). Repeated rows and ties each keep their own row, an
    empty table gives no rows, and other columns of the input, whatever their names, are not
    read. The work is one pass without a shuffle.
    """
    counts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col(text_col), vocabulary).alias("n_tokens"),
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
