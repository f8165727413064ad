"""Exact histogram of encoded lengths, and what it answers for every context limit."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.shared import cut, text_or_empty

#: Split pattern of the byte-level vocabulary (fixed value of the public tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Lengths that one window of the suffix sums spans.
SPAN = 128


@functools.lru_cache(maxsize=2)
def _encoding(table: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, table.splitlines())}
    return tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_count(
    df: DataFrame, text_column: str = "text", tokenizer: str = TOKENIZER, name: str = "n_tokens"
) -> DataFrame:
    """``df`` with the number of tokens of the whole text; null and empty texts have 0.

    The vocabulary file is read on the driver and broadcast (its size is fixed).  Special tokens in a
    text count as ordinary text.
    """
    table = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(table.value)
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(text)) for text in texts], dtype="int64")

    return df.withColumn(name, count(text_or_empty(text_column)))


def length_histogram(df: DataFrame, length_column: str = "n_tokens") -> DataFrame:
    """One row per length that occurs, with exact sums over all shorter and all longer documents.

    ``(length, documents, documents_above, tokens_above, documents_at_most, tokens_at_most,
    all_documents, all_tokens, truncated_total)``: ``truncated_total`` is the number of tokens that
    are left if every document is cut to ``length``.  Null lengths count as 0; an empty table gives no
    rows.  Suffix sums run within spans of lengths and over the spans' sums, so no task orders all.
    """
    length = F.coalesce(F.col(f"`{length_column}`").cast("bigint"), F.lit(0))
    # Used twice below; there are few lengths, and texts must not be counted again.
    counts = cut(df.select(length.alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("documents")))
    counts = counts.withColumn("_span", F.floor(F.col("length") / SPAN)).withColumn("_tokens", F.col("length") * F.col("documents"))
    after = W.partitionBy("_span").orderBy("length").rowsBetween(1, W.unboundedFollowing)
    spans = counts.groupBy("_span").agg(F.sum("documents").alias("_docs"), F.sum("_tokens").alias("_toks"))
    later = W.orderBy("_span").rowsBetween(1, W.unboundedFollowing)
    everything = W.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    spans = spans.select(
        "_span",
        zero(F.sum("_docs").over(later)).alias("_docs_later"),
        zero(F.sum("_toks").over(later)).alias("_toks_later"),
        F.sum("_docs").over(everything).alias("all_documents"),
        F.sum("_toks").over(everything).alias("all_tokens"),
    )
    return (
        counts.withColumn("documents_above", zero(F.sum("documents").over(after)))
        .withColumn("tokens_above", zero(F.sum("_tokens").over(after)))
        .join(spans, "_span")
        .select(
            "length", "documents",
            (F.col("documents_above") + F.col("_docs_later")).alias("documents_above"),
            (F.col("tokens_above") + F.col("_toks_later")).alias("tokens_above"),
            "all_documents", "all_tokens",
        )
        .select(
            "length", "documents", "documents_above", "tokens_above",
            (F.col("all_documents") - F.col("documents_above")).alias("documents_at_most"),
            (F.col("all_tokens") - F.col("tokens_above")).alias("tokens_at_most"),
            "all_documents", "all_tokens",
            (F.col("all_tokens") - F.col("tokens_above") + F.col("length") * F.col("documents_above")).alias("truncated_total"),
        )
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``(limit, all_tokens, truncated_total, truncated_documents)`` for any context limits."""
    asked = histogram.select("length", "documents", F.explode(F.array(*[F.lit(int(n)) for n in limits])).alias("limit"))
    return asked.groupBy("limit").agg(
        F.sum(F.col("length") * F.col("documents")).alias("all_tokens"),
        F.sum(F.least("length", "limit") * F.col("documents")).alias("truncated_total"),
        F.sum(F.when(F.col("length") > F.col("limit"), F.col("documents")).otherwise(0)).alias("truncated_documents"),
    )


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, length)``: the smallest length that at least that share of all documents does not exceed."""
    asked = histogram.select("length", "documents_at_most", "all_documents", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    enough = F.col("documents_at_most") >= F.col("share") * F.col("all_documents")
    return asked.groupBy("share").agg(F.min(F.when(enough, F.col("length"))).alias("length"))
