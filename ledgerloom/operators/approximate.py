"""Approximate cosine neighbours: hash tables of seeded planes, several probes, exact search where they fail."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.config import TOP_K
from ledgerloom.operators import retrieval
from ledgerloom.scale import settle, small_side

TABLES = 12
#: Rows that a bucket holds on average, about.
BUCKET_ROWS = 64
#: A bucket beyond so many rows is hot; queries that would probe one are answered exactly.
HOT_BUCKET = 1 << 16


def planes(tables: int, bits: int, dim: int, seed: int) -> np.ndarray:
    """Members 1 and -1 by a digest of seed, table, plane and place; ``tables * bits`` rows."""
    out = np.empty((tables * bits, dim))
    for t in range(tables):
        for j in range(bits):
            digests = [hashlib.md5(f"{seed}|{t}|{j}|{i}".encode()).hexdigest() for i in range(dim)]
            out[t * bits + j] = [1.0 if d < "8" else -1.0 for d in digests]
    return out


def _hashed(df: DataFrame, key: str, tables: int, bits: int, dim: int, flips: int, seed: int) -> DataFrame:
    """``(key, embedding, table, bucket)``: the bucket of each table, and those with up to ``flips`` other bits."""
    shared = df.sparkSession.sparkContext.broadcast(planes(tables, bits, dim, seed))
    masks = [sum(1 << j for j in c) for n in range(min(flips, bits) + 1) for c in combinations(range(bits), n)]
    long_arrays = T.ArrayType(T.LongType())
    schema = T.StructType([df.schema[key], T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("codes", long_arrays)])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = retrieval._matrix(batch.column("embedding"))
            sides = (rows @ shared.value.T >= 0).reshape(len(rows), tables, bits)
            codes = sides @ (1 << np.arange(bits, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), retrieval._vectors(rows), retrieval._vectors(codes)], [key, "embedding", "codes"]
            )

    signed = df.select(key, "embedding").mapInArrow(sign, schema).select(key, "embedding", F.posexplode("codes").alias("table", "_code"))
    probes = F.explode(F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: F.col("_code").bitwiseXOR(m)))
    bucket = probes if len(masks) > 1 else F.col("_code")
    return signed.select(key, "embedding", "table", bucket.alias("bucket"))


def approximate_knn(
    queries: DataFrame, index: DataFrame, k: int = TOP_K, query_id: str = "query_id", tables: int = TABLES,
    bits: int | None = None, flips: int = 1, seed: int = 42, hot_bucket: int = HOT_BUCKET, block_rows: int = retrieval.BLOCK_ROWS,
) -> DataFrame:
    """``query_id, idx, distance, similarity, rank, exact``: near rows, most of them the nearest.

    Every row lies in one bucket of each of ``tables`` hash tables, by the sides of ``bits`` planes (by
    default so many that a bucket holds about BUCKET_ROWS rows); a query looks into its own bucket and
    those that differ in up to ``flips`` bits.  Distances of what it meets are exact.  Blocks of a bucket's
    rows meet blocks of its queries by an equi-join, and each meeting returns ``k`` rows per query, never
    all pairs.  Queries that would probe a hot bucket, or meet fewer than ``k`` rows, go through
    :func:`retrieval.knn` (``exact``), so no query goes without its ``k`` rows.  ``idx`` and query key are unique.
    """
    asked = settle(queries.select(F.col(query_id).alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")))
    schema = retrieval._candidate_schema(queries, query_id, index)
    head, n = index.select("embedding").first(), index.count()
    if head is None or asked.isEmpty():
        return retrieval._no_answers(schema, queries).withColumn("exact", F.lit(True))
    bits = max(1, ceil(log2(max(1, n / BUCKET_ROWS)))) if bits is None else bits
    placed = settle(_hashed(index, "idx", tables, bits, len(head[0]), 0, seed))
    probing = settle(_hashed(asked, "query_id", tables, bits, len(head[0]), flips, seed))
    keys = ["table", "bucket"]
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("_rows"))
    hot = small_side(sizes.where(F.col("_rows") > hot_bucket).select(*keys))
    crowded = small_side(probing.join(hot, keys, "left_semi").select("query_id").distinct())
    calm = probing.join(crowded, "query_id", "left_anti")
    met = _meetings(calm, placed, keys, k, schema, block_rows)
    # A row met in several tables counts once.
    near = settle(retrieval._best_overall(met.dropDuplicates(["query_id", "idx"]), k))
    full = near.where(F.col("rank") == k).select("query_id")
    left = asked.join(full, "query_id", "left_anti")
    exact = retrieval.knn(left, index, k).select("query_id", "idx", "distance", "rank", F.lit(True).alias("exact"))
    found = near.join(full, "query_id", "left_semi").select("query_id", "idx", "distance", "rank", F.lit(False).alias("exact"))
    return found.unionByName(exact).withColumn("similarity", 1 - F.col("distance"))


def _meetings(asking: DataFrame, rows: DataFrame, keys: list[str], k: int, schema: T.StructType, block_rows: int) -> DataFrame:
    """The ``k`` best rows of every block of a bucket for each query of a block of those that probe it."""

    def blocked(df: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
        counts = df.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(f"{name}s"))
        own = F.pmod(F.xxhash64(key), F.col(f"{name}s")).cast("int")
        return df.join(counts, keys).withColumn(name, own).drop(f"{name}s"), counts

    sheets, n_sheets = blocked(asking, "query_id", "sheet")
    blocks, n_blocks = blocked(rows, "idx", "block")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(f"{name}s") - 1)).alias(name)
    left = sheets.join(n_blocks, keys).select("query_id", "embedding", *keys, every("block"), "sheet")
    right = blocks.join(n_sheets, keys).select("idx", "embedding", *keys, "block", every("sheet"))
    left = left.toDF("query_id", "embedding", "_table", "_bucket", "_block", "_sheet")
    together = left.groupBy("_table", "_bucket", "_block", "_sheet").cogroup(right.groupBy(*keys, "block", "sheet"))
    return together.applyInArrow(retrieval._comparer(k, schema), schema)
