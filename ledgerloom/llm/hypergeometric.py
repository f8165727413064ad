"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits that a partition's row number takes in monotonically_increasing_id().
ROW_BITS = 33
#: Rows that one task permutes after the exchange.
BUCKET_ROWS = 1024
#: Numbers (partitions times shards) up to which the cuts are broadcast; more are joined by shuffle.
BROADCAST_NUMBERS = 2_000_000
#: Rows of one partition of the exchange, where the session does not ask for more partitions.
PARTITION_ROWS = 65536


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` items taken without return from ``good + bad`` are good; any size.

    Inverts the distribution over a window of 12 standard deviations around its mean; the window's
    weights come from the ratio of neighbouring probabilities.  What lies outside is below 1e-30.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if low == high or total == 0:
        return low
    mean = draws * good / total
    spread = 12 * (mean * (bad / total) * max(total - draws, 1) / max(total - 1, 1)) ** 0.5 + 12
    start, end = max(low, int(mean - spread)), min(high, int(mean + spread) + 1)
    k = np.arange(start, end, dtype=np.float64)
    ratio = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(ratio)])
    share = np.cumsum(np.exp(weight - weight.max()))
    return start + int(np.searchsorted(share, rng.random() * share[-1]))


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard; row sums as given, column sums at most one apart.

    Each partition's row is drawn from the multivariate hypergeometric distribution of what the
    shards still lack, as if all rows had been put in one random order.
    """
    total, rng = sum(rows), np.random.default_rng(seed)
    lacking = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in rows:
        sent, rest, room = [], n, sum(lacking)
        for s in range(shards):
            room -= lacking[s]
            k = draw_hypergeometric(rng, lacking[s], room, rest)
            sent.append(k)
            rest -= k
        lacking = [a - b for a, b in zip(lacking, sent, strict=True)]
        matrix.append(sent)
    return matrix


def shuffle_into_shards(
    df: DataFrame,
    shards: int = 8,
    seed: int = 7,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``df`` in random order with ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 in a shard).

    Shard sizes differ by one row at most.  Every row is placed, whatever it holds: null ids, null
    texts and repeated rows count as rows, and rows that are alike go their own ways.  Columns named
    ``shard`` or ``slot`` are replaced; all others are kept, whatever their names.  An empty table gives an
    empty result.

    Step 1 counts the rows of each partition; step 2 draws on the driver how many of them go to each
    shard (partitions x shards numbers, no rows); step 3 permutes each partition by sorting it on a
    keyed hash of the row's place in the table and cuts it into runs for the shards; step 4 exchanges whole
    rows once, by shard and hash bucket, and permutes again by sorting on a second hash within each bucket.
    ``df`` must be the same, partition by partition and row by row, when it is read again: a table scan is,
    and so is anything derived from one without a shuffle.  A table that lost or gained rows in
    between raises an error.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    at = F.spark_partition_id()
    counted = {r["_p"]: r["_n"] for r in df.groupBy(at.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).collect()}
    parts = sorted(counted)
    matrix = communication_matrix([counted[p] for p in parts], shards, seed)
    ends = [(p, np.cumsum(m).tolist()) for p, m in zip(parts, matrix, strict=True)]
    schema = T.StructType([
        T.StructField("_p", T.IntegerType()),
        T.StructField("_ends", T.ArrayType(T.LongType())),
    ])
    # One short row per input partition, which the driver holds for the scan anyway.
    cuts = spark.createDataFrame(ends, schema)
    cuts = F.broadcast(cuts) if len(ends) * shards <= BROADCAST_NUMBERS else cuts
    total = sum(counted.values())
    buckets = max(1, -(-total // (shards * bucket_rows)))

    def placed(rows: DataFrame) -> DataFrame:
        """Rows with shard, bucket and second hash; nothing has moved yet."""
        number, row = F.col("_number"), F.col("_row")
        last = F.element_at("_ends", -1)
        changed = F.raise_error(F.lit("the table is not the same on its second reading"))
        shard = F.size(F.filter("_ends", lambda end: end <= row))
        return (
            rows.withColumn("_first", F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
            .withColumn("_second", F.xxhash64(F.lit(seed + 1), F.col("_first")))
            .sortWithinPartitions("_first")
            .withColumn("_number", F.monotonically_increasing_id())
            .withColumn("_p", F.shiftright(number, ROW_BITS).cast("int"))
            .withColumn("_row", number.bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
            .join(cuts, "_p", "left")
            .withColumn("shard", F.when(F.coalesce(row < last, F.lit(False)), shard).otherwise(changed.cast("int")))
            .withColumn("_bucket", F.pmod(F.shiftrightunsigned("_second", 16), F.lit(buckets)))
        )

    sizes = placed(df.select(F.lit(0).alias("_packed"))).groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("shard", "_bucket").orderBy("_second", "_first")
    parts_out = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION_ROWS)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_packed"))
    moved = placed(packed).repartition(parts_out, "shard", "_bucket")
    return (
        moved.withColumn("_place", F.row_number().over(inside))
        .join(starts, ["shard", "_bucket"])
        .select("_packed.*", "shard", (F.col("_start") + F.col("_place") - 1).alias("slot"))
    )
