"""Helpers that keep joins, ranks and lineage bounded whatever the data size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
RANK_ROWS = 1_000_000
#: Strata beyond this size are cut by a digit of the hash before anything is ranked.
CUT_ROWS = 1_024


def small_side(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Return ``df`` ready to be broadcast if, and only if, it is proven small.

    At most ``max_rows + 1`` rows are fetched.  A table within both limits comes
    back as a local relation with a broadcast hint, so later plans neither
    recompute it nor shuffle the other side.  A larger one comes back unchanged
    and is joined by shuffle, where adaptive execution splits skewed keys.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > max_bytes:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(table, schema=df.schema))


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session, which has no other machine, may do without the setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[[^,]*(,\s*\d+)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="ledgerloom-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    root = shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for rows that several passes read.

    Unlike a checkpoint it is compressed, and every pass reads only the columns it needs.
    """
    path = f"{shared_root(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_key(column: Column | str, seed: int) -> Column:
    """Reproducible pseudo-random sort key: hex digest of seed and value."""
    value = F.col(column) if isinstance(column, str) else column
    return F.md5(F.concat(F.lit(f"{seed}|"), value.cast("string")).cast("binary"))


def bucket_digits(group_rows: int, max_rows: int = RANK_ROWS) -> int:
    """Leading hex digits of a hash key that cut ``group_rows`` below ``max_rows``."""
    digits = 0
    while group_rows > max_rows * 16**digits:
        digits += 1
    return digits


def quota_thresholds(
    keys: DataFrame, quotas: DataFrame, largest: int, max_rows: int = RANK_ROWS
) -> DataFrame:
    """``(stratum, quota, threshold)``: the hash key at the given ranks of a stratum.

    ``keys`` holds ``(stratum, key)`` for every row, ``quotas`` any number of
    ranks per stratum (a short table), ``largest`` the biggest stratum's size.
    No task ever sorts a whole hot stratum: above ``max_rows`` rows it is cut by
    the leading digits of the hash, and only the pieces in which a quota falls
    are ranked, so few of the keys are shuffled.  Rank 0 gives the empty string,
    which is below every key.
    """
    digits = max(bucket_digits(largest, max_rows), int(largest > CUT_ROWS))
    if digits == 0:
        rank = F.row_number().over(W.partitionBy("stratum").orderBy("key"))
        ranked = keys.withColumn("quota", rank.cast("bigint"))
        found = ranked.join(small_side(quotas.distinct()), ["stratum", "quota"])
    else:
        keys = keys.withColumn("_piece", F.substring("key", 1, digits))
        upto = W.partitionBy("stratum").orderBy("_piece")
        crossing = small_side(
            keys.groupBy("stratum", "_piece")
            .count()
            .withColumn("_upto", F.sum("count").over(upto))
            .join(quotas.distinct(), "stratum")
            .where(F.col("_upto") >= F.col("quota"))
            .where(F.col("_upto") - F.col("count") < F.col("quota"))
            .select(
                "stratum",
                "_piece",
                "quota",
                (F.col("quota") - F.col("_upto") + F.col("count")).alias("_rank"),
            )
        )
        pieces = small_side(crossing.select("stratum", "_piece").distinct())
        rank = F.row_number().over(W.partitionBy("stratum", "_piece").orderBy("key"))
        ranked = keys.join(pieces, ["stratum", "_piece"], "left_semi")
        ranked = ranked.withColumn("_rank", rank.cast("bigint"))
        found = ranked.join(crossing, ["stratum", "_piece", "_rank"])
    at = small_side(found.select("stratum", "quota", F.col("key").alias("threshold")))
    return quotas.join(at, ["stratum", "quota"], "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(""))
    )
