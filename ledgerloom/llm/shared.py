"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.scale import settle, shared_root
from ledgerloom.session import ship_package

#: Rows of one Arrow batch.  A row holds a whole text, so the usual number would make batches too large.
ARROW_ROWS = 1000


def prepared(spark: SparkSession) -> None:
    """Send the package to the Python workers and keep Arrow batches of documents small."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


#: Bytes of text that one shuffled partition should hold.
PARTITION_BYTES = 64 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the driver and all executors share.

    What is written there outlives the executor that wrote it.
    """
    return f"{shared_root(spark).rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint; for narrow tables."""
    return settle(df)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder; for wide tables, as Parquet is compressed."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, n_bytes: int, per_partition: int = PARTITION_BYTES) -> int:
    """Number of shuffle partitions for ``n_bytes``: what the session says, or more if they would be too large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / per_partition))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def text_crc32(column: Column) -> Column:
    return F.crc32(F.encode(column, "utf-8"))


def id_remainder(id_column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.encode(F.col(id_column).cast("string"), "utf-8")) % divisor


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
