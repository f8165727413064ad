"""Exact deduplication by sorting whole contents (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.shared import PARTITION_BYTES, cut, partitions_for, text_or_empty

#: A group of copies with more than this share of all rows is sorted in pieces.
HOT_SHARE = 1 / 4096
#: Rows, and bytes of text, of a hot group that make a piece of it.
PIECE_ROWS, PIECE_BYTES = 1 << 14, PARTITION_BYTES // 4
#: Characters of a text that lead its sort key.
HEAD = 32


def _prepared(
    df: DataFrame, id_column: str, text_column: str, normalise: Callable[[Column], Column] | None
) -> DataFrame:
    """``(_id, _text, _row)``; the row travels only if a later step reads it."""
    text = text_or_empty(text_column)
    return df.select(
        F.col(f"`{id_column}`").alias("_id"),
        (normalise(text) if normalise else text).alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
    )


def _hot_and_cold(rows: DataFrame, hot_share: float) -> tuple[DataFrame, DataFrame, int]:
    """Rows of very large groups with the piece of the group they go to, all others, and the number of range partitions.

    The hashes only decide how rows are spread; equality is decided on whole texts.  At most
    ``1 / hot_share`` hashes can have more than that share of the rows, which bounds the list.  A row's piece comes from its
    id and its place in the table, so rows that repeat an id, or have none, spread too.
    """
    total, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("_text"))).first()
    digest = F.xxhash64("_text")
    tally = [F.count(F.lit(1)).alias("_n"), F.max(F.octet_length("_text")).alias("_bytes")]
    counts = rows.groupBy(digest.alias("_hash")).agg(*tally).where(F.col("_n") > max(1.0, total * hot_share))
    hot = {r["_hash"]: max(r["_n"] // PIECE_ROWS, r["_n"] * r["_bytes"] // PIECE_BYTES) + 1 for r in counts.collect()}
    parts = partitions_for(rows.sparkSession, size or 0)
    if not hot:
        return rows.where(F.lit(False)).withColumn("_piece", F.lit(0).cast("long")), rows, parts
    pieces = F.broadcast(rows.sparkSession.createDataFrame(list(hot.items()), "_hot long, _pieces long"))
    met = rows.withColumn("_spread", F.xxhash64("_id", F.monotonically_increasing_id())).join(pieces, digest == F.col("_hot"))
    met = met.withColumn("_piece", F.pmod("_spread", "_pieces")).drop("_spread", "_hot", "_pieces")
    return met, rows.where(~digest.isin(list(hot))), parts


def _sorted_groups(rows: DataFrame, parts: int, keys: list[str], smallest: bool) -> DataFrame:
    """Range-partition by sampled splitters, sort, and give each row its place in its run of equals.

    Texts are ordered by their first characters, then by a hash, then as a whole: so the splitters,
    which the driver samples, are short, and texts with a common beginning still spread.  The range
    exchange places equal keys together and the window adds no second exchange; it sorts externally
    and compares neighbouring rows on the whole text.
    """
    short = ["_head", "_hash", *[k for k in keys if k != "_text"]]
    rows = rows.withColumn("_head", F.substring("_text", 1, HEAD)).withColumn("_hash", F.xxhash64("_text"))
    run = W.partitionBy(*short, "_text")
    best = F.col("_id").asc_nulls_last() if smallest else F.col("_id").desc_nulls_last()
    pick = F.min("_id") if smallest else F.max("_id")
    return (
        rows.repartitionByRange(parts, *short)
        .withColumn("_place", F.row_number().over(run.orderBy(best)))
        .withColumn("_keep", pick.over(run))
        .withColumn("_size", F.count(F.lit(1)).over(run))
    )


def exact_duplicates(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """One row per row of ``df``: ``(<id>, keep_id, group_size, kept, text_sha256)``.

    Texts are equal when identical after ``normalise`` (none: no change); a null text counts as
    empty.  The row with the smallest (``keep="largest"``: largest) id stays; null ids lose to any
    other, and of rows that repeat both id and text exactly one is kept.  Other columns of ``df``
    are ignored, whatever their names.  An empty table gives an empty result.

    Whole texts are range-partitioned by sampled splitters and sorted externally, so that equal
    ones become neighbours.  A group that holds more than ``hot_share`` of all rows is cut into
    as many pieces as its size asks for; each piece is sorted on its own and only the first row of each
    piece is sorted again, so no task gets a whole hot group.
    """
    smallest = {"smallest": True, "largest": False}[keep]
    hot, cold, parts = _hot_and_cold(_prepared(df, id_column, text_column, normalise), hot_share)
    digest = F.sha2("_text", 256).alias("text_sha256")
    result = [
        F.col("_id").alias(id_column),
        F.col("_keep").alias("keep_id"),
        F.col("_size").cast("bigint").alias("group_size"),
        F.col("kept"),
        F.col("text_sha256"),
    ]
    alone = (
        _sorted_groups(cold.select("_id", "_text"), parts, ["_text"], smallest)
        .select("_id", "_keep", "_size", (F.col("_place") == 1).alias("kept"), digest)
        .select(*result)
    )
    pieces = cut(
        _sorted_groups(hot.select("_id", "_text", "_piece"), parts, ["_text", "_piece"], smallest).select(
            "_id", "_piece", "_place", "_keep", "_size", digest,
            F.when(F.col("_place") == 1, F.col("_text")).alias("_text"),
        )
    )
    heads = pieces.where(F.col("_text").isNotNull()).select(
        F.col("_keep").alias("_id"), "_text", "_piece", "text_sha256", F.col("_size").alias("_part")
    )
    merged = (
        _sorted_groups(heads, parts, ["_text"], smallest)
        .withColumn("_size", F.sum("_part").over(W.partitionBy("_head", "_hash", "_text")))
        .select("text_sha256", "_piece", (F.col("_place") == 1).alias("_first"), "_keep", "_size")
    )
    together = (
        pieces.select("_id", "_piece", "_place", "text_sha256")
        .join(merged, ["text_sha256", "_piece"])
        .withColumn("kept", (F.col("_place") == 1) & F.col("_first"))
        .select(*result)
    )
    return alone.unionByName(together)


def without_exact_duplicates(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """The rows of ``df`` that :func:`exact_duplicates` keeps, with all their columns."""
    smallest = {"smallest": True, "largest": False}[keep]
    hot, cold, parts = _hot_and_cold(_prepared(df, id_column, text_column, normalise), hot_share)
    alone = _sorted_groups(cold, parts, ["_text"], smallest).where(F.col("_place") == 1)
    heads = _sorted_groups(hot, parts, ["_text", "_piece"], smallest).where(F.col("_place") == 1)
    together = _sorted_groups(heads.select("_id", "_text", "_row"), parts, ["_text"], smallest)
    kept = alone.select("_row").unionByName(together.where(F.col("_place") == 1).select("_row"))
    return kept.select([F.col("_row").getField(c).alias(c) for c in df.columns])
