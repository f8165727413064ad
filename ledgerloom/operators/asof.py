"""As-of joins: the version of something that was valid at a row's time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of time that one chunk of a key covers.
CHUNK_SECONDS = 30 * 24 * 3600


def as_of_join(
    rows: DataFrame, versions: DataFrame, on: list[str], row_time: str, version_time: str, chunk_seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """``rows`` with the columns of the last of ``versions`` at or before their time, for each key ``on``.

    Rows before the first version, and rows whose key or time is null, get nulls.  Of versions with one time the
    one that sorts last by its other columns holds.  Columns of ``versions`` other than the key must have names
    of their own.

    Rows and versions are put together and sorted by time; a version's values are carried forward.  A key's
    rows are cut into chunks of time first: each chunk carries its own versions, and only the last version of
    every chunk is carried from chunk to chunk, so a hot key is not sorted by one task.
    """
    values = [c for c in versions.columns if c not in on]
    same = set(values) & set(rows.columns)
    if same:
        raise ValueError(f"columns on both sides: {sorted(same)}")
    chunk = lambda t: F.floor(F.unix_timestamp(F.col(t).cast("timestamp")) / chunk_seconds)
    version = F.struct(version_time, *[c for c in values if c != version_time])
    good = F.lit(True)
    for c in [*on, version_time]:
        good = good & F.col(f"`{c}`").isNotNull()
    known = versions.where(good).select(*on, chunk(version_time).alias("_chunk"), F.col(version_time).cast("timestamp").alias("_time"), version.alias("_version"))
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")
    asked = rows.select(*on, chunk(row_time).alias("_chunk"), F.col(row_time).cast("timestamp").alias("_time"), row)
    kind = known.schema["_version"].dataType
    both = known.select(*on, "_chunk", "_time", "_version", F.lit(None).cast(asked.schema["_row"].dataType).alias("_row")).unionByName(
        asked.select(*on, "_chunk", "_time", F.lit(None).cast(kind).alias("_version"), "_row")
    )
    # At one time versions come first, in order of their values.
    order = [F.col("_time").asc_nulls_first(), F.col("_row").isNotNull(), "_version"]
    upto = W.partitionBy(*on, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    within = both.withColumn("_own", F.last("_version", ignorenulls=True).over(upto)).where("_row IS NOT NULL")
    ends = known.groupBy(*on, "_chunk").agg(F.max("_version").alias("_end"))
    # Chunks with rows but without versions take the last end before them.
    chunks = ends.unionByName(asked.select(*on, "_chunk").distinct().withColumn("_end", F.lit(None).cast(kind)))
    chunks = chunks.groupBy(*on, "_chunk").agg(F.max("_end").alias("_end"))
    earlier = W.partitionBy(*on).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = chunks.select(*on, "_chunk", F.last("_end", ignorenulls=True).over(earlier).alias("_carried")).where("_carried IS NOT NULL")
    found = within.join(carried, [*on, "_chunk"], "left")
    valid = F.when(F.col("_time").isNotNull(), F.coalesce("_own", "_carried")).alias("_valid")
    return found.select("_row", valid).select("_row.*", *[F.col("_valid").getField(c).alias(c) for c in values])
