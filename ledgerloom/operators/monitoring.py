"""Distribution of confidences over time, of a table or of a stream, and how far it moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.config import LABEL_COLUMNS

BINS = 10
#: A population stability index above this raises an alert.
MOVED = 0.2


def confidence_counts(
    predictions: DataFrame, time: str, every: str = "1 day", bins: int = BINS, watermark: str | None = None
) -> DataFrame:
    """``(window_start, field, bin, n)``: a histogram of each label's confidence in every time window.

    Bins are equally wide over 0 to 1; a missing confidence counts as 0.  Counts add up, so histograms of parts
    of a table may be merged.  The table may be a stream; ``watermark`` then says how late rows may be.
    """
    rows = predictions.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, watermark) if watermark else rows
    value = lambda f: F.coalesce(F.try_element_at("confidence", F.lit(f)), F.lit(0.0))
    place = lambda f: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(value(f) * bins))).cast("int")
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), place(f).alias("bin")) for f in LABEL_COLUMNS]))
    each = rows.select(F.col(time).alias("_time"), fields.alias("_one"))
    grouped = each.groupBy(F.window("_time", every).alias("_window"), F.col("_one.field").alias("field"), F.col("_one.bin").alias("bin"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("_window.start").alias("window_start"), "field", "bin", "n")


def distribution_distance(counts: DataFrame, bins: int = BINS, moved: float = MOVED) -> DataFrame:
    """``(window_start, field, n, psi, ks, alert)``: each window's histogram against that of the window before.

    ``psi`` is the population stability index of shares smoothed by half a row per bin, ``ks`` the largest
    difference of the cumulated shares; both are 0 in a field's first window.  ``alert`` is true where ``psi``
    exceeds ``moved``.  Windows without rows are no windows.  One row per window and field is ordered, not the rows.
    """
    by_bin = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    summed = counts.groupBy("window_start", "field", "bin").agg(F.sum("n").alias("n"))
    whole = summed.groupBy("window_start", "field").agg(by_bin.alias("_bins"), F.sum("n").alias("n"))
    places = F.sequence(F.lit(0), F.lit(bins - 1))
    whole = whole.withColumn("_now", F.transform(places, lambda b: F.coalesce(F.try_element_at("_bins", b), F.lit(0).cast("bigint"))))
    order = W.partitionBy("field").orderBy("window_start")
    pairs = whole.select("window_start", "field", "n", "_now", F.lag("_now").over(order).alias("_old"), F.lag("n").over(order).alias("_old_n"))
    share = lambda x, n: (x + 0.5) / (F.col(n) + 0.5 * bins)
    terms = F.zip_with("_now", "_old", lambda p, q: (share(p, "n") - share(q, "_old_n")) * F.log(share(p, "n") / share(q, "_old_n")))
    total = lambda name, i: F.aggregate(F.slice(name, F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + x)
    gaps = F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda i: F.abs(total("_now", i) / F.col("n") - total("_old", i) / F.col("_old_n")))
    psi = F.coalesce(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    return pairs.select(
        "window_start", "field", "n", psi.alias("psi"), F.coalesce(F.array_max(gaps), F.lit(0.0)).alias("ks"), (psi > moved).alias("alert")
    )


def stream_confidence_counts(
    stream: DataFrame, time: str, table: str, checkpoint: str, every: str = "1 day", bins: int = BINS,
    watermark: str = "1 hour", available_now: bool = True,
) -> StreamingQuery:
    """Keep :func:`confidence_counts` of a stream in the folder ``table``; returns the started query.

    Each micro-batch writes the histograms that it changed under its own number, overwriting what a failed
    attempt left there, so a batch that is run again changes nothing.  A window's state is dropped once the
    watermark has passed its end; rows later than that are not counted (:func:`late_rows` tells how many).
    ``table`` and ``checkpoint`` are folders that driver and executors share.
    """
    counted = confidence_counts(stream, time, every, bins, watermark)

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={batch}")

    writer = counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def kept_counts(spark, table: str) -> DataFrame:
    """The newest state of every histogram that a stream keeps in ``table``."""
    rows = spark.read.parquet(table)
    return rows.groupBy("window_start", "field", "bin").agg(F.max_by("n", "batch").alias("n"))


def late_rows(query: StreamingQuery) -> int:
    """Counts that came after their window was closed, over the batches that the query still remembers.

    Rows are counted after they were added up by task: one for each task, window, field and bin.
    """
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
