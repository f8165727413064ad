"""After scoring: review routing, cascades, corrections, drift and versions of predictions.

Predictions are rows with ``line_id``, the three labels under their short names
and ``confidence``, a map from label name to a number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.config import LABEL_COLUMNS

REVIEW_BELOW = 0.7


def least_confidence() -> Column:
    """The smallest confidence of the three labels; a missing one counts as 0."""
    values = [F.coalesce(F.try_element_at("confidence", F.lit(f)), F.lit(0.0)) for f in LABEL_COLUMNS]
    return F.least(*values)


def route_for_review(predictions: DataFrame, below: float = REVIEW_BELOW) -> DataFrame:
    """Add ``least_confidence`` and ``review``: true where a person should look."""
    return predictions.withColumn("least_confidence", least_confidence()).withColumn(
        "review", F.col("least_confidence") < below
    )


def cascade(
    first: DataFrame, second: Callable[[DataFrame], DataFrame], accept: float = REVIEW_BELOW,
    review_below: float = REVIEW_BELOW, key: str = "line_id",
) -> DataFrame:
    """Only lines that the first stage is not sure of reach the second; ``stage`` says who decided.

    ``second`` gets the keys of those lines and returns predictions for all or some
    of them.  What neither stage is sure of is marked ``review``; no line is lost.
    """
    columns = [key, *LABEL_COLUMNS, "confidence"]
    sure = least_confidence() >= accept
    done = first.where(sure).select(*columns, F.lit("first").alias("stage"))
    rest = first.where(~sure)
    again = second(rest.select(key)).select(*columns)
    named = again.select(key, *[F.col(c).alias(f"_{c}") for c in columns[1:]], F.lit(True).alias("_found"))
    met = rest.select(*columns).join(named, key, "left")
    better = F.coalesce("_found", F.lit(False))
    picked = met.select(key, *[F.when(better, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns[1:]])
    stage = F.when(least_confidence() < review_below, "review").otherwise("second")
    return done.unionByName(picked.withColumn("stage", stage))


def merge_corrections(index: DataFrame, corrections: DataFrame, key: str = "idx", at: str = "corrected_at") -> DataFrame:
    """The index with corrected labels: the latest correction of a row wins, others stay as they are.

    ``corrections`` has the key, ``at`` and label columns; a null label leaves the
    index's own.  Ties in time go to the larger labels.
    """
    labels = list(LABEL_COLUMNS)
    newest = F.max_by(F.struct(*labels), F.struct(at, *labels)).alias("_new")
    latest = corrections.groupBy(key).agg(newest)
    merged = index.join(latest, key, "left")
    return merged.withColumns({f: F.coalesce(F.col(f"_new.{f}"), F.col(f)) for f in labels}).drop("_new")


def confidence_drift(
    predictions: DataFrame, time: str, every: str = "1 day", below: float = REVIEW_BELOW, alert: float = 0.1
) -> DataFrame:
    """Per time window: rows, mean confidence, share of unsure rows, and ``alert``.

    ``alert`` is true where that share rose by more than ``alert`` over the window
    before.  The windows are few; they are ordered after counting.
    """
    routed = route_for_review(predictions, below)
    counted = routed.groupBy(F.window(time, every).start.alias("window_start")).agg(
        F.count("*").alias("n"),
        F.avg("least_confidence").alias("mean_confidence"),
        F.avg(F.col("review").cast("double")).alias("unsure_share"),
    )
    before = F.lag("unsure_share").over(W.partitionBy().orderBy("window_start"))
    return counted.withColumn("alert", F.coalesce(F.col("unsure_share") - before > alert, F.lit(False)))


def with_versions(predictions: DataFrame, model: str, prompt: str) -> DataFrame:
    """Model and prompt version on every prediction."""
    return predictions.withColumns({"model_version": F.lit(model), "prompt_version": F.lit(prompt)})
