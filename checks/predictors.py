"""Two deterministic predictors that make prediction tables for the metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import LABEL_COLUMNS, REPORT_FIELDS
from ledgerloom.operators.split import Split
from ledgerloom.scale import kept, small_side

COLUMNS = dict(zip(REPORT_FIELDS, LABEL_COLUMNS.values()))


def _mode(counts: DataFrame, *keys: str) -> DataFrame:
    best = F.min_by("label", F.struct(-F.col("n"), F.col("label")))
    return counts.groupBy(*keys, "field").agg(best.alias("label"))


def _counts(train: DataFrame, *keys: str) -> DataFrame:
    pairs = [F.struct(F.lit(f).alias("field"), F.col(c).alias("label")) for f, c in COLUMNS.items()]
    return (
        train.select(*keys, F.explode(F.array(*pairs)).alias("p"))
        .where(F.col("p.label").isNotNull())
        .groupBy(*keys, "p.field", "p.label")
        .agg(F.count("*").alias("n"))
    )


def _wide(modes: DataFrame, *keys: str, prefix: str) -> DataFrame:
    return modes.groupBy(*keys).agg(
        *[F.max(F.when(F.col("field") == f, F.col("label"))).alias(f"{prefix}_{f}") for f in COLUMNS]
    )


def majority_labels(train: DataFrame) -> dict[str, str]:
    """The most frequent label of every field (three rows)."""
    return {r["field"]: r["label"] for r in _mode(_counts(train), ).collect()}


def _truth(test: DataFrame) -> list:
    return [F.col(c).alias(f"true_{f}") for f, c in COLUMNS.items()]


def majority_predictions(split: Split) -> DataFrame:
    modes = majority_labels(split.train)
    return split.test.select(
        "line_id",
        F.col("DETAIL").alias("detail"),
        F.col("SUPPLIER").alias("supplier"),
        *_truth(split.test),
        *[F.lit(modes[f]).alias(f"pred_{f}") for f in COLUMNS],
    )


def supplier_predictions(split: Split) -> DataFrame:
    """The supplier's most frequent label in train, else the overall one."""
    by_supplier = kept(_counts(split.train, "SUPPLIER"))
    overall = {r["field"]: r["label"] for r in _mode(
        by_supplier.groupBy("field", "label").agg(F.sum("n").alias("n"))
    ).collect()}
    modes = small_side(kept(_wide(_mode(by_supplier, "SUPPLIER"), "SUPPLIER", prefix="mode")))
    return split.test.join(modes, "SUPPLIER", "left").select(
        "line_id",
        F.col("DETAIL").alias("detail"),
        F.col("SUPPLIER").alias("supplier"),
        *_truth(split.test),
        *[
            F.coalesce(F.col(f"mode_{f}"), F.lit(overall[f])).alias(f"pred_{f}")
            for f in COLUMNS
        ],
    )
