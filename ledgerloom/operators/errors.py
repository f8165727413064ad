"""Error reports and what they show: confusions, shares, suppliers, majority collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.config import REPORT_FIELDS
from ledgerloom.functions.match import all_match, field_match, labels_match, wrong_fields
from ledgerloom.operators.metrics import class_report, confusion_counts

REPORT_COLUMNS = ["detail", "supplier"] + [
    f"{side}_{f}" for f in REPORT_FIELDS for side in ("true", "pred")
]
EXTENDED_COLUMNS = REPORT_COLUMNS + ["confidence", "reasoning"]


def error_rows(predictions: DataFrame) -> DataFrame:
    """Rows with at least one wrong field."""
    return predictions.where(~all_match())


def error_report(predictions: DataFrame) -> DataFrame:
    """Error rows in report layout.

    Predictions with confidence and reasoning give the long layout, in which the
    confidence map is written as JSON text.
    """
    errors = error_rows(predictions)
    if not {"confidence", "reasoning"} <= set(predictions.columns):
        return errors.select(*REPORT_COLUMNS)
    as_json = F.coalesce(F.to_json("confidence"), F.lit("{}"))
    return errors.withColumn("confidence", as_json).select(*EXTENDED_COLUMNS)


def confusion_topk(predictions: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most frequent wrong (true, predicted) pairs of every field."""
    wrong = confusion_counts(predictions).where(~labels_match("true", "pred"))
    order = W.partitionBy("field").orderBy(F.desc("n"), "true", "pred")
    return wrong.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def error_field_shares(predictions: DataFrame) -> DataFrame:
    """Errors per field and their share of all error rows (shares may overlap)."""
    counts = error_rows(predictions).agg(
        F.count("*").alias("total"),
        *[F.count_if(~field_match(f)).alias(f) for f in REPORT_FIELDS],
    )
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).alias("n_wrong")) for f in REPORT_FIELDS]
    return counts.select("total", F.explode(F.array(*pairs)).alias("p")).select(
        "p.field",
        "p.n_wrong",
        F.col("total").alias("n_error_rows"),
        F.coalesce(F.try_divide("p.n_wrong", "total"), F.lit(0.0)).alias("share"),
    )


def wrong_field_histogram(predictions: DataFrame) -> DataFrame:
    """Number of error rows with one, two and three wrong fields."""
    counted = error_rows(predictions).select(wrong_fields().alias("n_wrong"))
    return counted.groupBy("n_wrong").agg(F.count("*").alias("n_rows"))


def supplier_errors(predictions: DataFrame) -> DataFrame:
    """Per supplier: error rows, wrong labels, and the distinct confusions behind them.

    Counting label pairs first leaves one row per distinct confusion, so a
    supplier with a third of all rows never gathers in one task.
    """
    errors = error_rows(predictions)
    pairs = [
        F.when(
            ~field_match(f),
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"true_{f}").alias("true"),
                F.col(f"pred_{f}").alias("pred"),
            ),
        )
        for f in REPORT_FIELDS
    ]
    # The first wrong field of a row carries the row itself into the count.
    wrong = errors.select(
        "supplier", F.posexplode(F.array_compact(F.array(*pairs))).alias("at", "pair")
    )
    distinct = wrong.groupBy("supplier", "pair").agg(
        F.count("*").alias("n"), F.count_if(F.col("at") == 0).alias("rows")
    )
    pair = F.struct("pair.field", "pair.true", "pair.pred", "n")
    return distinct.groupBy("supplier").agg(
        F.sum("rows").alias("n_error_rows"),
        F.sum("n").alias("n_wrong_labels"),
        F.count("*").alias("n_confusions"),
        # At most one entry for each field and pair of labels.
        F.array_sort(F.collect_list(pair)).alias("confusions"),
    )


def majority_collapse(train: DataFrame, predictions: DataFrame) -> DataFrame:
    """How far a model retreats to the most frequent training label, per field.

    Counts wrong predictions of the majority label, their share of the field's
    errors, and the classes with an F1 of zero.  ``train`` has ``true_<field>``
    columns.
    """
    sides = [
        F.struct(F.lit(f).alias("field"), F.col(f"true_{f}").alias("label")) for f in REPORT_FIELDS
    ]
    sizes = (
        train.select(F.explode(F.array(*sides)).alias("p"))
        .where(F.col("p.label").isNotNull())
        .groupBy("p.field", "p.label")
        .agg(F.count("*").alias("n"))
    )
    majority = sizes.groupBy("field").agg(
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("majority_label")
    )
    wrong = confusion_counts(predictions).where(~labels_match("true", "pred"))
    falls = (
        F.broadcast(majority)  # one row per field; a field without errors stays
        .join(wrong, "field", "left")
        .groupBy("field", "majority_label")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_errors"),
            F.coalesce(
                F.sum(F.when(F.col("pred") == F.col("majority_label"), F.col("n"))), F.lit(0)
            ).alias("n_to_majority"),
        )
    )
    zero = class_report(predictions).groupBy("field").agg(
        F.count("*").alias("n_classes"), F.count_if(F.col("f1") == 0).alias("n_zero_f1")
    )
    return falls.join(zero, "field", "left").select(
        "field",
        "majority_label",
        "n_errors",
        "n_to_majority",
        F.coalesce(F.try_divide("n_to_majority", "n_errors"), F.lit(0.0)).alias("share_to_majority"),
        F.coalesce("n_classes", F.lit(0)).alias("n_classes"),
        F.coalesce("n_zero_f1", F.lit(0)).alias("n_zero_f1"),
    )
