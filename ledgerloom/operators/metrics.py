"""Accuracy, macro-F1, sample-wise F1 and class reports.

Input is a prediction table with ``true_<field>`` / ``pred_<field>`` columns.
All field metrics come from one count of ``(field, true, pred)``, which Spark
combines before the shuffle; what follows runs on label pairs only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import REPORT_FIELDS
from ledgerloom.functions.match import all_match, field_match, labels_match, wrong_fields


def confusion_counts(predictions: DataFrame) -> DataFrame:
    """``(field, true, pred, n)`` for the three fields."""
    pairs = [
        F.struct(
            F.lit(f).alias("field"),
            F.col(f"true_{f}").alias("true"),
            F.col(f"pred_{f}").alias("pred"),
        )
        for f in REPORT_FIELDS
    ]
    return (
        predictions.select(F.explode(F.array(*pairs)).alias("p"))
        .groupBy("p.field", "p.true", "p.pred")
        .agg(F.count("*").alias("n"))
    )


def _class_counts(confusion: DataFrame, keys: list[str]) -> DataFrame:
    """tp / fp / fn per class.  Missing labels stay on a null row: errors, not a class."""
    n, zero = F.col("n"), F.lit(0).cast("bigint")

    def part(label, tp, fp, fn):
        return F.struct(
            label.alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")
        )

    hit = F.array(part(F.col("true"), n, zero, zero))
    miss = F.array(part(F.col("true"), zero, zero, n), part(F.col("pred"), zero, n, zero))
    parts = F.when(labels_match("true", "pred"), hit).otherwise(miss)
    return (
        confusion.select(*keys, F.explode(parts).alias("c"))
        .groupBy(*keys, "c.label")
        .agg(*[F.sum(f"c.{m}").alias(m) for m in ("tp", "fp", "fn")])
    )


def _ratio(top, bottom):
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def class_report_of(confusion: DataFrame, keys: list[str]) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return _class_counts(confusion, keys).select(
        *keys,
        "label",
        "tp",
        "fp",
        "fn",
        (tp + fn).alias("support"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every true or predicted label."""
    report = class_report_of(confusion_counts(predictions), ["field"])
    return report.where(F.col("label").isNotNull())


def field_metrics_of(confusion: DataFrame, keys: list[str]) -> DataFrame:
    report = class_report_of(confusion, keys)
    return report.groupBy(*keys).agg(
        F.sum("support").alias("n"),
        F.sum("tp").alias("n_correct"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.coalesce(
            F.avg(F.when(F.col("label").isNotNull(), F.col("f1"))), F.lit(0.0)
        ).alias("f1_macro"),
    )


def field_metrics(predictions: DataFrame) -> DataFrame:
    """Rows, exact number correct, accuracy and macro-F1 of every field.

    The classes of macro-F1 are the labels seen as truth or as prediction.
    """
    return field_metrics_of(confusion_counts(predictions), ["field"])


def average_f1(metrics: DataFrame) -> DataFrame:
    """Mean macro-F1 and accuracy over the fields, with equal weight."""
    return metrics.agg(F.avg("f1_macro").alias("f1_macro"), F.avg("accuracy").alias("accuracy"))


def sample_wise_f1(predictions: DataFrame) -> DataFrame:
    """Mean share of correct fields per row (precision and recall coincide)."""
    share = (F.lit(len(REPORT_FIELDS)) - wrong_fields()) / F.lit(len(REPORT_FIELDS))
    return predictions.agg(F.avg(share).alias("sample_wise_f1"), F.count("*").alias("n"))


def error_rate(predictions: DataFrame) -> DataFrame:
    """Rows with at least one wrong field, and their share."""
    wrong = F.count_if(~all_match())
    return predictions.agg(
        F.count("*").alias("n"),
        wrong.alias("n_errors"),
        F.try_divide(wrong, F.count("*")).alias("error_rate"),
    )


def evaluate_predictions(predictions: DataFrame) -> dict[str, float]:
    """All headline scores as plain numbers, in one pass over the predictions."""
    shares = predictions.groupBy(
        *[f"{side}_{f}" for f in REPORT_FIELDS for side in ("true", "pred")]
    ).agg(F.count("*").alias("rows"))
    shares = shares.persist()
    try:
        total = shares.agg(
            F.coalesce(F.sum("rows"), F.lit(0)),
            F.sum(F.col("rows") * (len(REPORT_FIELDS) - wrong_fields())),
            F.sum(F.when(~all_match(), F.col("rows")).otherwise(0)),
        ).first()
        if total[0] == 0:
            raise ValueError("cannot evaluate an empty prediction table")
        pairs = [
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"true_{f}").alias("true"),
                F.col(f"pred_{f}").alias("pred"),
            )
            for f in REPORT_FIELDS
        ]
        confusion = (
            shares.select("rows", F.explode(F.array(*pairs)).alias("p"))
            .groupBy("p.field", "p.true", "p.pred")
            .agg(F.sum("rows").alias("n"))
        )
        scores = {r["field"]: r for r in field_metrics_of(confusion, ["field"]).collect()}
    finally:
        shares.unpersist()
    out: dict[str, float] = {"test_size": total[0], "n_errors": total[2]}
    for field in REPORT_FIELDS:
        out[f"{field}_f1"] = scores[field]["f1_macro"]
        out[f"{field}_acc"] = scores[field]["accuracy"]
    out["f1_macro"] = sum(out[f"{f}_f1"] for f in REPORT_FIELDS) / len(REPORT_FIELDS)
    out["sample_wise_f1"] = total[1] / (len(REPORT_FIELDS) * total[0])
    out["error_rate"] = total[2] / total[0]
    return out


def metric_cube(predictions: DataFrame, dimensions: list[str]) -> DataFrame:
    """``(field, <dimensions>, level, n, n_correct, accuracy, error_rate)`` for all combinations of totals.

    Null in a dimension means all of its values where its bit in ``level`` is set (the field's bit is the
    highest, the last dimension's the lowest), and a missing value where it is not.  One pass: every row becomes
    one per field and combination, counted before the shuffle.  ``error_rate`` is the share of wrong labels.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), field_match(f).alias("right")) for f in REPORT_FIELDS
    ]))
    each = predictions.select(*dimensions, pairs.alias("_one")).select("_one.field", *dimensions, F.col("_one.right").cast("bigint").alias("_right"))
    total = each.cube("field", *dimensions).agg(
        F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("_right").alias("n_correct")
    )
    accuracy = F.col("n_correct") / F.col("n")
    return total.select("field", *dimensions, "level", "n", "n_correct", accuracy.alias("accuracy"), (1 - accuracy).alias("error_rate"))
