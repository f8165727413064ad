"""Comparing runs: target, improvement, best method, leaderboard.

A result table has one row per run and field: ``experiment, method, field,
f1_macro, accuracy, sample_wise_f1, time_seconds, test_size, is_baseline,
run_order``.  These tables hold a handful of rows per run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.config import TARGET_F1_MACRO


def method_scores(results: DataFrame) -> DataFrame:
    """One row per method: mean macro-F1 and accuracy over its fields."""
    return results.groupBy("experiment", "method", "is_baseline", "run_order").agg(
        F.avg("f1_macro").alias("f1_macro"),
        F.avg("accuracy").alias("accuracy"),
        F.max("sample_wise_f1").alias("sample_wise_f1"),
        F.max("time_seconds").alias("time_seconds"),
    )


def target_check(scores: DataFrame, target: float = TARGET_F1_MACRO) -> DataFrame:
    """Whether a mean macro-F1 reaches the target, and by what margin."""
    return scores.withColumns(
        {"passed": F.col("f1_macro") >= target, "margin": F.col("f1_macro") - F.lit(target)}
    )


def improvement(scores: DataFrame, baseline: str, tuned: str, keys: list[str]) -> DataFrame:
    """Absolute and percent change from one method to another; keeps the better.

    The tuned method is kept only when strictly better.  A zero baseline gives a
    zero percent change.
    """
    sides = scores.where(F.col("method").isin(baseline, tuned)).groupBy(*keys)
    paired = sides.agg(
        F.max(F.when(F.col("method") == baseline, F.col("f1_macro"))).alias("baseline_f1"),
        F.max(F.when(F.col("method") == tuned, F.col("f1_macro"))).alias("tuned_f1"),
    )
    change = F.col("tuned_f1") - F.col("baseline_f1")
    percent = F.coalesce(F.try_divide(change * 100, F.col("baseline_f1")), F.lit(0.0))
    return paired.select(
        *keys,
        "baseline_f1",
        "tuned_f1",
        change.alias("change"),
        percent.alias("percent_change"),
        F.when(change > 0, tuned).otherwise(baseline).alias("kept"),
    )


def best_method(scores: DataFrame) -> DataFrame:
    """The method with the highest mean macro-F1; the earlier run wins a tie."""
    return scores.orderBy(F.desc("f1_macro"), "run_order").limit(1)


def winner_fields(results: DataFrame) -> DataFrame:
    """Field results of the best method."""
    winner = best_method(method_scores(results)).select("experiment", "method")
    return results.join(F.broadcast(winner), ["experiment", "method"], "left_semi")  # one row


def union_results(tables: list[DataFrame]) -> DataFrame:
    """Stack the summaries of several experiments that name their scores differently.

    The score of a row is its overall macro-F1, else its average, else its best,
    else zero.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    names = [n for n in ("overall_f1_macro", "avg_f1_macro", "best_f1_macro") if n in stacked.columns]
    score = F.coalesce(*[F.col(n) for n in names], F.lit(0.0))
    return stacked.withColumn("f1_macro", score).drop(*names)


def leaderboard(scores: DataFrame, target: float = TARGET_F1_MACRO) -> DataFrame:
    """All methods by mean macro-F1 with rank, winner flag and target check."""
    order = W.partitionBy().orderBy(F.desc("f1_macro"), "run_order")
    ranked = scores.withColumn("rank", F.row_number().over(order))
    return target_check(ranked, target).withColumn("winner", F.col("rank") == 1)
