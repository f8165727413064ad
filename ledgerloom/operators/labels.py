"""Label vocabulary, coding, decoding, null counts and class weights."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.config import LABEL_COLUMNS
from ledgerloom.scale import BROADCAST_ROWS, small_side

FIELDS = tuple(LABEL_COLUMNS.values())


def unpivot_labels(df: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """One ``(field, label)`` row per field of every line."""
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).alias("label")) for f in fields]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.field", "p.label")


def label_vocabulary(df: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Distinct non-null labels of every field with their sorted position from 0."""
    seen = unpivot_labels(df, fields).where(F.col("label").isNotNull()).distinct()
    position = F.row_number().over(W.partitionBy("field").orderBy("label")) - 1
    return seen.withColumn("idx", position)


def build_label_vocab(df: DataFrame, max_labels: int = BROADCAST_ROWS) -> dict[str, list[str]]:
    """The vocabularies as sorted lists, for prompts and model constructors.

    Label sets are short lists by nature; more than ``max_labels`` in total is
    refused, never cut.
    """
    rows = label_vocabulary(df).limit(max_labels + 1).collect()
    if len(rows) > max_labels:
        raise ValueError(f"more than {max_labels} distinct labels; use label_vocabulary() instead")
    ordered = sorted(rows, key=lambda r: r["idx"])
    return {
        name: [r["label"] for r in ordered if r["field"] == column]
        for name, column in LABEL_COLUMNS.items()
    }


def null_label_counts(df: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Missing labels per field."""
    counts = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in fields])
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).alias("n_null")) for f in fields]
    return counts.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def attach_codes(
    df: DataFrame, vocabulary: DataFrame, fields: Sequence[str], suffix: str = "_idx"
) -> DataFrame:
    """Join every field's code on its label; unknown and missing labels become -1."""
    for field in fields:
        codes = vocabulary.where(F.col("field") == field).select(
            F.col("label").alias(field), F.col("idx").alias(f"{field}{suffix}")
        )
        df = df.join(codes, field, "left").withColumn(
            f"{field}{suffix}", F.coalesce(f"{field}{suffix}", F.lit(-1))
        )
    return df


def encode_labels(df: DataFrame, fields: Sequence[str] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """Add ``<field>_idx`` columns; returns the coded table and the vocabulary.

    The vocabulary serves as encoder and decoder.  Missing labels get -1 and a
    warning; a field without any label is an error.  One count of labels answers
    all of that.
    """
    counts = small_side(unpivot_labels(df, fields).groupBy("field", "label").agg(F.count("*").alias("n")))
    position = F.row_number().over(W.partitionBy("field").orderBy("label")) - 1
    known = counts.where(F.col("label").isNotNull())
    vocabulary = small_side(known.select("field", "label", position.alias("idx")))
    per_field = counts.groupBy("field").agg(
        F.count("label").alias("n_labels"),
        F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
    )
    seen = {r["field"]: r for r in per_field.collect()}
    for field in fields:
        if field not in seen or seen[field]["n_labels"] == 0:
            raise ValueError(f"field {field} holds no labels")
        if seen[field]["n_null"]:
            warnings.warn(f"{seen[field]['n_null']} missing labels in {field} are coded as -1")
    return attach_codes(df, vocabulary, fields), vocabulary


def decode_labels(
    df: DataFrame, vocabulary: DataFrame, codes: dict[str, str], unknown: str = "UNKNOWN"
) -> DataFrame:
    """Turn code columns back into labels: ``codes`` maps code column to field.

    Each code column gains a ``<column>_label`` beside it; codes outside the
    vocabulary read ``unknown``.
    """
    for column, field in codes.items():
        names = vocabulary.where(F.col("field") == field).select(
            F.col("idx").alias(column), F.col("label").alias(f"{column}_label")
        )
        df = df.join(names, column, "left").withColumn(
            f"{column}_label", F.coalesce(f"{column}_label", F.lit(unknown))
        )
    return df


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, weight)`` with weight = rows / (classes * rows of the class)."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    everything = W.partitionBy()
    weight: Column = F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    return sizes.select(F.col(label).alias("label"), "n", weight.alias("weight"))


def dataset_profile(df: DataFrame) -> DataFrame:
    """Row count and number of classes per field, as ``(metric, value)`` rows."""
    classes = label_vocabulary(df).groupBy("field").agg(F.count("*").alias("value"))
    named = classes.select(F.concat(F.lit("classes_"), F.lower("field")).alias("metric"), "value")
    rows = df.agg(F.count("*").alias("value")).select(F.lit("rows").alias("metric"), "value")
    return rows.unionByName(named)


def rare_classes(df: DataFrame, below: int = 10) -> DataFrame:
    """Labels with fewer than ``below`` rows, per field."""
    counts = unpivot_labels(df).where(F.col("label").isNotNull()).groupBy("field", "label").count()
    return counts.where(F.col("count") < below).withColumnRenamed("count", "n")
