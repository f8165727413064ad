"""The invoice-line CSV: scan, column check, typing, keys; and the error-report sink."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import add_model_text_column
from ledgerloom.operators.labels import build_label_vocab
from ledgerloom.schema import LINE_TYPES, REQUIRED_COLUMNS

# Texts a CSV reader of the pandas family takes as missing.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


#: Rows of an error report that one task writes as one file, if the caller does not say otherwise.
ONE_FILE_ROWS = 1_000_000


def check_columns(columns: list[str]) -> None:
    missing = [c for c in REQUIRED_COLUMNS if c not in columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def load_raw_df(
    spark: SparkSession, path: str, multi_line: bool = False, date_format: str = "yyyy-MM-dd"
) -> DataFrame:
    """Read a header CSV by column name; order is free and extra columns are kept.

    Everything is read as text, so an all-digit DETAIL stays text.  Values that do
    not parse as their type become null.  Files with line breaks inside quotes
    need ``multi_line``, which makes every file a single task.
    """
    raw = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
        .csv(path)
    )
    check_columns(raw.columns)

    def typed(name: str):
        value = F.when(~F.col(f"`{name}`").isin(MISSING), F.col(f"`{name}`"))
        kind = LINE_TYPES.get(name, "string")
        if kind == "date":
            return F.try_to_date(value, date_format).alias(name)
        return (value if kind == "string" else value.try_cast(kind)).alias(name)

    extra = [c for c in raw.columns if c not in REQUIRED_COLUMNS]
    return raw.select(*[typed(c) for c in REQUIRED_COLUMNS + extra])


def with_line_id(df: DataFrame, columns: list[str] | None = None, chunk: int = 100_000) -> DataFrame:
    """Add a unique ``line_id``: digest of the content and number of the copy.

    Identical rows are interchangeable, so they are counted (copies melt before
    the shuffle) and written out again with numbers.  That depends on content
    alone: a second evaluation, or one after a lost executor, gives the same ids.
    Rows with more than ``chunk`` copies are written out by several tasks.
    """
    columns = columns or df.columns
    if set(columns) != set(df.columns):
        raise ValueError("copies are counted over all columns, so the digest covers all of them")
    content = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"))
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    few = counted.where(F.col("_copies") <= chunk).withColumn("_from", F.lit(0).cast("bigint"))
    many = (
        counted.where(F.col("_copies") > chunk)
        .withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1, F.lit(chunk))))
        .repartition("_from", *df.columns)
    )
    last = F.least(F.col("_from") + chunk, F.col("_copies")) - 1
    numbered = few.unionByName(many).withColumn("_copy", F.explode(F.sequence(F.col("_from"), last)))
    return numbered.select(*df.columns, F.concat_ws("-", content, "_copy").alias("line_id"))


def load_and_prepare_data(
    spark: SparkSession, path: str, **options
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Lines with key and model text, and the label vocabularies of the whole table."""
    df = load_raw_df(spark, path, **options)
    return add_model_text_column(with_line_id(df)), build_label_vocab(df)


def report_name(run: str) -> str:
    """File-system form of a run name: spaces to ``_``, no parentheses, rest to ``-``."""
    plain = re.sub(r"[()]", "", run.strip().lower()).replace(" ", "_")
    return "error_report_" + re.sub(r"[^a-z0-9_\-]", "-", plain)


def write_error_report(
    report: DataFrame, folder: str, run: str, single_file: bool | None = None
) -> str:
    """Write error rows as CSV with a header under ``folder``; returns the path.

    ``single_file`` writes one file by one task; with ``False`` each partition
    writes its own, which is what a very large report needs.  Without a choice a
    report of at most ONE_FILE_ROWS rows is one file.
    """
    path = f"{folder.rstrip('/')}/{report_name(run)}"
    if single_file is None:
        single_file = report.limit(ONE_FILE_ROWS + 1).count() <= ONE_FILE_ROWS
    if single_file:
        # Not coalesce: the task that writes would also compute the whole report.
        report = report.repartition(1)
    report.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def read_error_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').csv(path)
