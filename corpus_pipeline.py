"""A training corpus from documents: reject, deduplicate, mix and encode, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.content_sort import without_exact_duplicates
from ledgerloom.llm.cotraining import fit_quality
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.near_copies import without_near_duplicates
from ledgerloom.llm.pieces import encode
from ledgerloom.llm.shared import documents, prepared, written

#: A document is rejected if good quality is less likely than this.
ACCEPTED = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that both views together hold to be of good quality."""
    prepared(spark)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    kept = model.score(docs, [row]).where(F.col("score") >= ACCEPTED)
    return kept.select([F.col("_row").getField(c).alias(c) for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return without_exact_duplicates(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    prepared(spark)
    return without_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    prepared(spark)
    return encode(docs)


STAGES = [
    ("quality", quality),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixture),
    ("encoding", encoding),
]

#: Fitted models and verified similarities have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
