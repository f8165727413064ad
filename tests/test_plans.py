"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import labels, retrieval, split
from ledgerloom.operators.tfidf import Tfidf, tfidf_weights


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return re.findall(r"(?<!Broadcast)Exchange (\w+)", plan(df))


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lines") / "lines")
    spark.range(300).select(
        F.concat(F.lit("l"), "id").alias("line_id"), F.concat(F.lit("word"), F.col("id") % 7).alias("model_text"),
        *[F.concat(F.lit(c), F.col("id") % 3).alias(c) for c in ("NOMINAL", "DEPARTMENT", "TC")],
        F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"), F.lit("unused").alias("wide"),
    ).write.parquet(folder)
    return folder


def test_splitting_does_not_shuffle_the_table(spark, path):
    df = spark.read.parquet(path)
    assert shuffles(split.stratified_random_split(df).data) == []
    assert shuffles(split.random_split(df).data) == []
    assert shuffles(split.group_split(df, "NOMINAL").data) == []
    assert shuffles(split.stratified_folds(df, "NOMINAL", 3)) == []


def test_coding_does_not_shuffle_the_table(spark, path):
    coded, vocabulary = labels.encode_labels(spark.read.parquet(path))
    assert shuffles(coded) == []
    assert shuffles(labels.decode_labels(coded, vocabulary, {"TC_idx": "TC"})) == []


def test_terms_are_never_shuffled(spark, path):
    df = spark.read.parquet(path)
    assert shuffles(tfidf_weights(df, "line_id", "model_text")) == []  # not even the texts
    text = plan(tfidf_weights(df, "line_id", "model_text"))
    assert "ReadSchema: struct<line_id:string,model_text:string>" in text
    assert shuffles(Tfidf().fit(df).transform(df)) == []


def test_few_queries_leave_the_index_in_place(spark, path):
    df = spark.read.parquet(path).withColumnRenamed("line_id", "idx").withColumnRenamed("model_text", "text")
    index = retrieval.build_index(df)
    asked = df.limit(3).select(F.col("idx").alias("query_id"), "embedding")
    assert shuffles(retrieval.retrieve(asked, index)) == []


def test_scans_read_only_what_is_used(spark, path):
    text = plan(labels.label_vocabulary(spark.read.parquet(path)))
    assert "ReadSchema: struct<NOMINAL:string,DEPARTMENT:string,TC:string>" in text
