"""Every stage of the pipeline on odd rows: nulls, empty and very long texts, repeated rows, clashing columns."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    words = "the water of the house was never quite what it would be this morning and so on".split()
    rows = [(i, " ".join(words[(i * j) % len(words)] for j in range(1, 40 + i % 30)), "en", f"src{i % 3}", None) for i in range(160)]
    rows += [(None, "a row without an id and a text of its own here", None, None, 1), (500, None, "en", "src0", 2), (501, "", "de", "src1", 3)]
    rows += [(502, " \t\n ", None, "src2", 4), (7, rows[7][1], "en", "src1", None), (7, rows[7][1], "en", "src1", None)]
    rows += [(503, "very long text of words " * 60_000, "en", "src0", 5), (504, "x" * 200_000, "en", "src0", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "_row", "_k", "_s", "epochs", "last_key", "_id", "size", "kept", "keep_id", "class_id"):
        docs = docs.withColumn(name, F.lit("own"))
    docs = docs.repartition(3, "n_chars", "text")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(0, 160, 3)] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("at", range(4))
def test_stages_keep_rows_and_columns(spark, odd, at):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, docs, odd)
    assert out.columns == docs.columns
    whole = {tuple(map(str, r)) for r in docs.collect()}
    got = [tuple(map(str, r)) for r in out.collect()]
    assert set(got) <= whole and got  # rows come out as they went in
    if name == "exact dedup":
        texts = docs.select(F.coalesce("text", F.lit(""))).distinct().count()
        assert len(got) == texts
    if name == "near dedup":
        assert len(got) <= docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert stage(spark, docs.limit(0), odd).count() == 0


def test_last_stage_encodes_every_row(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = corpus_pipeline.STAGES[-1][1](spark, docs, odd)
    assert out.count() == docs.count() and out.where("doc_id = 500 AND n_ids > 0").count() == 0
    assert out.where("doc_id = 503").first()["n_ids"] > 100_000
