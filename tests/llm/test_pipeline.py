import re
from collections import Counter

import pytest

import corpus_pipeline
from ledgerloom.llm.near_copies import inverse_frequencies
from ledgerloom.llm.shared import documents, written
from test_near_copies import plain_classes

SF = "/root/testdata/sf0.01"
sentencepiece = pytest.importorskip("sentencepiece")


def test_every_stage_against_brute_force(spark):
    docs = documents(spark, SF)
    names, tables = [n for n, _ in corpus_pipeline.STAGES], [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], SF)))
    start, good, distinct, single, mixture, encoded = (t.toPandas() for t in tables)
    assert len(names) == 5 and all(t.columns == docs.columns for t in tables[:-1])

    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    met = start.merge(labels, on="doc_id")
    kept = met["doc_id"].isin(good["doc_id"])
    assert kept[met["quality"] == 1].mean() > 0.97 and kept[met["quality"] == 0].mean() < 0.3

    assert sorted(distinct["doc_id"]) == sorted(good.groupby("text")["doc_id"].max())

    rows = distinct.sort_values("doc_id")
    classes = plain_classes(list(rows["text"]), inverse_frequencies(tables[2].select("text")))
    ids = rows["doc_id"].tolist()
    assert sorted(single["doc_id"]) == sorted({ids[c] for c in classes})

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert set(mixture["doc_id"]) <= set(single["doc_id"]) and max(Counter(mixture["doc_id"]).values()) <= 2
    total = sum(map(words, single["text"]))
    assert abs(sum(map(words, mixture["text"])) - 1.5 * total) < 0.15 * total

    reader = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    ids_of = {i: reader.encode(t) for i, t in zip(mixture["doc_id"], mixture["text"], strict=True)}
    assert len(encoded) == len(mixture)
    assert all(list(x) == ids_of[i] for i, x in zip(encoded["doc_id"], encoded["ids"], strict=True))


def test_empty_table(spark):
    docs = documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
    assert docs.count() == 0
