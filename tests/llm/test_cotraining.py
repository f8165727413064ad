import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import cotraining
from ledgerloom.llm.cotraining import View, _taught, fit_quality, fitted, quality


def table(spark, n=700, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(30, 80))]
        text = " ".join(words) + "." if good else " | ".join(w + "$$$" for w in words)
        source = rng.choice(["a", "b", "c"] if good else ["x", "y", "c"])
        docs.append((i, text, "en", source, len(text)))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
    docs += [(None, "plain words here", None, None, None), (9000, "", "en", "a", 0), (9001, None, None, None, None), (9002, "w " * 60_000, "en", "a", 1), docs[0]]
    labels += [(None, 1, 0), (1, None, 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash")),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_unlabelled_documents_are_judged(spark):
    docs, labels = table(spark)
    got = quality(docs, labels).toPandas()
    assert len(got) == docs.count()
    assert got[["score", "content_score", "metadata_score"]].stack().between(0, 1).all()
    met = got.merge(docs.toPandas()[["doc_id", "text"]].dropna(), on="doc_id").drop_duplicates("doc_id")
    met = met[met["doc_id"] < 9000]
    bad = met["text"].str.contains(r"\$\$\$")
    assert (met["accepted"] != bad).mean() > 0.98
    # Metadata alone tells something, and rounds of co-training do not harm it.
    assert met["metadata_score"][~bad].mean() > met["metadata_score"][bad].mean() + 0.1
    again = quality(docs, labels).toPandas()
    assert np.allclose(np.sort(got["score"]), np.sort(again["score"]))


def test_views_teach_each_other(spark):
    docs, labels = table(spark)
    few = labels.where("doc_id % 9 = 0")
    alone, taught = fit_quality(docs, few, rounds=0), fit_quality(docs, few, rounds=3)
    assert not np.allclose(alone.views[1].weights, taught.views[1].weights)


def test_one_class_no_labels_and_missing_columns(spark):
    docs, labels = table(spark, 60)
    only = quality(docs, labels.where("quality = 1")).toPandas()["score"]
    assert only.nunique() == 1 and only.iloc[0] > 0.8
    assert quality(docs, labels.limit(0)).first()["score"] == 0.5
    assert quality(docs.limit(0), labels).count() == 0
    assert quality(docs.select("doc_id", "text"), labels).count() == docs.count()


def test_fit_recovers_a_known_line():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    view = fitted(x, y)
    assert np.allclose([*view.weights, view.intercept], [2, -1, 0.5], atol=0.25)


@pytest.mark.parametrize("tasks", [64, 2])
def test_all_unlabelled_documents_teach(spark, monkeypatch, tasks):
    """The same views as a plain fit to the labelled rows and every document of which the other view is sure, in whatever tasks."""
    monkeypatch.setattr(cotraining, "SUM_TASKS", tasks)
    rng = np.random.default_rng(1)
    side = rng.integers(0, 2, 9000)
    x = [rng.normal(size=(9000, 2)) + side[:, None] * 2, rng.normal(size=(9000, 3)) - side[:, None]]
    teachers = [fitted(v[:200], side[:200].astype(float)) for v in x]
    pool = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x[0][200:], x[1][200:], strict=True)], "content array<double>, metadata array<double>")
    got = _taught([(v[:200], side[:200].astype(float)) for v in x], pool.repartition(5), teachers, 2.0)
    for v, other in ((0, 1), (1, 0)):
        odds = teachers[other].odds(x[other][200:])
        sure = np.abs(odds) >= 2.0
        plain = fitted(np.vstack([x[v][:200], x[v][200:][sure]]), np.concatenate([side[:200], odds[sure] > 0]).astype(float))
        assert isinstance(got[v], View) and np.allclose([*got[v].weights, got[v].intercept], [*plain.weights, plain.intercept], atol=1e-5)


def test_every_language_of_the_labels_has_its_own_place(spark):
    rows = [(i, f"text {i}", ("de", "fr", "es")[i % 3], f"s{i % 40}", 8) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    assert sorted(model.places[1]) == ["de", "es", "fr"] and len(model.places[0]) == 40
    got = {r["lang"]: r["metadata_score"] for r in model.score(docs, [F.col("lang")]).collect()}
    assert got["de"] > 0.9 > 0.1 > max(got["fr"], got["es"])
