import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import add_model_text_column
from ledgerloom.operators.split import Split, stratified_random_split
from ledgerloom.operators.tfidf import (
    Tfidf,
    TfidfSettings,
    term_frequencies,
    term_statistics,
    text_statistics,
    tfidf_vocabulary,
    tfidf_weights,
)
from ledgerloom.plans import experiments, tuning
from ledgerloom.plans.models import (
    ForestSettings,
    LogisticSettings,
    MlClassifier,
    fit_field,
    fit_text_models,
)

TEXTS = ["red paint red", "red nails", "blue paint nails rope", "rope rope rope", "", "tea"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "line_id string, model_text string").cache()


@pytest.fixture(scope="module")
def lines(spark):
    """Learnable lines: the words tell the labels."""
    rows = []
    for i in range(60):
        kind = i % 3
        detail = ["green tea bags", "steel nails box", "printer paper pack"][kind] + f" lot{i % 4}"
        rows.append((f"l{i:02d}", detail, f"S{i % 2}", 1.0, 0.2, "TPO"[kind], ["KITCHEN", "WORKS", "OFFICE"][kind], f"T{i % 2}"))
    df = spark.createDataFrame(
        rows, "line_id string, DETAIL string, SUPPLIER string, NET double, VAT double, NOMINAL string, DEPARTMENT string, TC string")
    return add_model_text_column(df).cache()


@pytest.mark.parametrize("settings", [
    TfidfSettings(ngram_range=(1, 1)), TfidfSettings(sublinear_tf=True), TfidfSettings(min_df=2, max_df=0.5),
    TfidfSettings(max_features=3, ngram_range=(1, 3)),
])
def test_vector_form_equals_long_form(texts, settings):
    tfidf = Tfidf(maxFeatures=settings.max_features, minN=settings.ngram_range[0], maxN=settings.ngram_range[1],
                  minDF=settings.min_df, maxDF=settings.max_df, sublinear=settings.sublinear_tf)
    long = {}
    for r in tfidf_weights(texts, "line_id", "model_text", settings).collect():
        long.setdefault(r.line_id, {})[r.idx] = r.weight
    for r in tfidf.fit(texts).transform(texts).collect():
        own = dict(zip(r.features.indices.tolist(), r.features.values.tolist()))
        assert own.keys() == long.get(r.line_id, {}).keys()
        assert all(abs(own[i] - long[r.line_id][i]) < 1e-12 for i in own)
        assert not own or abs(math.sqrt(sum(v * v for v in own.values())) - 1) < 1e-12


def test_weights_by_hand(texts):
    rows = {r.term: r.weight for r in tfidf_weights(texts, "line_id", "model_text", TfidfSettings(ngram_range=(1, 1))).where("line_id = '0'").collect()}
    idf = math.log(7 / 3) + 1  # red and paint are both in two of six texts
    assert rows["red"] == pytest.approx(2 * idf / math.hypot(2 * idf, idf))


def test_vocabulary_order_and_ties(texts):
    got = tfidf_vocabulary(texts, "line_id", "model_text", TfidfSettings(max_features=3, ngram_range=(1, 1))).collect()
    # rope 4, red 3, then nails before paint at 2 each
    assert sorted((r.idx, r.term, r.cf) for r in got) == [(0, "nails", 2), (1, "red", 3), (2, "rope", 4)]


def test_statistics_without_keys(texts):
    a = {tuple(r) for r in term_statistics(term_frequencies(texts, "line_id", "model_text")).collect()}
    assert a == {tuple(r) for r in text_statistics(texts, "model_text", (1, 2)).collect()}


def test_empty_vocabulary(texts):
    with pytest.raises(ValueError, match="no terms"):
        Tfidf(minDF=99).fit(texts)


def test_logistic_optimum(spark):
    """At the fitted weights the gradient of C * loss + |w|^2 / 2 vanishes."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 4)) * [1.0, 0.8, 1.2, 1.0]
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=90) > 0.8, "b", np.where(x[:, 1] > 0.5, "c", "a"))
    df = spark.createDataFrame([(r.tolist(), str(t)) for r, t in zip(x, y)], "embedding array<double>, y string").coalesce(1)
    model = MlClassifier("embeddings", ["y"], settings=LogisticSettings(C=2.0, tol=1e-10, max_iter=500)).fit(df).fitted[0]
    w, b = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    weight = np.array([90 / (3 * (y == t).sum()) for t in y])
    z = x @ w.T + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    truth = np.array([[t == label for label in model.labels] for t in y])
    gradient = 2.0 * ((p - truth) * weight[:, None]).T @ x + w
    assert np.abs(gradient).max() < 1e-3 * 90
    assert model.labels == ["a", "b", "c"]


def test_classifier_arguments(texts):
    for bad in (dict(feature_type="x", targets=["a"]), dict(feature_type="tfidf", targets=["a", "b"]),
                dict(feature_type="tfidf", targets=[]), dict(feature_type="embeddings", targets=["a"], classifier="svm")):
        with pytest.raises(ValueError):
            MlClassifier(**bad)
    with pytest.raises(ValueError, match="not fitted"):
        MlClassifier("tfidf", ["a"]).predict(texts)


def test_text_models_and_probabilities(lines):
    split = stratified_random_split(lines)
    models = fit_text_models(split.train, ["NOMINAL", "TC"], LogisticSettings(max_iter=20))
    scored = models[0].predict(split.test).collect()
    assert all(r.NOMINAL_pred == r.NOMINAL and 0.33 < r.NOMINAL_confidence <= 1 for r in scored)
    proba = models[0].predict_proba(split.test).first().NOMINAL_proba
    assert set(proba) == {"T", "P", "O"} and sum(proba.values()) == pytest.approx(1)


def test_missing_and_single_labels(spark, lines):
    holes = lines.withColumn("NOMINAL", F.when(F.col("line_id") > "l05", F.col("NOMINAL"))).withColumn("TC", F.lit("T1"))
    vectors = holes.select(F.array(F.col("NET"), F.length("DETAIL").cast("double")).alias("embedding"), "NOMINAL", "TC")
    model = MlClassifier("embeddings", ["NOMINAL", "TC"], settings=LogisticSettings(max_iter=10)).fit(vectors)
    rows = model.predict(vectors).collect()
    assert len(rows) == 60 and {r.TC_pred for r in rows} == {"T1"} and rows[0].TC_confidence == 1.0
    with pytest.raises(ValueError, match="no labels"):
        fit_field(spark.createDataFrame([], "features array<double>, y string"), "y", LogisticSettings())


def test_forest_is_reproducible(lines):
    vectors = lines.select("line_id", "NOMINAL", F.array(F.length("DETAIL").cast("double"), F.ascii("DETAIL").cast("double")).alias("embedding"))
    settings = ForestSettings(n_estimators=5, max_depth=None, max_features="log2")
    runs = [
        {r.line_id: r.NOMINAL_confidence for r in MlClassifier("embeddings", ["NOMINAL"], "random_forest", settings=settings).fit(vectors).predict(vectors).collect()}
        for _ in range(2)
    ]
    assert runs[0] == runs[1]


def test_draws():
    drawn = tuning.draw_settings("random_forest", 20)
    assert drawn == tuning.draw_settings("random_forest", 20) and len(drawn) == 20
    assert all(100 <= s.n_estimators < 300 and 1 <= s.min_samples_leaf < 5 for s in drawn)
    listed = tuning.draw_settings("logistic_regression", 20)
    assert len(set(listed)) == 20 and len(tuning.draw_settings("logistic_regression", 99)) == 40
    assert math.prod(len(v) for v in tuning.TFIDF_GRID.values()) == 192


def test_searches(lines):
    grid = {"max_features": [50], "ngram_range": [(1, 1)], "min_df": [1], "max_df": [0.9], "sublinear_tf": [True], "C": [1.0]}
    found = tuning.grid_search_tfidf(lines, "NOMINAL", grid=grid, n_folds=2)
    assert found.best_score == pytest.approx(1.0) and len(found.scores) == 1
    vectors = lines.withColumn("embedding", F.array(*[F.ascii(F.substring("DETAIL", i, 1)) / 100 for i in (1, 2, 3)]))
    options = [LogisticSettings(C=0.001, max_iter=5), LogisticSettings(C=100.0, max_iter=30)]
    found = tuning.random_search_embeddings(vectors, ["NOMINAL", "DEPARTMENT"], settings=options)
    top = max(score for _, score in found.scores)
    assert found.best_score == top and found.best_params == next(p for p, score in found.scores if score == top)
    assert len(found.model.fitted) == 2


def test_macro_evaluator(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("a", "a"), ("b", "a")], "t string, p string")
    evaluator = tuning.MacroF1Evaluator([("t", "p"), ("t", "t")])
    assert evaluator.evaluate(df) == pytest.approx((6 / 14 + 1) / 2) and evaluator.isLargerBetter()


def test_experiments_end_to_end(spark, lines):
    runs, split = experiments.evaluate_lines(lines, dim=32, k=3)
    assert [r.method for r in runs][0].startswith("TF-IDF") and len(runs) == 4
    table = experiments.result_table(spark, runs)
    assert table.count() == 12
    for run in runs:
        assert run.scores["test_size"] == split.test.count() == 12
        assert run.scores["nominal_f1"] == pytest.approx(1.0)
        assert run.errors().count() == run.scores["n_errors"]
    assert runs[3].predictions.columns[-3:] == ["confidence", "reasoning", "failed"]


def test_novel_items(spark, lines):
    items = spark.createDataFrame([("n1", "Green tea"), ("n2", "Steel nails")], "line_id string, DETAIL string")
    rows = {r.line_id: r for r in experiments.classify_novel_items(items, lines, dim=64).collect()}
    assert rows["n1"].nominal == "T" and rows["n2"].department == "WORKS" and len(rows["n1"].examples) == 5
    assert rows["n1"].model_text == "detail: green tea" and rows["n1"].confidence["nominal"] == 1.0


def test_vector_run_with_given_split(lines):
    vectors = lines.withColumn("embedding", F.array(*[F.ascii(F.substring("DETAIL", i, 1)) / 100 for i in (1, 2, 3)]))
    made = stratified_random_split(vectors)
    run = experiments.vector_experiment(Split(made.data, made.level), tune=True, settings=[LogisticSettings(C=100.0, max_iter=30)])
    assert not run.is_baseline and run.method.endswith("(tuned)") and run.scores["nominal_acc"] == 1.0
