import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.metrics import field_metrics_of
from ledgerloom.plans import experiments, tuning
from ledgerloom.plans.models import LogisticSettings


def test_macro_f1_of_counts_is_that_of_the_table(spark):
    rng = random.Random(3)
    counts = {}
    for _ in range(200):
        key = (rng.choice(["x", "y"]), rng.choice(["a", "b", "c", None]), rng.choice(["a", "b", "d"]))
        counts[key] = counts.get(key, 0) + 1
    rows = [(*key, n) for key, n in counts.items()]
    df = spark.createDataFrame(rows, "field string, true string, pred string, n long")
    table = field_metrics_of(df, ["field"]).agg(F.avg("f1_macro")).first()[0]
    assert tuning.macro_f1_of_counts(rows) == pytest.approx(table)
    assert tuning.macro_f1_of_counts([]) == 0.0
    assert tuning.macro_f1_of_counts([("x", None, "a", 3)]) == 0.0


def test_scores_follow_from_the_counts_and_every_row_is_held_out_once(spark):
    rows = [(str(i), [float(i % 3 == d) + 0.1 * (i % 7) for d in range(3)], f"N{i % 3}", None if i % 10 == 9 else f"D{i % 2}") for i in range(90)]
    df = spark.createDataFrame(rows, "line_id string, embedding array<double>, NOMINAL string, DEPARTMENT string")
    settings = [LogisticSettings(C=0.1, max_iter=20), LogisticSettings(C=10.0, max_iter=20)]
    found = tuning.random_search_embeddings(df, ["NOMINAL", "DEPARTMENT"], settings=settings)
    counts = found.counts(spark)
    assert counts.groupBy("setting", "field").agg(F.sum("n").alias("n")).where("n <> 90").count() == 0
    assert counts.select("setting", "fold").distinct().count() == 6
    by_fold = field_metrics_of(counts, ["setting", "fold", "field"]).groupBy("setting", "fold").agg(F.avg("f1_macro").alias("f"))
    again = {r["setting"]: r["f"] for r in by_fold.groupBy("setting").agg(F.avg("f").alias("f")).collect()}
    assert [score for _, score in found.scores] == pytest.approx([again[0], again[1]])
    assert found.best_score == max(score for _, score in found.scores)


def test_draws_come_from_the_spaces_and_repeat():
    for classifier, space in (("logistic_regression", tuning.LOGISTIC_SPACE), ("random_forest", tuning.FOREST_SPACE)):
        drawn = tuning.draw_settings(classifier, 20)
        assert len(drawn) == 20 and drawn == tuning.draw_settings(classifier, 20)
        assert all(vars(s)[k] in list(v) for s in drawn for k, v in space.items())
    assert len(set(tuning.draw_settings("logistic_regression", 1000))) == 40


def test_novel_items_read_past_lines_once(spark):
    lines = spark.createDataFrame(
        [(f"l{i}", ["red bolt", "blue nut", "green saw", "black pen"][i % 4], "s", f"N{i % 4}", "D", "T") for i in range(40)],
        "line_id string, DETAIL string, SUPPLIER string, NOMINAL string, DEPARTMENT string, TC string",
    )
    items = spark.createDataFrame([("n1", "green saw"), ("n2", "")], "line_id string, DETAIL string")
    out = {r["line_id"]: r for r in experiments.classify_novel_items(items, lines, k=3, dim=32).collect()}
    assert out["n1"]["nominal"] == "N2" and len(out["n1"]["examples"]) == 3 and set(out) == {"n1", "n2"}
