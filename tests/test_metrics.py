import random

import pytest

from ledgerloom.config import REPORT_FIELDS
from ledgerloom.operators import errors, metrics, results

NAMES = ["line_id", "detail", "supplier"] + [f"{s}_{f}" for f in REPORT_FIELDS for s in ("true", "pred")]


def table(spark, rows):
    full = [(str(i), "d", r[0], *r[1:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ", ".join(f"{n} string" for n in NAMES))


def macro(pairs):
    classes = {x for p in pairs for x in p if x is not None}
    scores = []
    for c in classes:
        tp = sum(t == p == c for t, p in pairs)
        bad = sum((t == c) != (p == c) for t, p in pairs)
        scores.append(2 * tp / (2 * tp + bad) if tp + bad else 0)
    return sum(scores) / len(scores)


def test_against_plain_python(spark):
    rng = random.Random(1)
    pick = lambda: rng.choice(["a", "b", "c", "", None])
    rows = [("s", *[pick() for _ in range(6)]) for _ in range(200)]
    preds = table(spark, rows)
    got = {r.field: r for r in metrics.field_metrics(preds).collect()}
    numbers = metrics.evaluate_predictions(preds)
    for i, f in enumerate(REPORT_FIELDS):
        pairs = [(r[1 + 2 * i], r[2 + 2 * i]) for r in rows]
        right = sum(t is not None and t == p for t, p in pairs)
        assert got[f].n_correct == right and got[f].accuracy == pytest.approx(right / 200)
        assert got[f].f1_macro == pytest.approx(macro(pairs))
        assert numbers[f"{f}_f1"] == pytest.approx(macro(pairs))
    shares = [sum(r[1 + 2 * i] is not None and r[1 + 2 * i] == r[2 + 2 * i] for i in range(3)) / 3 for r in rows]
    assert metrics.sample_wise_f1(preds).first()[0] == pytest.approx(sum(shares) / 200)
    assert numbers["sample_wise_f1"] == pytest.approx(sum(shares) / 200)
    assert numbers["error_rate"] == pytest.approx(metrics.error_rate(preds).first().error_rate)


def test_macro_is_not_weighted(spark):
    preds = table(spark, [("s", t, p, "d", "d", "t", "t") for t, p in [("a", "a"), ("a", "a"), ("a", "a"), ("b", "a")]])
    report = {r.label: r for r in metrics.class_report(preds).where("field = 'nominal'").collect()}
    assert report["b"].f1 == 0 and report["b"].support == 1
    assert metrics.field_metrics(preds).where("field = 'nominal'").first().f1_macro == pytest.approx(6 / 14)


def test_empty_table_is_an_error(spark):
    with pytest.raises(ValueError):
        metrics.evaluate_predictions(table(spark, []))


@pytest.mark.parametrize(
    "wrong,hist,f1",
    [((14, 33, 17), (34, 9, 4), 0.9576), ((16, 32, 18), (32, 8, 6), 0.9563),
     ((35, 45, 23), (58, 12, 7), 0.9317), ((23, 39, 14), (36, 11, 6), 0.9496)],
)
def test_published_arithmetic(spark, wrong, hist, f1):
    """Rows re-created with the published error counts of 503 test lines."""
    left, rows = list(wrong), []
    for n_wrong, count in ((3, hist[2]), (2, hist[1]), (1, hist[0])):
        for _ in range(count):
            order = sorted(range(3), key=lambda i: -left[i])[:n_wrong]
            for i in order:
                left[i] -= 1
            rows.append(("s", *[x for i in range(3) for x in ("t", "w" if i in order else "t")]))
    assert left == [0, 0, 0]
    rows += [("s", "t", "t", "t", "t", "t", "t")] * (503 - len(rows))
    preds = table(spark, rows)
    assert metrics.sample_wise_f1(preds).first()[0] == pytest.approx(f1, abs=5e-5)
    assert {r.n_wrong: r.n_rows for r in errors.wrong_field_histogram(preds).collect()} == dict(zip((1, 2, 3), hist))
    shares = {r.field: r for r in errors.error_field_shares(preds).collect()}
    assert [shares[f].n_wrong for f in REPORT_FIELDS] == list(wrong)
    assert shares["nominal"].share == pytest.approx(wrong[0] / sum(hist))
    assert metrics.error_rate(preds).first().n_errors == sum(hist)


def test_confusions_suppliers_and_collapse(spark):
    rows = [("s1", "b", "a", "D", "E", "t", "t")] * 3 + [("s1", "c", "a", "D", "D", "t", "t")] * 2
    rows += [("s2", "a", "b", "D", "D", "t", "t")] * 2 + [("s2", "a", "a", "D", "D", "t", "t")] * 5
    preds = table(spark, rows)
    top = [(r.field, r.true, r.pred, r.n, r["rank"]) for r in errors.confusion_topk(preds, 2).orderBy("field", "rank").collect()]
    assert top == [("department", "D", "E", 3, 1), ("nominal", "b", "a", 3, 1), ("nominal", "a", "b", 2, 2)]
    by = {r.supplier: r for r in errors.supplier_errors(preds).collect()}
    assert (by["s1"].n_error_rows, by["s1"].n_wrong_labels, by["s1"].n_confusions) == (5, 8, 3)
    assert by["s2"].n_error_rows == 2 and sum(c.field == "department" for c in by["s1"].confusions) == 1
    train = preds.select(*[f"true_{f}" for f in REPORT_FIELDS])
    row = errors.majority_collapse(train, preds).where("field = 'nominal'").first()
    assert (row.majority_label, row.n_errors, row.n_to_majority, row.n_zero_f1) == ("a", 7, 5, 2)


def test_result_tables(spark):
    ddl = ("experiment string, method string, field string, f1_macro double, accuracy double, "
           "sample_wise_f1 double, time_seconds double, test_size bigint, is_baseline boolean, run_order int")
    rows = []
    for order, (m, f1) in enumerate([("base", 0.5), ("tuned", 0.8), ("late", 0.8), ("zero", 0.0)]):
        rows += [("e", m, f, f1, f1, f1, 1.0, 10, order == 0, order) for f in REPORT_FIELDS]
    table_ = spark.createDataFrame(rows, ddl)
    scores = results.method_scores(table_)
    board = results.leaderboard(scores).orderBy("rank").collect()
    assert [r.method for r in board] == ["tuned", "late", "base", "zero"]
    assert [r.winner for r in board] == [True, False, False, False] and board[0].passed and not board[2].passed
    assert results.best_method(scores).first().method == "tuned"
    assert results.winner_fields(table_).count() == 3
    change = results.improvement(scores, "base", "tuned", ["experiment"]).first()
    assert change.kept == "tuned" and change.percent_change == pytest.approx(60)
    same = results.improvement(scores, "tuned", "late", ["experiment"]).first()
    assert same.kept == "tuned" and same.change == 0
    assert results.improvement(scores, "zero", "base", ["experiment"]).first().percent_change == 0
    parts = [spark.createDataFrame([(m, 0.5)], f"method string, {n} double") for m, n in
             (("x", "overall_f1_macro"), ("y", "avg_f1_macro"), ("z", "best_f1_macro"))]
    parts.append(spark.createDataFrame([("none",)], "method string"))
    got = {r.method: r.f1_macro for r in results.union_results(parts).collect()}
    assert got == {"x": 0.5, "y": 0.5, "z": 0.5, "none": 0.0}
