import math
import warnings

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import labels, split


@pytest.fixture(scope="module")
def lines(spark):
    """One label combination holds most rows."""
    kinds = [("A", "X", "1")] * 60 + [("B", "X", "1")] * 25 + [("B", "Y", "2")] * 15
    return spark.createDataFrame(
        [(f"id{i}", *k) for i, k in enumerate(kinds)],
        "line_id string, NOMINAL string, DEPARTMENT string, TC string",
    ).cache()


def sides(made):
    return {r.line_id: r.split for r in made.data.collect()}


def test_vocabulary_codes_and_back(spark):
    df = spark.createDataFrame(
        [("1", "b", "x", "t"), ("2", "a", None, "t"), ("3", None, "y", "t"), ("4", "É", "x", "t")],
        "line_id string, NOMINAL string, DEPARTMENT string, TC string",
    )
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        coded, vocabulary = labels.encode_labels(df)
    assert sum("coded as -1" in str(w.message) for w in seen) == 2
    got = {r.line_id: (r.NOMINAL_idx, r.DEPARTMENT_idx, r.TC_idx) for r in coded.collect()}
    assert got == {"1": (1, 0, 0), "2": (0, -1, 0), "3": (-1, 1, 0), "4": (2, 0, 0)}
    back = labels.decode_labels(coded, vocabulary, {"NOMINAL_idx": "NOMINAL"})
    assert {r.line_id: r.NOMINAL_idx_label for r in back.collect()} == {
        "1": "b", "2": "a", "3": "UNKNOWN", "4": "É"}
    assert labels.build_label_vocab(df) == {"nominal": ["a", "b", "É"], "department": ["x", "y"], "tax_code": ["t"]}


def test_field_without_labels_is_an_error(spark):
    df = spark.createDataFrame([("a", None)], "NOMINAL string, TC string")
    with pytest.raises(ValueError, match="TC"):
        labels.encode_labels(df, ["NOMINAL", "TC"])


def test_vocabulary_is_never_cut(lines):
    with pytest.raises(ValueError, match="more than 3"):
        labels.build_label_vocab(lines, max_labels=3)


def test_weights_and_profile(lines):
    weights = {r.label: r.weight for r in labels.balanced_weights(lines, "NOMINAL").collect()}
    assert weights == {"A": 100 / (2 * 60), "B": 100 / (2 * 40)}
    profile = {r.metric: r.value for r in labels.dataset_profile(lines).collect()}
    assert profile == {"rows": 100, "classes_nominal": 2, "classes_department": 2, "classes_tc": 2}
    assert labels.rare_classes(lines, 16).count() == 2


def test_split_sizes_and_layout_independence(lines):
    made = split.stratified_random_split(lines)
    assert made.level == "all_fields"
    got = sides(made)
    assert len(got) == 100 and sum(s == "test" for s in got.values()) == 20
    per = {tuple(r)[:3]: r["count"] for r in made.train.groupBy("NOMINAL", "DEPARTMENT", "TC").count().collect()}
    assert per == {("A", "X", "1"): 48, ("B", "X", "1"): 20, ("B", "Y", "2"): 12}
    for n in (1, 17):
        assert sides(split.stratified_random_split(lines.repartition(n))) == got


def test_hot_stratum_in_pieces_gives_the_same_split(lines):
    whole, pieces = split.stratified_random_split(lines), split.stratified_random_split(lines, max_rank_rows=3)
    assert sides(whole) == sides(pieces)
    folds = [
        {r.line_id: r.fold for r in split.stratified_folds(lines, "NOMINAL", 5, max_rank_rows=m).collect()}
        for m in (1000, 3)
    ]
    assert folds[0] == folds[1]


@pytest.mark.parametrize("n", [5, 7, 33, 101])
def test_exact_size(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("line_id"))
    made = split.random_split(df)
    assert sum(s == "test" for s in sides(made).values()) == math.ceil(0.2 * n)


def test_levels(spark, lines):
    rare = spark.createDataFrame([("r", "A", "Z", "1")], lines.schema)
    with pytest.warns(UserWarning, match="too rare"):
        assert split.stratified_random_split(lines.union(rare)).level == "NOMINAL"
    alone = spark.createDataFrame([("r", None, "Z", "1")], lines.schema)
    with pytest.warns(UserWarning):
        made = split.stratified_random_split(lines.union(alone))
    assert made.level == "random" and sum(s == "test" for s in sides(made).values()) == 21
    with pytest.raises(ValueError):
        split.stratified_random_split(lines.where("false"))


def test_null_labels_form_a_stratum(spark):
    df = spark.createDataFrame(
        [(str(i), None if i % 2 else "A", "D", "T") for i in range(40)],
        "line_id string, NOMINAL string, DEPARTMENT string, TC string",
    )
    made = split.stratified_random_split(df)
    assert made.test.where("NOMINAL is null").count() == 4


def test_folds_are_even_per_class(lines):
    folded = split.stratified_folds(lines, "NOMINAL", 5)
    sizes = {(r.NOMINAL, r.fold): r["count"] for r in folded.groupBy("NOMINAL", "fold").count().collect()}
    assert sizes == {**{("A", f): 12 for f in range(5)}, **{("B", f): 8 for f in range(5)}}
    few = split.stratified_folds(lines.limit(3), "NOMINAL", 5)
    assert few.count() == 3 and few.select("fold").distinct().count() == 3


def test_groups_stay_together(spark):
    df = spark.range(200).select("id", F.when(F.col("id") < 90, 0).otherwise(F.col("id") % 10).alias("g"))
    made = split.group_split(df, "g")
    per = made.data.groupBy("g").agg(F.count_distinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert all(r.n == 1 for r in per) and sum(r.s == "train" for r in per) == 8


def test_clusters_stay_together(spark):
    df = spark.range(60).select("id", F.array((F.col("id") % 6).cast("double"), F.lit(1.0)).alias("embedding"))
    made = split.semantic_holdout_split(df, id_col="id")
    assert made.data.groupBy("cluster").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert {r.split for r in made.data.select("split").distinct().collect()} == {"train", "test"}


def test_prepare_sides(lines):
    train, test = split.prepare_multilabel_data(split.stratified_random_split(lines))
    assert train.count() == 80 and test.count() == 20
    assert set(train.first().labels.asDict()) == {"nominal", "department", "tax_code"}
    with pytest.raises(ValueError, match="test side"):
        split.prepare_multilabel_data(split.Split(lines.withColumn("split", F.lit("train")), "x"))
