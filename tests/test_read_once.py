"""Rows that several passes read are joined once, and nothing is written larger or by fewer tasks than it need be."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import catalogue
from ledgerloom.operators import retrieval, split, tfidf
from ledgerloom.scale import quota_thresholds, shared_root
from ledgerloom.sources import lines as files


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    day = datetime.datetime(2024, 1, 2)
    made = {
        "lineitem": ([(i // 4, i % 6, i % 5, i % 4, float(i), 10.0 + i, 0.1, 0.01 * (i % 2)) for i in range(240)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"),
        "orders": ([(o, o % 7, day) for o in range(60)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "customer": ([(c, "A" if c % 2 else None) for c in range(7)], "c_custkey long, c_mktsegment string"),
        "part": ([(p, f"part {p}", "B", f"type {p % 2}") for p in range(6)], "p_partkey long, p_name string, p_brand string, p_type string"),
        "supplier": ([(s, f"Supplier {s}") for s in range(5)], "s_suppkey long, s_name string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def test_split_and_predictions_read_kept_lines(spark, tables):
    data = catalogue.line_split(spark, tables).data
    assert data.count() == 240
    found = catalogue.predictions(spark, tables)
    assert found.count() == 48
    for df in (data, found, catalogue.majority(spark, tables)):
        assert df.inputFiles() and all("/kept-" in f for f in df.inputFiles())


def test_lines_are_joined_to_orders_that_know_their_customers(spark, tables):
    plan = catalogue.ap_lines(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 4 and "o_custkey" in joins[-1]


def test_files_that_lack_a_column_are_compressed_and_replaced(spark, tables):
    from pathlib import Path

    before = set(Path(shared_root(spark)).glob("lacking-*"))
    rows = {r["column"]: r["problem"] for r in catalogue.QUERIES["csv_missing_columns"](spark, tables).collect()}
    assert rows == {c: f"missing columns: {c}" for c in files.REQUIRED_COLUMNS}
    (folder,) = set(Path(shared_root(spark)).glob("lacking-*")) - before
    written = [f for f in folder.iterdir() if f.name.startswith("part-")]
    assert written and all(f.name.endswith(".csv.gz") for f in written)
    assert spark.read.option("header", True).csv(str(folder)).count() == 240


def test_only_pieces_of_larger_strata_are_ranked(spark):
    keys = spark.range(5000).select(F.lit("s").alias("stratum"), F.md5(F.col("id").cast("string").cast("binary")).alias("key"))
    quotas = spark.createDataFrame([("s", 0), ("s", 1), ("s", 4000), ("s", 5000)], "stratum string, quota bigint")
    found = quota_thresholds(keys, quotas, 5000)
    ordered = sorted(r.key for r in keys.collect())
    assert {r.quota: r.threshold for r in found.collect()} == {0: "", 1: ordered[0], 4000: ordered[3999], 5000: ordered[4999]}
    seen = []
    real = quota_thresholds.__globals__["small_side"]
    quota_thresholds.__globals__["small_side"] = lambda df, *a: seen.append(df.columns) or real(df, *a)
    try:
        quota_thresholds(keys, quotas, 5000)
    finally:
        quota_thresholds.__globals__["small_side"] = real
    assert ["stratum", "_piece"] in seen


def test_levels_are_ruled_out_without_shuffling_names(spark, monkeypatch):
    """Every line a class of its own: no table of names is made for the levels that fail."""
    made = []
    real = split.small_side
    monkeypatch.setattr(split, "small_side", lambda df, *a: made.append(df.columns) or real(df, *a))
    df = spark.range(50).select(F.col("id").cast("string").alias("line_id"), F.col("id").cast("string").alias("NOMINAL"), F.lit("D").alias("DEPARTMENT"), F.lit("T").alias("TC"))
    with pytest.warns(UserWarning):
        got = split.stratified_random_split(df)
    assert got.level == "random" and got.test.count() == 10
    assert ["stratum", "c"] not in made


def test_a_large_report_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    report = spark.range(100).repartition(4).select(F.col("id").cast("string").alias("detail"))
    few = files.write_error_report(report, str(tmp_path / "few"), "run")
    monkeypatch.setattr(files, "ONE_FILE_ROWS", 99)
    many = files.write_error_report(report, str(tmp_path / "many"), "run")
    one = files.write_error_report(report, str(tmp_path / "one"), "run", single_file=True)
    numbers = [len(spark.read.csv(p).inputFiles()) for p in (few, many, one)]
    assert numbers[0] == 1 and numbers[1] > 1 and numbers[2] == 1
    assert files.read_error_report(spark, many).count() == 100


def test_texts_read_several_times_are_kept(spark, tables):
    for name in ("stripped_text", "trained_vectors"):
        found = catalogue.QUERIES[name](spark, tables)
        assert all("/kept-" in f for f in found.inputFiles()) and found.inputFiles()


def test_vectors_are_compared_without_sorting_rows(spark, tables):
    plan = catalogue.QUERIES["trained_vectors"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


# ---- neighbours ----


def brute_force(queries, rows, ids, k):
    distance = np.round(1.0 - queries @ rows.T, retrieval.DIGITS)
    return [(q, ids[i], distance[q, i]) for q in range(len(queries)) for i in np.lexsort((ids, distance[q]))[:k]]


@pytest.mark.parametrize("tile", [40, 4_000_000])
@pytest.mark.parametrize("k", [1, 3, 50])
def test_best_rows_with_many_equal_distances(monkeypatch, tile, k):
    monkeypatch.setattr(retrieval, "TILE", tile)
    monkeypatch.setattr(retrieval, "TILE_QUERIES", 7)
    rng = np.random.default_rng(1)
    rows = np.eye(4)[rng.integers(0, 4, 30)]
    rows[5:15] = 0
    queries = np.vstack([np.eye(4), np.zeros((3, 4)), np.full((4, 4), 0.5)])
    ids = rng.permutation(30)
    found = retrieval._best(queries, rows, ids, k)
    assert [tuple(r) for r in found.itertuples(index=False)] == brute_force(queries, rows, ids, k)


def test_equal_distances_are_not_all_kept(monkeypatch):
    """A zero query is equally far from every row: only its k answers are sorted."""
    most = []
    real = np.argsort
    monkeypatch.setattr(retrieval.np, "argsort", lambda a, **kw: most.append(a.shape[-1]) or real(a, **kw))
    retrieval._best(np.zeros((5, 4)), np.eye(4)[np.arange(4000) % 4], np.arange(4000), 5)
    assert max(most[1:]) <= 10


@pytest.mark.parametrize("pack_rows", [3, 16, 1000])
def test_packs_of_small_and_large_cells_are_exact(spark, monkeypatch, pack_rows):
    monkeypatch.setattr(retrieval, "PACK_ROWS", pack_rows)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 6))
    vectors = centres[rng.integers(0, 5, 150)] + 0.05 * rng.normal(size=(150, 6))
    vectors[:12] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "idx long, embedding array<double>")
    asked = df.where("idx % 4 = 0").withColumnRenamed("idx", "query_id")
    columns = ["query_id", "idx", "rank"]
    found = [sorted(tuple(r) for r in retrieval.knn(asked, df, 4, method=m, block_rows=2).select(columns).collect()) for m in ("blocks", "broadcast")]
    assert found[0] == found[1] and len(found[0]) == 38 * 4


def test_small_blocks_are_compared_together(spark):
    """Cells of two rows: many cells, one pack, and each query meets it once."""
    pivots = np.eye(8)
    cells = retrieval._pack({c: retrieval._Cell(2, 0.0, 1.6) for c in range(8)}, pivots, 1000)
    assert {c.first for c in cells.values()} == {0}
    asked = spark.createDataFrame([(i, [1.0] * 8, 2.0) for i in range(5)], "query_id long, embedding array<double>, bound double")
    visits = retrieval._visits(asked, pivots, cells, 3, False).collect()
    assert len(visits) == 5 and all(sorted(v["cells"]) == list(range(8)) for v in visits)


def test_large_answers_from_a_short_index_are_not_ranked_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 10)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(60, 3)))], "idx long, embedding array<double>")
    asked = df.withColumnRenamed("idx", "query_id")
    found = retrieval.knn(asked, df, 20)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    plain = retrieval.knn(asked, df, 20, method="broadcast")
    rows = lambda d: sorted((r["query_id"], r["rank"], r["idx"], r["distance"]) for r in d.collect())
    assert rows(found) == rows(plain)
    twice = asked.unionByName(asked)  # a repeated key is ranked over all its rows, as by the other plans
    assert rows(retrieval.knn(twice, df, 20)) == rows(retrieval.knn(twice, df, 20, method="broadcast"))


def test_terms_are_counted_without_sorting(spark):
    df = spark.createDataFrame([("x", "aa bb aa"), ("x", "bb cc"), ("y", "aa aa aa"), ("y", None), ("y", "")], "side string, text string")
    found = tfidf.text_statistics(df, "text", (1, 2), by=["side"])
    assert "sort_array" not in found._jdf.queryExecution().analyzed().toString()
    assert {(r["side"], r["term"]): (r["df"], r["cf"]) for r in found.collect()} == {
        ("x", "aa"): (1, 2), ("x", "bb"): (2, 2), ("x", "cc"): (1, 1), ("x", "aa bb"): (1, 1), ("x", "bb aa"): (1, 1), ("x", "bb cc"): (1, 1),
        ("y", "aa"): (1, 3), ("y", "aa aa"): (1, 2),
    }
