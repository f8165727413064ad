import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import retrieval
from ledgerloom.operators.approximate import approximate_knn
from ledgerloom.operators.kept_index import SemanticIndex
from ledgerloom.operators.review import merge_corrections

SCHEMA = "idx long, text string, nominal string, department string, tax_code string, embedding array<double>"


def vectors(n, dim=6, seed=1, first=0):
    rng = random.Random(seed)
    rows = []
    for i in range(first, first + n):
        base = [float((i % 7) * (d + 1) % 5) for d in range(dim)]
        v = [0.0] * dim if i % 41 == 40 else [x + rng.gauss(0, 0.4) for x in base] if i % 5 else base
        rows.append((i, f"text {i}", f"N{i % 3}", f"D{i % 4}", None if i % 9 == 0 else f"T{i % 2}", v))
    return rows


def as_rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "idx", F.round("distance", 6)).collect())


def asked(spark, n=60, seed=5):
    return spark.createDataFrame([(r[0], r[5]) for r in vectors(n, seed=seed)], "query_id long, embedding array<double>")


@pytest.mark.parametrize("block_rows", [8192, 16])
def test_same_as_without_an_index(spark, tmp_path, block_rows):
    df = spark.createDataFrame(vectors(500), SCHEMA)
    SemanticIndex.fit(df, str(tmp_path / "index"))
    index = SemanticIndex.open(spark, str(tmp_path / "index"))
    assert as_rows(index.knn(asked(spark), 4, block_rows=block_rows)) == as_rows(retrieval.knn(asked(spark), df, 4))
    found = index.retrieve(asked(spark), 4, min_similarity=0.9)
    plain = retrieval.retrieve(asked(spark), df, 4, min_similarity=0.9)
    columns = ["query_id", "rank", "idx", "text", "nominal", "department"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, plain.select(*columns).collect()))


def test_only_visited_cells_are_read(spark, tmp_path):
    rng = random.Random(4)
    apart = [(i, "t", "N", "D", "T", [(i % 12 == d) + rng.gauss(0, 0.02) for d in range(12)]) for i in range(900)]
    df = spark.createDataFrame(apart, SCHEMA)
    index = SemanticIndex.fit(df, str(tmp_path / "index"))
    few = spark.createDataFrame([(i, apart[i][5]) for i in (1, 13)], "query_id long, embedding array<double>")
    winners, visited = index._knn(few, 3, "query_id", 8192)
    assert 0 < len(visited) < len(index.cells) // 2
    read = index.rows(visited)
    plan = read._jdf.queryExecution().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "cell" in filters and "generation" in filters
    assert {f[0].split("/cell=")[1].split("/")[0] for f in read.select(F.input_file_name()).distinct().collect()} == set(map(str, visited))
    assert as_rows(winners) == as_rows(retrieval.knn(few, df, 3))


def test_same_files_under_any_partitioning(spark, tmp_path):
    df = spark.createDataFrame(vectors(300), SCHEMA)
    one = SemanticIndex.fit(df.repartition(1), str(tmp_path / "one"))
    two = SemanticIndex.fit(df.repartition(7), str(tmp_path / "two"))
    cells = lambda index: sorted(map(tuple, index.rows().select("idx", "cell").collect()))
    assert cells(one) == cells(two) and sum(n for _, n, _, _ in one.cells.values()) == 300


def test_upkeep_is_a_rebuild_that_writes_touched_cells_only(spark, tmp_path):
    path = str(tmp_path / "index")
    old = spark.createDataFrame(vectors(600), SCHEMA)
    first = SemanticIndex.fit(old, path)
    # One changed row, two new ones, one of the old ones in another place, and corrections of old and new rows.
    moved = [(7, "moved", "N9", "D9", "T9", [-1.0, 5.0, 0.0, 2.0, 0.5, 0.1])]
    new = spark.createDataFrame(vectors(2, first=600) + moved, SCHEMA)
    fixes = spark.createDataFrame([(3, 1, "A", None, None), (3, 2, "B", "C", None), (601, 1, None, "E", None), (5000, 1, "X", "X", "X")],
                                  "idx long, corrected_at int, nominal string, department string, tax_code string")
    second = first.update(corrections=fixes, lines=new)
    written = {d for d in os.listdir(f"{path}/rows/generation=1") if d.startswith("cell=")}
    assert 0 < len(written) <= 6 < len(first.cells)
    whole = merge_corrections(old.where("idx <> 7").unionByName(new), fixes)
    columns = ["idx", "text", "nominal", "department", "tax_code"]
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    for index in (second, SemanticIndex.open(spark, path)):
        assert index.generation == 1 and rows(index.rows()) == rows(whole)
        assert as_rows(index.knn(asked(spark), 3)) == as_rows(retrieval.knn(asked(spark), whole, 3))
    # Who opened the index before still reads what it saw.
    assert rows(first.rows()) == rows(old)
    assert first.update() is first
    third = second.update(lines=spark.createDataFrame(vectors(1, first=700), SCHEMA))
    assert third.rows().count() == 603 and third.generation == 2


def test_an_update_that_fails_midway_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    index = SemanticIndex.fit(spark.createDataFrame(vectors(100), SCHEMA), path)
    # Rows of a next generation without its table of cells, as a lost driver leaves them.
    index.rows([0]).write.partitionBy("cell").parquet(f"{path}/rows/generation=1")
    again = SemanticIndex.open(spark, path)
    assert again.generation == 0 and again.rows().count() == 100
    assert again.update(lines=spark.createDataFrame(vectors(1, first=100), SCHEMA)).rows().count() == 101


def test_empty_zero_and_small_indexes(spark, tmp_path):
    empty = SemanticIndex.fit(spark.createDataFrame([], SCHEMA), str(tmp_path / "empty"))
    assert empty.knn(asked(spark)).count() == 0
    assert SemanticIndex.open(spark, str(tmp_path / "empty")).rows().count() == 0
    filled = empty.update(lines=spark.createDataFrame(vectors(80), SCHEMA))
    assert as_rows(filled.knn(asked(spark), 2)) == as_rows(retrieval.knn(asked(spark), spark.createDataFrame(vectors(80), SCHEMA), 2))
    zeros = [(i, "t", None, None, None, [0.0] * 6) for i in range(3)]
    index = SemanticIndex.fit(spark.createDataFrame(zeros, SCHEMA), str(tmp_path / "zeros"))
    assert {tuple(r) for r in index.knn(asked(spark, 2), 5).select("idx", "distance").collect()} == {(i, 1.0) for i in range(3)}
    assert index.knn(asked(spark).limit(0)).count() == 0


# ---- approximate neighbours ----


def test_approximate_neighbours_are_near(spark):
    df = spark.createDataFrame(vectors(900), SCHEMA)
    queries = asked(spark, 90)
    exact = as_rows(retrieval.knn(queries, df, 5))
    found = approximate_knn(queries, df, 5)
    got = as_rows(found)
    assert len(got) == len(exact)
    hits = len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in exact})
    assert hits / len(exact) >= 0.9
    distance = {(q, i): d for q, _, i, d in as_rows(retrieval.knn(queries, df, 900))}
    assert all(distance[(q, i)] == pytest.approx(d, abs=1e-6) for q, _, i, d in got)
    assert as_rows(approximate_knn(queries.repartition(7), df.repartition(3), 5, block_rows=20)) == got


def test_hot_buckets_and_scarce_ones_are_answered_exactly(spark):
    df = spark.createDataFrame(vectors(400), SCHEMA)
    queries = asked(spark, 50)
    exact = as_rows(retrieval.knn(queries, df, 5))
    hot = approximate_knn(queries, df, 5, hot_bucket=3)
    assert as_rows(hot) == exact and hot.where("NOT exact").count() == 0
    scarce = approximate_knn(queries, df, 5, tables=1, bits=12, flips=0)
    assert scarce.groupBy("query_id").count().where("count <> 5").count() == 0
    sure = {r["query_id"] for r in scarce.where("exact").collect()}
    assert sure and [r for r in as_rows(scarce) if r[0] in sure] == [r for r in exact if r[0] in sure]
    assert approximate_knn(queries.limit(0), df).count() == 0 and approximate_knn(queries, df.limit(0)).count() == 0
