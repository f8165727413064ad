import math
import random

import pytest

from ledgerloom.llm import vector_search
from ledgerloom.llm.vector_search import exact_topk


def plain(rows, k, every=20):
    """Each query id's best pairs of one of its rows and a row of another id."""
    codes = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        codes.append((i, [math.floor(64 * x) for x in v]))
    out = []
    for q in sorted({i for i, _ in codes}):
        if q % every == 0:
            asked = [c for i, c in codes if i == q]
            scores = sorted((-sum(a * b for a, b in zip(x, c)), i) for x in asked for i, c in codes if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return out


def vectors(n, dim, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = [math.sin((i % 7) * (d + 1)) for d in range(dim)]
        rows.append((i, [x + rng.gauss(0, 0.3) for x in base] if i % 5 else base))
    return rows


@pytest.mark.parametrize(("block", "tile", "step"), [(16384, 256, 16), (50, 7, 3)])
def test_same_as_comparing_all(spark, monkeypatch, block, tile, step):
    for name, value in (("BLOCK_ROWS", block), ("SHEET_ROWS", block // 10), ("TILE", tile), ("STEP", step)):
        monkeypatch.setattr(vector_search, name, value)
    rows = vectors(400, 12)
    rows += [(401, None), (402, [1.0, None] + [0.0] * 10), (403, [float("nan")] + [0.0] * 11), (404, [float("inf")] + [0.0] * 11), (None, [9.0] * 12)]
    rows += [(420, [0.5, 0.25]), (440, []), (40, [100.0] * 12), (40, [-1.0] * 12)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = sorted(tuple(r) for r in exact_topk(df, 20, 9).collect())
    assert got == plain(rows, 9)


def test_few_candidates_ties_and_empty(spark):
    rows = [(i, [1.0, 1.0]) for i in (0, 5, 3, 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in exact_topk(df, 20, 20).collect()) == plain(rows, 20)
    assert exact_topk(df.limit(0)).count() == 0
    big = [(0, [1e6, 1.0]), (1, [1e6, 3.0]), (2, [-1e6, 0.0]), (20, [3e5, 7.0]), (21, [1e6, 3.0])]
    assert sorted(tuple(r) for r in exact_topk(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()) == plain(big, 20)
    with pytest.raises(Exception, match="63 bits"):
        exact_topk(spark.createDataFrame([(0, [1e9]), (1, [1e9])], df.schema)).collect()


def test_repeated_ids_keep_all_their_rows_like_the_sql(spark):
    import duckdb

    from ledgerloom.llm.queries import ORACLE

    rows = [(0, [5.0, 1.0]), (0, [1.0, 5.0]), (1, [1.0, 0.0]), (1, [0.0, 5.0]), (1, [0.0, 5.0]), (2, [3.0, 3.0]), (40, [2.0, 2.0])]
    rows += [(7, [float(i % 3), 1.0]) for i in range(300)]  # one hot id
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, _place int")
    got = sorted(tuple(r) for r in exact_topk(df).collect())
    assert got == plain(rows, 20)
    embeddings = df.toPandas()  # noqa: F841  read by the SQL below
    assert got == sorted(duckdb.sql(ORACLE["op8_exact_search"]).fetchall())
