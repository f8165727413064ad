import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import inference, prompts, retrieval
from ledgerloom.operators.vote import vote

SCHEMA = "idx bigint, text string, nominal string, department string, tax_code string, embedding array<double>"


def frame(spark, vectors):
    rows = [(i, f"t{i}", f"N{i % 3}", f"D{i % 2}", None if i % 5 == 0 else "T", [float(x) for x in v])
            for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def asked(spark, vectors):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "query_id bigint, embedding array<double>").repartition(3)


def brute(queries, index, k):
    out = []
    for q, v in enumerate(queries):
        scored = []
        for i, w in enumerate(index):
            norm = np.linalg.norm(v) * np.linalg.norm(w)
            scored.append((round(1 - float(v @ w) / norm, 9) if norm else 1.0, i))
        out += [(q, i, r, d + 0.0) for r, (d, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.idx, r["rank"], r.distance + 0.0) for r in df.collect())


def same(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert np.allclose([x[3] for x in a], [x[3] for x in b], atol=2e-9)


@pytest.fixture(scope="module")
def skewed():
    """Clusters, copies making up a third of the rows, and zero vectors."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    index = centres[rng.integers(0, 6, 240)] + 0.05 * rng.normal(size=(240, 8))
    index[80:160] = index[80]
    index[200:210] = 0
    queries = np.vstack([centres[rng.integers(0, 6, 20)] + 0.05 * rng.normal(size=(20, 8)),
                         index[80:84], np.zeros((2, 8)), rng.normal(size=(6, 8))])
    return queries, index


@pytest.mark.parametrize("plan", [
    {}, {"method": "broadcast"}, {"method": "blocks", "block_rows": 16},
    {"method": "blocks", "block_rows": 1000}, {"broadcast_bytes": 64, "block_rows": 7},
])
def test_every_plan_is_exact(spark, skewed, plan):
    queries, index = skewed
    for k in (1, 5):
        same(got(retrieval.knn(asked(spark, queries), frame(spark, index), k, **plan)), brute(queries, index, k))


@pytest.mark.parametrize("method", ["broadcast", "blocks"])
def test_small_index_gives_what_it_has(spark, method):
    index = np.eye(3)
    found = retrieval.knn(asked(spark, np.ones((2, 3))), frame(spark, index), 5, method=method, block_rows=2)
    assert got(found) == brute(np.ones((2, 3)), index, 5) and found.count() == 6


def test_all_zero_index(spark):
    index = np.zeros((4, 3))
    for method in ("broadcast", "blocks"):
        found = retrieval.knn(asked(spark, np.eye(3)), frame(spark, index), 2, method=method, block_rows=2)
        assert got(found) == brute(np.eye(3), index, 2)


def test_too_many_queries_for_broadcast(spark):
    with pytest.raises(ValueError, match="blocks"):
        retrieval.knn(asked(spark, np.eye(3)), frame(spark, np.eye(3)), 1, method="broadcast", broadcast_bytes=24)


def test_string_keys(spark):
    index = frame(spark, np.eye(3)).withColumn("idx", F.concat(F.lit("k"), "idx"))
    queries = asked(spark, np.eye(3)).withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    for method in ("broadcast", "blocks"):
        rows = retrieval.knn(queries, index, 2, method=method, block_rows=2).collect()
        assert {(r.query_id, r.idx) for r in rows if r["rank"] == 1} == {("q0", "k0"), ("q1", "k1"), ("q2", "k2")}
        assert {r.idx for r in rows if r["rank"] == 2 and r.query_id == "q0"} == {"k1"}


def test_retrieve_search_and_floor(spark):
    index = frame(spark, [[1, 0], [0.8, 0.6], [0, 1]])
    rows = retrieval.retrieve(asked(spark, [[1, 0]]), index, 3).orderBy("rank").collect()
    assert [(r.text, r.nominal) for r in rows] == [("t0", "N0"), ("t1", "N1"), ("t2", "N2")]
    assert [round(r.similarity, 6) for r in rows] == [1.0, 0.8, 0.0]
    assert retrieval.retrieve(asked(spark, [[1, 0]]), index, 3, min_similarity=0.45).count() == 2
    first = retrieval.search(asked(spark, [[1, 0]]), index, 1).first()
    assert first.labels.asDict() == {"nominal": "N0", "department": "D0", "tax_code": None}


def examples(spark):
    index = frame(spark, [[1, 0], [0.8, 0.6], [0, 1], [0.6, 0.8]])
    return retrieval.nested_examples(retrieval.retrieve(asked(spark, [[1, 0], [0, 0]]), index, 3))


def test_vote(spark):
    rows = {r.query_id: r for r in vote(examples(spark)).collect()}
    # 1.0 for N0, 0.8 for N1, 0.6 for N0
    assert rows[0].nominal == "N0" and rows[0].confidence["nominal"] == pytest.approx(1.6 / 2.4)
    assert rows[0].department == "D1" and rows[0].confidence["department"] == pytest.approx(1.4 / 2.4)
    assert rows[0].tax_code == "T" and rows[0].confidence["tax_code"] == 1.0
    # A zero query has no weight to give: smallest label, no confidence.
    assert rows[1].nominal == "N0" and rows[1].confidence["nominal"] == 0.0


def test_prompts(spark):
    nested = examples(spark).where("query_id = 0")
    block = prompts.build_few_shot_block(nested).first().few_shot_examples
    assert block.split("\n")[:5] == ["- text: t0", "  nominal: N0", "  department: D0", "  tax_code: ", "  similarity: 1.00"]
    assert len(block.split("\n")) == 15
    vocabulary = {"nominal": [f"N{i:02d}" for i in range(12)], "department": ["O'Hare", "D"], "tax_code": ["T"]}
    items = nested.selectExpr("*", "'Tea' AS DETAIL", "CAST(NULL AS STRING) AS SUPPLIER", "1.5D AS NET", "0.0D AS VAT", "'detail: tea' AS model_text")
    user = prompts.chat_prompt(items, vocabulary).first().user_prompt
    assert "NET: 1.5\nVAT: 0.0" in user and block in user and """["O'Hare", 'D']""" in user and "SUPPLIER: \n" in user
    plain = prompts.plain_prompt(items, vocabulary).first().prompt
    assert "N09..." in plain and "N10" not in plain and "Example 1: t0...\n  NOMINAL: N0, DEPARTMENT: D0, TC: " in plain
    assert "DEPARTMENT: O'Hare, D" in plain and "detail: tea" in plain


def test_embedding_batches(spark):
    def embed(texts):
        assert len(texts) <= 3
        if "boom" in texts:
            raise RuntimeError("down")
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("1", "abc"), ("2", ""), ("3", None), ("4", "boom"), ("5", "z"), ("6", "yy")],
                               "line_id string, model_text string").coalesce(1)
    rows = {r.line_id: r for r in inference.batch_embed(df, embed, dim=2, batch_size=3).collect()}
    assert rows["1"].embedding == [3.0, 1.0] and rows["2"].embedding == [0.0, 0.0] and rows["3"].embed_error is None
    assert rows["5"].embedding == [0.0, 0.0] and "down" in rows["5"].embed_error
    short = inference.batch_embed(df, lambda t: [[1.0]] * len(t), dim=2, batch_size=3).where("line_id = '1'").first()
    assert "shape" in short.embed_error


def test_scorer_failures_stay_alone(spark):
    def score(row):
        if row["DETAIL"] is None:
            raise ValueError
        return {"nominal": row["DETAIL"], "department": "D", "tax_code": "T", "confidence": {"nominal": 1}, "reasoning": " r "}

    df = spark.createDataFrame([("1", "a"), ("2", None)], "line_id string, DETAIL string")
    rows = {r.line_id: r for r in inference.batch_infer(df, score, ["DETAIL"]).collect()}
    assert rows["1"].nominal == "a" and rows["1"].reasoning == "r" and rows["1"].confidence == {"nominal": 1.0}
    assert rows["2"].failed and rows["2"].nominal == "" and rows["2"].confidence == {}
    first = {"nominal": "n", "department": "d", "tax_code": "t"}
    rows = {r.line_id: r for r in inference.batch_infer(df, score, ["DETAIL"], on_error="first_label", first_labels=first).collect()}
    assert (rows["2"].nominal, rows["2"].tax_code, rows["2"].failed) == ("n", "t", True)
    with pytest.raises(ValueError):
        inference.batch_infer(df, score, ["DETAIL"], on_error="first_label")
