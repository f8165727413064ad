from pyspark.sql import functions as F

from ledgerloom.functions.text import (
    add_model_text_column,
    add_terms,
    clean_reasoning,
    create_novel_items,
    example_excerpt,
    normalize_text,
    tokens,
)
from ledgerloom.functions.vectors import hashed_embedding, similarity_text


def test_normalize(spark):
    cases = [None, "", "  ", "A&B", "Café £3.50 – x", "tab\tline\nend", "ODD\x0bspace here",
             "KEEP-dash.dot", "100%", "1234", "İstanbul Kelvin K"]
    expected = ["", "", "", "a and b", "caf 3.50 x", "tab line end", "odd space here",
                "keep-dash.dot", "100", "1234", "i stanbul kelvin k"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in rows.select(normalize_text("t")).collect()]
    assert got == expected


def test_model_text_keeps_both_parts(spark):
    df = spark.createDataFrame([("Tea & Milk", None), (None, "X Ltd")], "DETAIL string, SUPPLIER string")
    got = [r.model_text for r in add_model_text_column(df).collect()]
    assert got == ["detail: tea and milk | supplier: ", "detail:  | supplier: x ltd"]


def test_novel_items_leave_out_empty_supplier(spark):
    df = spark.createDataFrame([("Green Paint", None), ("Bolts", "A.B.")], "DETAIL string, SUPPLIER string")
    rows = create_novel_items(df).collect()
    assert [r.model_text for r in rows] == ["detail: green paint", "detail: bolts | supplier: a.b."]
    assert rows[0].SUPPLIER == "" and rows[0].NET == 0.0 and rows[0].VAT == 0.0
    only = create_novel_items(df.select("DETAIL")).first()
    assert only.model_text == "detail: green paint"


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("a bb_1 cc élan d9",), ("x",), (None,), ("one two",)], "t string")
    got = [r[0] for r in df.select(tokens("t")).collect()]
    assert got == [["bb_1", "cc", "élan", "d9"], [], [], ["one", "two"]]
    grams = [r.terms for r in add_terms(df, "t", (1, 3)).collect()]
    assert grams[0] == ["bb_1", "cc", "élan", "d9", "bb_1 cc", "cc élan", "élan d9",
                        "bb_1 cc élan", "cc élan d9"]
    assert grams[1:] == [[], [], ["one", "two", "one two"]]


def test_small_expressions(spark):
    df = spark.createDataFrame([("x" * 120, "  why \n"), ("ab", None)], "t string, r string")
    rows = df.select(example_excerpt("t").alias("e"), clean_reasoning("r").alias("c")).collect()
    assert rows[0].e == "x" * 100 + "..." and rows[1].e == "ab..."
    assert [r.c for r in rows] == ["why", ""]
    assert spark.range(1).select(similarity_text(F.lit(0.876))).first()[0] == "0.88"


def test_hashed_vectors_are_unit_or_zero(spark):
    df = spark.createDataFrame([("paint for walls",), ("",), (None,)], "t string")
    rows = [r.embedding for r in hashed_embedding(df, "t", 16).collect()]
    assert all(len(v) == 16 for v in rows)
    assert abs(sum(x * x for x in rows[0]) - 1) < 1e-12
    assert rows[1] == rows[2] == [0.0] * 16
