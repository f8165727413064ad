import re
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerloom.llm.mixing import mix, mixed, source_targets


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Deal out by weight; what exceeds a cap is dealt out again among the others until nothing does."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        dealt = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if dealt[s] > most * sizes[s]]
        if not over:
            return fixed | dealt
        fixed |= {s: most * sizes[s] for s in over}


def docs(spark):
    rows = []
    for i in range(900):
        source = ["hot"] * 5 + ["a", "b", "Zed", "é", None]
        rows.append((i, "word " * (i * 7 % 90), source[i % 10], "clash"))
    rows += [(None, None, "a", "x"), (5, "one two", "void", "x"), (5, "one two", "void", "x"), (901, "", "empty", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string")


def test_targets_and_budgets(spark):
    df = docs(spark)
    got = mixed(df).toPandas()
    assert len(got) == df.count()
    by_source = defaultdict(list)
    for source, size, whole, target, repeats in zip(*(got[c] for c in ("source", "size", "source_size", "target", "repeats")), strict=True):
        by_source[source if isinstance(source, str) else None].append((size, whole, target, repeats))
    expected = plain_targets({s: sum(r[0] for r in rows) for s, rows in by_source.items()})
    assert abs(sum(expected.values()) - 1.5 * got["size"].sum()) < 1e-6
    for source, rows in by_source.items():
        taken, longest = sum(r[0] * r[3] for r in rows), max(r[0] for r in rows)
        assert {round(r[2], 6) for r in rows} == {round(expected[source], 6)}
        assert abs(taken - expected[source]) <= longest / 2 + 1e-6 or source == "void"
        epochs = int(expected[source] // rows[0][1]) if rows[0][1] else 0
        assert {r[3] for r in rows} <= {epochs, epochs + 1} and max(r[3] for r in rows) <= 2
    assert all(n == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t, n in zip(got["text"], got["size"], strict=True))


def test_reruns_agree_whatever_the_partitions(spark):
    df = docs(spark)
    one, two = (sorted(map(str, mixed(df.repartition(n)).collect())) for n in (1, 7))
    assert one == two


def test_heavier_documents_come_first(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.lit("s").alias("source"))
    weight = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.25)
    got = mixed(df, weight=weight, share=0.5).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("repeats").alias("n"))
    n = dict(got.collect())
    assert n[0] + n[1] == 2000 and n[0] > 2 * n[1]


def test_mix_repeats_rows_and_keeps_columns(spark):
    df = docs(spark)
    assert mix(df).columns == df.columns
    assert mix(df).count() == mixed(df).agg(F.sum("repeats")).first()[0]
    assert mix(df.limit(0)).count() == 0


def test_targets_of_many_shapes(spark):
    for sizes in ({"a": 1, "b": 100, "c": 100}, {"a": 100, "b": 1, "c": 1, "d": 1}, {"a": 0, "b": 5}, {"a": 7}, {str(i): i * i for i in range(30)}):
        rows = spark.createDataFrame([(f"+{s}", s, n) for s, n in sizes.items()], "_s string, _source string, source_size long")
        got = {r["_s"][1:]: r["target"] for r in source_targets(rows, (3, 1, 2), 1.5, 2.0).collect()}
        expected = plain_targets(sizes)
        assert all(abs(got[s] - expected[s]) < 1e-6 for s in sizes), (got, expected)


def _near_targets(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    for own in by_source.values():
        taken, longest = sum(r["size"] * r["repeats"] for r in own), max(r["size"] for r in own)
        assert abs(taken - own[0]["target"]) <= longest / 2 + 1e-6, (taken, own[0])
        assert max(r["repeats"] for r in own) <= 2


def test_null_and_repeated_ids_meet_the_targets(spark):
    for ids in ([None], [7], [None, 1, 2]):
        rows = [(ids[i % len(ids)], "word " * (i % 5 + 1) if i % 3 else "the same text", "abc"[i % 3]) for i in range(1200)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
        _near_targets(mixed(df).collect())


def test_one_row_many_times(spark):
    df = spark.createDataFrame([(None, "three words here", s) for s in "aaab" * 200], "doc_id long, text string, source string").repartition(3)
    got = mixed(df)
    _near_targets(got.collect())
    assert mix(df).count() == got.agg(F.sum("repeats")).first()[0]


def test_columns_may_have_any_name(spark):
    names = ["epochs", "last_key", "last_tie", "_k", "_s", "_t", "_row", "_n", "_end", "_rest", "size", "repeats", "target", "source_size"]
    df = docs(spark).drop("target")
    for i, name in enumerate(names):
        df = df.withColumn(name, F.lit(f"own {i}"))
    got = mixed(df)
    assert got.count() == df.count() and got.select("epochs", "_s", "_row").distinct().count() == 1
    assert sorted(got.columns) == sorted(set(df.columns) | {"size", "source_size", "target", "repeats"})
    plain = mixed(docs(spark)).select("doc_id", "text", "repeats").collect()
    assert sorted(map(str, got.select("doc_id", "text", "repeats").collect())) == sorted(map(str, plain))
    again = mix(df)
    assert again.columns == df.columns and again.select("size", "_t").first() == ("own 10", "own 5")


def test_a_very_long_text(spark):
    rows = [(i, "w " * 20, "ab"[i % 2]) for i in range(200)] + [(500, "long " * 400_000, "a"), (501, None, "b"), (502, " \t\n", "b")]
    _near_targets(mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_same_as_the_sql_with_repeated_rows(spark):
    import duckdb

    from ledgerloom.llm.queries import ORACLE, op6_mixing

    rows = [(i % 40 if i % 4 else None, "word " * (i % 7), [None, "a", "b", "é"][i % 4]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents = df.toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    import tempfile

    folder = tempfile.mkdtemp()
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = op6_mixing(spark, folder).collect()
    want = duckdb.sql(ORACLE["op6_mixing"]).fetchall()
    shown = lambda rs: sorted((str(r[0]), r[1], r[2], round(r[3], 6), r[4]) for r in rs)
    assert shown(got) == shown(want)
