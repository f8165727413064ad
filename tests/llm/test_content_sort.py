import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import content_sort
from ledgerloom.llm.content_sort import exact_duplicates, without_exact_duplicates


def docs(spark):
    rng = random.Random(4)
    texts = [f"{'common beginning of many texts ' * 2}{i}" for i in range(60)] + ["", "a", "A", "é" * 50, "long " * 30_000]
    rows = [(i, rng.choice(texts)) for i in range(600)] + [(1000 + i, "hot text") for i in range(400)]
    rows += [(7, "twice"), (7, "twice"), (None, "hot text"), (None, None), (5, ""), (None, "only null ids"), (None, "only null ids")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep_id", F.lit("clash")).withColumn("_text", F.lit(1))


def plain(rows, best, norm=lambda t: t):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text or "")].append(r.doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        left = True
        for i in ids:
            kept, left = (i == keep and left), left and i != keep
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("share", [0.05, 1 / 4096, 1.0])
@pytest.mark.parametrize(("keep", "best"), [("largest", max), ("smallest", min)])
def test_same_as_grouping_whole_texts(spark, keep, best, share):
    df = docs(spark)
    rows = df.collect()
    got = exact_duplicates(df, keep=keep, hot_share=share)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(rows, best)
    kept = without_exact_duplicates(df, keep=keep, hot_share=share)
    assert kept.columns == df.columns
    expected = sorted(x[1 : x.index(",")] for x in plain(rows, best) if ", True, " in x)
    assert sorted(str(r.doc_id) for r in kept.collect()) == expected


def test_normalised_and_empty(spark):
    df = docs(spark)
    got = exact_duplicates(df, normalise=F.lower)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(df.collect(), min, str.lower)
    assert exact_duplicates(df.limit(0)).count() == 0 and without_exact_duplicates(df.limit(0)).count() == 0


def test_pieces_of_a_hot_group_follow_its_size(spark, monkeypatch):
    """Rows without an id, or with one id, spread over pieces as well."""
    monkeypatch.setattr(content_sort, "PIECE_ROWS", 50)
    rows = [(None, "hot")] * 900 + [(3, "warm")] * 300 + [(i, f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hot, cold, _ = content_sort._hot_and_cold(content_sort._prepared(df, "doc_id", "text", None), 0.05)
    sizes = {t: [r["count"] for r in hot.where(F.col("_text") == t).groupBy("_piece").count().collect()] for t in ("hot", "warm")}
    assert len(sizes["hot"]) == 19 and len(sizes["warm"]) == 7 and max(map(max, sizes.values())) < 110 and cold.count() == 300
    got = exact_duplicates(df, hot_share=0.05)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(df.collect(), min)
    assert without_exact_duplicates(df, hot_share=0.05).count() == 302


def test_one_exchange_and_no_python_on_the_main_path(spark):
    df = docs(spark)
    rows = content_sort._prepared(df, "doc_id", "text", None).select("_id", "_text")
    plan = content_sort._sorted_groups(rows, 4, ["_text"], True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan
    assert "Python" not in plan and "Arrow" not in plan
