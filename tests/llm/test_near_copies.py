import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import near_copies
from ledgerloom.llm.near_copies import Weights, connected, inverse_frequencies, near_duplicates, shingles, similarities, without_near_duplicates


def corpus(n=160, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = [" ".join(rng.choices(words, k=rng.randint(0, 90))) for _ in range(n)]
    for base in range(12):
        for _ in range(12):
            copy = docs[base].split() or ["x"] * 30
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy))
    return docs + ["", "  ", "One two", "one  two", "one three", docs[0].upper()]


def plain_shingles(text):
    w = text.lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain_weights(docs):
    """Exact document frequencies, shingle by shingle."""
    counts = [plain_shingles(d) for d in docs]
    df = Counter(s for c in counts for s in c)
    rare = sum(sum(c.values()) for c in counts) * near_copies.FREQUENT
    if not 0 < rare < len(docs):
        return dict.fromkeys(df, 2.0)
    return {s: 1 + math.log(len(docs) / n) / math.log(len(docs) / rare) if n >= rare else 2.0 for s, n in df.items()}


def plain_classes(docs, least=0.8):
    weights = plain_weights(docs)
    sets = [{s: n * weights[s] for s, n in plain_shingles(d).items()} for d in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = sum(min(x, sets[j][k]) for k, x in a.items() if k in sets[j])
            whole = sum(a.values()) + sum(sets[j].values()) - shared
            if (shared >= least * whole) if whole else True:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(docs))]


def test_same_classes_as_comparing_all_pairs(spark):
    docs = corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    expected = plain_classes(docs)
    got = near_duplicates(df).toPandas().sort_values("doc_id")
    assert got["class_id"].tolist() == expected
    assert got["kept"].tolist() == [i == c for i, c in enumerate(expected)]
    assert got["class_size"].tolist() == [expected.count(c) for c in expected]
    kept = without_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r[0] for r in kept.collect()) == sorted(set(expected))


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Every bucket tile by tile: the same classes."""
    monkeypatch.setattr(near_copies, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_copies, "TILE", 4)
    docs = corpus(40, 5)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = near_duplicates(df).toPandas().sort_values("doc_id")
    assert got["class_id"].tolist() == plain_classes(docs)


def test_similarity_of_pairs():
    weights = Weights(np.zeros(0, np.uint64), np.zeros(0, np.float32), 1.0)
    a, b = "a b c d e f g h i j", "a b c d e f g h i x"
    got = similarities([a, a, "", "hi", a + " " + a], [a, b, "", "Hi", a], weights)
    assert np.allclose(got, [1, 5 / 7, 1, 1, 6 / 16])


@pytest.mark.parametrize("frequent", [2.0**-18, 0.001, 0.5])
def test_weights_come_from_exact_document_frequencies(spark, monkeypatch, frequent):
    """Also where most shingles are below the frequent ones, and where none is frequent."""
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    docs = corpus(60, 7) + ["same words in all of them here"] * 20 + ["again and again " * 50]
    weights = inverse_frequencies(spark.createDataFrame([(d,) for d in docs], "text string").repartition(5))
    assert len(weights.frequent) <= 1 / frequent
    expected = plain_weights(docs)
    for doc in docs:
        _, hashes, times, _ = shingles([doc])
        got = sorted(zip(times.tolist(), weights.of(hashes).tolist(), strict=True))
        want = sorted((n, expected[s]) for s, n in plain_shingles(doc).items())
        assert np.allclose(got, want, atol=1e-5) if want else not got


def test_weights_do_not_fade_with_size(spark):
    """The same share of texts weighs the same in a table ten times as long."""
    def weights_of(n):
        docs = [f"the common start of a text {i} and {i} its own {i} end {i}" if i % 10 == 0 else f"{i} a b {i} c d {i} e f {i}" for i in range(n)]
        hashes = shingles(["the common start of a"])[1]
        found = inverse_frequencies(spark.createDataFrame([(d,) for d in docs], "text string"))
        return float(found.of(hashes)[0])

    assert abs(weights_of(2000) - weights_of(20_000)) < 0.01


def test_very_long_text_has_weights_of_one_and_more(spark):
    text = " ".join(f"x{i}" for i in range(1_500_000))
    weights = inverse_frequencies(spark.createDataFrame([(text,), ("a b c",)], "text string"))
    assert weights.of(shingles([text])[1]).min() >= 1


def test_nulls_repeats_long_texts_and_empty_table(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, None), (5, ""), (6, long), (7, long + " y"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df).toPandas()
    assert len(got) == len(rows)
    assert Counter(got["class_id"].tolist()) == {3: 3, 4: 3, 6: 2}
    assert sorted(r[0] for r in without_near_duplicates(df).collect()) == [3, 4, 6]
    assert near_duplicates(df.limit(0)).count() == 0


def test_connected_components_of_a_long_chain(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("x", "y"), ("z", "z")]
    got = dict(connected(spark.createDataFrame(chain, "a string, b string")).collect())
    assert got == {f"{i:03d}": "000" for i in range(61)} | {"x": "x", "y": "x"}
