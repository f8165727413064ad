import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import treap_search
from ledgerloom.llm.treap_search import Treap, lexical_topk, term_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k):
    """The contract, document by document."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in terms(text) if c[t]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["É", "über", "x-y", "A1", "naïve"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(n)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(12)]
    docs += [(n + i, docs[i][1] + ", " + items[i][1].upper()) for i in range(5)] + [(3, docs[3][1]), (n + 50, docs[4][1])]
    docs += [(n + 90, None), (n + 91, ""), (n + 92, "-- !!"), (None, items[2][1])]
    return docs, items + [(99, None), (98, ""), (97, "nowhere"), (5, items[6][1]), (None, items[0][1])]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize(("grid", "opened", "vocabulary"), [(1 << 14, 256, 1 << 20), (1100, 3, 1 << 20), (1 << 14, 16, 40)])
def test_same_as_scoring_all(spark, monkeypatch, grid, opened, vocabulary):
    monkeypatch.setattr(treap_search, "GRID_DOCUMENTS", grid)
    monkeypatch.setattr(treap_search, "OPENED", opened)
    docs, items = made(2, 600)
    left = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, score int, item_id string").repartition(3)
    right = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, doc_id string")
    assert rows(lexical_topk(left, right, 9, vocabulary=vocabulary)) == ordered(plain(docs, items, 9))


def test_ties_go_by_id_and_empty_tables(spark):
    docs = [(i, "same words") for i in (9, 4, 7, None, 1)] + [(20, "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert [r["doc_id"] for r in lexical_topk(df, items, 3).orderBy("rank").collect()] == [1, 4, 7]
    assert [r["doc_id"] for r in lexical_topk(df, items, 20).orderBy("rank").collect()] == [1, 4, 7, 9, None]
    assert lexical_topk(df.limit(0), items).count() == 0
    assert lexical_topk(df, items.limit(0)).count() == 0
    assert lexical_topk(df, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_of_a_very_long_text(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice(["Ab", "é", " ", "-", "9", "\n", "Ω"]) for _ in range(50_000)) + "x" * 5000
    whole = Counter(terms(text))
    for size in (1 << 20, 1000, 17):
        monkeypatch.setattr(treap_search, "TEXT_SLICE", size)
        counts, n = term_counts(text)
        assert counts == whole and n == sum(whole.values())


def test_a_very_long_document(spark):
    docs = [(0, "alpha beta " * 300_000), (1, "alpha"), (2, "gamma " * 10)]
    items = [(0, "alpha gamma beta beta")]
    got = lexical_topk(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert rows(got) == ordered(plain(docs, items, 5))


@pytest.mark.parametrize("seed", range(4))
def test_treap_bounds_and_search(seed):
    rng = np.random.default_rng(seed)
    n_rows, n_columns = 37, 61
    dense = np.where(rng.random((n_rows, n_columns)) < 0.15, rng.integers(1, 1000, (n_rows, n_columns)), 0)
    r, c = np.nonzero(dense)
    treap = Treap(r, c, dense[r, c], 6)
    for level, most in enumerate(treap.most):
        side = 64 >> level
        blocks = {}
        for i, j in zip(r, c, strict=True):
            blocks[(i // side, j // side)] = max(blocks.get((i // side, j // side), 0), dense[i, j])
        assert sorted(most.tolist()) == sorted(blocks.values())
    for _ in range(5):
        asked = np.sort(rng.choice(n_rows, 6, replace=False))
        often = rng.integers(1, 3, 6)
        scores = dense[asked].T @ often
        columns, found, floor = treap.search(asked, often, 7, 0)
        assert (scores[columns] == found).all()
        best = np.sort(scores[scores > 0])[::-1]
        assert floor == (best[6] if len(best) >= 7 else 0)
        assert set(np.flatnonzero(scores >= max(floor, 1))) == set(columns.tolist())
        assert treap.search(asked, often, 7, int(best[0]) + 1)[0].size == 0
