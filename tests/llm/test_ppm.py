import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm.ppm import build_trie, code_lengths, language_model_scores, score_texts, window_counts

ORDER = 3


def plain_ppm(training, text, order=ORDER):
    """Straight from the definition: sets of excluded symbols, one byte at a time."""
    counts = defaultdict(Counter)
    for t in training:
        data = [255] * order + list(t.encode()) + [255]
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[tuple(data[i - k : i])][data[i]] += 1
    total = 0.0
    data = [255] * order + list(text.encode()) + [255]
    for i in range(order, len(data)):
        excluded, p = set(), 1.0
        for k in range(order, -1, -1):
            seen = {s: n for s, n in counts.get(tuple(data[i - k : i]), {}).items() if s not in excluded}
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                p *= seen[data[i]] / whole
                break
            if whole:
                p *= len(seen) / whole
            excluded |= set(seen)
        else:
            p *= 1 / (256 - len(excluded))
        total += math.log10(p)
    return total


TEXTS = ["the cat sat on the mat", "the dog sat", "", "a cat é ate\nthe hat", "zzz the cat", "the cat sat on the mat"]


def test_same_as_plain_definition(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS[:4]], "text string")
    trie = build_trie(window_counts(rows, ORDER), ORDER, 1e-9)
    asked = TEXTS + ["q", "the the the", "ünknown ßtuff", "THE Cat"]
    assert np.allclose(code_lengths(trie, [t.lower().encode() for t in asked]), [plain_ppm(TEXTS[:4], t.lower()) for t in asked])


def test_probabilities_of_next_byte_sum_to_one(spark):
    rows = spark.createDataFrame([(t * 5,) for t in TEXTS], "text string")
    for share in (1e-9, 0.02):
        trie = build_trie(window_counts(rows, 2), 2, share)
        for context in (b"th", b"e ", b"qq", b"\xff\xff"):
            codes = np.array([(context[0] << 16) | (context[1] << 8) | s for s in range(256)], dtype=np.uint64)
            assert abs((10 ** trie.log10(codes)).sum() - 1) < 1e-9


def test_scores_and_base(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, None), (7, "THE Cat")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    for known in (3, 1000):
        got = score_texts(df, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)), known_words=known).toPandas()
        assert len(got) == len(docs)
        words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["<end>"]
        c = Counter(w for i, t in docs if i is not None and i % 2 == 0 for w in words(t))
        n, v = sum(c.values()), len(c)
        expected = sorted(
            (str(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 6))
            for i, t in docs
        )
        ids = ["None" if x != x else str(int(x)) for x in got["doc_id"]]
        assert expected == sorted(zip(ids, got["n_tokens"], got["n_known"], got["train_tokens"], got["base_score"].round(6), strict=True))
        assert (got["score"] < 0).all()


def test_nothing_is_cut_from_the_model(spark):
    asked = TEXTS + ["q", "the the the", "ünknown ßtuff", "", "mat on the hat"]
    docs = [(i, t) for i, t in enumerate(asked)] + [(4, "zzz the cat")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for share in (1e-9, 0.02, 2.0):
        got = score_texts(df, F.col("doc_id") < 4, order=ORDER, share=share).select("doc_id", "score").collect()
        expected = sorted((i, plain_ppm(TEXTS[:4], t)) for i, t in docs)
        assert np.allclose(sorted(tuple(row) for row in got), expected)


def test_nothing_to_learn_from_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    got = score_texts(df, F.lit(False)).first()
    assert abs(got["score"] + 4 * math.log10(256)) < 1e-9 and got["train_tokens"] == 0
    assert language_model_scores(df.limit(0)).count() == 0
