import base64

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import token_lengths
from ledgerloom.llm.token_lengths import TOKENIZER, length_histogram, length_quantiles, truncated_totals, with_token_count

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


def test_counts_are_those_of_the_tokenizer(spark):
    texts = ["", "hello world", "  two  blanks\n\n", "don't we'll I'd", "é日本😀", "<|endoftext|>", "a" * 3000, "x1 y22,z", "word " * 40_000]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = dict(with_token_count(df).select("doc_id", "n_tokens").collect())
    assert got == {i: len(own.encode_ordinary(t)) for i, t in enumerate(texts)} | {99: 0}


def test_every_sum_is_exact(spark, monkeypatch):
    monkeypatch.setattr(token_lengths, "SPAN", 16)
    lengths = [(i * i) % 97 for i in range(500)] + [None, 0, 5000]
    df = spark.createDataFrame([(n,) for n in lengths], "n_tokens long")
    known = [n or 0 for n in lengths]
    histogram = length_histogram(df)
    got = {r.length: r for r in histogram.collect()}
    assert set(got) == set(known)
    for n, r in got.items():
        above = [x for x in known if x > n]
        assert (r.documents, r.documents_above, r.tokens_above) == (known.count(n), len(above), sum(above))
        assert (r.documents_at_most, r.tokens_at_most) == (len(known) - len(above), sum(known) - sum(above))
        assert (r.all_documents, r.all_tokens, r.truncated_total) == (len(known), sum(known), sum(min(x, n) for x in known))
    limits = [0, 1, 50, 96, 97, 10_000]
    assert {r.limit: (r.truncated_total, r.truncated_documents) for r in truncated_totals(histogram, limits).collect()} == {
        n: (sum(min(x, n) for x in known), sum(x > n for x in known)) for n in limits
    }
    ordered = sorted(known)
    assert {r.share: r.length for r in length_quantiles(histogram, [0.25, 0.5, 1.0]).collect()} == {
        s: ordered[max(0, -int(-s * len(ordered) // 1) - 1)] for s in (0.25, 0.5, 1.0)
    }
    assert length_histogram(df.limit(0)).count() == 0
