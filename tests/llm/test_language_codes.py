import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import language_codes as lc

WORDS = {
    "en": "the of and thing water house never would which morning".split(),
    "de": "der und nicht wasser haus über schön straße zwischen groß".split(),
    "fr": "le et pas eau maison où élève garçon entre matin".split(),
    "es": "el y no agua casa niño señor mañana también entre".split(),
}


def made(n, seed=3, languages=tuple(WORDS)):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = languages[i % len(languages)]
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(4, 30))) + ".", lang, "x", 1.0))
    return rows


SCHEMA = "doc_id long, text string, lang string, lang_pred string, score double"


def plain_grams(text):
    """All n-grams by definition: letters lower-cased, one blank for the rest, one blank before."""
    out = " "
    for c in text.lower():
        if c.isalpha():
            out += c
        elif out[-1] != " ":
            out += " "
    return Counter(out[i : i + n] for n in lc.ORDERS for i in range(len(out) - n + 1) if not (n == 1 and out[i] == " "))


def place_of(gram):
    """The place of one n-gram, from a text that consists of it."""
    code = np.uint32(0)
    with np.errstate(over="ignore"):
        for c in gram:
            code = code * np.uint32(0x01000193) + np.uint32(ord(c))
        return int(((code + np.uint32(len(gram))) * np.uint32(0x9E3779B1)) >> np.uint32(16))


@pytest.mark.parametrize("size", [7, 50, 100_000])
def test_ngrams_are_those_of_the_whole_text(size):
    texts = ["Ab, cd!", "", "  ??  ", "x\0y Straße ÉTÉ" + " " * 90 + "z", "word " * 40, "é"]
    found = [Counter() for _ in texts]
    letters = np.zeros(len(texts), int)
    for step in lc._steps(texts, size):
        ends = [*step.starts[1:], len(step.places[0])]
        for row, a, b in zip(step.rows, step.starts, ends, strict=True):
            for places in step.places:
                found[row].update(p for p in places[a:b].tolist() if p != lc.PLACES)
        letters += step.letters
    for text, got, n in zip(texts, found, letters, strict=True):
        want = Counter()
        for gram, k in plain_grams(text).items():
            want[place_of(gram)] += k
        if any(c.isalpha() for c in text):
            assert got == want
        assert n == sum(c.isalpha() for c in text)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 9, 40])
def test_codewords_are_apart(n):
    code = lc.codewords(n)
    assert code.shape[0] == n
    columns = {tuple(c * c[0]) for c in code.T}
    assert len(columns) == code.shape[1] and all(-1 in c for c in columns)
    if n >= 4:
        distance = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        assert distance >= 4  # one wrong bit is mended


def test_one_wrong_bit_is_mended():
    code = lc.codewords(4)
    bits = code.shape[1]
    model = lc.LanguageModel(list("abcd"), code, np.zeros((0, bits)), np.ones(bits), np.zeros(bits), np.ones(bits) / bits, 4.0)
    for i in range(4):
        for b in range(bits):
            margins = 3.0 * code[i].astype(float)
            margins[b] *= -1
            assert model.probabilities(margins[None, :]).argmax() == i


def test_counts_and_weights_by_definition(spark):
    rows = [("a", "xx xy"), ("a", None or ""), ("b", "yy")]
    counts = lc.ngram_counts(spark.createDataFrame(rows, "lang string, text string"))
    got = {(r["lang"], r["place"]): r["n"] for r in counts.collect()}
    want = Counter()
    for lang, text in rows:
        if text:
            for gram, n in plain_grams(text).items():
                want[(lang, place_of(gram))] += n
    assert got == dict(want)
    totals = {x: sum(n for (lang, _), n in want.items() if lang == x) for x in "ab"}
    weights = lc.bit_weights(counts, totals, lc.codewords(2))
    size = {x: totals[x] + lc.SMOOTHING * lc.PLACES for x in "ab"}
    for place in {p for _, p in want}:
        a, b = ((want.get((x, place), 0) + lc.SMOOTHING) / size[x] for x in "ab")
        assert weights[place, 0] == pytest.approx(np.log(a / b), abs=1e-5)
    assert not weights[lc.PLACES].any()


def test_held_out_accuracy_and_odd_rows(spark):
    rows = made(1200)
    odd = [(5000, None, "en", None, None), (5001, "", "de", None, None), (5002, "123 ?!", "fr", None, None),
           (None, "der und nicht wasser", None, None, None), (5003, "the and water never which", None, None, None),
           (5004, "le garçon et élève " * 60_000, "fr", None, None), (7, rows[7][1], rows[7][2], "y", 2.0)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    out = lc.languages(spark, docs).toPandas()
    assert len(out) == len(rows) + len(odd)
    by_id = out.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")
    truth = {r[0]: r[2] for r in rows}
    held = by_id[by_id["held_out"] & by_id.index.isin(truth)]
    assert 200 < len(held) < 400
    assert (held["lang_pred"] == [truth[i] for i in held.index]).mean() > 0.98
    assert out["score"].between(0, 1).all()
    for i in (5000, 5001, 5002):
        assert (by_id.loc[i, "lang_pred"], by_id.loc[i, "score"]) == ("und", 0.0)
    assert by_id.loc[5003, "lang_pred"] == "en" and by_id.loc[5004, "lang_pred"] == "fr"
    null = out[out["doc_id"].isna()].iloc[0]
    assert (null["lang_pred"], bool(null["held_out"])) == ("de", False)
    assert out[out["doc_id"] == 7]["score"].nunique() == 1


def test_held_out_rows_teach_nothing(spark):
    import zlib

    rows = made(400)
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, a, b) for i, t, lang, a, b in rows]
    first = lc.languages(spark, spark.createDataFrame(rows, SCHEMA)).toPandas().sort_values("doc_id")
    second = lc.languages(spark, spark.createDataFrame(other, SCHEMA).repartition(7)).toPandas().sort_values("doc_id")
    assert first.reset_index(drop=True).equals(second.reset_index(drop=True))


def test_no_one_and_two_languages(spark):
    rows = [(i, "some words here", None, None, None) for i in range(5)]
    assert {tuple(r)[2:4] for r in lc.languages(spark, spark.createDataFrame(rows, SCHEMA)).collect()} == {("und", 0.0)}
    rows = [(i, "some words here", "en", None, None) for i in range(9)] + [(99, "12", "en", None, None)]
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in lc.languages(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(i, "en", 1.0) for i in range(9)} | {(99, "und", 0.0)}
    assert lc.languages(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_mixed_text_is_ambiguous_and_other_columns_stay(spark):
    model = lc.fit_languages(spark.createDataFrame(made(800), SCHEMA))
    df = spark.createDataFrame([(1, "entre", "k", 5.0), (2, "the water and morning which never would", "k", 6.0)], "margins int, text string, _row string, score double")
    out = {r["margins"]: r for r in model.predict(df).collect()}
    assert out[2]["lang_pred"] == "en" and not out[2]["ambiguous"] and out[2]["_row"] == "k"
    assert set(out[1].asDict()) == {"margins", "text", "_row", "lang_pred", "score", "ambiguous"}
    assert out[1]["score"] < out[2]["score"]
