import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import pieces as module
from ledgerloom.llm.pieces import MODEL, decode, encode, load_pieces

sentencepiece = pytest.importorskip("sentencepiece")


def texts():
    rng = random.Random(5)
    whole = [p for p, _, _ in load_pieces().table]
    made = ["".join(rng.choice(whole) for _ in range(rng.randint(1, 30))).strip(" ") for _ in range(120)]
    random_ = ["".join(rng.choice("etaoin shrdluETA\n\t.,-=é日ß0123😀") for _ in range(rng.randint(1, 60))) for _ in range(120)]
    return made + random_ + ["", " ", "   ", "  two  blanks ", "x" * 500 + "日" * 300, "ab" * 4000 + " end", "<s> </s> <unk> <0x41>", "\n\n", "a\x00b", "=" * 90] + [
        # Words around the longest that a bit mask holds.
        c * n for c in ("=", "international", "日x") for n in (4, 5, 30, 31, 59, 60, 61, 62, 63, 64)
    ]


def check(spark, model, pieces, known):
    reader = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([*rows, (None, None), (3, rows[3][1])], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = encode(df, pieces, known_words=known)
    assert got.count() == len(rows) + 2
    back = {r["doc_id"]: (list(r["ids"]), r["text"]) for r in decode(got, pieces).collect()}
    assert back[None] == ([], "")
    total = lambda ids: sum(reader.get_score(i) for i in ids)
    for i, text in rows:
        expected = reader.encode(text)
        # Sums of log probabilities may tie, as in a run of one letter.
        assert back[i][0] == expected or not pieces.merging and abs(total(back[i][0]) - total(expected)) < 1e-3, text[:80]
        assert back[i][1] == text, text[:80]


@pytest.mark.parametrize("known", [1 << 20, 40])
def test_same_ids_as_the_library_and_round_trip(spark, known):
    check(spark, open(MODEL, "rb").read(), load_pieces(), known)


def test_log_probabilities_give_the_best_path(spark):
    """The same pieces as a unigram model, with scores in place of the merge order."""
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = proto.ModelProto.FromString(open(MODEL, "rb").read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    rng = random.Random(2)
    for piece in model.pieces:
        if piece.type == 1:
            piece.score = -rng.random() * 12 - 1
    data = model.SerializeToString()
    check(spark, data, load_pieces(data, merging=False), 1 << 20)


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert module.MASK_BITS == 62
