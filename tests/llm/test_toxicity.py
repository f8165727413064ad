import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm.toxicity import FEATURES, _features, _Words, toxicity

CALM = [f"{a}{b}" for a in ("lor", "mip", "dol", "sit", "ame") for b in ("un", "er", "ang", "ovi", "ekt", "ast")]


def table(spark, n=900, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(CALM, k=rng.randint(20, 60))
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "krux", "blarg"]) + rng.choice(["", "ing", "oso", "er!"]))
        docs.append((i, " ".join(words).capitalize() + ".", "en", str(rng.random())))
        if rng.random() < 0.8:
            labels.append((i, int(rng.random() < 0.9), int(toxic)))
    docs += [(None, "krux idiot", "de", "s"), (5000, "", None, None), (5001, None, None, None), (5002, "lorun " * 60_000, "x", "y"), (3, docs[3][1], "zz", "other")]
    labels += [(None, 1, 1), (4, 1, None), (5000, 1, 0), (6, 1, labels[0][2])]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("clash")).withColumn("label", F.lit("clash")),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_rows_are_recognised(spark):
    docs, labels = table(spark)
    got = toxicity(spark, docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    met = got.merge(labels.toPandas().dropna(), on="doc_id")
    held = met[met["held_out"]]
    assert len(held) > 100
    assert (held["predicted"] == held["toxic"]).mean() > 0.95
    clean = held[held["toxic"] == 0]
    assert clean["predicted"].mean() < 0.05
    # Same text, same score, whatever language and source are.
    assert got[got["doc_id"] == 3]["score"].nunique() == 1
    again = toxicity(spark, docs.withColumns({"lang": F.lit("q"), "source": F.lit("q")}), labels).toPandas()
    assert np.allclose(np.sort(got["score"]), np.sort(again["score"]))


def test_held_out_labels_are_never_read(spark):
    docs, labels = table(spark, 400)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity(spark, docs, x).toPandas().sort_values(["doc_id", "score"]) for x in (labels, flipped))
    assert np.allclose(a["score"], b["score"])


def test_no_labels_or_no_documents(spark):
    docs, labels = table(spark, 60)
    prior = toxicity(spark, docs, labels.where("toxic = 0")).toPandas()["score"]
    assert prior.nunique() == 1 and 0 < prior.iloc[0] < 0.3
    assert toxicity(spark, docs, labels.limit(0)).first()["score"] == 0.5
    assert toxicity(spark, docs.limit(0), labels).count() == 0


def test_features_see_disguise_and_address():
    words = _Words({" idiot ": 5.0, "krux": 2.0})
    row = dict(zip(FEATURES, _features("You 1D10T, 1diot kruxing! HELLO", words), strict=True))
    assert row["hits"] > 0 and row["strong_density"] == 0.0 and row["near_second_person"] == 1.0
    row = dict(zip(FEATURES, _features("you id1ot! fine", words), strict=True))
    assert row["obfuscated"] > 0 and row["strong_density"] > 0 and row["largest_weight"] == 5.0
    assert _features("", words)[:6] == [0.0] * 6
