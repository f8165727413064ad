"""Toxicity: boosted trees over dense features of whole texts, with isotonic calibration."""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import cut, id_remainder, text_or_empty

# Words of address in the four languages, letters that digits and signs stand for.
SECOND_PERSON = frozenset(
    "you your yours yourself u du dich dir dein deine deinen ihr euch euer sie ihnen tu te toi ton ta tes vous "
    "votre vos tú ti tus usted ustedes vosotros vuestro su".split()
)
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")
EDGES = string.punctuation + "¿¡«»„“”’"

#: Labelled rows that the lexicon and the trees are learned from, at most (about).
FIT_ROWS = 16_000
#: Terms in the lexicon, at most; prefixes of words from these lengths on, and whole words.
LEXICON_TERMS, PREFIXES = 4000, (3, 4, 5, 6, 7)
FOLDS = 4
FEATURES = (
    "hit_density", "strong_density", "weight_density", "largest_weight", "hits", "strong_hits", "near_second_person",
    "second_person", "capitals", "exclamations", "punctuation", "digits", "obfuscated", "log_words",
)
#: A term this many times likelier (log) in toxic texts counts as strong.
STRONG = 4.0


def sample_of_labels(labels: DataFrame, label: str, rows: int, id_column: str = "doc_id") -> tuple[DataFrame, int, int]:
    """``(id, label, fold)`` of about ``rows`` labelled rows at most, chosen by a hash of the id; rows; positives.

    Null ids and null labels take no part; of several labels of one id the largest counts.
    """
    known = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(id_column).agg(F.max(F.col(label).cast("int")).alias("label"))
    share = min(1.0, rows / max(1, known.count()))
    place = F.pmod(F.xxhash64(F.lit(5), F.col(id_column)), F.lit(1 << 20))
    chosen = known.where(place < F.lit(int(share * (1 << 20)) if share < 1 else 1 << 20))
    chosen = cut(chosen.withColumn("fold", F.pmod(F.xxhash64(F.lit(9), F.col(id_column)), F.lit(FOLDS)).cast("int")))
    n, positive = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    return chosen, n, positive


def learned_lexicon(texts: DataFrame, terms: int = LEXICON_TERMS) -> dict[str, tuple[float, ...]]:
    """Terms that mark positive texts: ``{term: (weight, weight without fold 0, ...)}``.

    ``texts`` holds ``(text, label, fold)``.  A term is the start of a word, or a whole word with
    blanks around; its weight is the log of how much likelier it is in positive texts.  The table's
    size is bounded by ``terms``.
    """
    word = F.regexp_replace(F.lower("text"), r"[\p{Punct}¿¡«»„“”’]", " ")
    words = F.array_distinct(F.filter(F.split(word, r"\s+"), lambda w: F.length(w) >= PREFIXES[0]))
    starts = [
        F.transform(F.filter("_words", lambda w, n=n: F.length(w) > n), lambda w, n=n: F.substring(w, 1, n)) for n in PREFIXES
    ]
    whole = F.transform("_words", lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    found = texts.select("label", "fold", words.alias("_words")).select(
        "label", "fold", F.explode(F.array_distinct(F.concat(whole, *starts))).alias("term")
    )
    kinds = [(y, f) for y in (1, 0) for f in range(FOLDS)]
    named = [F.count_if((F.col("label") == y) & (F.col("fold") == f)).alias(f"n{y}{f}") for y, f in kinds]
    size = {(r["label"], r["fold"]): r["n"] for r in texts.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = lambda y: F.expr(" + ".join(f"n{y}{f}" for f in range(FOLDS)))
    positives, negatives = (max(1, sum(size.get((y, f), 0) for f in range(FOLDS))) for y in (1, 0))
    odds = F.log((total(1) + 0.5) / positives) - F.log((total(0) + 0.5) / negatives)
    best = (
        found.groupBy("term").agg(*named)
        .where(total(1) >= 3).withColumn("_odds", odds).where(F.col("_odds") >= 1.5)
        .withColumn("_z", F.col("_odds") * F.sqrt(total(1)))
        .orderBy(F.desc("_z"), "term").limit(terms)
    )

    def weight(row: dict, folds: list[int]) -> float:
        n1, n0 = (sum(row[f"n{y}{f}"] for f in folds) for y in (1, 0))
        all1, all0 = (max(1, sum(size.get((y, f), 0) for f in folds)) for y in (1, 0))
        return max(0.0, math.log((n1 + 0.5) / all1) - math.log((n0 + 0.5) / all0)) if n1 >= 2 else 0.0

    every = list(range(FOLDS))
    return {
        r["term"]: (weight(r, every), *(weight(r, [f for f in every if f != out]) for out in every))
        for r in best.collect()
    }


class _Words(dict):
    """Code of a word: its lexicon weight, plus 100 if it is disguised; -1 for a word of address."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def weight(self, word: str) -> float:
        found = [self.lexicon.get(word[:n], 0.0) for n in PREFIXES if len(word) > n]
        return max(self.lexicon.get(f" {word} ", 0.0), *found, 0.0)

    def __missing__(self, raw: str) -> float:
        word = raw.strip(EDGES)
        if word in SECOND_PERSON:
            code = -1.0
        else:
            disguised = len(word) > 2 and not word.isalpha() and word[0].isalpha() and any(c.isdigit() or c in "@$!*|" for c in word)
            plain = "".join(c for c in word.translate(LOOKALIKES) if c.isalpha()) if disguised else word
            code = min(self.weight(plain), 99.0) + (100.0 if disguised else 0.0)
        if len(self) < 500_000:
            self[raw] = code
        return code


def _features(text: str, words: _Words) -> list[float]:
    codes = np.array([words[w] for w in text.lower().split()])
    n = max(1, len(codes))
    weights = np.where(codes > 0, codes % 100.0, 0.0)
    hits, address = np.flatnonzero(weights > 1.0), np.flatnonzero(codes == -1.0)
    strong, near = int((weights >= STRONG).sum()), 0.0
    if len(hits) and len(address):
        after = np.searchsorted(address, hits)
        gap = np.minimum(
            np.abs(hits - address[np.minimum(after, len(address) - 1)]), np.abs(hits - address[np.maximum(after - 1, 0)])
        )
        near = float((gap <= 5).mean())
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    size = max(1, len(raw))
    count = np.bincount(raw, minlength=256)
    marks = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    return [
        len(hits) / n, strong / n, float(weights.sum()) / n, float(weights.max(initial=0.0)), math.log1p(len(hits)),
        math.log1p(strong), near, len(address) / n, count[65:91].sum() / size, count[33] / size, marks / size,
        count[48:58].sum() / size, float((codes >= 100).mean()) if len(codes) else 0.0, math.log1p(len(codes)),
    ]


def _extractor(lexicons: list[dict[str, float]]) -> Callable[[Iterator[tuple]], Iterator[pd.Series]]:
    def extract(batches):
        words = [_Words(lexicon) for lexicon in lexicons]
        for texts, variants in batches:
            yield pd.Series([_features(t, words[v]) for t, v in zip(texts, variants, strict=True)])

    return extract


def dense_features(df: DataFrame, lexicons: list[dict[str, float]], variant: F.Column, text_column: str = "text") -> DataFrame:
    """``df`` with ``features``, an array in the order of :data:`FEATURES`; ``variant`` picks the lexicon."""

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from _extractor(lexicons)(batches)

    return df.withColumn("features", features(text_or_empty(text_column), variant))


@dataclass
class ToxicityModel:
    """Lexicon, trees and calibration; without both classes in the sample only the ``prior``."""

    prior: float
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None

    def score(self, df: DataFrame, text_column: str = "text", name: str = "score") -> DataFrame:
        """``df`` with a calibrated probability in ``name`` for every row, empty and null texts included."""
        if self.trees is None:
            return df.withColumn(name, F.lit(self.prior))
        packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{text_column}`").alias("text"))
        rows = dense_features(packed, [self.lexicon], F.lit(0)).select("_row", "features")
        kept = [F.col("_row").getField(c).alias(c) for c in df.columns if c.lower() != name.lower()]
        return _calibrated(_raw(rows, self.trees), self.calibration, name).select(*kept, name)


def _raw(rows: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    scored = trees.transform(rows.withColumn("_vector", array_to_vector("features")))
    return scored.withColumn("_raw", vector_to_array("probability")[1])


def _calibrated(rows: DataFrame, calibration: IsotonicRegressionModel, name: str) -> DataFrame:
    """The calibrated score; a thousandth of the raw one keeps the order within a step."""
    return calibration.transform(rows).withColumn(name, 0.999 * F.col("_step") + 0.001 * F.col("_raw"))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", fit_rows: int = FIT_ROWS
) -> ToxicityModel:
    """Learn from ``labels (id, toxic)``, of which about ``fit_rows`` rows at most are used.

    The lexicon's weights for a row of the sample come from the other folds, so that the trees see
    them as they will be on new texts.  Three folds fit the trees, the last one the calibration.
    """
    sample, n, positive = sample_of_labels(labels, "toxic", fit_rows, id_column)
    prior = (positive + 1.0) / (n + 2.0)
    if positive < FOLDS or n - positive < FOLDS:
        return ToxicityModel(prior, {})
    # The sample has about fit_rows rows at most, whatever the size of the tables.
    key = F.col(f"`{id_column}`").alias(id_column)
    rows = docs.select(key, text_or_empty(text_column).alias("text")).join(F.broadcast(sample), id_column)
    lexicon = learned_lexicon(rows)
    variants = [{t: w[1 + f] for t, w in lexicon.items() if w[1 + f] > 0} for f in range(FOLDS)]
    # Few partitions of a fixed order: the fit is small and reruns agree.
    train = dense_features(rows, variants, F.col("fold")).select(id_column, "features", F.col("label").cast("double").alias("label"), "fold")
    train = cut(train.repartition(4, id_column).sortWithinPartitions(id_column, "label", "features"))
    there = {(r["label"], r["last"]) for r in train.select("label", (F.col("fold") == FOLDS - 1).alias("last")).distinct().collect()}
    if len(there) < 4:  # labels of documents that are not there
        return ToxicityModel(prior, {})
    vectors = train.withColumn("_vector", array_to_vector("features"))
    trees = GBTClassifier(
        featuresCol="_vector", labelCol="label", maxIter=20, maxDepth=4, stepSize=0.25, minInstancesPerNode=3, seed=13,
    ).fit(vectors.where(F.col("fold") < FOLDS - 1))
    checked = _raw(vectors.where(F.col("fold") == FOLDS - 1).select("features", "label"), trees).select("_raw", "label")
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_step").fit(checked)
    return ToxicityModel(prior, {t: w[0] for t, w in lexicon.items() if w[0] > 0}, trees, calibration)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``; held-out rows teach nothing.

    Held out are ids whose crc32 as text leaves remainder 2 modulo 4 (a null id is not).  Null texts
    count as empty; repeated rows are scored alike; columns other than id and text are never read.
    An empty table gives an empty result; without both classes among the labels every score is the prior.
    """
    held = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    model = fit_toxicity(docs.select("doc_id", "text"), labels.where(~held).select("doc_id", "toxic"))
    scored = model.score(docs.select("doc_id", "text"))
    return scored.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
