"""Quality by co-training: a content view and a metadata view teach each other, then vote."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import text_or_empty, written
from ledgerloom.llm.toxicity import FOLDS, sample_of_labels

#: Labelled rows that the views learn from, at most (about).
FIT_ROWS = 12_000
ROUNDS, CONFIDENT = 3, 0.97
#: Sources and languages of labelled rows with a place of their own, at most; the rarest beyond share the place of unknown ones.
SOURCES, LANGS = 256, 64
#: Rows of sums that the driver adds up, at most; where more tasks sum over the unlabelled documents, other tasks add up theirs first.
SUM_TASKS = 64


#: Places of sources and of languages; null is a value like others.
Places = tuple[dict[str | None, int], dict[str | None, int]]


def content_features(text: str) -> list[float]:
    """Rates of characters, words and repetition of a whole text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    count, size = np.bincount(raw, minlength=256), max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    rates = [
        count[65:91].sum() / size, count[48:58].sum() / size, count[124] / size, count[33] / size,
        (count[35:39].sum() + count[42] + count[64] + count[94] + count[126]) / size, (count[44] + count[46]) / size,
        (count[60] + count[62] + count[91:97].sum() + count[123] + count[125] + count[47]) / size,
        count[128:].sum() / size, 1 - len(seen) / n, 1 - (pairs + 1) / n if n > 1 else 0.0,
        max(seen.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
    ]
    rates = [max(0.0, float(r)) for r in rates]
    return [*rates, *[math.sqrt(r) for r in rates], size / n / 8, math.log1p(len(words)) / 8]


def metadata_features(source: str | None, lang: str | None, n_chars: float | None, text: str, places: Places) -> list[float]:
    """Origin, language, declared length and layout; no character of the content is looked at."""
    known = n_chars is not None and n_chars == n_chars
    breaks = text.count("\n") + 1
    sources, langs = places
    out = [0.0] * (len(sources) + len(langs) + 2)
    out[sources.get(source, len(sources))] = 1.0
    out[len(sources) + 1 + langs.get(lang, len(langs))] = 1.0
    line = len(text) / breaks
    length = math.log1p(max(0.0, float(n_chars))) if known else 0.0
    return [*out, length / 8, (length / 8) ** 2, float(known), math.log1p(breaks) / 4, math.log1p(line) / 8, (math.log1p(line) / 8) ** 2]


def _given(docs: DataFrame, text_column: str) -> list[Column]:
    """Text, source, language and declared length; a metadata column that is missing counts as null."""
    kinds = {"source": "string", "lang": "string", "n_chars": "double"}
    metadata = [F.col(f"`{c}`").cast(k) if c in docs.columns else F.lit(None).cast(k) for c, k in kinds.items()]
    return [text_or_empty(text_column), *metadata]


def _view_matrices(places: Places, texts: pd.Series, *metadata: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    content = np.array([content_features(t) for t in texts])
    return content, np.array([metadata_features(*m, t, places) for *m, t in zip(*metadata, texts, strict=True)])


@dataclass
class View:
    """Logistic regression on one view's features, and the straight line that calibrates its log odds."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, features: np.ndarray) -> np.ndarray:
        return self.slope * np.clip(features @ self.weights + self.intercept, -30, 30) + self.shift


def fitted(features: np.ndarray, labels: np.ndarray, penalty: float = 1.0, steps: int = 25) -> View:
    """Newton's method for penalised logistic regression on standardised features."""
    middle, spread = features.mean(axis=0), features.std(axis=0)
    spread[spread < 1e-9] = 1.0
    ridge = np.diag([penalty] * features.shape[1] + [1e-6])
    w = np.zeros(features.shape[1] + 1)
    for _ in range(steps):
        w, change = _step(w, ridge, *_slopes(features, labels, middle, spread, w))
        if change < 1e-6:
            break
    weights = w[:-1] / spread
    return View(weights, float(w[-1] - middle @ weights))


def _slopes(features: np.ndarray, labels: np.ndarray, middle: np.ndarray, spread: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log loss; they add up over rows."""
    x = np.hstack([(features - middle) / spread, np.ones((len(features), 1))])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (p - labels), (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x


def _step(w: np.ndarray, ridge: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> tuple[np.ndarray, float]:
    change = np.linalg.solve(curve + ridge, slope + ridge @ w)
    largest = float(np.abs(change).max())
    return w - change * min(1.0, 4 / max(1e-12, largest)), largest


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _pool_sums(pool: DataFrame, views: list[View], limit: float, term: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """For each view, ``term(view, features, labels)`` summed over all of ``pool (content, metadata)`` of which the other view is sure."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0.0, 0.0]
        for batch in batches:
            x = [_matrix(batch.column(v), len(views[v].weights)) for v in (0, 1)]
            for v, other in ((0, 1), (1, 0)):
                odds = views[other].odds(x[other])
                sure = np.abs(odds) >= limit
                sums[v] = sums[v] + term(v, x[v][sure], (odds[sure] > 0).astype(float))
        if not isinstance(sums[0], float):
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in sums], ["content", "metadata"])

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({v: [sum(np.frombuffer(x) for x in rows[v]).tobytes()] for v in ("content", "metadata")})

    kind = "content binary, metadata binary"
    parts = pool.select("content", "metadata").mapInArrow(add, kind)
    if pool.rdd.getNumPartitions() > SUM_TASKS:
        parts = parts.groupBy(F.spark_partition_id() % SUM_TASKS).applyInPandas(together, kind)
    found = parts.toArrow()
    return [sum(np.frombuffer(x) for x in found.column(v).to_pylist()) for v in (0, 1)]


def _taught(lessons: list[tuple[np.ndarray, np.ndarray]], pool: DataFrame, teachers: list[View], limit: float, penalty: float = 1.0, steps: int = 25) -> list[View]:
    """Both views as :func:`fitted` to their labelled ``lessons`` and all documents of ``pool`` of which the other teacher is sure.

    Every step of Newton's method sums over the pool with Spark, for both views at once.
    """
    means = [x.mean(axis=0) for x, _ in lessons]

    def moments(v: int, x: np.ndarray, _: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x - means[v]).sum(axis=0), ((x - means[v]) ** 2).sum(axis=0)])

    middles, spreads, ws, ridges = [], [], [], []
    for v, (more, (x, y)) in enumerate(zip(_pool_sums(pool, teachers, limit, moments), lessons, strict=True)):
        n, first, second = np.split(more + moments(v, x, y), [1, 1 + x.shape[1]])
        spread = np.sqrt(np.maximum(0.0, second / n - (first / n) ** 2))
        spread[spread < 1e-9] = 1.0
        middles.append(means[v] + first / n)
        spreads.append(spread)
        ws.append(np.append(teachers[v].weights * spread, teachers[v].intercept + middles[v] @ teachers[v].weights))
        ridges.append(np.diag([penalty] * x.shape[1] + [1e-6]))

    def slopes(v: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        slope, curve = _slopes(x, y, middles[v], spreads[v], ws[v])
        return np.concatenate([slope, curve.ravel()])

    for _ in range(steps):
        changes = []
        for v, (more, (x, y)) in enumerate(zip(_pool_sums(pool, teachers, limit, slopes), lessons, strict=True)):
            slope, curve = np.split(more + slopes(v, x, y), [len(ws[v])])
            ws[v], change = _step(ws[v], ridges[v], slope, curve.reshape(len(slope), -1))
            changes.append(change)
        if max(changes) < 1e-6:
            break
    weights = [w[:-1] / spread for w, spread in zip(ws, spreads, strict=True)]
    return [View(x, float(w[-1] - middle @ x)) for x, w, middle in zip(weights, ws, middles, strict=True)]


@dataclass
class QualityModel:
    """Both views, or the ``prior`` alone if the labels do not hold both classes."""

    prior: float
    views: tuple[View, ...] = ()
    places: Places = ({}, {})

    def score(self, docs: DataFrame, keep: list[Column], text_column: str = "text") -> DataFrame:
        """``keep`` with ``score`` (probability of good quality), ``content_score`` and ``metadata_score``.

        The views are taken as independent given the class: their calibrated log odds add up, and
        the prior, which both hold, counts once.
        """
        if not self.views:
            only = F.lit(self.prior)
            return docs.select(*keep, only.alias("score"), only.alias("content_score"), only.alias("metadata_score"))
        views, places, prior = self.views, self.places, math.log(self.prior / (1 - self.prior))

        @F.pandas_udf("score double, content_score double, metadata_score double")
        def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                content, metadata = (v.odds(x) for v, x in zip(views, _view_matrices(places, *batch), strict=True))
                odds = np.stack([content + metadata - prior, content, metadata], axis=1)
                yield pd.DataFrame(1 / (1 + np.exp(-odds)), columns=["score", "content_score", "metadata_score"])

        return docs.select(*keep, scored(*_given(docs, text_column)).alias("_scores")).select("*", "_scores.*").drop("_scores")


def fit_quality(
    docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT,
    fit_rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text",
) -> QualityModel:
    """Co-train on about ``fit_rows`` labelled documents at most, and on all that have no label.

    In each round either view marks the unlabelled documents of which it is ``confident``; the other
    view learns from them in the next round.  One fold of the labelled rows only calibrates.  Features
    are computed by Spark and written once; the driver gets those of the labelled sample, and sums over
    the unlabelled documents.
    """
    sample, n, positive = sample_of_labels(labels, "quality", fit_rows, id_column)
    prior = (positive + 1.0) / (n + 2.0)
    if positive < FOLDS or n - positive < FOLDS:
        return QualityModel(prior)
    # About fit_rows ids at most, whatever the size of the tables.
    sample = F.broadcast(sample.withColumnRenamed(id_column, "id"))
    given = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), *(c.alias(k) for c, k in zip(_given(docs, text_column), "tslc", strict=True)))
    origins = given.select("id", "s", "l").join(sample, "id").groupBy("s", "l").agg(F.count(F.lit(1)).alias("n")).collect()
    places = []
    for at, most in ((0, SOURCES), (1, LANGS)):
        tally = Counter()
        for row in origins:
            tally[row[at]] += row["n"]
        often = sorted(tally, key=lambda value: (-tally[value], value is not None, value))[:most]
        places.append({value: i for i, value in enumerate(often)})

    @F.pandas_udf("content array<double>, metadata array<double>")
    def features(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content, metadata = _view_matrices(places, *batch)
            yield pd.DataFrame({"content": list(content), "metadata": list(metadata)})

    described = written(given.select("id", features("t", "s", "l", "c").alias("v")).select("id", "v.content", "v.metadata"))
    rows = described.join(sample, "id").select("id", "label", "fold", "content", "metadata").toArrow().sort_by([("id", "ascending"), ("fold", "ascending")])
    x = [rows.column(view).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 1)) for view in ("content", "metadata")]
    y, fold = rows.column("label").to_pandas().to_numpy(dtype=float), rows.column("fold").to_numpy()
    teach, check = (fold >= 0) & (fold < FOLDS - 1), fold == FOLDS - 1
    if any(len(np.unique(y[part])) < 2 for part in (teach, check)):  # labels of documents that are not there
        return QualityModel(prior)
    lessons = [(x[v][teach], y[teach]) for v in (0, 1)]
    views = [fitted(*lesson) for lesson in lessons]
    known = labels.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id")).distinct()
    pool = written(described.join(known, "id", "left_anti").select("content", "metadata"))
    if rounds and not pool.isEmpty():
        for _ in range(rounds):
            views = _taught(lessons, pool, views, math.log(confident / (1 - confident)))
    for v, view in enumerate(views):
        line = fitted(view.odds(x[v][check])[:, None], y[check])
        view.slope, view.shift = max(0.0, float(line.weights[0])), line.intercept
    return QualityModel(prior, tuple(views), tuple(places))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options: object) -> DataFrame:
    """``(doc_id, score, content_score, metadata_score, accepted)`` for every row of ``docs``.

    Null texts count as empty, missing or null metadata as unknown; repeated rows score alike; other
    columns are ignored.  An empty table gives an empty result; labels without both classes give
    every document the prior.
    """
    model = fit_quality(docs, labels, **options)
    scored = model.score(docs, [F.col("doc_id")])
    return scored.withColumn("accepted", F.col("score") >= threshold)
