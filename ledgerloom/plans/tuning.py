"""Hyper-parameter search with macro-F1 on deterministic folds.

Grid search works on text: term statistics are counted once per n-gram range and
fold, and every vocabulary of the grid comes from those small counts.  Features
of a setting are computed once per fold and shared by all penalties.
"""

from __future__ import annotations

import itertools
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import SEED
from ledgerloom.operators.metrics import field_metrics_of
from ledgerloom.operators.split import stratified_folds
from ledgerloom.operators.tfidf import Tfidf, text_statistics
from ledgerloom.plans.models import (
    packed,
    ForestSettings,
    LogisticSettings,
    MlClassifier,
    Settings,
    fit_field,
)

# The two search spaces.
TFIDF_GRID = {
    "max_features": [5000, 7500, 10000],
    "ngram_range": [(1, 2), (1, 3)],
    "min_df": [1, 2],
    "max_df": [0.9, 1.0],
    "sublinear_tf": [True, False],
    "C": [0.5, 1.0, 2.0, 5.0],
}
LOGISTIC_SPACE = {
    "C": [0.01, 0.1, 1.0, 10.0, 100.0],
    "balanced": [True, False],
    "max_iter": [2000, 3000],
    "tol": [1e-4, 1e-3],
}
FOREST_SPACE = {
    "n_estimators": range(100, 300),
    "max_depth": [None, 10, 20, 30],
    "min_samples_leaf": range(1, 5),
    "max_features": ["sqrt", "log2"],
    "balanced": [True, False],
}


#: Held-out confusion counts ``(field, true, pred, n)`` of one fit.
Counts = list[tuple[str, str | None, str | None, int]]


@dataclass
class SearchResult:
    """Best settings, their score, all scores, the counts behind them and the model refitted on all rows.

    ``folds`` holds ``(settings, fold, counts)`` of every fit; every score can be worked out again from it.
    """

    best_params: dict[str, Any]
    best_score: float
    scores: list[tuple[dict[str, Any], float]]
    model: MlClassifier
    folds: list[tuple[dict[str, Any], int, Counts]]

    def counts(self, spark: SparkSession) -> DataFrame:
        """``(setting, fold, field, true, pred, n)``; ``setting`` is a place in ``scores``."""
        places = {repr(params): i for i, (params, _) in enumerate(self.scores)}
        rows = [(places[repr(params)], fold, *row) for params, fold, counts in self.folds for row in counts]
        return spark.createDataFrame(rows, "setting int, fold int, field string, true string, pred string, n long")


def macro_f1(df: DataFrame, true: str, pred: str) -> float:
    """Macro-F1 over the union of true and predicted labels."""
    counts = (
        df.select(F.lit("x").alias("field"), F.col(true).alias("true"), F.col(pred).alias("pred"))
        .groupBy("field", "true", "pred")
        .agg(F.count("*").alias("n"))
    )
    row = field_metrics_of(counts, ["field"]).first()
    return row["f1_macro"] if row else 0.0


class MacroF1Evaluator(Evaluator):
    """Mean macro-F1 over pairs of true and predicted columns, for MLlib tuners."""

    def __init__(self, pairs: list[tuple[str, str]]):
        super().__init__()
        self.pairs = pairs

    def _evaluate(self, dataset: DataFrame) -> float:
        return mean_macro_f1(dataset, self.pairs)

    def isLargerBetter(self) -> bool:
        return True


def mean_macro_f1(df: DataFrame, pairs: list[tuple[str, str]]) -> float:
    """Mean of the macro-F1 of several label columns, in one pass over the rows."""
    rows = [
        F.struct(F.lit(i).alias("field"), F.col(t).cast("string").alias("true"),
                 F.col(p).cast("string").alias("pred"))
        for i, (t, p) in enumerate(pairs)
    ]
    counts = (
        df.select(F.explode(F.array(*rows)).alias("r"))
        .groupBy("r.field", "r.true", "r.pred")
        .agg(F.count("*").alias("n"))
    )
    return field_metrics_of(counts, ["field"]).agg(F.avg("f1_macro")).first()[0] or 0.0


def _best(scores: list[tuple[dict[str, Any], float]]) -> tuple[dict[str, Any], float]:
    return max(scores, key=lambda s: s[1])  # the first of equals


def grid_search_tfidf(
    train: DataFrame,
    target: str,
    text: str = "model_text",
    grid: dict[str, list] | None = None,
    n_folds: int = 5,
    id_col: str = "line_id",
    seed: int = SEED,
    parallelism: int = 8,
) -> SearchResult:
    """Exhaustive search for one field; ``grid`` may narrow any of the axes.

    Up to ``parallelism`` fits run side by side.
    """
    grid = {**TFIDF_GRID, **(grid or {})}
    axes = ("max_features", "ngram_range", "min_df", "max_df", "sublinear_tf")
    known = train.where(F.col(target).isNotNull()).select(id_col, text, target)
    folded = stratified_folds(known, target, n_folds, seed, id_col).persist()
    sizes = {r["fold"]: r["n"] for r in folded.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    n_bytes = folded.agg(F.sum(F.octet_length(text) * 4)).first()[0]
    statistics = {
        span: text_statistics(folded, text, span, by=["fold"]).persist()
        for span in grid["ngram_range"]
    }
    scores, folds = [], []
    try:
        for choice in itertools.product(*[grid[a] for a in axes]):
            setting = dict(zip(axes, choice))
            tfidf = Tfidf(
                inputCol=text, maxFeatures=setting["max_features"],
                minN=setting["ngram_range"][0], maxN=setting["ngram_range"][1],
                minDF=setting["min_df"], maxDF=setting["max_df"], sublinear=setting["sublinear_tf"],
            )
            found_by: dict[float, list[Counts]] = {c: [] for c in grid["C"]}
            for fold in sorted(sizes):  # one fold's features at a time
                others = (
                    statistics[setting["ngram_range"]]
                    .where(F.col("fold") != fold)
                    .groupBy("term")
                    .agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
                )
                model = tfidf.model_for(others, total - sizes[fold])
                ready = packed(model.transform(folded).select("features", target, "fold"), n_bytes).persist()

                def held_out(c: float) -> Counts:
                    fitted = fit_field(
                        ready.where(F.col("fold") != fold), target, LogisticSettings(C=c, max_iter=200)
                    )
                    return _held_out_counts([fitted], ready.where(F.col("fold") == fold))

                try:
                    with ThreadPoolExecutor(parallelism) as pool:
                        for c, found in zip(grid["C"], pool.map(held_out, grid["C"])):
                            found_by[c].append(found)
                finally:
                    ready.unpersist()
            for c, found in found_by.items():
                params = {**setting, "C": c}
                scores.append((params, sum(map(macro_f1_of_counts, found)) / len(sizes)))
                folds += [(params, fold, counts) for fold, counts in zip(sorted(sizes), found, strict=True)]
    finally:
        folded.unpersist()
        for table in statistics.values():
            table.unpersist()
    params, score = _best(scores)
    tfidf = Tfidf(
        inputCol=text, maxFeatures=params["max_features"], minN=params["ngram_range"][0],
        maxN=params["ngram_range"][1], minDF=params["min_df"], maxDF=params["max_df"],
        sublinear=params["sublinear_tf"],
    )
    best = MlClassifier(
        "tfidf", [target], settings=LogisticSettings(C=params["C"], max_iter=200), tfidf=tfidf
    )
    return SearchResult(params, score, scores, best.fit(known), folds)


def macro_f1_of_counts(counts: Counts) -> float:
    """Mean over the fields of macro-F1, as :func:`mean_macro_f1` has it, from collected counts."""
    by_field: dict[str, dict[str, list[int]]] = {}
    for field, true, pred, n in counts:
        labels = by_field.setdefault(field, {})
        right = true is not None and true == pred
        for label, place in ((true, 0 if right else 1), (None if right else pred, 1)):
            if label is not None:
                labels.setdefault(label, [0, 0])[place] += n
    means = [
        sum(2 * hit / (2 * hit + miss) for hit, miss in labels.values()) / len(labels) if labels else 0.0
        for labels in by_field.values()
    ]
    return sum(means) / len(means) if means else 0.0


def _held_out_counts(models: list, held_out: DataFrame) -> Counts:
    """Confusion counts of the models' predictions; a few per pair of classes, which MLlib keeps on the driver anyway."""
    scored = held_out
    for m in models:
        scored = m.probabilities(scored)
        probs = F.col(f"prob_{m.field}")
        names = F.array(*[F.lit(x) for x in m.labels])
        scored = scored.withColumn(
            f"_pred_{m.field}",
            F.element_at(names, F.array_position(probs, F.array_max(probs)).cast("int")),
        )
    pairs = [
        F.struct(F.lit(m.field).alias("field"), F.col(m.field).cast("string").alias("true"), F.col(f"_pred_{m.field}").alias("pred"))
        for m in models
    ]
    counts = scored.select(F.explode(F.array(*pairs)).alias("r")).groupBy("r.field", "r.true", "r.pred").agg(F.count("*").alias("n"))
    return [tuple(r) for r in counts.collect()]


def draw_settings(classifier: str, n_iter: int, seed: int = SEED) -> list[Settings]:
    """Seeded random draws from the space of a classifier.

    A space smaller than ``n_iter`` is listed completely; otherwise list-only
    spaces are drawn without repetition.
    """
    space = LOGISTIC_SPACE if classifier == "logistic_regression" else FOREST_SPACE
    kind = LogisticSettings if classifier == "logistic_regression" else ForestSettings
    rng = random.Random(seed)
    if classifier == "logistic_regression":
        every = [dict(zip(space, c)) for c in itertools.product(*space.values())]
        chosen = every if len(every) <= n_iter else rng.sample(every, n_iter)
    else:
        chosen = [{k: rng.choice(list(v)) for k, v in space.items()} for _ in range(n_iter)]
    return [kind(**c) for c in chosen]


def random_search_embeddings(
    train: DataFrame,
    targets: list[str],
    classifier: str = "logistic_regression",
    vector: str = "embedding",
    n_iter: int = 20,
    n_folds: int = 3,
    id_col: str = "line_id",
    seed: int = SEED,
    settings: list[Settings] | None = None,
    parallelism: int = 8,
) -> SearchResult:
    """Random search over the settings shared by all fields.

    Several targets get plain random folds, a single one stratified folds.
    """
    if len(targets) == 1:
        known = train.where(F.col(targets[0]).isNotNull())
        folded = stratified_folds(known, targets[0], n_folds, seed, id_col)
    else:
        together = train.withColumn("_all", F.lit("all"))
        folded = stratified_folds(together, "_all", n_folds, seed, id_col).drop("_all")
    shape = MlClassifier("embeddings", targets, classifier, input_col=vector, seed=seed)
    ready = shape.features(folded).select("features", *targets, "fold")
    ready = packed(ready, shape.feature_bytes(train)).persist()
    scores, folds = [], []
    try:
        chosen = settings or draw_settings(classifier, n_iter, seed)

        def held_out(case: tuple[Settings, int]) -> Counts:
            setting, fold = case
            rest = ready.where(F.col("fold") != fold)
            models = [fit_field(rest, t, setting, seed=seed) for t in targets]
            return _held_out_counts(models, ready.where(F.col("fold") == fold))

        with ThreadPoolExecutor(parallelism) as pool:
            found = list(pool.map(held_out, [(s, f) for s in chosen for f in range(n_folds)]))
        for at, setting in enumerate(chosen):
            own = found[at * n_folds : (at + 1) * n_folds]
            scores.append((vars(setting), sum(map(macro_f1_of_counts, own)) / n_folds))
            folds += [(vars(setting), fold, counts) for fold, counts in enumerate(own)]
    finally:
        ready.unpersist()
    params, score = _best(scores)
    kind = LogisticSettings if classifier == "logistic_regression" else ForestSettings
    best = MlClassifier(
        "embeddings", targets, classifier, settings=kind(**params), input_col=vector, seed=seed
    )
    return SearchResult(params, score, scores, best.fit(train), folds)
