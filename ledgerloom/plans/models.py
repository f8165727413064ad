"""Classifiers on TF-IDF or dense vectors, one label field or all three.

The solvers are MLlib's; what is set here is the mapping of hyper-parameters.
"""

from __future__ import annotations

import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from math import ceil
from typing import Any

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.config import SEED
from ledgerloom.operators.tfidf import Tfidf, TfidfModel

# Bytes of features in one partition while a model is fitted, and memory of one pass over tree nodes.
FIT_BYTES = 64 * 1024 * 1024
TREE_MEMORY_MB = 1024

# Spark's random forests stop at this depth; "no limit" maps to it.
DEEPEST = 30


@dataclass(frozen=True)
class LogisticSettings:
    C: float = 1.0
    max_iter: int = 3000
    tol: float = 1e-3
    balanced: bool = True


@dataclass(frozen=True)
class ForestSettings:
    n_estimators: int = 100
    max_depth: int | None = 10
    min_samples_leaf: int = 1
    max_features: str = "sqrt"
    balanced: bool = True


Settings = LogisticSettings | ForestSettings


@dataclass
class FieldModel:
    """A fitted classifier of one field with its label list."""

    field: str
    labels: list[str]
    model: Any
    constant: str | None = None
    kind: T.DataType = T.StringType()
    iterations: int | None = None
    converged: bool = True

    def probabilities(self, features: DataFrame) -> DataFrame:
        """Add ``prob_<field>``, an array in label order."""
        if self.model is None:
            return features.withColumn(f"prob_{self.field}", F.array(F.lit(1.0)))
        scored = self.model.transform(features)
        kept = vector_to_array("_probability")
        return scored.withColumn(f"prob_{self.field}", kept).drop(
            "_probability", "_raw", "_prediction"
        )


def packed(features: DataFrame, n_bytes: int | None) -> DataFrame:
    """A solver starts a job for every step: as few partitions as the size of the features allows."""
    parts = max(1, ceil((n_bytes or 0) / FIT_BYTES))
    return features.repartition(parts) if features.rdd.getNumPartitions() > parts else features


def _name_of(labels: list[str], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), position.cast("int"))


def fit_field(
    train: DataFrame, label: str, settings: Settings, features: str = "features", seed: int = SEED
) -> FieldModel:
    """Fit one field.  Rows without a label are left out; labels of other types are coded as text.

    MLlib keeps the list of classes, and logistic regression a coefficient per class and feature, on
    the driver; that alone bounds the number of classes.

    With balanced weights the weights sum to the number of rows, so a penalty of
    ``1/(C * rows)`` on unscaled features equals an objective of C times the summed
    loss plus half the squared coefficients.
    """
    kind = train.schema[label].dataType
    known = train.where(F.col(label).isNotNull()).select(features, F.col(label).cast("string").alias(label))
    counts = known.groupBy(label).agg(F.count("*").alias("n")).collect()
    if not counts:
        raise ValueError(f"field {label} holds no labels")
    sizes = {r[label]: r["n"] for r in counts}
    labels = sorted(sizes)
    if len(labels) == 1:
        return FieldModel(label, labels, None, labels[0], kind)
    n = sum(sizes.values())
    indexer = StringIndexerModel.from_labels(labels, inputCol=label, outputCol="_label", handleInvalid="error")
    coded = indexer.transform(known)
    weights = [n / (len(labels) * sizes[x]) if settings.balanced else 1.0 for x in labels]
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("_label").cast("int") + 1)
    coded = coded.withColumn("_weight", weight)
    common = dict(
        featuresCol=features, labelCol="_label", weightCol="_weight", predictionCol="_prediction",
        probabilityCol="_probability", rawPredictionCol="_raw",
    )
    if isinstance(settings, LogisticSettings):
        estimator = LogisticRegression(
            family="auto", regParam=1.0 / (settings.C * n), elasticNetParam=0.0,
            standardization=False, maxIter=settings.max_iter, tol=settings.tol, **common,
        )
    else:
        estimator = RandomForestClassifier(
            numTrees=settings.n_estimators,
            maxDepth=DEEPEST if settings.max_depth is None else min(settings.max_depth, DEEPEST),
            minInstancesPerNode=settings.min_samples_leaf,
            featureSubsetStrategy=settings.max_features, seed=seed, maxMemoryInMB=TREE_MEMORY_MB,
            **common,
        )
    model = estimator.fit(coded)
    if not isinstance(settings, LogisticSettings):
        return FieldModel(label, labels, model, None, kind)
    steps = model.summary.totalIterations
    if steps >= settings.max_iter:
        warnings.warn(f"{label}: no convergence within {steps} iterations")
    return FieldModel(label, labels, model, None, kind, steps, steps < settings.max_iter)


@dataclass
class MlClassifier:
    """One or several fields over shared features.

    ``feature_type`` is ``tfidf`` (a text column, one field) or ``embeddings`` (a
    vector column as ``ARRAY``; any number of fields, each with its own model).
    """

    feature_type: str
    targets: list[str]
    classifier: str = "logistic_regression"
    settings: Settings | None = None
    tfidf: Tfidf | None = None
    input_col: str | None = None
    seed: int = SEED
    fitted: list[FieldModel] = field(default_factory=list)
    text_model: TfidfModel | None = None

    def __post_init__(self):
        if self.feature_type not in ("tfidf", "embeddings"):
            raise ValueError("feature_type is 'tfidf' or 'embeddings'")
        if self.classifier not in ("logistic_regression", "random_forest"):
            raise ValueError(f"unknown classifier: {self.classifier}")
        if not self.targets:
            raise ValueError("no target column given")
        if self.feature_type == "tfidf" and len(self.targets) > 1:
            raise ValueError("TF-IDF models predict one field; use one model per field")
        if self.settings is None:
            if self.classifier == "random_forest":
                self.settings = ForestSettings()
            else:
                # Sparse text features converge earlier than dense vectors.
                few = 200 if self.feature_type == "tfidf" else 3000
                self.settings = LogisticSettings(max_iter=few)
        if self.feature_type == "tfidf":
            self.tfidf = self.tfidf or Tfidf()
            self.input_col = self.input_col or self.tfidf.getInputCol()
        self.input_col = self.input_col or "embedding"

    def features(self, df: DataFrame) -> DataFrame:
        if self.feature_type == "tfidf":
            if self.text_model is None:
                raise ValueError("classifier is not fitted; call fit() first")
            return self.text_model.transform(df)
        return df.withColumn("features", array_to_vector(F.col(self.input_col).cast("array<double>")))

    def feature_bytes(self, df: DataFrame) -> int:
        """About the bytes that the features take: the vectors', or a few times the texts'."""
        column = F.col(self.input_col)
        size = F.octet_length(column) * 4 if self.feature_type == "tfidf" else F.size(column) * 8
        return df.agg(F.sum(size)).first()[0] or 0

    def fit(self, train: DataFrame) -> MlClassifier:
        """Fit all fields on features computed once; the fits run side by side."""
        if self.feature_type == "tfidf":
            self.text_model = self.tfidf.fit(train)
        ready = packed(self.features(train).select("features", *self.targets), self.feature_bytes(train))
        ready = ready.persist()
        try:
            with ThreadPoolExecutor(len(self.targets)) as pool:
                self.fitted = list(
                    pool.map(lambda t: fit_field(ready, t, self.settings, seed=self.seed), self.targets)
                )
        finally:
            ready.unpersist()
        return self

    def _scored(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise ValueError("classifier is not fitted; call fit() first")
        scored = self.features(df)
        for model in self.fitted:
            scored = model.probabilities(scored)
        return scored.drop("features")

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``<field>_pred`` and ``<field>_confidence`` for every target."""
        scored = self._scored(df)
        for m in self.fitted:
            probs = F.col(f"prob_{m.field}")
            best = F.array_max(probs)
            scored = scored.withColumns(
                {
                    f"{m.field}_pred": _name_of(m.labels, F.array_position(probs, best)).cast(m.kind),
                    f"{m.field}_confidence": best,
                }
            )
        return scored.drop(*[f"prob_{m.field}" for m in self.fitted])

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Add ``<field>_proba``, a map from label to probability, for every target."""
        scored = self._scored(df)
        for m in self.fitted:
            names = F.array(*[F.lit(x) for x in m.labels]).cast(T.ArrayType(m.kind))
            scored = scored.withColumn(
                f"{m.field}_proba", F.map_from_arrays(names, F.col(f"prob_{m.field}"))
            )
        return scored.drop(*[f"prob_{m.field}" for m in self.fitted])


def fit_text_models(
    train: DataFrame, targets: list[str], settings: Settings | None = None, tfidf: Tfidf | None = None
) -> list[MlClassifier]:
    """One text model per field.  The vocabulary does not depend on the field, so
    it is built once, the features are kept, and the fits run side by side."""
    models = [MlClassifier("tfidf", [t], settings=settings, tfidf=tfidf) for t in targets]
    text_model = models[0].tfidf.fit(train)
    ready = text_model.transform(train).select("features", *targets)
    ready = packed(ready, models[0].feature_bytes(train)).persist()
    try:
        with ThreadPoolExecutor(len(targets)) as pool:
            fitted = list(pool.map(lambda m: fit_field(ready, m.targets[0], m.settings), models))
    finally:
        ready.unpersist()
    for model, one in zip(models, fitted):
        model.text_model, model.fitted = text_model, [one]
    return models
