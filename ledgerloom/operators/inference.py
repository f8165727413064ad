"""Batched calls of pluggable Python models: embedding functions and row scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.config import EMBEDDING_BATCH, EMBEDDING_DIM, LABEL_COLUMNS

FIELDS = tuple(LABEL_COLUMNS)
PREDICTION = T.StructType(
    [T.StructField(f, T.StringType()) for f in FIELDS]
    + [
        T.StructField("confidence", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("reasoning", T.StringType()),
        T.StructField("failed", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)


def batch_embed(
    df: DataFrame,
    embed: Callable[[list[str]], Sequence[Sequence[float]]],
    key: str = "line_id",
    text: str = "model_text",
    dim: int = EMBEDDING_DIM,
    batch_size: int = EMBEDDING_BATCH,
) -> DataFrame:
    """``key, text, embedding, embed_error``: vectors from ``embed`` in batches.

    Empty texts never reach ``embed`` and get zero vectors.  A failing batch gives
    zero vectors too, with the message in ``embed_error``.  Parallelism is the
    number of partitions.
    """
    schema = T.StructType(
        [
            df.schema[key],
            df.schema[text],
            T.StructField("embedding", T.ArrayType(T.DoubleType())),
            T.StructField("embed_error", T.StringType()),
        ]
    )

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            for start in range(0, len(chunk), batch_size):
                part = chunk.iloc[start : start + batch_size].reset_index(drop=True)
                full = part[text].fillna("").str.strip() != ""
                vectors = [np.zeros(dim)] * len(part)
                error = None
                try:
                    got = embed(part.loc[full, text].tolist()) if full.any() else []
                    got = [np.asarray(v, dtype=float) for v in got]
                    if len(got) != full.sum() or any(v.shape != (dim,) for v in got):
                        raise ValueError("the embedding function returned a wrong shape")
                    for at, vector in zip(np.flatnonzero(full), got):
                        vectors[at] = vector
                except Exception as problem:
                    vectors = [np.zeros(dim)] * len(part)
                    error = f"{type(problem).__name__}: {problem}"
                part["embedding"] = vectors
                part["embed_error"] = error
                part.loc[~full, "embed_error"] = None
                yield part

    return df.select(key, text).mapInPandas(run, schema)


def batch_infer(
    df: DataFrame,
    predict_one: Callable[[dict[str, Any]], dict[str, Any]] | None,
    inputs: Sequence[str],
    key: str = "line_id",
    on_error: str = "empty",
    first_labels: dict[str, str] | None = None,
    predict_batch: Callable[[list[dict[str, Any]]], list[dict[str, Any]]] | None = None,
    batch_size: int = EMBEDDING_BATCH,
) -> DataFrame:
    """Score every row with a Python callable; one bad row never stops the others.

    ``predict_one`` gets the ``inputs`` of a row as a dict and returns the labels
    and, optionally, ``confidence`` and ``reasoning``.  ``predict_batch`` does so
    for a list of rows; a batch that fails is scored row by row (with
    ``predict_one`` if given, else in batches of one).  For a failed row
    ``on_error='empty'`` gives empty labels, ``'first_label'`` the labels in
    ``first_labels``, and ``error`` says why.
    """
    if predict_one is None and predict_batch is None:
        raise ValueError("give predict_one or predict_batch")
    if on_error not in ("empty", "first_label"):
        raise ValueError("on_error is 'empty' or 'first_label'")
    if on_error == "first_label" and not first_labels:
        raise ValueError("first_labels is needed for on_error='first_label'")
    fallback = {f: (first_labels[f] if on_error == "first_label" else "") for f in FIELDS}
    schema = T.StructType([df.schema[key], *PREDICTION.fields])

    def shaped(out: dict[str, Any]) -> tuple:
        confidence = {k: float(v) for k, v in (out.get("confidence") or {}).items()}
        reasoning = str(out.get("reasoning") or "").strip()
        return (*[str(out[f]) for f in FIELDS], confidence, reasoning, False, None)

    def score(row: dict[str, Any]) -> tuple:
        try:
            return shaped(predict_one(row) if predict_one else predict_batch([row])[0])
        except Exception as problem:
            return (*fallback.values(), {}, "", True, f"{type(problem).__name__}: {problem}")

    def score_all(rows: list[dict[str, Any]]) -> list[tuple]:
        if predict_batch is None:
            return [score(r) for r in rows]
        try:
            found = predict_batch(rows)
            if len(found) != len(rows):
                raise ValueError("the batch scorer returned another number of rows")
            return [shaped(out) for out in found]
        except Exception:
            return [score(r) for r in rows]

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            rows = chunk[list(inputs)].to_dict("records")
            scored = [x for a in range(0, len(rows), batch_size) for x in score_all(rows[a : a + batch_size])]
            out = pd.DataFrame(scored, columns=[f.name for f in PREDICTION.fields])
            out.insert(0, key, chunk[key].to_numpy())
            yield out

    columns = [key, *[c for c in inputs if c != key]]
    return df.select(*columns).mapInPandas(run, schema)


def fallback_labels(
    parsed: DataFrame, vocabulary: dict[str, list[str]], on_error: str = "first_label"
) -> DataFrame:
    """Fill the labels of failed answers (``valid`` is false) by policy, on the JVM."""
    fill = {f: vocabulary[f][0] if on_error == "first_label" else "" for f in FIELDS}
    return parsed.withColumns(
        {f: F.when(F.col("valid"), F.col(f)).otherwise(F.lit(fill[f])) for f in FIELDS}
    ).withColumn("failed", ~F.col("valid"))


def with_truth(
    predictions: DataFrame, lines: DataFrame, key: str = "line_id",
    first_labels: dict[str, str] | None = None,
) -> DataFrame:
    """Put predictions beside the true labels, in prediction-table layout.

    Every line stays.  One without a prediction is ``failed`` and gets empty
    labels, or those in ``first_labels``.
    """
    names = dict(zip(("nominal", "department", "tc"), LABEL_COLUMNS.items()))
    truth = lines.select(
        key,
        F.col("DETAIL").alias("detail"),
        F.col("SUPPLIER").alias("supplier"),
        *[F.col(column).alias(f"true_{n}") for n, (_, column) in names.items()],
    )
    extra = [c for c in ("confidence", "reasoning", "failed", "error") if c in predictions.columns]
    guesses = predictions.select(
        key, *[F.col(short).alias(f"pred_{n}") for n, (short, _) in names.items()], *extra,
        F.lit(True).alias("_scored"),
    )
    fill = {n: F.lit((first_labels or {}).get(short, "")) for n, (short, _) in names.items()}
    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in extra else F.lit(False)
    return (
        truth.join(guesses, key, "left")
        .withColumns(
            {
                **{f"pred_{n}": F.when(F.col("_scored").isNull(), fill[n]).otherwise(F.col(f"pred_{n}")) for n in names},
                "failed": F.col("_scored").isNull() | failed,
            }
        )
        .drop("_scored")
    )
