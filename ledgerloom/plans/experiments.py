"""Whole evaluation runs: text model, vector models, retrieval, and new lines."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.config import LABEL_COLUMNS, REPORT_FIELDS, TOP_K
from ledgerloom.functions.parsing import parse_json_response, parse_line_response
from ledgerloom.functions.text import add_model_text_column, create_novel_items
from ledgerloom.functions.vectors import hashed_embedding
from ledgerloom.operators.errors import error_report
from ledgerloom.operators.inference import batch_infer, with_truth
from ledgerloom.operators.metrics import evaluate_predictions
from ledgerloom.operators.prompts import chat_prompt, plain_prompt
from ledgerloom.operators.retrieval import build_index, nested_examples, retrieve
from ledgerloom.operators.split import Split, stratified_random_split
from ledgerloom.operators.vote import vote
from ledgerloom.plans.models import MlClassifier, fit_text_models
from ledgerloom.plans.tuning import grid_search_tfidf, random_search_embeddings
from ledgerloom.scale import settle

Scorer = Callable[[DataFrame], DataFrame]
Embedder = Callable[[DataFrame], DataFrame]
COLUMN_OF = dict(zip(REPORT_FIELDS, LABEL_COLUMNS.values()))
RESULT_DDL = (
    "experiment string, method string, field string, f1_macro double, accuracy double, "
    "sample_wise_f1 double, time_seconds double, test_size bigint, is_baseline boolean, "
    "run_order int"
)


@dataclass
class Run:
    """Predictions of one method beside the truth, and its scores."""

    experiment: str
    method: str
    predictions: DataFrame
    scores: dict[str, float]
    seconds: float
    is_baseline: bool = True
    order: int = 0

    def rows(self) -> list[tuple]:
        return [
            (self.experiment, self.method, f, self.scores[f"{f}_f1"], self.scores[f"{f}_acc"],
             self.scores["sample_wise_f1"], self.seconds, int(self.scores["test_size"]),
             self.is_baseline, self.order)
            for f in REPORT_FIELDS
        ]

    def errors(self) -> DataFrame:
        return error_report(self.predictions)


def result_table(spark: SparkSession, runs: list[Run]) -> DataFrame:
    """One row per run and field."""
    return spark.createDataFrame([row for run in runs for row in run.rows()], RESULT_DDL)


def _finish(experiment, method, predictions, started, baseline, order) -> Run:
    predictions = predictions.persist()
    scores = evaluate_predictions(predictions)
    return Run(experiment, method, predictions, scores, time.time() - started, baseline, order)


def _beside_truth(scored: DataFrame) -> DataFrame:
    columns = []
    for f, c in COLUMN_OF.items():
        columns += [F.col(c).alias(f"true_{f}"), F.col(f"{c}_pred").alias(f"pred_{f}")]
    confidence = F.create_map(
        *[x for n, c in LABEL_COLUMNS.items() for x in (F.lit(n), F.col(f"{c}_confidence"))]
    )
    return scored.select(
        "line_id", F.col("DETAIL").alias("detail"), F.col("SUPPLIER").alias("supplier"),
        *columns, confidence.alias("confidence"),
    )


def evaluate_field(train: DataFrame, test: DataFrame, target: str) -> tuple[DataFrame, MlClassifier]:
    """Fit the text model of one field and score the test lines."""
    model = MlClassifier("tfidf", [target]).fit(train)
    return model.predict(test), model


def tfidf_experiment(
    split: Split, tune: bool = False, grid: dict[str, list] | None = None, order: int = 0
) -> Run:
    """TF-IDF and logistic regression, one model per field over one split."""
    started = time.time()
    train = split.train.persist()
    columns = list(LABEL_COLUMNS.values())
    if tune:
        models = [grid_search_tfidf(train, column, grid=grid).model for column in columns]
    else:
        models = fit_text_models(train, columns)
    scored = split.test
    for model in models:
        scored = model.predict(scored)
    name = "TF-IDF + LogisticRegression" + (" (tuned)" if tune else "")
    run = _finish("tfidf", name, _beside_truth(scored), started, not tune, order)
    train.unpersist()
    return run


def vector_experiment(
    split: Split, classifier: str = "logistic_regression", tune: bool = False, n_iter: int = 20,
    vector: str = "embedding", order: int = 0, settings: list | None = None,
) -> Run:
    """One model per field over shared dense vectors."""
    started = time.time()
    targets = list(LABEL_COLUMNS.values())
    if tune:
        model = random_search_embeddings(
            split.train, targets, classifier, vector, n_iter, settings=settings
        ).model
    else:
        model = MlClassifier("embeddings", targets, classifier, input_col=vector).fit(split.train)
    name = {"logistic_regression": "LogisticRegression", "random_forest": "RandomForest"}[classifier]
    name = f"Embeddings + {name}" + (" (tuned)" if tune else "")
    scored = _beside_truth(model.predict(split.test))
    return _finish("embeddings", name, scored, started, not tune, order)


def retrieval_predictions(
    queries: DataFrame, index: DataFrame, k: int = TOP_K, scorer: Scorer | None = None, **plan
) -> DataFrame:
    """Neighbours of every query and the labels that a scorer gives; the vote by default.

    ``queries`` has ``line_id`` and ``embedding``.  ``scorer`` gets a table with
    ``line_id`` and ``examples`` and returns it with labels, ``confidence`` and
    ``reasoning``.  A query without a neighbour has no row here.
    """
    found = retrieve(queries, index, k, "line_id", **plan)
    return (scorer or vote)(nested_examples(found, "line_id"))


def prompt_scorer(
    lines: DataFrame, vocabulary: dict[str, list[str]], complete: Callable[[list[str]], list[str]],
    plain: bool = False, text: str = "model_text",
) -> Scorer:
    """A scorer that sends prompts with few-shot examples to ``complete`` and parses the answers.

    ``complete`` gets the prompts of a batch and returns as many answers; it stands
    for a language model.  Structured answers are JSON; ``plain`` prompts are
    answered in lines, and a missing label becomes the first one of its field.
    """
    fields = list(LABEL_COLUMNS)

    def answered(rows: list[dict]) -> list[dict]:
        prompts = [r["prompt"] for r in rows]
        return [{f: "" for f in fields} | {"reasoning": a} for a in complete(prompts)]

    def score(nested: DataFrame) -> DataFrame:
        shown = [c for c in ("DETAIL", "SUPPLIER", "NET", "VAT", text) if c in lines.columns]
        items = nested.join(lines.select("line_id", *shown), "line_id")
        if plain:
            asked = plain_prompt(items, vocabulary, text)
        else:
            made = chat_prompt(items, vocabulary)
            asked = made.withColumn("prompt", F.concat_ws("\n\n", "system_prompt", "user_prompt"))
        raw = batch_infer(asked, None, ["prompt"], predict_batch=answered)
        raw = raw.select("line_id", F.col("reasoning").alias("response"), "failed", "error")
        first = {f: F.lit(vocabulary[f][0]) for f in fields}
        if plain:
            read = raw.withColumn("p", parse_line_response("response"))
            label = {f: F.when(F.col("failed") | (F.col(f"p.{f}") == ""), first[f]).otherwise(F.col(f"p.{f}")) for f in fields}
            labelled = read.select(
                "line_id", *[c.alias(f) for f, c in label.items()],
                F.create_map().cast("map<string,double>").alias("confidence"), F.lit("").alias("reasoning"), "failed", "error",
            )
        else:
            read = parse_json_response(raw)
            good = F.col("valid") & ~F.col("failed")
            sure = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f"{f}_confidence"))])
            labelled = read.select(
                "line_id", *[F.when(good, F.col(f)).otherwise("").alias(f) for f in fields],
                F.when(good, sure).alias("confidence"), "reasoning", (~good).alias("failed"),
                F.when(~good, F.coalesce("error", "reason")).alias("error"),
            )
        return nested.join(labelled, "line_id")

    return score


def retrieval_experiment(
    split: Split, k: int = TOP_K, order: int = 0, scorer: Scorer | None = None,
    embed: Embedder | None = None, method: str | None = None, **plan,
) -> Run:
    """Neighbours and a scorer: train lines are the index, test lines the queries.

    ``embed`` makes the vectors (a column ``embedding`` from ``model_text``); without
    it the split brings them.  Test lines without a neighbour count as failed.
    """
    started = time.time()
    train, test = (embed(split.train), embed(split.test)) if embed else (split.train, split.test)
    index = build_index(train, "line_id", "model_text")
    guessed = retrieval_predictions(test, index, k, scorer, **plan)
    predictions = with_truth(guessed, split.test)
    return _finish("retrieval", method or f"Retrieval vote (k={k})", predictions, started, True, order)


def classify_novel_items(
    items: DataFrame, lines: DataFrame, k: int = TOP_K, dim: int = 384, key: str = "line_id",
    scorer: Scorer | None = None, embed: Embedder | None = None, **plan,
) -> DataFrame:
    """Label new, unlabelled items from the whole table of past lines.

    ``items`` has ``key`` and ``DETAIL`` (``SUPPLIER``, ``NET``, ``VAT`` optional).
    The result keeps every item, with labels, confidence, reason and the examples
    used; an item without a neighbour is ``failed`` and has empty labels.

    Past lines repeat their texts, so each text is embedded once and stands in the
    index with its ``k`` smallest keys, more of which cannot be among ``k`` winners.
    """
    past = lines if "model_text" in lines.columns else add_model_text_column(lines)
    vectors = embed or (lambda df: hashed_embedding(df, "model_text", dim))
    ranked = F.row_number().over(W.partitionBy("model_text").orderBy("line_id"))
    few = past.select("line_id", "model_text", *LABEL_COLUMNS.values()).withColumn("_copy", ranked)
    # Used twice: settled, so that past lines are read and prepared once.
    few = settle(few.where(F.col("_copy") <= k).drop("_copy"))
    texts = vectors(few.select("model_text").distinct()).select("model_text", "embedding")
    index = build_index(few.join(texts, "model_text"), "line_id", "model_text")
    shaped = create_novel_items(items)
    asked = vectors(shaped).select(F.col(key).alias("line_id"), "embedding")
    labelled = retrieval_predictions(asked, index, k, scorer, **plan)
    kept = shaped.select(F.col(key).alias("line_id"), "DETAIL", "SUPPLIER", "NET", "VAT", "model_text")
    missing = F.col("examples").isNull()
    return kept.join(labelled, "line_id", "left").withColumns(
        {"failed": missing, **{f: F.when(missing, "").otherwise(F.col(f)) for f in LABEL_COLUMNS}}
    )


def evaluate_lines(lines: DataFrame, dim: int = 384, k: int = TOP_K) -> tuple[list[Run], Split]:
    """The three experiments without tuning on one table of prepared lines."""
    split = stratified_random_split(hashed_embedding(lines, "model_text", dim))
    split = Split(split.data.persist(), split.level)
    runs = [
        tfidf_experiment(split, order=0),
        vector_experiment(split, "logistic_regression", order=1),
        vector_experiment(split, "random_forest", order=2),
        retrieval_experiment(split, k, order=3),
    ]
    return runs, split
