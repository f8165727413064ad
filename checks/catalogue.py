"""Registered queries: every operator run over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.adapters import (
    ap_lines,
    doc_items,
    prepared_lines,
    responses,
    spread,
    table,
    vec_items,
)
from checks.predictors import majority_predictions, supplier_predictions
from ledgerloom.config import LABEL_COLUMNS, MIN_SIMILARITY, REPORT_FIELDS
from ledgerloom.functions.parsing import parse_json_response, parse_line_response
from ledgerloom.functions.text import (
    add_model_text_column,
    add_terms,
    create_novel_items,
    example_excerpt,
    normalize_text,
    tokens,
)
from ledgerloom.functions.vectors import hashed_embedding, similarity_text, zero_vector
from ledgerloom.operators import errors, inference, labels, metrics, prompts, results, retrieval, review, split, tfidf
from ledgerloom.operators.vote import vote
from ledgerloom.plans import experiments, tuning
from ledgerloom.plans.models import ForestSettings, LogisticSettings, MlClassifier, fit_text_models
from ledgerloom.scale import kept, small_side
from ledgerloom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FIELDS = list(LABEL_COLUMNS.values())
_shared: dict[tuple, object] = {}


def query(build: Query) -> Query:
    """Register a query; doubles are rounded and integers widened for comparison."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        df = build(spark, sf_dir)
        columns = []
        for f in df.schema.fields:
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                columns.append((F.round(F.col(f.name), 6) + 0.0).alias(f.name))
            elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
                columns.append(F.col(f.name).cast("bigint").alias(f.name))
            else:
                columns.append(F.col(f.name))
        return df.select(*columns)

    run.__doc__ = build.__doc__
    QUERIES[build.__name__] = run
    return run


def shared(name: str, spark: SparkSession, sf_dir: str, make: Callable[[], object]):
    """Splits and predictions are made once per session and reused by the metric queries."""
    key = (name, sf_dir, spark.sparkContext.applicationId)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def line_split(spark, sf_dir):
    """The lines' columns that splits and predictions read, joined and written once, as both read them several times."""

    def make():
        lines = ap_lines(spark, sf_dir).select("line_id", "DETAIL", "SUPPLIER", *FIELDS)
        return split.stratified_random_split(kept(lines))

    return shared("split", spark, sf_dir, make)


def predictions(spark, sf_dir) -> DataFrame:
    """Supplier-mode predictions of the test lines; every metric reads the columns it needs."""
    return shared("supplier", spark, sf_dir, lambda: supplier_predictions(line_split(spark, sf_dir)))


def majority(spark, sf_dir) -> DataFrame:
    return shared("majority", spark, sf_dir, lambda: majority_predictions(line_split(spark, sf_dir)))


# ---- text ----


@query
def text_normalized(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", normalize_text("text").alias("text_norm"))


@query
def model_text(spark, sf_dir):
    return prepared_lines(spark, sf_dir).select("line_id", "detail_norm", "supplier_norm", "model_text")


@query
def novel_model_text(spark, sf_dir):
    """Parts as new items; those of even size come without a supplier."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_name").alias("DETAIL"),
        F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")).alias("SUPPLIER"),
        F.col("p_retailprice").alias("NET"),
    )
    return create_novel_items(parts).select(
        "p_partkey", F.col("DETAIL").alias("detail"), F.col("SUPPLIER").alias("supplier"),
        F.col("NET").alias("net"), F.col("VAT").alias("vat"), "model_text",
    )


@query
def example_excerpts(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", example_excerpt("text").alias("excerpt"))


@query
def token_counts(spark, sf_dir):
    """Tokens of whole documents in four languages."""
    docs = spread(table(spark, sf_dir, "documents")).withColumn("words", tokens("text"))
    return docs.select(
        "doc_id",
        F.size("words").alias("n_tokens"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.md5(F.array_join("words", " ").cast("binary")).alias("token_digest"),
    )


@query
def line_ngrams(spark, sf_dir):
    """Uni- to trigrams of every line, counted over the table."""
    termed = add_terms(prepared_lines(spark, sf_dir), "model_text", (1, 3))
    grams = termed.select(F.explode_outer("terms").alias("term"))
    return grams.groupBy("term").agg(F.count("*").alias("n"))


# ---- labels ----


@query
def dataset_profile(spark, sf_dir):
    return labels.dataset_profile(ap_lines(spark, sf_dir))


def _with_gaps(df: DataFrame) -> DataFrame:
    """Lines whose NOMINAL is missing where the supplier name ends in 7."""
    gap = F.when(~F.col("SUPPLIER").endswith("7"), F.col("NOMINAL"))
    return df.withColumn("NOMINAL", gap)


@query
def null_label_counts(spark, sf_dir):
    return labels.null_label_counts(_with_gaps(ap_lines(spark, sf_dir)))


@query
def label_vocab(spark, sf_dir):
    return labels.label_vocabulary(ap_lines(spark, sf_dir))


@query
def encoded_labels(spark, sf_dir):
    coded, _ = labels.encode_labels(_with_gaps(ap_lines(spark, sf_dir)))
    return coded.select("line_id", *[f"{f}_idx" for f in FIELDS])


@query
def decoded_labels(spark, sf_dir):
    """Codes shifted by one and read back: the last class is out of range."""
    coded, vocabulary = labels.encode_labels(ap_lines(spark, sf_dir).select("line_id", *FIELDS), FIELDS)
    codes = {"n": "NOMINAL", "d": "DEPARTMENT", "t": "TC"}
    shifted = coded.withColumns({short: F.col(f"{field}_idx") + 1 for short, field in codes.items()})
    read = labels.decode_labels(shifted, vocabulary, codes)
    return read.groupBy(*FIELDS, *[f"{short}_label" for short in codes]).agg(F.count("*").alias("n_lines"))


@query
def class_weights(spark, sf_dir):
    return labels.balanced_weights(doc_items(spark, sf_dir), "NOMINAL")


@query
def rare_classes(spark, sf_dir):
    return labels.rare_classes(doc_items(spark, sf_dir), below=100)


# ---- TF-IDF ----


@query
def tfidf_vocab(spark, sf_dir):
    """``detail`` and ``supplier`` are in every line: the share limit removes them."""
    settings = tfidf.TfidfSettings(max_features=500, min_df=2, max_df=0.9)
    lines = prepared_lines(spark, sf_dir).select("line_id", "model_text")
    return tfidf.tfidf_vocabulary(lines, "line_id", "model_text", settings)


@query
def tfidf_weights(spark, sf_dir):
    return tfidf.tfidf_weights(doc_items(spark, sf_dir), "line_id", "DETAIL")


@query
def tfidf_weights_sublinear(spark, sf_dir):
    settings = tfidf.TfidfSettings(max_features=2000, ngram_range=(1, 1), min_df=2, max_df=0.9, sublinear_tf=True)
    return tfidf.tfidf_weights(doc_items(spark, sf_dir), "line_id", "DETAIL", settings)


# ---- splits ----


@query
def stratified_split(spark, sf_dir):
    made = line_split(spark, sf_dir)
    return made.data.select("line_id", "split", F.lit(made.level).alias("level"))


@query
def stratified_split_fallback(spark, sf_dir):
    """One label combination is too rare in the small tables: the single field decides."""
    made = split.stratified_random_split(doc_items(spark, sf_dir))
    return made.data.select("line_id", "split", F.lit(made.level).alias("level"))


@query
def stratified_split_random(spark, sf_dir):
    """Every line a class of its own: no level is possible but the last."""
    lines = kept(ap_lines(spark, sf_dir).select("line_id", "DEPARTMENT", "TC"))
    made = split.stratified_random_split(lines.withColumn("NOMINAL", F.col("line_id")))
    return made.data.select("line_id", "split", F.lit(made.level).alias("level"))


@query
def random_split(spark, sf_dir):
    return split.random_split(ap_lines(spark, sf_dir)).data.select("line_id", "split")


@query
def split_sizes(spark, sf_dir):
    return split.split_sizes(line_split(spark, sf_dir))


@query
def prepared_sides(spark, sf_dir):
    """Label tuples of both sides, counted."""
    train, test = split.prepare_multilabel_data(line_split(spark, sf_dir))
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy(
        "side", "labels.nominal", "labels.department", "labels.tax_code"
    ).agg(F.count("*").alias("n"))


@query
def cv_folds(spark, sf_dir):
    return split.stratified_folds(doc_items(spark, sf_dir), "NOMINAL", 5).select("line_id", "NOMINAL", "fold")


@query
def group_split(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return split.group_split(events, "user_id").data


@query
def group_split_with_gaps(spark, sf_dir):
    """A missing group is a group like any other."""
    events = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("user_id") % 10 != 3, F.col("user_id").cast("string")).alias("user_id")
    )
    return split.group_split(events, "user_id").data


@query
def cluster_holdout(spark, sf_dir):
    made = split.semantic_holdout_split(vec_items(spark, sf_dir), id_col="idx")
    return made.data.select("idx", "cluster", "split")


# ---- retrieval, prompts, answers ----


def vec_split(spark, sf_dir):
    def make():
        vectors = vec_items(spark, sf_dir).withColumn("line_id", F.col("idx").cast("string"))
        return split.random_split(vectors)

    return shared("vectors", spark, sf_dir, make)


def _queries_and_index(spark, sf_dir):
    made = vec_split(spark, sf_dir)
    asked = made.test.select(F.col("idx").alias("query_id"), "embedding")
    return asked, retrieval.build_index(made.train)


def _neighbours(spark, sf_dir) -> DataFrame:
    def make():
        asked, index = _queries_and_index(spark, sf_dir)
        return retrieval.retrieve(asked, index).persist()

    return shared("neighbours", spark, sf_dir, make)


@query
def knn_topk(spark, sf_dir):
    asked, index = _queries_and_index(spark, sf_dir)
    return retrieval.retrieve(asked, index)


@query
def knn_blocks(spark, sf_dir):
    """The plan for many queries, with blocks small enough to have several per cell."""
    asked, index = _queries_and_index(spark, sf_dir)
    return retrieval.retrieve(asked, index, method="blocks", block_rows=64)


@query
def knn_search(spark, sf_dir):
    asked, index = _queries_and_index(spark, sf_dir)
    found = retrieval.search(asked, index, k=3)
    return found.select("query_id", "rank", "text", "labels.*", "similarity")


@query
def knn_small_index(spark, sf_dir):
    """Index of the rarest label only, asked for more than it may hold."""
    vectors = vec_items(spark, sf_dir)
    rarest = vectors.groupBy("NOMINAL").count().orderBy("count", "NOMINAL").limit(1)
    index = retrieval.build_index(vectors.join(F.broadcast(rarest), "NOMINAL", "left_semi"))
    asked = vectors.select(F.col("idx").alias("query_id"), "embedding")
    return retrieval.knn(asked, index, k=1000).groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("rank").alias("last_rank"), F.max("distance").alias("farthest")
    )


@query
def knn_zero_vector(spark, sf_dir):
    """Every fiftieth vector is empty text: at distance one from everything."""
    empty = F.col("idx") % 50 == 0
    vectors = vec_items(spark, sf_dir).withColumn(
        "embedding",
        F.when(empty, zero_vector(64)).otherwise(F.col("embedding").cast("array<double>")),
    )
    asked = vectors.select(F.col("idx").alias("query_id"), "embedding")
    found = retrieval.knn(asked, retrieval.build_index(vectors))
    return found.select("query_id", "idx", "rank", "distance", "similarity")


@query
def knn_empty_index(spark, sf_dir):
    """No index rows: no answers, by either plan; each query is counted."""
    asked, index = _queries_and_index(spark, sf_dir)
    found = [
        retrieval.knn(asked, index.where("idx < 0"), method=m).groupBy("query_id").agg(F.count("*").alias(m))
        for m in ("broadcast", "blocks")
    ]
    out = asked.select("query_id")
    for f in found:
        out = out.join(f, "query_id", "left")
    return out.select("query_id", *[F.coalesce(m, F.lit(0)).alias(m) for m in ("broadcast", "blocks")])


@query
def knn_empty_queries(spark, sf_dir):
    """No queries: no answers, by either plan; each index row is counted."""
    asked, index = _queries_and_index(spark, sf_dir)
    out = index.select("idx")
    for m in ("broadcast", "blocks"):
        found = retrieval.knn(asked.where("query_id < 0"), index, method=m)
        out = out.join(found.groupBy("idx").agg(F.count("*").alias(m)), "idx", "left")
    return out.select("idx", *[F.coalesce(m, F.lit(0)).alias(m) for m in ("broadcast", "blocks")])


@query
def knn_tenant(spark, sf_dir):
    """Neighbours within the same tenant only: one index and one query set for each department."""
    asked, index = _queries_and_index(spark, sf_dir)
    asked = asked.withColumn("tenant", F.concat(F.lit("D"), F.col("query_id") % 4))
    return retrieval.knn_by_tenant(asked, index.withColumn("tenant", F.concat(F.lit("D"), F.col("idx") % 4)), k=3)


@query
def knn_accepted(spark, sf_dir):
    """Neighbours at or above the acceptance floor."""
    asked, index = _queries_and_index(spark, sf_dir)
    return retrieval.retrieve(asked, index, min_similarity=MIN_SIMILARITY)


@query
def similarity_labels(spark, sf_dir):
    found = _neighbours(spark, sf_dir)
    return found.select("query_id", "idx", similarity_text("similarity").alias("shown"))


@query
def few_shot_block(spark, sf_dir):
    nested = retrieval.nested_examples(_neighbours(spark, sf_dir))
    return prompts.build_few_shot_block(nested).select("query_id", "few_shot_examples")


def _prompt_items(spark, sf_dir) -> DataFrame:
    """Test vectors as lines: text, supplier, and amounts from very small to large."""
    nested = retrieval.nested_examples(_neighbours(spark, sf_dir))
    return nested.withColumns(
        {
            "DETAIL": F.concat(F.lit("item "), "query_id"),
            "SUPPLIER": F.concat(F.lit("S"), F.col("query_id") % 7),
            "NET": F.col("query_id") * 12345.125,
            "VAT": F.col("query_id") * 0.0005,
            "model_text": F.concat(F.lit("detail: item "), "query_id"),
        }
    )


def _vec_vocab(spark, sf_dir):
    return shared("vec_vocab", spark, sf_dir, lambda: labels.build_label_vocab(vec_items(spark, sf_dir)))


@query
def chat_prompt(spark, sf_dir):
    made = prompts.chat_prompt(_prompt_items(spark, sf_dir), _vec_vocab(spark, sf_dir))
    return made.select("query_id", "system_prompt", "user_prompt")


@query
def plain_prompt(spark, sf_dir):
    made = prompts.plain_prompt(_prompt_items(spark, sf_dir), _vec_vocab(spark, sf_dir))
    return made.select("query_id", "prompt")


def _voted(spark, sf_dir) -> DataFrame:
    return vote(retrieval.nested_examples(_neighbours(spark, sf_dir)))


@query
def retrieval_vote(spark, sf_dir):
    return _voted(spark, sf_dir).select(
        "query_id", *LABEL_COLUMNS, *[F.col("confidence")[f].alias(f"{f}_confidence") for f in LABEL_COLUMNS],
        "reasoning",
    )


def _vote_predictions(spark, sf_dir) -> DataFrame:
    guessed = _voted(spark, sf_dir).withColumn("line_id", F.col("query_id").cast("string"))
    lines = vec_split(spark, sf_dir).test.withColumns({"DETAIL": F.col("text"), "SUPPLIER": F.lit("none")})
    return inference.with_truth(guessed, lines)


@query
def retrieval_metrics(spark, sf_dir):
    return metrics.field_metrics(_vote_predictions(spark, sf_dir))


def _floor_split(spark, sf_dir):
    made = vec_split(spark, sf_dir)
    data = made.data.withColumns({"DETAIL": F.col("text"), "SUPPLIER": F.lit("none"), "model_text": F.col("text")})
    return split.Split(data, made.level)


@query
def retrieval_with_floor(spark, sf_dir):
    """A floor that leaves few neighbours: every test line is scored, most of them as failed."""
    run = experiments.retrieval_experiment(_floor_split(spark, sf_dir), min_similarity=0.6)
    return run.predictions.select("line_id", *[f"{s}_{f}" for f in REPORT_FIELDS for s in ("true", "pred")], "failed")


def _echo_json(asked: list[str]) -> list[str]:
    """Stands for a language model: answers with the labels of the first example in the prompt."""
    import json
    import re

    out = []
    for prompt in asked:
        found = {f: re.search(rf"^  {f}: (.*)$", prompt, re.M).group(1) for f in LABEL_COLUMNS}
        out.append(json.dumps({**found, **{f"{f}_confidence": 0.5 for f in LABEL_COLUMNS}, "reasoning": "first"}))
    return out


@query
def retrieval_with_scorer(spark, sf_dir):
    """Retrieve, show examples, ask a batch model, parse its JSON."""
    made = _floor_split(spark, sf_dir)
    lines = made.test.withColumns({"NET": F.col("idx") * 0.5, "VAT": F.lit(0.0)})
    scorer = experiments.prompt_scorer(lines, _vec_vocab(spark, sf_dir), _echo_json)
    run = experiments.retrieval_experiment(made, scorer=scorer, method="first example")
    return run.predictions.select(
        "line_id", *[f"pred_{f}" for f in REPORT_FIELDS], "reasoning", "failed", "error",
        F.col("confidence")["nominal"].alias("nominal_confidence"),
    )


def _echo_lines(asked: list[str]) -> list[str]:
    """Answers in lines with the first example's nominal; leaves the department out."""
    import re

    found = [re.search(r"  NOMINAL: (.*), DEPARTMENT: (.*), TC: (.*)$", p, re.M).groups() for p in asked]
    return [f"NOMINAL: {n}\nTC: {t}" for n, _, t in found]


@query
def plain_batch(spark, sf_dir):
    """The plain form: answers in lines; what is missing becomes the first label."""
    made = _floor_split(spark, sf_dir)
    scorer = experiments.prompt_scorer(made.test, _vec_vocab(spark, sf_dir), _echo_lines, plain=True)
    run = experiments.retrieval_experiment(made, scorer=scorer, method="plain")
    return run.predictions.select("line_id", *[f"pred_{f}" for f in REPORT_FIELDS], "failed")


@query
def error_report_extended(spark, sf_dir):
    """The long report, with confidence and reasoning."""
    return errors.error_report(_vote_predictions(spark, sf_dir)).select(
        *errors.REPORT_COLUMNS, F.get_json_object("confidence", "$.nominal").cast("double").alias("nominal_confidence"),
        "reasoning",
    )


@query
def review_routing(spark, sf_dir):
    """Votes of which one label is unsure go to review."""
    routed = review.route_for_review(_voted(spark, sf_dir))
    return routed.select("query_id", "least_confidence", "review")


@query
def review_cascade(spark, sf_dir):
    """Unsure votes get a second look with fifteen neighbours."""
    made = _floor_split(spark, sf_dir)
    index = retrieval.build_index(made.train)
    first = _voted(spark, sf_dir).withColumn("line_id", F.col("query_id").cast("string"))

    def second(keys: DataFrame) -> DataFrame:
        asked = made.test.join(keys, "line_id").select("line_id", "embedding")
        return experiments.retrieval_predictions(asked, index, 15)

    return review.cascade(first, second).select("line_id", *LABEL_COLUMNS, "stage")


@query
def corrected_index(spark, sf_dir):
    """Every seventh vector was corrected twice, the later time in one field only."""
    _, index = _queries_and_index(spark, sf_dir)
    fixes = index.where(F.col("idx") % 7 == 0)
    one = fixes.select("idx", F.lit(1).alias("corrected_at"), F.lit("NX").alias("nominal"), F.lit("DX").alias("department"), F.lit("TX").alias("tax_code"))
    two = fixes.where(F.col("idx") % 2 == 0).select("idx", F.lit(2).alias("corrected_at"), F.lit("NY").alias("nominal"), F.lit(None).cast("string").alias("department"), F.lit(None).cast("string").alias("tax_code"))
    return review.merge_corrections(index, one.unionByName(two)).select("idx", *LABEL_COLUMNS)


@query
def confidence_drift(spark, sf_dir):
    """Event values as confidences, by month."""
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), "event_id").alias("line_id"), F.col("ts"),
        F.create_map(*[x for f in LABEL_COLUMNS for x in (F.lit(f), F.pmod(F.col("event_id"), F.lit(11)) / 10.0)]).alias("confidence"),
    )
    drift = review.confidence_drift(events, "ts", "7 days")
    return drift.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query
def prediction_versions(spark, sf_dir):
    out = review.with_versions(_voted(spark, sf_dir), "vote-1", "few-shot-1")
    return out.select("query_id", "nominal", "model_version", "prompt_version")


@query
def parse_json(spark, sf_dir):
    answers = responses(spark, sf_dir).select("line_id", "response")
    return parse_json_response(answers).drop("response")


@query
def parse_lines(spark, sf_dir):
    parsed = responses(spark, sf_dir).select("line_id", parse_line_response("line_response").alias("p"))
    return parsed.select("line_id", "p.*")


@query
def fallback_labels(spark, sf_dir):
    vocabulary = labels.build_label_vocab(ap_lines(spark, sf_dir))
    answers = responses(spark, sf_dir).select("line_id", "response")
    filled = inference.fallback_labels(parse_json_response(answers), vocabulary)
    return filled.select("line_id", *LABEL_COLUMNS, "failed")


@query
def batch_infer(spark, sf_dir):
    """A Python scorer over every line; lines with an empty tax rate make it fail."""

    def score(row):
        if row["TC"] == "T0":
            raise ValueError("no rate")
        first = row["DETAIL"].split(" ")[0]
        return {
            "nominal": first, "department": row["SUPPLIER"][-1], "tax_code": row["TC"],
            "confidence": {"nominal": 0.5}, "reasoning": f"  {first}  ",
        }

    lines = ap_lines(spark, sf_dir)
    out = inference.batch_infer(lines, score, ["DETAIL", "SUPPLIER", "TC"])
    return out.select(
        "line_id", *LABEL_COLUMNS, F.col("confidence")["nominal"].alias("nominal_confidence"),
        "reasoning", "failed",
    )


@query
def batch_embed(spark, sf_dir):
    """Letter counts as a stand-in model; whole conversation turns."""

    def embed(texts):
        return [[float(t.lower().count(c)) for c in "aeiou"] for t in texts]

    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("line_id"), F.col("text").alias("model_text")
    )
    out = inference.batch_embed(turns, embed, dim=5)
    return out.select("line_id", *[F.col("embedding")[i].alias(c) for i, c in enumerate("aeiou")], "embed_error")


@query
def hashed_vectors(spark, sf_dir):
    """Non-zero members of the built-in text vectors of whole documents."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    vectors = hashed_embedding(docs, "text", dim=384)
    return vectors.select("doc_id", F.posexplode_outer("embedding").alias("pos", "value")).where("value <> 0")


@query
def novel_items(spark, sf_dir):
    """Every distinct part description as a new item against all past lines."""
    items = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("line_id"), F.col("p_name").alias("DETAIL")
    ).distinct()
    labelled = experiments.classify_novel_items(items, ap_lines(spark, sf_dir), dim=384)
    return labelled.select(
        "line_id", *LABEL_COLUMNS, *[F.col("confidence")[f].alias(f"{f}_confidence") for f in LABEL_COLUMNS],
        F.array_join(F.transform("examples", lambda e: e["idx"]), ",").alias("neighbours"),
    )


# ---- metrics and error analysis ----


@query
def field_metrics(spark, sf_dir):
    return metrics.field_metrics(predictions(spark, sf_dir))


@query
def average_f1(spark, sf_dir):
    return metrics.average_f1(metrics.field_metrics(predictions(spark, sf_dir)))


@query
def class_report(spark, sf_dir):
    return metrics.class_report(predictions(spark, sf_dir))


@query
def sample_f1(spark, sf_dir):
    return metrics.sample_wise_f1(predictions(spark, sf_dir))


@query
def error_rate(spark, sf_dir):
    return metrics.error_rate(predictions(spark, sf_dir))


@query
def metrics_with_gaps(spark, sf_dir):
    """A missing truth or prediction is an error and no class."""
    gap = F.substring(F.md5(F.col("line_id").cast("binary")), 32, 1)
    damaged = predictions(spark, sf_dir).withColumns(
        {
            "true_nominal": F.when(gap != "0", F.col("true_nominal")),
            "pred_nominal": F.when(gap != "1", F.col("pred_nominal")),
        }
    )
    return metrics.field_metrics(damaged)


@query
def confusion_topk(spark, sf_dir):
    return errors.confusion_topk(predictions(spark, sf_dir))


@query
def error_report(spark, sf_dir):
    return errors.error_report(predictions(spark, sf_dir))


@query
def error_field_shares(spark, sf_dir):
    return errors.error_field_shares(predictions(spark, sf_dir))


@query
def wrong_field_histogram(spark, sf_dir):
    return errors.wrong_field_histogram(predictions(spark, sf_dir))


@query
def supplier_errors(spark, sf_dir):
    """Counts per supplier, and the confused pairs of labels as text."""
    shown = F.transform("confusions", lambda x: F.concat_ws(":", x["field"], x["true"], x["pred"], x["n"]))
    found = errors.supplier_errors(predictions(spark, sf_dir))
    return found.withColumn("confusions", F.array_join(shown, ";"))


@query
def majority_collapse(spark, sf_dir):
    truth = [F.col(c).alias(f"true_{f}") for f, c in zip(REPORT_FIELDS, FIELDS)]
    return errors.majority_collapse(line_split(spark, sf_dir).train.select(*truth), predictions(spark, sf_dir))


# ---- comparing runs ----


def _results(spark, sf_dir) -> DataFrame:
    """Result table of three predictors, one row per run and field."""

    def make():
        runs = [
            ("majority", "majority", majority(spark, sf_dir), True),
            ("supplier", "supplier_mode", predictions(spark, sf_dir), False),
            ("retrieval", "retrieval_vote", _vote_predictions(spark, sf_dir), False),
        ]
        tables = []
        for order, (experiment, method, preds, baseline) in enumerate(runs):
            sample = metrics.sample_wise_f1(preds).select("sample_wise_f1", F.col("n").alias("test_size"))
            fields = metrics.field_metrics(preds).select("field", "f1_macro", "accuracy")
            tables.append(
                fields.withColumn("sample_wise_f1", F.lit(sample.first()[0])).select(
                    F.lit(experiment).alias("experiment"), F.lit(method).alias("method"), "field",
                    "f1_macro", "accuracy", "sample_wise_f1",
                    F.lit(None).cast("double").alias("time_seconds"),
                    F.lit(baseline).alias("is_baseline"), F.lit(order).alias("run_order"),
                )
            )
        return small_side(_stack(tables))

    return shared("results", spark, sf_dir, make)


def _stack(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


@query
def leaderboard(spark, sf_dir):
    return results.leaderboard(results.method_scores(_results(spark, sf_dir))).drop("time_seconds")


@query
def target_check(spark, sf_dir):
    scores = results.method_scores(_results(spark, sf_dir)).select("method", "f1_macro")
    return results.target_check(scores, 0.15)


@query
def improvement(spark, sf_dir):
    per_field = _results(spark, sf_dir).select("field", "method", "f1_macro")
    return results.improvement(per_field, "majority", "supplier_mode", ["field"])


@query
def best_method(spark, sf_dir):
    return results.best_method(results.method_scores(_results(spark, sf_dir))).select("method", "f1_macro")


@query
def winner_fields(spark, sf_dir):
    won = results.winner_fields(_results(spark, sf_dir))
    return won.select("experiment", "method", "field", "f1_macro", "accuracy")


@query
def union_results(spark, sf_dir):
    """Summaries that name their score differently, stacked and scored."""
    scores = results.method_scores(_results(spark, sf_dir)).select("method", "f1_macro")
    names = {"majority": "overall_f1_macro", "supplier_mode": "avg_f1_macro", "retrieval_vote": "best_f1_macro"}
    parts = [
        scores.where(F.col("method") == m).select("method", F.col("f1_macro").alias(n))
        for m, n in names.items()
    ]
    return results.union_results(parts)


# ---- models ----


def _documents(spark, sf_dir):
    def make():
        known = doc_items(spark, sf_dir).where(F.col("TC").isNotNull())
        return split.stratified_random_split(add_model_text_column(known))

    return shared("documents", spark, sf_dir, make)


@query
def tfidf_lr(spark, sf_dir):
    """TF-IDF and logistic regression on whole documents, one model per field."""
    made = _documents(spark, sf_dir)
    return _judged(experiments.tfidf_experiment(made).predictions, made.train)


@query
def predict_proba(spark, sf_dir):
    """Probabilities of all fields: one for each label, and they add up."""
    made = _documents(spark, sf_dir)
    scored = made.test
    for model in fit_text_models(made.train, FIELDS):
        scored = model.predict_proba(scored)
    rows = [
        F.struct(
            F.lit(f).alias("field"), F.size(f"{f}_proba").alias("n_labels"),
            F.aggregate(F.map_values(f"{f}_proba"), F.lit(0.0), lambda a, x: a + x).alias("total"),
        )
        for f in FIELDS
    ]
    return scored.select("line_id", F.explode(F.array(*rows)).alias("r")).select("line_id", "r.*")


@query
def embed_lr_multi(spark, sf_dir):
    made = split.Split(_as_lines(vec_split(spark, sf_dir).data), "random")
    return _judged(experiments.vector_experiment(made).predictions, made.train)


@query
def embed_rf_multi(spark, sf_dir):
    made = split.Split(_as_lines(vec_split(spark, sf_dir).data), "random")
    return _judged(experiments.vector_experiment(made, "random_forest").predictions, made.train)


@query
def integer_labels(spark, sf_dir):
    """Label codes as integers, 1, 2 and 10 among them, keep their type and are found again.

    The vectors get members that tell the label, so that a right model cannot miss it.
    """
    codes = F.element_at(F.array(*[F.lit(c) for c in (1, 2, 10, 20, 3, 11, 100, 12, 4, 30)]), F.col("label") % 10 + 1)
    vectors = table(spark, sf_dir, "embeddings").withColumns({"code": codes, "side": F.col("vec_id") % 5})
    told = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label") % 10, 5.0).otherwise(0.0))
    vectors = vectors.withColumn("embedding", F.concat(told, F.col("embedding").cast("array<double>")))
    model = MlClassifier("embeddings", ["code"], settings=LogisticSettings(max_iter=50)).fit(vectors.where("side > 0"))
    scored = model.predict(vectors.where("side = 0"))
    right = F.count_if(F.col("code") == F.col("code_pred")) >= 0.9 * F.count("*")
    return scored.groupBy("code").agg(F.count("*").alias("n"), right.alias("mostly_right"))


def _judged(predictions: DataFrame, train: DataFrame) -> DataFrame:
    """Truth beside what must hold of any model: it predicts a label it was taught, with a confidence."""
    known = {f: [r[0] for r in train.where(F.col(c).isNotNull()).select(c).distinct().collect()] for f, c in zip(REPORT_FIELDS, FIELDS)}
    taught = [F.col(f"pred_{f}").isin(known[f]).alias(f"{f}_known") for f in REPORT_FIELDS]
    sure = [
        ((F.col("confidence")[n] >= 1.0 / len(known[f]) - 1e-9) & (F.col("confidence")[n] <= 1 + 1e-9)).alias(f"{f}_sure")
        for f, n in zip(REPORT_FIELDS, LABEL_COLUMNS)
    ]
    return predictions.select("line_id", *[f"true_{f}" for f in REPORT_FIELDS], *taught, *sure)


def _as_lines(df: DataFrame) -> DataFrame:
    return df.withColumns({"DETAIL": F.col("text"), "SUPPLIER": F.lit("none")})


def _search_rows(spark, found: tuning.SearchResult, keys: list[str]) -> DataFrame:
    """Held-out rows of every fit by ``keys``; whether each score follows from its counts, and the best one is the top."""
    counts = found.counts(spark)
    by_field = metrics.field_metrics_of(counts, ["setting", "fold", "field"])
    again = by_field.groupBy("setting", "fold").agg(F.avg("f1_macro").alias("f")).groupBy("setting").agg(F.avg("f").alias("again"))
    top = max(score for _, score in found.scores)
    told = [(i, score, params != found.best_params or score == top) for i, (params, score) in enumerate(found.scores)]
    agreed = spark.createDataFrame(told, "setting int, score double, best_is_top boolean").join(again, "setting")
    agreed = agreed.select("setting", (F.abs(F.col("score") - F.col("again")) < 1e-9).alias("score_agrees"), "best_is_top")
    rows = counts.groupBy("setting", "fold", *keys).agg(F.sum("n").alias("n_held_out"), F.count_distinct("true").alias("n_labels"))
    return rows.join(agreed, "setting")


@query
def grid_search_small(spark, sf_dir):
    """A cut-down grid over whole documents: two vocabulary sizes; the rows held out, by fold and label."""
    grid = {
        "max_features": [300, 600], "ngram_range": [(1, 1)], "min_df": [2], "max_df": [0.9],
        "sublinear_tf": [False], "C": [1.0],
    }
    found = tuning.grid_search_tfidf(
        _documents(spark, sf_dir).train, "NOMINAL", grid=grid, n_folds=3
    )
    sizes = spark.createDataFrame([(i, p["max_features"], p["C"]) for i, (p, _) in enumerate(found.scores)], "setting int, max_features int, c double")
    rows = _search_rows(spark, found, ["field", "true"]).join(sizes, "setting")
    return rows.select("max_features", "c", "fold", F.col("true").alias("label"), "n_held_out", "score_agrees", "best_is_top")


@query
def random_search_small(spark, sf_dir):
    """Two settings each of both classifiers over all vectors; the rows held out, by fold and field."""
    train = vec_split(spark, sf_dir).train
    choices = {
        "logistic_regression": [LogisticSettings(C=0.01, max_iter=50), LogisticSettings(C=1.0, max_iter=50)],
        "random_forest": [ForestSettings(n_estimators=10, max_depth=4), ForestSettings(n_estimators=10, max_depth=6)],
    }
    rows = None
    for classifier, settings in choices.items():
        found = tuning.random_search_embeddings(train, FIELDS, classifier, n_folds=3, settings=settings)
        own = _search_rows(spark, found, ["field"]).withColumn("classifier", F.lit(classifier))
        rows = own if rows is None else rows.unionByName(own)
    return rows.select("classifier", F.col("setting").alias("draw"), "fold", "field", "n_held_out", "n_labels", "score_agrees", "best_is_top")


@query
def search_draws(spark, sf_dir):
    """The drawn settings of both random searches, and how many labelled vectors each would be fitted on in each fold."""
    folded = split.stratified_folds(vec_split(spark, sf_dir).train.withColumn("_all", F.lit("all")), "_all", 3)
    sizes = folded.groupBy("fold").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    rows = []
    for classifier, space in (("logistic_regression", tuning.LOGISTIC_SPACE), ("random_forest", tuning.FOREST_SPACE)):
        drawn = [vars(s) for s in tuning.draw_settings(classifier, 20)]
        inside = [all(d[k] in list(v) for k, v in space.items()) for d in drawn]
        differ = classifier == "random_forest" or len({repr(d) for d in drawn}) == len(drawn)
        rows += [(classifier, i, ok and differ) for i, ok in enumerate(inside)]
    draws = spark.createDataFrame(rows, "classifier string, draw int, in_space boolean")
    return draws.join(sizes.join(total), how="cross").select("classifier", "draw", "in_space", "fold", (F.col("total") - F.col("n")).alias("n_fitted"))


from checks import catalogue_more  # noqa: E402, F401  registers its queries here
