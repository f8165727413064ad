"""Cases that once lost rows, swapped labels or depended on how a table was cut."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import add_model_text_column
from ledgerloom.functions.vectors import hashed_embedding
from ledgerloom.operators import errors, inference, prompts, retrieval, review, split, tfidf
from ledgerloom.operators.vote import vote
from ledgerloom.plans import experiments
from ledgerloom.plans.models import ForestSettings, LogisticSettings, MlClassifier
from ledgerloom.sources.lines import with_line_id, write_error_report

LINES = "line_id string, DETAIL string, SUPPLIER string, NOMINAL string, DEPARTMENT string, TC string, NET double, VAT double"


def lines(spark, n=40):
    rows = [(f"l{i:02d}", f"{'paper' if i % 2 else 'fuel'} item{i:02d}", "s", f"N{i % 2}", f"D{i % 2}", "T", i * 1.5, 0.0) for i in range(n)]
    return add_model_text_column(spark.createDataFrame(rows, LINES))


@pytest.mark.parametrize("settings", [LogisticSettings(max_iter=50), ForestSettings(n_estimators=5)])
def test_integer_labels_keep_their_order_and_type(spark, settings):
    rows = [([float(c == 1), float(c == 2), float(c == 10)], c) for c in (1, 2, 10) for _ in range(20)]
    df = spark.createDataFrame(rows, "embedding array<double>, code int")
    kind = "random_forest" if isinstance(settings, ForestSettings) else "logistic_regression"
    model = MlClassifier("embeddings", ["code"], kind, settings).fit(df)
    got = model.predict(df)
    assert dict(got.dtypes)["code_pred"] == "int"
    assert got.where("code <> code_pred").count() == 0
    assert set(model.predict_proba(df).first()["code_proba"]) == {1, 2, 10}


def test_solver_that_stops_early_says_so(spark):
    df = spark.createDataFrame([([float(i % 7), float(i % 5)], str(i % 3)) for i in range(60)], "embedding array<double>, y string")
    with pytest.warns(UserWarning, match="no convergence"):
        model = MlClassifier("embeddings", ["y"], settings=LogisticSettings(max_iter=1, tol=1e-12)).fit(df)
    assert not model.fitted[0].converged and model.fitted[0].iterations == 1


def test_lines_without_neighbours_count_as_failed(spark):
    made = split.random_split(hashed_embedding(lines(spark), "model_text", 64))
    run = experiments.retrieval_experiment(made, min_similarity=1.1)
    assert run.scores["test_size"] == made.test.count() == run.predictions.where("failed").count()
    assert run.predictions.where("pred_nominal = ''").count() == made.test.count()
    first = inference.with_truth(
        vote(retrieval.nested_examples(retrieval.retrieve(made.test, retrieval.build_index(made.train, "line_id", "model_text"), 1, "line_id", min_similarity=1.1), "line_id")),
        made.test, first_labels={"nominal": "N0"},
    )
    assert {r.pred_nominal for r in first.collect()} == {"N0"}


def test_new_items_without_neighbours_stay(spark):
    items = spark.createDataFrame([("a", "paper item01"), ("b", "")], "line_id string, DETAIL string")
    got = {r.line_id: r for r in experiments.classify_novel_items(items, lines(spark), dim=64, min_similarity=0.9).collect()}
    assert set(got) == {"a", "b"}
    every = experiments.classify_novel_items(items, lines(spark), dim=64, min_similarity=1.1).collect()
    assert len(every) == 2 and all(r.failed and r.nominal == "" for r in every)


def test_repeated_texts_give_the_same_neighbours(spark):
    past = lines(spark, 6)
    past = past.unionByName(past.withColumn("line_id", F.concat(F.lit("z"), "line_id"))).unionByName(past.withColumn("line_id", F.concat(F.lit("y"), "line_id")))
    items = spark.createDataFrame([("a", "paper item01")], "line_id string, DETAIL string")
    got = experiments.classify_novel_items(items, past, k=2, dim=64).first()
    assert [e.idx for e in got.examples] == ["l01", "yl01"]


def test_line_ids_differ_where_only_an_extra_column_does(spark):
    columns = "DATE string, REF string, DETAIL string, NET double, TC string, VAT double, SUPPLIER string, NOMINAL string, DEPARTMENT string, extra int"
    row = ("d", "r", "x", 1.0, "T", 0.0, "s", "n", "d")
    df = spark.createDataFrame([(*row, 1), (*row, 2), (*row, 2)], columns)
    ids = [r.line_id for r in with_line_id(df).collect()]
    assert len(set(ids)) == 3


@pytest.mark.parametrize("method", ["broadcast", "blocks"])
def test_empty_queries_and_empty_index(spark, method):
    full = spark.createDataFrame([(1, "t", "a", "b", "c", [1.0, 0.0])], "idx int, text string, nominal string, department string, tax_code string, embedding array<double>")
    asked = full.select(F.col("idx").alias("query_id"), "embedding")
    assert retrieval.retrieve(asked.limit(0), full, method=method).collect() == []
    assert retrieval.retrieve(asked, full.limit(0), method=method).collect() == []


def test_rows_without_a_group_are_a_group(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 10).alias("g"))
    made = split.group_split(df, "g").data
    assert made.where("split = 'train'").select("g").distinct().count() == 8
    assert made.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_cell_split_does_not_depend_on_partitions(spark):
    df = spark.range(300).select("id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.sin((F.col("id") + 1) * (i + 1.5))).alias("embedding"))
    one, two = (sorted(split.semantic_holdout_split(df.repartition(n), id_col="id").data.select("id", "cluster", "split").collect()) for n in (1, 7))
    assert one == two and {r.split for r in one} == {"train", "test"}


def test_quotas_of_many_strata_in_pieces(spark):
    df = spark.range(600).select(F.col("id").cast("string").alias("line_id"), (F.col("id") % 150).cast("string").alias("NOMINAL"), F.lit("d").alias("DEPARTMENT"), F.lit("t").alias("TC"))
    split_of = lambda rows: sorted(map(tuple, split.stratified_random_split(df, 0.3, max_rank_rows=rows).data.select("line_id", "split").collect()))
    assert split_of(10) == split_of(10**6)
    assert sum(s == "test" for _, s in split_of(10)) == 180


def test_field_without_errors_stays_in_the_collapse_table(spark):
    names = "line_id string, true_nominal string, pred_nominal string, true_department string, pred_department string, true_tc string, pred_tc string"
    df = spark.createDataFrame([("1", "a", "a", "b", "c", "t", "t"), ("2", "a", "a", "b", "b", "t", "t")], names)
    got = {r.field: r for r in errors.majority_collapse(df, df).collect()}
    assert set(got) == {"nominal", "department", "tc"}
    assert (got["nominal"].n_errors, got["nominal"].share_to_majority, got["department"].n_errors) == (0, 0.0, 1)


def test_amounts_in_prompts_are_plain_decimals(spark):
    row = spark.createDataFrame([("d", "s", 12345678.9, 0.0005)], "DETAIL string, SUPPLIER string, NET double, VAT double")
    nested = row.withColumn("examples", F.array().cast("array<struct<rank:int,idx:int,text:string,nominal:string,department:string,tax_code:string,distance:double,similarity:double>>"))
    text = prompts.chat_prompt(nested, {"nominal": ["a"], "department": ["b"], "tax_code": ["c"]}).first()["user_prompt"]
    assert "NET: 12345678.9\n" in text and "VAT: 0.0005\n" in text


def test_batch_scorer_falls_back_to_single_rows(spark):
    def batch(rows):
        if any(r["DETAIL"] == "bad" for r in rows):
            raise ValueError("bad row")
        return [{"nominal": r["DETAIL"], "department": "d", "tax_code": str(len(rows))} for r in rows]

    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(["a", "b", "bad", "c"])], "line_id string, DETAIL string").coalesce(1)
    got = {r.line_id: r for r in inference.batch_infer(df, None, ["DETAIL"], predict_batch=batch, batch_size=2).collect()}
    assert (got["0"].nominal, got["0"].tax_code, got["3"].tax_code) == ("a", "2", "1")
    assert got["2"].failed and got["2"].error == "ValueError: bad row" and got["0"].error is None


def test_no_text_is_shuffled_for_weights(spark):
    df = lines(spark)
    for made in (tfidf.tfidf_weights(df, "line_id", "model_text"), tfidf.tfidf_vocabulary(df, "line_id", "model_text")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        exchanges = [x for x in plan.splitlines() if "Exchange" in x and "BroadcastExchange" not in x]
        assert not any("model_text" in x for x in exchanges)
    logs = tfidf.tfidf_weights(df, "line_id", "model_text", tfidf.TfidfSettings(sublinear_tf=True))
    assert logs.groupBy("line_id").agg(F.sum(F.col("weight") ** 2).alias("n")).where("abs(n - 1) > 1e-9").count() == 0


def test_one_file_or_many_as_asked(spark, tmp_path):
    df = spark.range(10).repartition(4)
    one = write_error_report(df, str(tmp_path), "one")
    many = write_error_report(df, str(tmp_path), "many", single_file=False)
    count = lambda p: len(list(__import__("pathlib").Path(p).glob("part-*")))
    assert count(one) == 1 and count(many) > 1


def test_tenants_never_see_each_other(spark):
    df = spark.range(60).select(F.col("id").alias("idx"), (F.col("id") % 3).alias("tenant"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    got = retrieval.knn_by_tenant(df.withColumnRenamed("idx", "query_id"), df, 4, block_rows=8).collect()
    assert len(got) == 240 and all(r.query_id % 3 == r.idx % 3 for r in got)


def test_cascade_and_corrections(spark):
    conf = lambda x: F.create_map(*[v for f in ("nominal", "department", "tax_code") for v in (F.lit(f), F.lit(x))])
    base = spark.range(4).select(F.col("id").cast("string").alias("line_id"), *[F.lit("a").alias(f) for f in ("nominal", "department", "tax_code")])
    first = base.withColumn("confidence", F.when(F.col("line_id") == "0", conf(0.9)).otherwise(conf(0.1)))
    seen = []

    def second(keys):
        seen.append(keys.count())
        return base.where("line_id in ('1', '2')").withColumn("nominal", F.lit("b")).withColumn("confidence", F.when(F.col("line_id") == "1", conf(0.8)).otherwise(conf(0.2)))

    got = {r.line_id: (r.nominal, r.stage) for r in review.cascade(first, second).collect()}
    assert seen == [3] and got == {"0": ("a", "first"), "1": ("b", "second"), "2": ("b", "review"), "3": ("a", "review")}
