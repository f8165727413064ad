"""More registered queries: the kept index, approximate search, names, monitoring, clusters, files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.adapters import ap_lines, prepared_lines, spread, table, vec_items
from checks.catalogue import FIELDS, _queries_and_index, predictions, query
from ledgerloom.config import LABEL_COLUMNS
from ledgerloom.functions.vectors import TrainedVectors
from ledgerloom.operators import approximate, asof, boilerplate, labels, metrics, monitoring, retrieval, suppliers
from ledgerloom.operators.kept_index import SemanticIndex
from ledgerloom.scale import kept, shared_root
from ledgerloom.sources import lines as files


def shared_path(spark, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- the kept index ----


@query
def index_fit(spark, sf_dir):
    """What a fitted index holds, opened anew: every row once, in the cell whose range of angles covers it."""
    path = shared_path(spark, "index")
    SemanticIndex.fit(retrieval.build_index(vec_items(spark, sf_dir)), path)
    index = SemanticIndex.open(spark, path)
    ranges = spark.createDataFrame([(c, low, high) for c, (_, _, low, high) in index.cells.items()], "cell int, low double, high double")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    rows = index.rows().join(F.broadcast(ranges), "cell")
    return rows.select("idx", "text", *LABEL_COLUMNS, length.alias("length"), F.col("angle").between(F.col("low"), F.col("high")).alias("in_range"))


@query
def knn_from_index(spark, sf_dir):
    """Fitted and opened once, asked for all queries; same rows as without an index."""
    asked, index = _queries_and_index(spark, sf_dir)
    path = shared_path(spark, "index")
    SemanticIndex.fit(index, path)
    return SemanticIndex.open(spark, path).retrieve(asked, block_rows=64)


@query
def index_upkeep(spark, sf_dir):
    """An index of part of the rows; then the others come as new lines, and every seventh row is corrected twice."""
    asked, index = _queries_and_index(spark, sf_dir)
    path = shared_path(spark, "index")
    first = SemanticIndex.fit(index.where("idx % 5 <> 3"), path)
    fixes = index.where("idx % 7 = 0")
    one = fixes.select("idx", F.lit(1).alias("corrected_at"), F.lit("NX").alias("nominal"), F.lit("DX").alias("department"), F.lit("TX").alias("tax_code"))
    none = F.lit(None).cast("string")
    two = fixes.where("idx % 2 = 0").select("idx", F.lit(2).alias("corrected_at"), F.lit("NY").alias("nominal"), none.alias("department"), none.alias("tax_code"))
    first.update(corrections=one.unionByName(two), lines=index.where("idx % 5 = 3"))
    return SemanticIndex.open(spark, path).retrieve(asked)


# ---- approximate neighbours ----


@query
def knn_approximate(spark, sf_dir):
    asked, index = _queries_and_index(spark, sf_dir)
    return approximate.approximate_knn(asked, index)


@query
def knn_approximate_recall(spark, sf_dir):
    """Share of the exact neighbours of all queries that the hash tables find."""
    asked, index = _queries_and_index(spark, sf_dir)
    found = approximate.approximate_knn(asked, index).select("query_id", "idx", F.lit(1).alias("hit"))
    exact = retrieval.knn(asked, index).select("query_id", "idx")
    both = exact.join(found, ["query_id", "idx"], "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


# ---- names ----


def written_names(spark, sf_dir):
    """Supplier names as they stand on the lines: some in capitals, some with a letter lost, doubled or swapped."""
    name, digit = F.col("s_name"), F.substring(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber").cast("binary")), 1, 1)
    part = lambda a, n: F.substring(name, a, n)
    spelled = (
        F.when(digit == "0", F.concat(part(1, 2), part(4, 100)))
        .when(digit == "1", F.concat(part(1, 2), part(2, 100)))
        .when(digit == "2", F.upper(name))
        .when(digit == "3", F.concat(part(1, 3), part(5, 1), part(4, 1), part(6, 100)))
        .otherwise(name)
    )
    rows = spread(table(spark, sf_dir, "lineitem")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(spelled.alias("SUPPLIER"))


@query
def supplier_canonical(spark, sf_dir):
    return suppliers.canonical_suppliers(written_names(spark, sf_dir))


# ---- confidences over time ----


def _event_predictions(spark, sf_dir):
    values = {"nominal": F.pmod(F.col("event_id"), F.lit(11)) / 10.0, "department": F.pmod(F.col("user_id"), F.lit(10)) / 10.0,
              "tax_code": F.least(F.col("value"), F.lit(20.0)) / 20.0}
    return table(spark, sf_dir, "events").select("ts", F.create_map(*[x for f, v in values.items() for x in (F.lit(f), v)]).alias("confidence"))


def _shown(distances):
    return distances.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query
def confidence_distance(spark, sf_dir):
    """How far each week's confidences are from those of the week before."""
    counts = monitoring.confidence_counts(_event_predictions(spark, sf_dir), "ts", "7 days")
    return _shown(monitoring.distribution_distance(counts))


@query
def confidence_stream(spark, sf_dir):
    """The same from a stream over files, whose histograms are kept in a table."""
    source, kept, state = (shared_path(spark, name) for name in ("events", "counts", "state"))
    events = _event_predictions(spark, sf_dir)
    events.repartition(4, "ts").write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    monitoring.stream_confidence_counts(stream, "ts", kept, state, "7 days", watermark="3650 days").awaitTermination()
    return _shown(monitoring.distribution_distance(monitoring.kept_counts(spark, kept)))


# ---- words and vectors ----


@query
def boilerplate_terms(spark, sf_dir):
    """Words of the lines that are common and say nothing about the nominal code."""
    return boilerplate.boilerplate_terms(prepared_lines(spark, sf_dir), "model_text", "NOMINAL", 0.05)


@query
def stripped_text(spark, sf_dir):
    lines = kept(prepared_lines(spark, sf_dir).select("line_id", "model_text", "NOMINAL"))
    terms = boilerplate.boilerplate_terms(lines, "model_text", "NOMINAL", 0.05)
    return boilerplate.strip_terms(lines, "model_text", terms).select("line_id", "stripped_text")


@query
def trained_vectors(spark, sf_dir):
    """Trained vectors of all lines and as many empty texts: their length, and whether equal texts got equal ones."""
    lines = kept(prepared_lines(spark, sf_dir).select("model_text"))
    model = TrainedVectors.fit(lines, "model_text", dim=32)
    both = lines.unionByName(lines.select(F.lit("").alias("model_text")))
    made = model.transform(both, "model_text").withColumn("_norm", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)))
    # Hashes of the vectors: numbers are summed up before the shuffle without sorting, arrays are not.
    made = made.withColumn("_hash", F.xxhash64("embedding"))
    return made.groupBy("model_text").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim"), F.max("_norm").alias("norm"), (F.min("_hash") == F.max("_hash")).alias("same")
    )


# ---- versions by date, totals ----


@query
def version_as_of(spark, sf_dir):
    """Each line with the version of its supplier's model that was valid on its date."""
    lines = ap_lines(spark, sf_dir)
    changed = lines.where((F.col("REF").cast("bigint") % 20 == 0)).select(
        "SUPPLIER", F.col("DATE").alias("valid_from"), F.concat(F.lit("v"), "REF").alias("model_version")
    )
    found = asof.as_of_join(lines.select("line_id", "SUPPLIER", "DATE"), changed, ["SUPPLIER"], "DATE", "valid_from")
    return found.select("line_id", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), "model_version")


@query
def metric_cube(spark, sf_dir):
    return metrics.metric_cube(predictions(spark, sf_dir), ["supplier", "true_department"])


# ---- files ----


@query
def csv_lines(spark, sf_dir):
    """All lines written as CSV, in another order of columns and with one more, then read by name and prepared."""
    path = shared_path(spark, "lines")
    wanted = ["TC", "extra note", "NOMINAL", "DEPARTMENT", "SUPPLIER", "VAT", "NET", "DETAIL", "REF", "DATE"]
    own = ap_lines(spark, sf_dir).withColumn("extra note", F.concat(F.lit('says "'), F.col("REF"), F.lit('", or so')))
    own.select(*[f"`{c}`" for c in wanted]).write.option("header", True).option("escape", '"').csv(path)
    lines, vocabulary = files.load_and_prepare_data(spark, path)
    sizes = [F.lit(len(vocabulary[f])).alias(f"n_{c.lower()}") for f, c in LABEL_COLUMNS.items()]
    return lines.select(
        F.date_format("DATE", "yyyy-MM-dd").alias("date"), F.col("REF").alias("ref"), F.col("DETAIL").alias("detail"), F.col("NET").alias("net"),
        F.col("NOMINAL").alias("nominal"), F.col("DEPARTMENT").alias("department"), F.col("TC").alias("tc"), F.col("extra note").alias("note"),
        "model_text", *sizes,
    )


@query
def csv_missing_columns(spark, sf_dir):
    """One file for each required column that it lacks: what the reader says of it."""
    found = []
    own = kept(ap_lines(spark, sf_dir).select(*files.REQUIRED_COLUMNS))
    path = shared_path(spark, "lacking")
    for name in files.REQUIRED_COLUMNS:
        # Every file holds all lines: compressed, and in place of the one before, which has been read.
        lacking = own.select(*[c for c in files.REQUIRED_COLUMNS if c != name])
        lacking.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
        try:
            files.load_raw_df(spark, path)
            found.append((name, ""))
        except ValueError as problem:
            found.append((name, str(problem)))
    return spark.createDataFrame(found, "column string, problem string")


@query
def error_report_files(spark, sf_dir):
    """The error report, written as CSV and read again."""
    from ledgerloom.operators import errors

    path = files.write_error_report(errors.error_report(predictions(spark, sf_dir)), shared_path(spark, "reports"), "Supplier Mode (v1.0)")
    return files.read_error_report(spark, path).withColumn("folder", F.lit(path.rsplit("/", 1)[1]))


@query
def fields_without_labels(spark, sf_dir):
    """Each field emptied in turn: coding it is an error that names it."""
    own, found = ap_lines(spark, sf_dir).select(*FIELDS), []
    for field in FIELDS:
        try:
            labels.encode_labels(own.withColumn(field, F.lit(None).cast("string")))
            found.append((field, ""))
        except ValueError as problem:
            found.append((field, str(problem)))
    return spark.createDataFrame(found, "field string, problem string")
