"""The given tables in the shape the library works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import add_model_text_column


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table that comes as fewer file splits than there are cores.

    A table of many splits, as on a cluster, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines: line items with their order, customer segment, part and supplier."""
    # Orders meet their customers before the lines, which are four times as many and would be shuffled for it.
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = (
        spread(table(spark, sf_dir, "lineitem"))
        .join(orders.select("o_orderkey", "o_orderdate", "c_mktsegment"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.select(
        F.concat_ws(
            "-",
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            F.col("l_quantity").cast("bigint"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint"),
        ).alias("line_id"),
        F.col("o_orderdate").cast("date").alias("DATE"),
        F.col("l_orderkey").cast("string").alias("REF"),
        F.concat("p_name", F.lit(" & "), "p_brand").alias("DETAIL"),
        net.alias("NET"),
        F.concat(F.lit("T"), F.round(F.col("l_tax") * 100).cast("int")).alias("TC"),
        (net * F.col("l_tax")).alias("VAT"),
        F.col("s_name").alias("SUPPLIER"),
        F.col("p_type").alias("NOMINAL"),
        F.col("c_mktsegment").alias("DEPARTMENT"),
    )


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as lines: whole texts, language / quality / toxicity as labels.

    Quality and toxicity are missing where ``labels`` does not cover a document.
    """
    docs = spread(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select(
        F.col("doc_id").cast("string").alias("line_id"),
        F.col("text").alias("DETAIL"),
        F.col("source").alias("SUPPLIER"),
        F.col("lang").alias("NOMINAL"),
        F.concat(F.lit("Q"), "quality").alias("DEPARTMENT"),
        F.concat(F.lit("X"), "toxic").alias("TC"),
    )


def vec_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with labels; integer ``idx`` is both key and tie-break."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("idx"),
        F.concat(F.lit("item "), "vec_id").alias("text"),
        "embedding",
        F.concat(F.lit("N"), "label").alias("NOMINAL"),
        F.concat(F.lit("D"), F.col("label") % 4).alias("DEPARTMENT"),
        F.concat(F.lit("T"), F.col("vec_id") % 8).alias("TC"),
    )


def prepared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_model_text_column(ap_lines(spark, sf_dir))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model answer per line, as JSON and in line form; some are damaged.

    The last hex digit of the key's digest picks the damage, so about a third
    of the answers is not valid.
    """
    lines = ap_lines(spark, sf_dir).select("line_id", "NOMINAL", "DEPARTMENT", "TC")
    damage = F.substring(F.md5(F.col("line_id").cast("binary")), 32, 1)
    head = F.concat(F.lit('{"nominal": "'), "NOMINAL", F.lit('", "department": "'), "DEPARTMENT", F.lit('"'))
    conf = ', "nominal_confidence": 0.75, "department_confidence": {}, "tax_code_confidence": 0.5'
    code = F.concat(F.lit(', "tax_code": "'), "TC", F.lit('"'))
    tail = F.lit(', "reasoning": "  close to past lines "}')
    good = F.concat(head, code, F.lit(conf.format("1.0")), tail)
    as_json = (
        F.when(damage == "0", F.concat(head, F.lit(conf.format("1.0")), tail))
        .when(damage == "1", F.concat(head, code, F.lit(conf.format("1.2")), tail))
        .when(damage == "2", F.concat(F.lit("I think "), "NOMINAL"))
        .when(damage == "3", F.concat(head, code, F.lit(conf.format("1.0")), F.lit(', "reasoning": null}')))
        .when(damage == "4", F.concat(head, code, F.lit(conf.format("-0.1")), tail))
        .when(damage == "5", F.concat(head, code, F.lit(conf.format("0.25")), F.lit(', "extra": 1'), tail))
        .otherwise(good)
    )
    lined = F.concat(
        F.lit("Sure.\n  NOMINAL: "), "NOMINAL", F.lit(" \nDEPARTMENT:"), "DEPARTMENT"
    )
    as_lines = (
        F.when(damage == "0", lined)
        .when(damage == "1", F.concat(lined, F.lit("\nTC: none\nTC: "), "TC"))
        .when(damage == "2", F.lit(""))
        .otherwise(F.concat(lined, F.lit("\nTC: "), "TC"))
    )
    return lines.select("line_id", as_json.alias("response"), as_lines.alias("line_response"))
