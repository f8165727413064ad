"""N-gram TF-IDF in two forms: long rows for SQL work, vectors for MLlib.

Weights are ``tf * (ln((1+n)/(1+df)) + 1)``, with ``1 + ln tf`` for ``tf`` when
sublinear, and unit length per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.functions.text import add_terms
from ledgerloom.scale import small_side


@dataclass(frozen=True)
class TfidfSettings:
    """Vocabulary and weighting choices."""

    max_features: int = 5000
    ngram_range: tuple[int, int] = (1, 2)
    min_df: int = 1
    max_df: float = 1.0
    sublinear_tf: bool = False


def term_frequencies(
    df: DataFrame, id_col: str, text: str, ngram_range: tuple[int, int] = (1, 2)
) -> DataFrame:
    """``(id, term, tf)``.

    The texts are placed by id once; counting and the later row norms then stay
    within partitions, so the exploded terms are never shuffled.
    """
    placed = df.select(id_col, text).repartition(F.col(id_col))
    termed = add_terms(placed, text, ngram_range)
    # A plain explode would add a filter that builds the terms a second time.
    exploded = termed.select(id_col, F.explode_outer("terms").alias("term"))
    return exploded.where(F.col("term").isNotNull()).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def term_statistics(frequencies: DataFrame) -> DataFrame:
    """``(term, df, cf)``: rows holding a term and its total count."""
    return frequencies.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def choose_vocabulary(
    statistics: DataFrame, n_rows: int | Column, settings: TfidfSettings = TfidfSettings()
) -> DataFrame:
    """``(term, df, cf, idx, idf)`` of the kept terms.

    Document-frequency limits first, then the most frequent ``max_features`` by
    total count, smaller terms first among equals; ``idx`` follows term order.
    """
    n = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    kept = (
        statistics.where(F.col("df") >= settings.min_df)
        .where(F.col("df") <= F.lit(settings.max_df) * n)
        .orderBy(F.desc("cf"), "term")
        .limit(settings.max_features)
    )
    # At most max_features rows from here on.
    position = F.row_number().over(W.partitionBy().orderBy("term")) - 1
    idf = F.log((1 + n) / (1 + F.col("df"))) + 1
    return kept.withColumns({"idx": position, "idf": idf})


def tfidf_vocabulary(
    df: DataFrame, id_col: str, text: str, settings: TfidfSettings = TfidfSettings()
) -> DataFrame:
    """The vocabulary; only sums by term are shuffled, never texts."""
    return choose_vocabulary(text_statistics(df, text, settings.ngram_range), df.count(), settings)


_ENTRY = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("weight", T.DoubleType())])


def _entries(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``(id, entries)``: the places and values of sparse vectors, which arrive as their parts; nothing is done per entry."""
    schema = T.StructType([df.schema[id_col], T.StructField("entries", T.ArrayType(_ENTRY))])
    arrow_schema = to_arrow_schema(schema)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            indices, values = (pc.struct_field(batch.column(1), name) for name in ("indices", "values"))
            entries = pa.StructArray.from_arrays([indices.flatten(), values.flatten()], ["idx", "weight"])
            offsets = np.r_[0, np.cumsum(indices.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), entries)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists.cast(arrow_schema.field("entries").type)], schema=arrow_schema)

    return df.select(id_col, vector).mapInArrow(parts, schema)


def tfidf_weights(
    df: DataFrame, id_col: str, text: str, settings: TfidfSettings = TfidfSettings()
) -> DataFrame:
    """``(id, term, idx, weight)``, one row per kept term of a row.

    A row holds its whole text, so its counts and its length come from the row
    alone: no text and no term is shuffled.
    """
    low, high = settings.ngram_range
    estimator = Tfidf(
        inputCol=text, outputCol="_weights", maxFeatures=settings.max_features, minN=low, maxN=high,
        minDF=settings.min_df, maxDF=settings.max_df, sublinear=settings.sublinear_tf,
    )
    model = estimator.fit(df.select(text))
    names = [(i, term) for i, term in enumerate(model.terms)]
    # At most max_features rows.
    terms = F.broadcast(df.sparkSession.createDataFrame(names, "idx int, term string"))
    found = _entries(model.transform(df.select(id_col, text)), id_col, "_weights").select(id_col, F.explode("entries").alias("e"))
    return found.select(id_col, "e.idx", "e.weight").join(terms, "idx").select(id_col, "term", "idx", "weight")


@F.pandas_udf(VectorUDT())
def _sublinear(counts: pd.DataFrame) -> pd.DataFrame:
    return counts.assign(values=counts["values"].map(lambda x: 1.0 + np.log(x)))


class TfidfModel(Model, HasInputCol, HasOutputCol):
    """Turns text into unit-length TF-IDF vectors; row-wise, no shuffle."""

    def __init__(self, terms: list[str], idf: list[float], settings: TfidfSettings):
        super().__init__()
        self.terms, self.idf, self.settings = terms, idf, settings

    def _transform(self, dataset: DataFrame) -> DataFrame:
        counter = CountVectorizerModel.from_vocabulary(
            self.terms, inputCol="_terms", outputCol="_counts"
        )
        scale = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_scaled"
        )
        unit = Normalizer(p=2.0, inputCol="_scaled", outputCol=self.getOutputCol())
        termed = add_terms(dataset, self.getInputCol(), self.settings.ngram_range, "_terms")
        counted = counter.transform(termed)
        if self.settings.sublinear_tf:
            counted = counted.withColumn("_counts", _sublinear("_counts"))
        return unit.transform(scale.transform(counted)).drop("_terms", "_counts", "_scaled")


class Tfidf(Estimator, HasInputCol, HasOutputCol):
    """TF-IDF estimator with corpus-count vocabulary and smooth idf."""

    maxFeatures = Param(Params._dummy(), "maxFeatures", "largest vocabulary", TypeConverters.toInt)
    minN = Param(Params._dummy(), "minN", "shortest n-gram", TypeConverters.toInt)
    maxN = Param(Params._dummy(), "maxN", "longest n-gram", TypeConverters.toInt)
    minDF = Param(Params._dummy(), "minDF", "fewest rows with a term", TypeConverters.toInt)
    maxDF = Param(Params._dummy(), "maxDF", "largest share of rows", TypeConverters.toFloat)
    sublinear = Param(Params._dummy(), "sublinear", "1 + ln tf", TypeConverters.toBoolean)

    @keyword_only
    def __init__(
        self, *, inputCol=None, outputCol=None, maxFeatures=None, minN=None, maxN=None,
        minDF=None, maxDF=None, sublinear=None,
    ):
        super().__init__()
        self._setDefault(
            inputCol="model_text", outputCol="features", maxFeatures=5000, minN=1, maxN=2,
            minDF=1, maxDF=1.0, sublinear=False,
        )
        self._set(**self._input_kwargs)

    def settings(self) -> TfidfSettings:
        value = self.getOrDefault
        return TfidfSettings(
            value(self.maxFeatures), (value(self.minN), value(self.maxN)), value(self.minDF),
            value(self.maxDF), value(self.sublinear),
        )

    def _fit(self, dataset: DataFrame) -> TfidfModel:
        settings = self.settings()
        return self.model_for(text_statistics(dataset, self.getInputCol(), settings.ngram_range),
                              dataset.count())

    def model_for(self, statistics: DataFrame, n_rows: int) -> TfidfModel:
        """Model from term statistics gathered before."""
        settings = self.settings()
        # At most max_features rows reach the driver.
        rows = choose_vocabulary(statistics, n_rows, settings).select("idx", "term", "idf").collect()
        if not rows:
            raise ValueError("no terms remain; relax min_df and max_df")
        rows.sort(key=lambda r: r["idx"])
        model = TfidfModel([r["term"] for r in rows], [r["idf"] for r in rows], settings)
        return model._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol())


def text_statistics(
    df: DataFrame, text: str, ngram_range: tuple[int, int], by: list[str] | None = None
) -> DataFrame:
    """``(term, df, cf)`` straight from a text column, optionally per group ``by``.

    A row lists its distinct terms and, only if some repeat, all its terms behind
    them, so no row key and no distinct count is needed, nothing is sorted and
    only per-term sums are shuffled.
    """
    by = by or []
    termed = add_terms(df.select(*by, text), text, ngram_range).withColumn("_once", F.array_distinct("terms"))
    repeats = F.size("_once") < F.size("terms")
    listed = F.when(repeats, F.concat("_once", "terms")).otherwise(F.col("terms"))
    listed = termed.select(*by, F.size("_once").alias("_kinds"), repeats.alias("_repeats"), listed.alias("_listed"))
    first = F.col("_at") < F.col("_kinds")
    return (
        listed.select(*by, "_kinds", "_repeats", F.posexplode_outer("_listed").alias("_at", "term"))
        .where(F.col("term").isNotNull())
        .groupBy(*by, "term")
        .agg(F.count_if(first).alias("df"), F.count_if(~first | ~F.col("_repeats")).alias("cf"))
    )
