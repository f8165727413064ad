"""Hashed text vectors and vector expressions, all on the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, Normalizer, Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import EMBEDDING_DIM
from ledgerloom.functions.text import add_terms, tokens


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def hash_bucket(term: Column, dim: int) -> Column:
    """Position of a term: the first eight hex digits of its digest, modulo ``dim``."""
    digest = F.substring(F.md5(term.cast("binary")), 1, 8)
    return F.conv(digest, 16, 10).cast("bigint") % dim


def hashed_embedding(
    df: DataFrame, text: str, dim: int = EMBEDDING_DIM, max_n: int = 2, out: str = "embedding"
) -> DataFrame:
    """Unit-length counts of hashed word n-grams, as ``ARRAY<DOUBLE>``.

    Row-wise and without a shuffle; text without tokens gives the zero vector.
    """
    buckets = F.transform("_buckets", lambda t: hash_bucket(t, dim).cast("string"))
    hashed = add_terms(df, text, (1, max_n), "_buckets").withColumn("_buckets", buckets)
    counter = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(dim)], inputCol="_buckets", outputCol="_counts"
    )
    unit = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit")
    counted = unit.transform(counter.transform(hashed))
    return counted.withColumn(out, vector_to_array("_unit")).drop("_buckets", "_counts", "_unit")


@dataclass(frozen=True)
class TrainedVectors:
    """Word vectors learned from texts; a text's vector is the mean of its words', of unit length.

    The contract is that of :func:`hashed_embedding`: fixed length, zero for a text without known words, and
    the same text always gets the same vector.
    """

    model: Word2VecModel

    @classmethod
    def fit(
        cls, texts: DataFrame, text: str, dim: int = EMBEDDING_DIM, min_count: int = 2, window: int = 5, rounds: int = 1,
        partitions: int = 1, seed: int = 42,
    ) -> TrainedVectors:
        """Learn from every distinct text.

        MLlib keeps the vocabulary on the driver; ``min_count`` keeps it small.  More ``partitions`` learn in parallel
        and are averaged in each of the ``rounds``; with one the fit is repeatable.  Those of one executor change the
        same vectors and slow each other down, so more partitions than executors do not pay.
        """
        distinct = texts.select(F.col(text).alias("_text")).where(F.col(text).isNotNull()).distinct()
        words = distinct.select(tokens("_text").alias("_words")).where(F.size("_words") > 0)
        learner = Word2Vec(
            vectorSize=dim, minCount=min_count, windowSize=window, maxIter=rounds, numPartitions=partitions, seed=seed,
            inputCol="_words", outputCol="_mean",
        )
        # In a fixed order, so that the fit does not depend on how the table was partitioned.
        return cls(learner.fit(words.orderBy("_words").coalesce(partitions)))

    def transform(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        """``df`` with the vector of ``text`` in ``out``, as ``ARRAY<DOUBLE>``; row by row, without a shuffle."""
        words = df.withColumn("_words", tokens(text))
        unit = Normalizer(p=2.0, inputCol="_mean", outputCol="_unit")
        return unit.transform(self.model.transform(words)).withColumn(out, vector_to_array("_unit")).drop("_words", "_mean", "_unit")


def similarity_text(similarity: Column | str) -> Column:
    """Similarity with two decimals, as shown in prompts."""
    value = F.col(similarity) if isinstance(similarity, str) else similarity
    return F.format_string("%.2f", value.cast("double"))
