"""Words that are common and say nothing about the labels, and texts without them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import tokens
from ledgerloom.scale import small_side

#: Share of texts that a boilerplate word is in, at least, and share of the labels' entropy that it leaves.
MIN_SHARE, MIN_ENTROPY = 0.1, 0.9


def term_label_entropy(df: DataFrame, text: str, label: str) -> DataFrame:
    """``(term, df, share, entropy, entropy_ratio)`` of every word of ``text``.

    ``entropy`` (bits) is that of the labels of the texts with the word, ``entropy_ratio`` compares it with that of
    all texts; where all texts have one label the ratio is 1.  A missing label is a label of its own.  Words
    are counted per label before they are shuffled, once.
    """
    named = df.select(F.coalesce(F.col(label).cast("string"), F.lit("")).alias("_label"), F.col(label).isNull().alias("_none"), F.array_distinct(tokens(text)).alias("_words"))
    counts = named.select("_label", "_none", F.explode("_words").alias("term")).groupBy("term", "_label", "_none").agg(F.count(F.lit(1)).alias("_n"))
    entropy = lambda n, total: F.log2(total) - F.sum(n * F.log2(n)) / total
    terms = counts.groupBy("term").agg(F.sum("_n").alias("df"), entropy(F.col("_n"), F.sum("_n")).alias("entropy"))
    labels = named.groupBy("_label", "_none").agg(F.count(F.lit(1)).alias("_n"))
    n, whole = labels.agg(F.coalesce(F.sum("_n"), F.lit(0)), entropy(F.col("_n"), F.sum("_n"))).first()
    ratio = F.col("entropy") / F.lit(whole) if whole and whole > 1e-12 else F.lit(1.0)
    return terms.select("term", "df", (F.col("df") / F.lit(max(1, n))).alias("share"), "entropy", ratio.alias("entropy_ratio"))


def boilerplate_terms(df: DataFrame, text: str, label: str, min_share: float = MIN_SHARE, min_entropy: float = MIN_ENTROPY) -> DataFrame:
    """The words in at least ``min_share`` of the texts whose labels are about as mixed as those of all texts.

    There are few: on average a text holds at most ``1 / min_share`` times fewer of them than words.
    """
    return term_label_entropy(df, text, label).where((F.col("share") >= min_share) & (F.col("entropy_ratio") >= min_entropy))


def strip_terms(df: DataFrame, text: str, terms: DataFrame, out: str = "stripped_text") -> DataFrame:
    """``df`` with the words of ``text`` (lower-cased, joined by blanks) that are not among ``terms (term)``.

    A few terms become one array that every row is filtered by, so the texts are not shuffled; a table of too
    many is refused, as boilerplate is short by its nature.
    """
    few = small_side(terms.select("term").distinct()).limit(100_001).collect()
    if len(few) > 100_000:
        raise ValueError("more than 100,000 terms are no boilerplate")
    listed = df.sparkSession.createDataFrame([(sorted(r["term"] for r in few),)], "_terms array<string>")
    row = df.crossJoin(F.broadcast(listed))  # one row
    return row.withColumn(out, F.array_join(F.filter(tokens(text), lambda w: ~F.array_contains("_terms", w)), " ")).drop("_terms")
