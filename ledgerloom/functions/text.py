"""Text expressions: normalisation, model text, tokens and n-grams.

Everything here is a Column built from JVM functions; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_text(value: Column | str) -> Column:
    """Lower-case, spell out ``&``, keep letters, digits, dash and dot, collapse space.

    Missing text becomes the empty string, so the result is never null.
    """
    text = F.replace(F.lower(F.coalesce(_col(value), F.lit(""))), F.lit("&"), F.lit(" and "))
    text = F.regexp_replace(text, r"[^a-z0-9\-\s.]", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def add_model_text_column(df: DataFrame) -> DataFrame:
    """Add ``detail_norm``, ``supplier_norm`` and the combined ``model_text``."""
    return df.withColumns(
        {"detail_norm": normalize_text("DETAIL"), "supplier_norm": normalize_text("SUPPLIER")}
    ).withColumn(
        "model_text",
        F.concat(
            F.lit("detail: "), F.col("detail_norm"), F.lit(" | supplier: "), F.col("supplier_norm")
        ),
    )


def create_novel_items(df: DataFrame) -> DataFrame:
    """Shape new, unlabelled lines: an empty supplier leaves no trace in ``model_text``.

    Needs ``DETAIL``; ``SUPPLIER``, ``NET`` and ``VAT`` are optional.  Other
    columns are kept.
    """
    defaults = {"SUPPLIER": F.lit(""), "NET": F.lit(0.0), "VAT": F.lit(0.0)}
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    detail, supplier = normalize_text("DETAIL"), normalize_text("SUPPLIER")
    suffix = F.when(supplier == "", F.lit("")).otherwise(F.concat(F.lit(" | supplier: "), supplier))
    return df.withColumn("model_text", F.concat(F.lit("detail: "), detail, suffix))


# Fixed value: a token is a maximal run of two or more word characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(value: Column | str) -> Column:
    """Lower-cased word tokens of at least two characters."""
    text = F.lower(F.coalesce(_col(value), F.lit("")))
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def ngrams(words: str, low: int = 1, high: int = 2) -> Column:
    """All word n-grams of the orders ``low`` to ``high`` of a token column.

    Shifted copies of the array are zipped, so the cost is linear in its length.
    ``words`` is a column name: a token expression would be evaluated per use.
    """
    array = F.col(words)

    def order(n: int) -> Column:
        if n == 1:
            return array
        count = F.greatest(F.size(array) - (n - 1), F.lit(0))
        shifted = [F.slice(array, at + 1, count).alias(f"w{at}") for at in range(n)]
        return F.transform(
            F.arrays_zip(*shifted), lambda t: F.concat_ws(" ", *[t[f"w{at}"] for at in range(n)])
        )

    return F.concat(*[order(n) for n in range(low, high + 1)])


def add_terms(
    df: DataFrame, text: str, ngram_range: tuple[int, int] = (1, 2), out: str = "terms"
) -> DataFrame:
    """Add the array of n-gram terms of a text column."""
    return (
        df.withColumn("_tokens", tokens(text))
        .withColumn(out, ngrams("_tokens", *ngram_range))
        .drop("_tokens")
    )


def example_excerpt(value: Column | str, length: int = 100) -> Column:
    """The first ``length`` characters, always followed by three dots."""
    return F.concat(F.substring(_col(value), 1, length), F.lit("..."))


def clean_reasoning(value: Column | str) -> Column:
    """Explanation text without surrounding space; missing becomes empty."""
    return F.regexp_replace(F.coalesce(_col(value).cast("string"), F.lit("")), r"^\s+|\s+$", "")
