"""Names written in different ways, brought together under one canonical name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalize_text
from ledgerloom.operators.components import connected_components
from ledgerloom.scale import settle, small_side

MAX_DISTANCE = 2
GRAM = 2
#: A block of more names is cut into pieces that meet pairwise.
BLOCK_NAMES = 2000


def _numbered_grams(text: Column) -> Column:
    """q-grams, the n-th occurrence of one told apart from the first."""
    places = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    grams = F.when(F.length(text) >= GRAM, F.transform(places, lambda i: F.substring(text, i, GRAM)))
    again = lambda g: F.transform(
        g, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(g, 1, i + 1), lambda y: y == x)).cast("string"))
    )
    return F.coalesce(again(grams), F.array().cast("array<string>"))


def _shortened(text: Column, times: int) -> Column:
    """All strings that are left when up to ``times`` characters are taken out."""
    out = level = F.array(text)
    for _ in range(times):
        level = F.array_distinct(F.flatten(F.transform(level, lambda x: F.when(
            F.length(x) > 0,
            F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))),
        ).otherwise(F.array().cast("array<string>")))))
        out = F.array_union(out, level)
    return out


def name_links(names: DataFrame, max_distance: int = MAX_DISTANCE, block_names: int = BLOCK_NAMES) -> DataFrame:
    """``(a, b)`` with ``a < b``: distinct ``names (name)`` with the same digits whose other characters are that close.

    Exact, without comparing all pairs.  An edit spoils at most GRAM q-grams, so two close names of enough
    q-grams share one of their ``GRAM * max_distance + 1`` rarest; shorter names share a string that is left when
    up to ``max_distance`` characters are taken out of each.  Names meet by an equi-join on digits and such a
    key.  Large blocks are cut into pieces by a hash, and pieces meet pairwise, so no task holds a whole block;
    what leaves a block are links only, never its pairs.
    """
    rest = F.regexp_replace("name", "[0-9]", "")
    rows = names.select("name", F.regexp_replace("name", "[^0-9]", "").alias("digits"), rest.alias("rest"))
    prefix = GRAM * max_distance + 1
    grams = rows.select("name", "digits", F.explode(_numbered_grams(F.col("rest"))).alias("gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("_often"))
    ordered = grams.join(often, "gram").groupBy("name", "digits").agg(F.array_sort(F.collect_list(F.struct("_often", "gram"))).alias("_grams"))
    rare = ordered.select("name", "digits", F.explode(F.slice("_grams", 1, prefix).getField("gram")).alias("key"))
    shortest = GRAM * max_distance + GRAM - 1 + max_distance
    short = rows.where(F.length("rest") <= shortest).select(
        "name", "digits", F.explode(F.transform(_shortened(F.col("rest"), max_distance), lambda x: F.concat(F.lit("="), x))).alias("key")
    )
    keyed = settle(rare.unionByName(short))
    sizes = keyed.groupBy("digits", "key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    hot = small_side(sizes.where(F.col("_n") > block_names).select("digits", "key", F.ceil(F.col("_n") / block_names).cast("int").alias("_pieces")))
    cut = keyed.join(hot, ["digits", "key"], "left").withColumn("_pieces", F.coalesce("_pieces", F.lit(1)))
    own = F.pmod(F.xxhash64("name"), F.col("_pieces")).cast("int")
    left = cut.select(F.col("name").alias("a"), "digits", "key", own.alias("_at"), F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_other"))
    right = cut.select(F.col("name").alias("b"), F.col("digits").alias("_digits"), F.col("key").alias("_key"), own.alias("_b_at"),
                       F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_b_other"))
    same = (
        (F.col("digits") == F.col("_digits")) & (F.col("key") == F.col("_key"))
        & (F.col("_at") == F.col("_b_other")) & (F.col("_other") == F.col("_b_at")) & (F.col("a") < F.col("b"))
    )
    without = lambda c: F.regexp_replace(c, "[0-9]", "")
    near = F.abs(F.length("a") - F.length("b")) <= max_distance
    distance = F.levenshtein(without("a"), without("b"), max_distance)
    return left.join(right, same).where(near).where(distance >= 0).select("a", "b").distinct()


def canonical_suppliers(df: DataFrame, name: str = "SUPPLIER", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``(name, canonical, canonical_id, n, n_spellings)``: each spelling and the one that stands for it.

    Spellings are normalised (case, punctuation, blanks) first.  Those with the same digits at an edit distance of
    ``max_distance`` at most, directly or through others, are one supplier; its canonical name is the
    commonest spelling (the smaller of equal ones).  ``n`` counts the rows of a spelling.  ``canonical_id`` is a
    digest of the canonical name.  Missing and empty names are spelling ``""`` and stand for themselves.
    """
    spelled = settle(df.select(normalize_text(name).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    links = name_links(spelled.where("name <> ''").select("name"), max_distance)
    roots = connected_components(links).select(F.col("id").alias("name"), "root")
    member = spelled.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    chosen = member.groupBy("root").agg(
        F.min_by("name", F.struct((-F.col("n")).alias("_n"), "name")).alias("canonical"), F.count(F.lit(1)).alias("n_spellings")
    )
    return member.join(chosen, "root").select(
        "name", "canonical", F.md5(F.col("canonical").cast("binary")).alias("canonical_id"), "n", "n_spellings"
    )
