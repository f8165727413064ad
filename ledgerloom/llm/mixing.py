"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.shared import cut, text_or_empty

#: What separates words; all other characters belong to words.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a key, and of each of its two leading digits.
KEY_BITS, DIGIT_BITS = 52, 9
#: A table of up to so many sources is sent to every executor; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("bigint")


def quality_weight(text_column: str = "text") -> Column:
    """A weight above 0 for a document: its mean word length against a usual range, by fixed rules."""
    text = text_or_empty(text_column)
    mean = F.length(text) / F.greatest(F.size(F.split(text, " ")), F.lit(1))
    return F.when((mean >= 4) & (mean <= 11), 1.0).otherwise(0.25)


def sampling_key(id_column: str, text_column: str, weight: Column, seed: int) -> Column:
    """Place in the sampling order, smallest first: ``1 - u ** (1 / weight)`` in 52 bits.

    It orders rows as exponential variables with the weight as rate do; ``u`` comes from a digest of
    seed, id and text, so that every run and every retry draws the same, and rows without an id differ.
    """
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")), F.lit("|"), text_or_empty(text_column))
    digits = F.substring(F.md5(F.encode(name, "utf-8")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(2.0**KEY_BITS)
    return F.floor((1 - F.pow(u, 1 / weight)) * F.lit(2.0**KEY_BITS)).cast("bigint")


def _tie_key(seed: int) -> Column:
    """Order among rows with one key, which are alike: by a hash of their place in the table."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), 64 - KEY_BITS)


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...], share: float, most: float
) -> DataFrame:
    """``(_s, source_size, target)`` from ``(_s, _source, source_size)``, one row per source.

    Sources in code point order, null last, take ``weights`` in turn.  Together they get ``share`` of
    all sizes, each at most ``most`` times its own; what exceeds that is dealt out again by weight:
    the level ``target / weight`` at which the sum is met lies between two ratios ``cap / weight``.
    """
    everything, rank = W.partitionBy(), W.orderBy(F.col("_source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sizes.withColumn("_weight", F.element_at(listed, (F.row_number().over(rank) - 1) % len(weights) + 1))
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    )
    by_ratio = W.orderBy("_ratio", F.col("_source").asc_nulls_last())
    levelled = (
        ranked.withColumn("_capped", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("_capped")) / F.col("_open"))
        # The first source, by ratio, that the level does not lift above its cap.
        .withColumn("_order", F.row_number().over(by_ratio))
        .withColumn("_fits", F.when(F.col("_level") <= F.col("_ratio"), F.struct("_order", "_level")))
        .withColumn("_level", F.min("_fits").over(everything)["_level"])
    )
    return levelled.select(
        "_s", "source_size",
        F.least("_cap", F.coalesce(F.col("_weight") * F.col("_level"), F.col("_cap"))).alias("target"),
    )


def _crossing(rows: DataFrame, digit: Column, limits: DataFrame) -> DataFrame:
    """Per source the value of ``digit`` in which the running size passes ``_rest``, and the size before it.

    ``rows`` holds ``(_s, _size, _k)``; only sums by digit are shuffled, at most ``2 ** DIGIT_BITS`` a source.
    """
    running = W.partitionBy("_s").orderBy("_digit")
    sums = rows.groupBy("_s", digit.alias("_digit")).agg(F.sum("_size").alias("_sum"))
    upto = sums.withColumn("_upto", F.sum("_sum").over(running))
    return (
        upto.join(limits, "_s")
        .where((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("_sum") <= F.col("_rest")))
        .select("_s", "_digit", (F.col("_rest") - (F.col("_upto") - F.col("_sum"))).alias("_rest"))
    )


def _ends(rows: DataFrame, limits: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(_s, _end, _rest)``: the first key that does not fit whole into a source's ``_rest``, and what is left for it.

    ``rows`` holds ``(_s, _size, _k)``.  The key is found digit by digit: sizes are summed by the keys' leading
    digits, and only rows of the one digit pair in which the budget ends are ordered.
    """
    low = KEY_BITS - DIGIT_BITS
    first = cut(_crossing(rows, F.shiftright("_k", low), near(limits)))
    rows = rows.join(near(first.select("_s", F.col("_digit").alias("_d1"))), "_s").where(F.shiftright("_k", low) == F.col("_d1"))
    lower = low - DIGIT_BITS
    second = cut(_crossing(rows, F.shiftright("_k", lower), near(first.select("_s", "_rest"))))
    rows = rows.join(near(second.select("_s", F.col("_digit").alias("_d2"), "_rest")), "_s").where(F.shiftright("_k", lower) == F.col("_d2"))
    running = W.partitionBy("_s").orderBy("_k")
    return (
        rows.groupBy("_s", "_k", "_rest").agg(F.sum("_size").alias("_sum"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_sum").over(running))
        .where((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("_sum") <= F.col("_rest")))
        .select("_s", F.col("_k").alias("_end"), (F.col("_rest") - F.col("_upto") + F.col("_sum")).alias("_rest"), "_sum", "_n")
    )


def mixing_plan(
    df: DataFrame,
    size: Column,
    weight: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 11,
) -> DataFrame:
    """One row per source: ``(_s, source_size, target, epochs, last_key, last_tie)``.

    ``epochs`` complete passes precede a fraction: of the last pass, rows with a key below ``last_key`` are
    taken, and of those with that key the ones up to ``last_tie`` (null: none).  A row that passes the budget
    still goes in if that brings the sum nearer to it.  Rows with one key are copies of each other; as many
    of them are taken as fit best, found by a second key in the same way.
    """
    marker = _marker(source_column)
    narrow = cut(
        df.select(
            marker.alias("_s"), F.col(f"`{source_column}`").alias("_source"), size.alias("_size"),
            sampling_key(id_column, text_column, weight, seed).alias("_k"), _tie_key(seed).alias("_t"),
        )
    )
    sizes = narrow.groupBy("_s").agg(F.first("_source").alias("_source"), F.sum("_size").alias("source_size"))
    targets = cut(source_targets(sizes, weights, share, most))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = targets.withColumn("epochs", epochs)
    limits = targets.select("_s", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("_rest"))
    small = targets.count() <= BROADCAST_SOURCES
    near = F.broadcast if small else (lambda t: t)
    ends = cut(_ends(narrow.select("_s", "_size", "_k"), limits, near))
    # Of the rows with the last key, so many that the sum is nearest to the budget (the fewer of equal ones).
    wanted = F.greatest(F.lit(0), F.ceil(F.col("_rest") * F.col("_n") / F.col("_sum") - 0.5)).cast("bigint")
    ends = ends.select("_s", F.col("_end").alias("last_key"), "_n", wanted.alias("_wanted"))
    whole = F.when(F.col("_wanted") >= F.col("_n"), F.lit((1 << KEY_BITS) - 1)).when(F.col("_wanted") == 0, F.lit(-1))
    ends = cut(ends.withColumn("last_tie", whole.cast("bigint")))
    parted = ends.where("last_tie IS NULL").select("_s", "last_key", (F.col("_wanted") + F.lit(0.0)).alias("_rest"))
    if not parted.isEmpty():
        copies = narrow.join(near(parted.select("_s", "last_key")), "_s").where(F.col("_k") == F.col("last_key"))
        copies = copies.select("_s", F.lit(1).cast("bigint").alias("_size"), F.col("_t").alias("_k"))
        ties = _ends(copies, parted.select("_s", "_rest"), near).select("_s", (F.col("_end") - 1).alias("_tie"))
        ends = ends.join(ties, "_s", "left").withColumn("last_tie", F.coalesce("last_tie", "_tie"))
    return targets.join(ends.select("_s", "last_key", "last_tie"), "_s", "left")


def _marker(source_column: str) -> Column:
    """The source as a key that is never null."""
    name = F.col(f"`{source_column}`").cast("string")
    return F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), name))


def _drawn(
    df: DataFrame, size: Column | None, weight: Column | None, id_column: str, text_column: str, source_column: str,
    weights: tuple[float, ...], share: float, most: float, seed: int,
) -> DataFrame:
    """``(_row, size, source_size, target, repeats)``; the row of ``df`` is packed, whatever its columns are called."""
    size = word_count(text_or_empty(text_column)) if size is None else size
    weight = quality_weight(text_column) if weight is None else weight
    plan = cut(mixing_plan(df, size, weight, id_column, text_column, source_column, weights, share, most, seed))
    near = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    keyed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), _marker(source_column).alias("_s"), size.alias("size"),
        sampling_key(id_column, text_column, weight, seed).alias("_k"), _tie_key(seed).alias("_t"),
    )
    taken = (F.col("_k") < F.col("last_key")) | ((F.col("_k") == F.col("last_key")) & (F.col("_t") <= F.col("last_tie")))
    # Without a last key the epochs fill the budget.
    drawn = F.coalesce(taken, F.lit(False)).cast("int")
    return keyed.join(near, "_s").select("_row", "size", "source_size", "target", (F.col("epochs") + drawn).alias("repeats"))


def mixed(
    df: DataFrame,
    size: Column | None = None,
    weight: Column | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 11,
) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target`` and ``repeats`` (how often the mix takes the row).

    ``size`` defaults to the words of the text, ``weight`` (above 0) to :func:`quality_weight`: of two
    documents, the one with twice the weight is twice as likely to be drawn first.  A null text has
    size 0; a null source is a source of its own and the last one; a null id counts as an empty one, and rows
    that agree in id and text are drawn one by one.  Texts without words have size 0 and are taken once per
    epoch or once more.  Columns of ``df`` with the names of result columns are replaced, all others are kept.  An
    empty table gives an empty result.  Reruns agree (among rows that agree in id and text, in how many are taken).
    """
    results = ("size", "source_size", "target", "repeats")
    rows = _drawn(df, size, weight, id_column, text_column, source_column, weights, share, most, seed)
    kept = [F.col("_row").getField(c).alias(c) for c in df.columns if c.lower() not in results]
    return rows.select(*kept, *results)


def mix(
    df: DataFrame,
    size: Column | None = None,
    weight: Column | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 11,
) -> DataFrame:
    """The mixed corpus itself: rows of ``df`` as often as the mix takes them, with the columns of ``df``."""
    rows = _drawn(df, size, weight, id_column, text_column, source_column, weights, share, most, seed)
    copies = rows.where(F.col("repeats") > 0).select("_row", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("_copy"))
    return copies.select([F.col("_row").getField(c).alias(c) for c in df.columns])
