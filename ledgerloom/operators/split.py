"""Train/test splits and folds that depend on the data only, not on its layout.

Rows are ordered by a hash of seed and key.  A split finds, per stratum, the hash
at which the train quota is reached, and then labels every row by comparing its
own hash with that threshold: the wide table is never shuffled.
"""

from __future__ import annotations

import math
import warnings
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.config import LABEL_COLUMNS, SEED, TEST_SIZE
from ledgerloom.operators.clusters import ROUNDS, kmeans_centres, nearest_centre
from ledgerloom.scale import RANK_ROWS, hash_key, quota_thresholds, small_side


class Split(NamedTuple):
    """A table with a ``split`` column and the way it was made."""

    data: DataFrame
    level: str

    @property
    def train(self) -> DataFrame:
        return self.data.where(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.data.where(F.col("split") == "test")


def _as_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("nan"))


def _ordered_key(id_col: str, seed: int) -> Column:
    return F.concat(hash_key(id_col, seed), F.lit("|"), F.col(id_col).cast("string"))


def _quotas(strata: DataFrame, n: int, n_train: int, max_rank_rows: int = RANK_ROWS) -> DataFrame:
    """Largest-remainder share of ``n_train`` for every ``(stratum, c)`` row.

    Integer arithmetic in 38 digits: row count times quota exceeds 64 bits.  The
    cut between remainders is found like the other thresholds, so that no task
    orders all strata.
    """
    wide = f"CAST(c AS DECIMAL(19,0)) * {n_train}BD"
    shares = strata.withColumns(
        {"base": F.expr(f"({wide}) div {n}BD"), "rest": F.expr(f"({wide}) % {n}BD")}
    )
    given, kinds = shares.agg(F.coalesce(F.sum("base"), F.lit(0)), F.count("*")).first()
    # Larger remainders first, then by name: the key ascends.
    place = F.concat(F.lpad((F.lit(n) - F.col("rest")).cast("string"), 20, "0"), F.lit("|"), "stratum")
    keys = shares.select(F.lit("all").alias("stratum"), place.alias("key"))
    missing = df_of(strata, [("all", int(n_train - given))], "stratum string, quota bigint")
    last = quota_thresholds(keys, missing, kinds, max_rank_rows).first()["threshold"]
    return shares.select("stratum", (F.col("base") + (place <= F.lit(last)).cast("bigint")).alias("quota"))


def df_of(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def _threshold_split(
    df: DataFrame, strata: DataFrame, stratum: Column, n: int, n_test: int, largest: int,
    id_col: str, seed: int, max_rank_rows: int,
) -> DataFrame:
    keys = df.select(stratum.alias("stratum"), _ordered_key(id_col, seed).alias("key"))
    quotas = small_side(_quotas(strata, n, n - n_test, max_rank_rows))
    thresholds = small_side(
        quota_thresholds(keys, quotas, largest, max_rank_rows).drop("quota")
    )
    is_train = F.coalesce(F.col("_key") <= F.col("threshold"), F.lit(False))
    return (
        df.withColumns({"stratum": stratum, "_key": _ordered_key(id_col, seed)})
        .join(thresholds, "stratum", "left")
        .withColumn("split", F.when(is_train, "train").otherwise("test"))
        .drop("stratum", "_key", "threshold")
    )


def _sizes(strata: DataFrame) -> tuple[int, int, int, int]:
    """Rows, the smallest and the largest stratum's rows, and the number of strata."""
    return strata.agg(F.coalesce(F.sum("c"), F.lit(0)), F.min("c"), F.max("c"), F.count("*")).first()


def stratified_random_split(
    df: DataFrame,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    stratify_by: str = "NOMINAL",
    id_col: str = "line_id",
    max_rank_rows: int = RANK_ROWS,
) -> Split:
    """Split on all three labels together, else on one label, else at random.

    A level is feasible when every stratum has two rows and both sides have room
    for every stratum.  ``level`` tells which one was used.  ``df`` is read several
    times: a costly one is better kept first.
    """
    joined = F.concat_ws("_", *[_as_text(c) for c in LABEL_COLUMNS.values()])
    levels = [("all_fields", joined), (stratify_by, _as_text(stratify_by)), ("random", F.lit("all"))]

    def feasible(n, smallest, kinds):
        return smallest >= 2 and kinds <= n_test and kinds <= n - n_test

    for name, stratum in levels:
        # Hashes may join strata, never part them: a level they rule out is ruled out, and no names were shuffled.
        n, smallest, largest, kinds = _sizes(df.groupBy(F.xxhash64(stratum)).agg(F.count("*").alias("c")))
        n_test = math.ceil(test_size * n)
        if n_test == 0 or n_test == n:
            raise ValueError(f"cannot split {n} rows into two non-empty sides")
        if name == "random":
            strata = df_of(df, [("all", n)], "stratum string, c bigint")
        elif feasible(n, smallest, kinds):
            strata = small_side(df.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("c")))
            n, smallest, largest, kinds = _sizes(strata)
        if feasible(n, smallest, kinds) or name == "random":
            data = _threshold_split(
                df, strata, stratum, n, n_test, largest, id_col, seed, max_rank_rows
            )
            return Split(data, name)
        warnings.warn(f"stratification on {name} is not possible: some classes are too rare")
    raise AssertionError("the random level is always feasible")


def random_split(
    df: DataFrame,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    id_col: str = "line_id",
    max_rank_rows: int = RANK_ROWS,
) -> Split:
    """Plain random split of exact size."""
    n = df.count()
    n_test = math.ceil(test_size * n)
    if n_test == 0 or n_test == n:
        raise ValueError(f"cannot split {n} rows into two non-empty sides")
    everything = F.lit("all")
    strata = df_of(df, [("all", n)], "stratum string, c bigint")
    data = _threshold_split(df, strata, everything, n, n_test, n, id_col, seed, max_rank_rows)
    return Split(data, "random")


def group_split(
    df: DataFrame,
    group: str,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    max_rank_rows: int = RANK_ROWS,
) -> Split:
    """Whole groups go to one side; the share counts groups, not rows.

    Membership follows from the group's own hash, so a hot group costs nothing
    and no join with the group list is needed.  Rows without a group form one.
    """
    name = _as_text(group)
    groups = df.select(name.alias("_group")).distinct()
    n_groups = groups.count()
    n_train = math.floor((1 - test_size) * n_groups)
    if n_train == 0 or n_train == n_groups:
        raise ValueError(f"cannot split {n_groups} groups into two non-empty sides")
    keys = groups.select(F.lit("all").alias("stratum"), _ordered_key("_group", seed).alias("key"))
    quota = df_of(df, [("all", n_train)], "stratum string, quota bigint")
    threshold = quota_thresholds(keys, quota, n_groups, max_rank_rows).first()["threshold"]
    own = F.concat(hash_key(name, seed), F.lit("|"), name)
    side = F.when(own <= F.lit(threshold), "train").otherwise("test")
    return Split(df.withColumn("split", side), "group")


def semantic_holdout_split(
    df: DataFrame,
    vector: str = "embedding",
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    id_col: str = "line_id",
    rounds: int = ROUNDS,
) -> Split:
    """Hold out whole clusters of similar rows, so that the test side looks new.

    About ``max(5, sqrt(n))`` clusters by :func:`clusters.kmeans_centres`, whose sums are exact: the same split
    under any partitioning.  ``id_col`` is unique.  Rows without a vector form a cluster of their own.
    """
    centres = kmeans_centres(df, id_col, vector, rounds=rounds, seed=seed)
    return group_split(df.withColumn("cluster", nearest_centre(df.sparkSession, centres, vector)), "cluster", test_size, seed)


def stratified_folds(
    df: DataFrame,
    label: str,
    n_folds: int = 5,
    seed: int = SEED,
    id_col: str = "line_id",
    max_rank_rows: int = RANK_ROWS,
) -> DataFrame:
    """Add ``fold`` (0 .. n_folds-1): equal runs of every class in hash order.

    As with splits, the runs' limits are found first and the rows then compare
    their own hash with them, so the table itself is not shuffled.
    """
    stratum = _as_text(label)
    strata = small_side(df.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("c")))
    largest = strata.agg(F.max("c")).first()[0] or 0
    ends = F.explode(F.sequence(F.lit(1), F.lit(n_folds - 1))).alias("run")
    quotas = small_side(
        strata.select("stratum", "c", ends).select(
            "stratum",
            F.expr(f"c div {n_folds} * run + c % {n_folds} * run div {n_folds}").alias("quota"),
        )
    )
    keys = df.select(stratum.alias("stratum"), _ordered_key(id_col, seed).alias("key"))
    limits = small_side(
        quota_thresholds(keys, quotas, largest, max_rank_rows)
        .groupBy("stratum")
        .agg(F.collect_list("threshold").alias("_limits"))
    )
    passed = F.filter("_limits", lambda limit: limit < F.col("_key"))
    return (
        df.withColumns({"stratum": stratum, "_key": _ordered_key(id_col, seed)})
        .join(limits, "stratum")
        .withColumn("fold", F.size(passed))
        .drop("stratum", "_key", "_limits")
    )


def split_sizes(split: Split) -> DataFrame:
    return split.data.groupBy("split").agg(F.count("*").alias("n"))


def prepare_multilabel_data(split: Split) -> tuple[DataFrame, DataFrame]:
    """Train and test tables with a ``labels`` tuple; an empty side is an error."""
    tuples = F.struct(*[F.col(c).alias(n) for n, c in LABEL_COLUMNS.items()])
    data = split.data.withColumn("labels", tuples)
    sides = []
    for side in ("train", "test"):
        part = data.where(F.col("split") == side).drop("split")
        if part.isEmpty():
            raise ValueError(f"the {side} side is empty")
        sides.append(part)
    return sides[0], sides[1]
