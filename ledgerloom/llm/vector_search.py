"""Exact top-k inner-product search by columnar branch-and-bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Candidates and queries that meet in one task.
BLOCK_ROWS, SHEET_ROWS = 16384, 4096
#: Of the candidates, one in so many is searched first, for a bound on every query's k-th score.
PILOT = 16
#: Dimensions that are accumulated between two prunings, and queries of one dense tile.
STEP, TILE = 16, 256
#: Share of surviving pairs below which they are followed one by one.
SPARSE = 0.04


def integer_codes(column: str, scale: float = 64.0) -> Column:
    """``floor(scale * x)`` of every component; null if the vector has a null or non-finite one."""
    value = F.col(f"`{column}`").cast("array<double>")
    good = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(good, F.transform(value, lambda x: F.floor(x * scale).cast("bigint")))


def _stacked(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """One row per vector; missing trailing components count as 0."""
    out = np.zeros((len(vectors), width))
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return out


def _rest_norms(matrix: np.ndarray, steps: list[slice]) -> np.ndarray:
    """Length of what is left of each row after each step: its remaining mass."""
    mass = np.stack([(matrix[:, s] ** 2).sum(axis=1) for s in steps])
    return np.sqrt(np.maximum(mass.sum(axis=0) - np.cumsum(mass, axis=0), 0))


def best_of_block(
    queries: np.ndarray, floors: np.ndarray, names: np.ndarray,
    columns: np.ndarray, ids: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query number, candidate number, score)``: each query's k best candidates of one block.

    ``columns`` holds the candidates by dimension (vertical layout), largest mass first.  Scores grow
    step by step; a pair goes on only while its score so far plus the largest product that its
    remaining masses allow reaches the query's floor.
    """
    steps = [slice(a, a + STEP) for a in range(0, columns.shape[0], STEP)]
    left, right = _rest_norms(queries, steps), _rest_norms(columns.T, steps)
    found = []
    for start in range(0, len(queries), TILE):
        tile = slice(start, start + TILE)
        floor = floors[tile]
        alive = np.arange(columns.shape[1])
        own = names[tile][:, None] == ids[None, :]
        score = np.where(own, -np.inf, 0.0)
        pairs = None
        for n, step in enumerate(steps):
            if pairs is None:
                score += queries[tile, step] @ columns[step][:, alive]
                mask = score + left[n, tile][:, None] * right[n, alive][None, :] * (1 + 1e-9) >= floor[:, None] - 0.5
                mask &= np.isfinite(score)
                if mask.mean() < SPARSE or n + 1 == len(steps):
                    q, c = np.nonzero(mask)
                    pairs, score = (q, alive[c]), score[mask]
                else:
                    some = mask.any(axis=0)
                    if some.mean() < 0.75:
                        alive, score = alive[some], score[:, some]
            else:
                q, c = pairs
                score = score + np.einsum("ij,ji->i", queries[tile][q, step], columns[step][:, c])
                good = score + left[n, tile][q] * right[n, c] * (1 + 1e-9) >= floor[q] - 0.5
                pairs, score = (q[good], c[good]), score[good]
        if pairs is None:
            q, c = np.nonzero(np.isfinite(score))
            pairs, score = (q, c), score[q, c]
        q, c = pairs
        order = np.lexsort((ids[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        first = np.searchsorted(q, np.arange(len(floor)))
        good = np.arange(len(q)) - first[q] < k
        found.append((q[good] + start, c[good], score[good]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _searcher(k: int) -> Callable[..., Iterator[pd.DataFrame]]:
    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or block.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        width = max(max(map(len, queries["_asked"])), max(map(len, block["_codes"])))
        left, right = _stacked(list(queries["_asked"]), width), _stacked(list(block["_codes"]), width)
        largest = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(width, 1)
        if largest >= 2**53:  # not exact in double precision
            return _whole_number_search(queries, block, width, k)
        order = np.argsort(-(right**2).sum(axis=0), kind="stable")
        ids, names = block["_id"].to_numpy(), queries["_name"].to_numpy()
        q, c, score = best_of_block(
            left[:, order], queries["_floor"].fillna(-np.inf).to_numpy(dtype=float), names,
            np.ascontiguousarray(right[:, order].T), ids, k,
        )
        return pd.DataFrame({"query_id": names[q], "vec_id": ids[c], "score": score.astype("int64")})

    return search


def _whole_number_search(queries: pd.DataFrame, block: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    """The same for products that doubles cannot hold: 64-bit integers, every pair in full, no floors.

    Beyond 63 bits a score cannot be told; that is an error.
    """
    most = [max((abs(int(x)) for v in side for x in v), default=0) for side in (queries["_asked"], block["_codes"])]
    if most[0] * most[1] * width >= 2**63:
        raise ValueError("inner products beyond 63 bits")
    stacked = [np.zeros((len(side), width), dtype=np.int64) for side in (queries, block)]
    for out, side in zip(stacked, (queries["_asked"], block["_codes"]), strict=True):
        for row, vector in zip(out, side, strict=True):
            row[: len(vector)] = vector
    ids, found = block["_id"].to_numpy(), []
    for name, row in zip(queries["_name"], stacked[0], strict=True):
        there = np.flatnonzero(ids != name)
        score = stacked[1][there] @ row
        best = np.lexsort((ids[there], -score))[:k]
        found.append(pd.DataFrame({"query_id": name, "vec_id": ids[there][best], "score": score[best]}))
    return pd.concat(found).astype("int64")


def _best(queries: DataFrame, candidates: DataFrame, rows: int, asked: int, k: int) -> DataFrame:
    """Top k of ``candidates (_id, _codes, _place)`` for ``queries (_name, _asked, _place, _floor)``, block by block.

    Rows are dealt to blocks by their place in the table, as many rows may have one id.
    """
    blocks, sheets = max(1, -(-rows // BLOCK_ROWS)), max(1, -(-asked // SHEET_ROWS))
    own = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_at_sheet", own("_place", sheets)).drop("_place").withColumn("_at_block", every(blocks))
    right = candidates.withColumn("_block", own("_place", blocks)).drop("_place").withColumn("_sheet", every(sheets))
    found = (
        left.groupBy("_at_block", "_at_sheet")
        .cogroup(right.groupBy("_block", "_sheet"))
        .applyInPandas(_searcher(k), "query_id long, vec_id long, score long")
    )
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def exact_topk(
    df: DataFrame,
    every: int = 20,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: float = 64.0,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query row's ``k`` largest integer inner products.

    Vectors become integers, ``floor(scale * x)``.  Rows with a null id, a null vector or a null or
    non-finite component take no part; vectors of unequal length count as if filled up with zeros.
    Rows that repeat an id all count: as candidates each for itself, as queries together (the best of any of
    them), and none is a neighbour of its own id.  Ties go to the smaller id; fewer candidates than ``k``
    give fewer rows, an empty table none.  Other columns are ignored.  Queries are the rows whose id
    is divisible by ``every``.  Products beyond 2**53 are added up as integers; those beyond 2**63 raise an error.

    A sixteenth of the candidates is searched first: a query's k-th score there is a floor that prunes
    the whole search, and only what reaches it leaves a task.  Every query still meets every row.
    """
    vectors = (
        df.select(
            F.col(f"`{id_column}`").cast("bigint").alias("_id"), integer_codes(vector_column, scale).alias("_codes"),
            F.monotonically_increasing_id().alias("_place"),
        )
        .where(F.col("_id").isNotNull() & F.col("_codes").isNotNull())
    )
    is_query = F.col("_id") % every == 0
    asked = vectors.where(is_query).select(F.col("_id").alias("_name"), F.col("_codes").alias("_asked"), "_place")
    rows, n_asked = vectors.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    pilot = vectors.where(F.pmod(F.xxhash64(F.lit(3), F.col("_place")), F.lit(PILOT)) == 0)
    start = asked.withColumn("_floor", F.lit(None).cast("double"))
    floors = (
        _best(start, pilot, -(-rows // PILOT), n_asked, k)
        .where(F.col("rank") == k)
        .select(F.col("query_id").alias("_name"), F.col("score").cast("double").alias("_floor"))
    )
    found = _best(asked.join(floors, "_name", "left"), vectors, rows, n_asked, k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
