"""Exact cosine nearest neighbours between two tables of vectors.

``index`` has ``idx`` (key and tie-break), ``embedding`` and the payload
``text, nominal, department, tax_code``; ``queries`` has a key column and
``embedding``.  Distances are ``1 - cosine``, compared after rounding to nine
places so that the order does not depend on how the work was cut; ties go to the
smaller ``idx``.  A zero vector is at distance 1 from everything.

Three physical plans give the same rows:

* few queries (size checked): the query matrix is broadcast and every task scans
  its part of the index once, keeping ``k`` rows per query.  The index is not
  shuffled.
* many queries, short index (size checked): the index matrix is broadcast and
  every task finds the whole answers of its queries, so no candidates are shuffled.
* many queries: index rows are grouped around pivots, and a query visits only
  those cells that the triangle inequality cannot rule out.  A large cell is cut
  into packs of bounded size, small neighbouring cells share one.  Packs of index
  rows meet sheets of queries by an equi-join on pack numbers.

``idx`` is unique, and so is the query key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import ceil, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.config import LABEL_COLUMNS, TOP_K
from ledgerloom.scale import BROADCAST_ROWS, settle, small_side

PAYLOAD = ("text", *LABEL_COLUMNS)
BROADCAST_QUERY_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 8192
#: Rows of the index, and queries, that one comparison of blocks takes: what a smaller ``block_rows`` cuts is put together again.
PACK_ROWS = BLOCK_ROWS
TILE = 4_000_000
TILE_QUERIES = 1024
DIGITS = 9


def build_index(df: DataFrame, idx: str = "idx", text: str = "text") -> DataFrame:
    """The index table: key, text, label columns under their short names, vector."""
    labels = [F.col(c).alias(n) for n, c in LABEL_COLUMNS.items()]
    return df.select(F.col(idx).alias("idx"), F.col(text).alias("text"), *labels, "embedding")


# ---- helpers that run inside tasks, on Arrow batches ----


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows of a list column; zero vectors stay zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    if column.null_count:
        raise ValueError("null vector; use zero vectors for empty texts")
    flat = column.flatten()
    if flat.null_count or len(flat) % len(column):
        raise ValueError("vectors must have the same length and no null members")
    rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    lengths = np.unique(np.asarray(column.value_lengths()))
    if len(lengths) > 1:
        raise ValueError("vectors must have the same length")
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _nearest(distance: np.ndarray, k: int) -> np.ndarray:
    """Marks the ``k`` smallest members of every row; of equal ones, those further left."""
    cut = np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
    less, equal = distance < cut, distance == cut
    wanted = k - less.sum(axis=1, keepdims=True)
    return less | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= wanted))


def _nearest_rows(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the query, number of the row and distance: the ``k`` nearest rows, the earlier of equals, nearest first."""
    k = min(k, len(rows))
    best, place = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1)
    step = max(1, TILE // max(1, len(queries)))
    for start in range(0, len(rows), step):
        distance = np.round(1.0 - queries @ rows[start : start + step].T, DIGITS)
        near = distance < best[:, -1:]  # an equal distance would lose to the earlier row
        crowded = np.flatnonzero(near.sum(axis=1) > k)
        if len(crowded):
            near[crowded] = _nearest(distance[crowded], k)
        hit = np.flatnonzero(near.any(axis=1))
        if len(hit) == 0:
            continue
        q, at = np.nonzero(near[hit])
        counts = np.bincount(q)
        slot = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
        new, where = np.full((len(hit), counts.max()), np.inf), np.full((len(hit), counts.max()), -1)
        new[q, slot], where[q, slot] = distance[hit[q], at], start + at
        both, places = np.hstack([best[hit], new]), np.hstack([place[hit], where])
        order = np.argsort(both, axis=1, kind="stable")[:, :k]
        best[hit], place[hit] = np.take_along_axis(both, order, axis=1), np.take_along_axis(places, order, axis=1)
    q, rank = np.nonzero(place >= 0)
    return q, place[q, rank], best[q, rank]


def _best(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best rows for every query, as ``q, idx, distance`` in order of rank; works in tiles."""
    order = np.argsort(ids, kind="stable")  # so that the earlier of equals has the smaller key
    rows, ids = rows[order], ids[order]
    parts = []
    for start in range(0, len(queries), TILE_QUERIES):
        q, at, distance = _nearest_rows(queries[start : start + TILE_QUERIES], rows, k)
        parts.append((q + start, ids[at], distance))
    q, idx, distance = (np.concatenate(p) for p in zip(*parts)) if parts else (np.empty(0, int), ids[:0], np.empty(0))
    return pd.DataFrame({"q": q, "idx": idx, "distance": distance})


def _vectors(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


# ---- plan 1: broadcast queries ----


def _candidate_schema(queries: DataFrame, query_id: str, index: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema[query_id].dataType),
            T.StructField("idx", index.schema["idx"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _scan_with_queries(
    index: DataFrame, query_ids: pa.Array, query_matrix: np.ndarray, k: int, schema: T.StructType
) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast((query_ids, query_matrix))
    arrow_schema = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        best = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            part = _best(matrix, _matrix(batch.column("embedding")), _ids(batch.column("idx")), k)
            if best is not None:
                part = pd.concat([best, part]).sort_values(["q", "distance", "idx"])
                part = part.groupby("q", sort=False).head(k)
            best = part
        if best is not None and len(best):
            yield pa.RecordBatch.from_arrays(
                [
                    names.take(pa.array(best["q"].to_numpy())),
                    pa.array(best["idx"].to_numpy(), type=arrow_schema.field("idx").type),
                    pa.array(best["distance"].to_numpy()),
                ],
                schema=arrow_schema,
            )

    return index.select("idx", "embedding").mapInArrow(scan, schema)


# ---- plan 2: broadcast index ----


def _dealt(df: DataFrame) -> DataFrame:
    """Vectors over as many tasks as their comparisons ask for, however few files or row groups they came in."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, ceil(df.count() / PACK_ROWS))
    return df.repartition(tasks)


def _scan_with_index(queries: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, schema: T.StructType) -> DataFrame:
    """The answers of every query with their rank; the query key is unique."""
    shared = queries.sparkSession.sparkContext.broadcast((ids, matrix))
    schema = T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())])
    arrow_schema = to_arrow_schema(schema)
    width = max(1, min(k, len(ids)))
    step = max(1, min(TILE_QUERIES, TILE // width))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                best = _best(_matrix(part.column("embedding")), rows, keys, k)
                q = best["q"].to_numpy()
                rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("query_id").take(pa.array(q)),
                        pa.array(best["idx"].to_numpy(), type=arrow_schema.field("idx").type),
                        pa.array(best["distance"].to_numpy()),
                        pa.array(rank.astype(np.int32)),
                    ],
                    schema=arrow_schema,
                )

    return _dealt(queries.select("query_id", "embedding")).mapInArrow(scan, schema)


# ---- plan 3: pivots and packs ----


@dataclass
class _Cell:
    """Size and angular range of the index rows nearest to one pivot, and the numbers of its packs."""

    rows: int
    low: float
    high: float
    first: int = 0
    packs: int = 1


def _pack(cells: dict[int, _Cell], pivots: np.ndarray, rows: int) -> dict[int, _Cell]:
    """``cells`` with pack numbers and in their order: a large cell has packs of its own, small ones near each other share one."""
    leaders = pivots[: max(1, isqrt(len(pivots)))]
    group = (pivots @ leaders.T).argmax(axis=1)
    out, number, room = {}, -1, 0
    for c in sorted(cells, key=lambda c: (int(group[c]) if c >= 0 else -1, c)):
        cell = cells[c]
        if cell.rows > rows:
            out[c] = replace(cell, first=number + 1, packs=ceil(cell.rows / rows))
            number, room = number + out[c].packs, 0
        else:
            if cell.rows > room:
                number, room = number + 1, rows
            out[c] = replace(cell, first=number, packs=1)
            room -= cell.rows
    return out


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _to_cells(index: DataFrame, pivots: np.ndarray, leaders: int | None = None) -> DataFrame:
    """Add a near pivot and the angle to it; zero vectors form cell -1.

    The first pivots lead groups of pivots; a row looks only into the group whose leader is nearest.
    Any cell would do, as only the range of angles in a cell is used; so the cost per row is about
    twice the root of the number of pivots.  With as many ``leaders`` as pivots the nearest one is found.
    """
    leaders = leaders or max(1, isqrt(len(pivots)))
    group = (pivots @ pivots[:leaders].T).argmax(axis=1)
    group[:leaders] = np.arange(leaders)
    shared = index.sparkSession.sparkContext.broadcast((pivots, leaders, group))
    schema = T.StructType(
        [
            index.schema["idx"],
            T.StructField("embedding", T.ArrayType(T.DoubleType())),
            T.StructField("cell", T.IntegerType()),
            T.StructField("angle", T.DoubleType()),
        ]
    )
    arrow_schema = to_arrow_schema(schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = _matrix(batch.column("embedding"))
            points, first, member = shared.value
            lead = (rows @ points[:first].T).argmax(axis=1)
            cell, angle = np.zeros(len(rows), dtype=int), np.zeros(len(rows))
            for one in np.unique(lead):
                at, own = np.flatnonzero(lead == one), np.flatnonzero(member == one)
                cosine = rows[at] @ points[own].T
                best = cosine.argmax(axis=1)
                cell[at], angle[at] = own[best], _angle(cosine[np.arange(len(at)), best])
            cell = np.where(np.any(rows != 0, axis=1), cell, -1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("idx"),
                    _vectors(rows).cast(arrow_schema.field("embedding").type),
                    pa.array(cell.astype(np.int32)),
                    pa.array(angle),
                ],
                schema=arrow_schema,
            )

    return index.select("idx", "embedding").mapInArrow(assign, schema)


def _visits(
    queries: DataFrame, pivots: np.ndarray, cells: dict[int, _Cell], k: int, pilot: bool
) -> DataFrame:
    """The packs every query has to look into, as ``query_id, embedding, pack``, and the ``cells`` there that it asks for.

    The pilot visit is one cell near the query that holds rows; its k-th distance
    (column ``bound``, missing in the pilot) then rules out cells.
    """
    shared = queries.sparkSession.sparkContext.broadcast((pivots, cells))
    schema = T.StructType(
        [
            queries.schema["query_id"],
            T.StructField("embedding", T.ArrayType(T.DoubleType())),
            T.StructField("pack", T.IntegerType()),
            T.StructField("cells", T.ArrayType(T.IntegerType())),
        ]
    )
    arrow_schema = to_arrow_schema(schema)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, known = shared.value
        names = np.array(list(known))  # in the order of their packs
        low, high = (np.array([getattr(c, name) for c in known.values()]) for name in ("low", "high"))
        first, packs = (np.array([getattr(c, name) for c in known.values()]) for name in ("first", "packs"))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = _matrix(batch.column("embedding"))
            angles = _angle(rows @ points.T)
            # Zero vectors are at a right angle to everything.
            toward = np.where(names >= 0, angles[:, np.maximum(names, 0)], 0.0)
            nearest = np.maximum(np.maximum(toward - high, low - toward), 0.0)
            if pilot:
                # Of cells that may hold the query, the one with the nearest pivot; of its packs, any one.
                at, which = np.arange(len(rows)), (nearest + 1e-6 * toward).argmin(axis=1)
                pack = first[which] + at % packs[which]
            else:
                bound = batch.column("bound").to_numpy(zero_copy_only=False)
                # One unit in the last rounded place, and the error of arccos.
                reach = _angle(1.0 - (bound + 10.0**-DIGITS)) + 1e-6
                at, which = np.nonzero(nearest <= reach[:, None])
                times = packs[which]
                at, which, pack = np.repeat(at, times), np.repeat(which, times), np.repeat(first[which], times)
                pack = pack + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            # A query asks a pack once, whatever the number of its cells.
            begins = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(pack) != 0)]) if len(at) else at
            ends = np.r_[begins, len(at)]
            for start in range(0, len(begins), BLOCK_ROWS):
                some = begins[start : start + BLOCK_ROWS]
                edges = ends[start : start + len(some) + 1]
                asked = pa.ListArray.from_arrays(
                    pa.array((edges - edges[0]).astype(np.int32)), pa.array(names[which[edges[0] : edges[-1]]].astype(np.int32))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("query_id").take(pa.array(at[some])),
                        _vectors(rows[at[some]]).cast(arrow_schema.field("embedding").type),
                        pa.array(pack[some].astype(np.int32)),
                        asked.cast(arrow_schema.field("cells").type),
                    ],
                    schema=arrow_schema,
                )

    columns = ["query_id", "embedding"] + ([] if pilot else ["bound"])
    return queries.select(*columns).mapInArrow(visit, schema)


def _with_number(df: DataFrame, numbers: dict[int, tuple[int, ...]], key: str, *names: str) -> DataFrame:
    """Add numbers per cell or pack.  There is one cell per pivot, about the root of the index's rows at most."""
    rows = [(int(c), *map(int, v)) for c, v in numbers.items()]
    schema = ", ".join(f"{name} int" for name in (key, *names))
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), key)


def _packed(placed: DataFrame, cells: dict[int, _Cell]) -> DataFrame:
    """``idx, embedding, pack`` of the rows in ``cells``."""
    numbered = _with_number(placed, {c: (v.first, v.packs) for c, v in cells.items()}, "cell", "_first", "_packs")
    own = F.col("_first") + F.pmod(F.xxhash64("idx"), F.col("_packs")).cast("int")
    return numbered.select("idx", "embedding", own.alias("pack"))


def _meet(blocks: DataFrame, visits: DataFrame, k: int, schema: T.StructType, sheet_rows: int) -> DataFrame:
    """Compare every sheet of the queries that visit a pack with the pack's rows.

    A group is one pack and one sheet, both of bounded size.
    """
    sheets = {r["pack"]: (ceil(r["n"] / sheet_rows),) for r in visits.groupBy("pack").agg(F.count("*").alias("n")).collect()}
    sheet = F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("_sheets")).cast("int")
    asking = _with_number(visits.select("query_id", "embedding", "pack"), sheets, "pack", "_sheets")
    asking = asking.select("query_id", "embedding", "pack", sheet.alias("sheet"))
    answering = _with_number(blocks, sheets, "pack", "_sheets").select(
        "idx", "embedding", "pack", F.explode(F.sequence(F.lit(0), F.col("_sheets") - 1)).alias("sheet")
    )
    keys = ["pack", "sheet"]
    return asking.groupBy(*keys).cogroup(answering.groupBy(*keys)).applyInArrow(_comparer(k, schema), schema)


def _comparer(k: int, schema: T.StructType):
    """The ``k`` best rows of an index block for every query of a sheet."""
    arrow_schema = to_arrow_schema(schema)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return arrow_schema.empty_table()
        best = _best(
            _matrix(left.column("embedding")), _matrix(right.column("embedding")),
            _ids(right.column("idx")), k,
        )
        return pa.Table.from_arrays(
            [
                left.column("query_id").take(pa.array(best["q"].to_numpy())),
                pa.array(best["idx"].to_numpy(), type=arrow_schema.field("idx").type),
                pa.array(best["distance"].to_numpy()),
            ],
            schema=arrow_schema,
        )

    return compare


def _best_overall(candidates: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("distance", "idx")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _without_surplus_copies(index: DataFrame, k: int) -> DataFrame:
    """Of rows with the same vector only the ``k`` smallest keys can be among ``k`` winners.

    Spark applies the limit before the shuffle too, so a vector that fills a third
    of the index leaves ``k`` rows per task, not a hot partition.
    """
    # Sorted by a short hash first; vectors are compared only where hashes agree.
    copies = W.partitionBy("_hash", "embedding").orderBy("idx")
    hashed = index.select("idx", "embedding", F.xxhash64("embedding").alias("_hash"))
    ranked = hashed.withColumn("_copy", F.row_number().over(copies))
    return ranked.where(F.col("_copy") <= k).drop("_copy", "_hash")


def _pruned_blocks(
    queries: DataFrame, index: DataFrame, k: int, schema: T.StructType, block_rows: int
) -> DataFrame:
    index = settle(_without_surplus_copies(index, k))
    n = index.count()
    wanted = max(2, min(ceil(n / block_rows), isqrt(n)))
    is_zero = F.forall("embedding", lambda x: x == 0)
    chosen = (
        index.where(~is_zero).orderBy(F.xxhash64("idx")).select("embedding").limit(wanted).toArrow()
    )
    pivots = _matrix(chosen.column("embedding"))
    if len(pivots) == 0:
        pivots = np.zeros((1, len(index.select("embedding").first()[0])))
    placed = settle(_to_cells(index, pivots))
    sizes = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")
    )
    cells = {}
    for row in sizes.collect():  # one row per pivot
        low, high = (np.pi / 2, np.pi / 2) if row["cell"] < 0 else (row["low"], row["high"])
        cells[row["cell"]] = _Cell(row["n"], low, high)
    rows = max(block_rows, PACK_ROWS)
    cells = _pack(cells, pivots, rows)
    blocks = _packed(placed, cells)

    # All rows are equally far from a zero query: its answer is the same k rows.
    zero = queries.where(is_zero)
    first = index.orderBy("idx").select("idx").limit(k).toArrow().column("idx").to_pylist()
    same = F.array(*[F.lit(i) for i in first])
    answered = zero.select("query_id", F.explode(same).alias("idx"), F.lit(1.0).alias("distance"))

    asking = queries.where(~is_zero)
    pilot = _meet(blocks, _visits(asking, pivots, cells, k, True), k, schema, rows)
    found = pilot.groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("distance").alias("bound")
    )
    # Too few rows in the pilot's pack: nothing can be ruled out.
    bound = F.when(F.col("n") >= k, F.col("bound")).otherwise(F.lit(2.0))
    bounded = settle(
        asking.join(found, "query_id", "left").select(
            "query_id", "embedding", F.coalesce(bound, F.lit(2.0)).alias("bound")
        )
    )
    visits = _visits(bounded, pivots, cells, k, False)
    full = _meet(blocks, visits, k, schema, rows)
    return full.unionByName(answered)


# ---- public operators ----


def _no_answers(schema: T.StructType, queries: DataFrame) -> DataFrame:
    """The result where there are no queries or no index rows."""
    empty = queries.sparkSession.createDataFrame([], schema)
    return empty.select("*", F.lit(0).alias("rank"), (1 - F.col("distance")).alias("similarity"))


def knn(
    queries: DataFrame,
    index: DataFrame,
    k: int = TOP_K,
    query_id: str = "query_id",
    method: str = "auto",
    broadcast_bytes: int = BROADCAST_QUERY_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, idx, distance, similarity, rank``: the ``k`` nearest index rows.

    Fewer than ``k`` rows come back only when the index is smaller than ``k``.
    ``method`` is ``auto``, ``broadcast`` or ``blocks``; ``block_rows`` is about the
    size of the cells that ``blocks`` rules out one by one.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), "embedding")
    schema = _candidate_schema(queries, query_id, index)
    candidates, few = None, False
    if method in ("auto", "broadcast"):
        head = asked.select("embedding").first()
        if head is None:
            return _no_answers(schema, queries)
        dim = len(head[0])
        cap = max(1, broadcast_bytes // (8 * dim))
        table = asked.limit(cap + 1).toArrow()
        few = table.num_rows <= cap and table.num_rows * k <= BROADCAST_ROWS
        if not few and method == "auto":
            short = index.select("idx", "embedding").limit(cap + 1).toArrow()
            # The answers of a query key that occurs twice are ranked together, below.
            if 0 < short.num_rows <= cap and asked.groupBy("query_id").count().where("count > 1").isEmpty():
                ids = _ids(short.column("idx").combine_chunks())
                found = _scan_with_index(asked, ids, _matrix(short.column("embedding")), k, schema)
                return found.withColumn("similarity", 1 - F.col("distance"))
        if table.num_rows <= cap:
            ids = table.column("query_id").combine_chunks()
            scanned = index if few else _dealt(index.select("idx", "embedding"))
            candidates = _scan_with_queries(
                scanned, ids, _matrix(table.column("embedding")), k, schema
            )
        elif method == "broadcast":
            raise ValueError(f"more than {cap} queries; use method='blocks'")
    if candidates is None:
        if asked.isEmpty() or index.isEmpty():
            return _no_answers(schema, queries)
        candidates = _pruned_blocks(asked, index, k, schema, block_rows)
    best = _best_overall(candidates, k).withColumn("similarity", 1 - F.col("distance"))
    # Few queries have few answers: kept, they can be broadcast to the index.
    return small_side(best) if few else best


def retrieve(
    queries: DataFrame, index: DataFrame, k: int = TOP_K, query_id: str = "query_id",
    min_similarity: float | None = None, **plan,
) -> DataFrame:
    """Nearest neighbours with their text and labels.

    Winners and index meet on the unique ``idx``.  ``min_similarity`` drops
    neighbours below an acceptance floor.
    """
    winners = knn(queries, index, k, query_id, **plan)
    if min_similarity is not None:
        winners = winners.where(F.col("similarity") >= min_similarity)
    return winners.join(index.select("idx", *PAYLOAD), "idx").select(
        F.col("query_id").alias(query_id), "rank", "idx", *PAYLOAD, "distance", "similarity"
    )


def knn_by_tenant(
    queries: DataFrame, index: DataFrame, k: int = TOP_K, query_id: str = "query_id", tenant: str = "tenant",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Like :func:`knn`, but a query sees only index rows of its own tenant.

    Blocks of a tenant's rows meet blocks of its queries by an equi-join on tenant
    and block numbers, so a large tenant merely has more blocks.  A tenant or vector
    that is null has no neighbours.
    """
    schema = _candidate_schema(queries, query_id, index)
    good = F.col(tenant).isNotNull() & F.col("embedding").isNotNull()
    asked = queries.where(good).select(
        F.col(query_id).alias("query_id"), F.col("embedding").alias("embedding"), F.col(tenant).alias("_tenant")
    )
    known = index.where(good).select("idx", F.col("embedding").alias("embedding"), F.col(tenant).alias("_tenant"))

    def blocked(df: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
        counts = df.groupBy("_tenant").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(f"{name}s"))
        own = F.pmod(F.xxhash64(key), F.col(f"{name}s")).cast("int")
        return df.join(counts, "_tenant").withColumn(name, own).drop(f"{name}s"), counts

    sheets, n_sheets = blocked(asked, "query_id", "sheet")
    blocks, n_blocks = blocked(known, "idx", "block")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(f"{name}s") - 1)).alias(name)
    left = sheets.join(n_blocks, "_tenant").select("query_id", "embedding", "_tenant", every("block"), "sheet")
    right = blocks.join(n_sheets, "_tenant").select("idx", "embedding", "_tenant", "block", every("sheet"))
    # Other names on the left: both sides may come from one table.
    left = left.toDF("query_id", "embedding", "_at_tenant", "_at_block", "_at_sheet")
    right = right.toDF("idx", "embedding", "_tenant", "_block", "_sheet")
    asking = left.groupBy("_at_tenant", "_at_block", "_at_sheet")
    found = asking.cogroup(right.groupBy("_tenant", "_block", "_sheet")).applyInArrow(_comparer(k, schema), schema)
    return _best_overall(found, k).withColumn("similarity", 1 - F.col("distance"))


def search(
    queries: DataFrame, index: DataFrame, k: int = TOP_K, query_id: str = "query_id", **plan
) -> DataFrame:
    """Nearest neighbours as text, label tuple and similarity."""
    return retrieve(queries, index, k, query_id, **plan).select(
        query_id, "rank", "text", F.struct(*LABEL_COLUMNS).alias("labels"), "similarity"
    )


def nested_examples(retrieved: DataFrame, query_id: str = "query_id") -> DataFrame:
    """One row per query with its neighbours as an array in rank order."""
    item = F.struct("rank", "idx", *PAYLOAD, "distance", "similarity")
    return retrieved.groupBy(query_id).agg(F.array_sort(F.collect_list(item)).alias("examples"))
