"""Ranked lexical search: compressed quadtrees of impact maxima over term-document grids."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ledgerloom.llm.shared import cut, text_or_empty, written

#: Runs of ASCII letters, digits and of all that is not ASCII.
TERM, GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Characters of a text that are split into terms at once.
TEXT_SLICE = 1 << 20
#: Different terms of the items that are searched for together; more items are searched for in further passes.
VOCABULARY = 1 << 20
#: Documents of one grid, and postings after which a grid is closed early.
GRID_DOCUMENTS, GRID_POSTINGS = 1 << 14, 1 << 22
#: Document ranges that one step of the descent opens.
OPENED = 256
_LOWER = {c: c + 32 for c in range(65, 91)}


def _folded(term: str) -> str:
    return term.lower() if term.isascii() else term.translate(_LOWER)


def term_counts(text: str) -> tuple[Counter, int]:
    """How often each term occurs in the whole text, only A-Z lower-cased; terms in all."""
    find, gap = re.compile(TERM).findall, re.compile(GAP)
    if len(text) <= TEXT_SLICE:
        raw = Counter(find(text))
    else:
        raw, first = Counter(), 0
        while first < len(text):
            end = gap.search(text, min(first + TEXT_SLICE, len(text)))
            end = end.start() if end else len(text)
            raw.update(find(text[first:end]))
            first = max(end, first + 1)
    counts: Counter = Counter()
    for term, n in raw.items():
        counts[_folded(term)] += n
    return counts, sum(raw.values())


def item_terms(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """``(item, id, term, n)``: the terms of every row of ``items``, which ``item`` numbers."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, t, n) for i, k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t, n in term_counts(text)[0].items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), batch.schema.field(1).type, pa.string(), pa.int64()))],
                ["item", "id", "term", "n"],
            )

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{id_column}`").alias("id"), text_or_empty(text_column).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(split, f"item long, id {kind}, term string, n long")


def passes(terms: DataFrame, vocabulary: int = VOCABULARY) -> list[DataFrame]:
    """``terms`` cut into groups of whole items with about ``vocabulary`` term rows at most (one item may have more)."""
    n, items = terms.agg(F.count(F.lit(1)), F.count_distinct("item")).first()
    groups = max(1, min(items, -(-n // vocabulary)))
    if groups == 1:
        return [terms]
    place = F.pmod(F.xxhash64(F.lit(3), F.col("item")), F.lit(groups))
    return [terms.where(place == g) for g in range(groups)]


def postings(docs: DataFrame, terms: list[str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n, terms, counts)`` of every document with a term: all its terms' number, and its postings among ``terms``."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            keep, sizes, found, often = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                counts, n = term_counts(text)
                if n:
                    own = sorted((number[t], c) for t, c in counts.items() if t in number)
                    keep.append(row)
                    sizes.append(n)
                    found.append([i for i, _ in own])
                    often.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))],
                ["id", "n", "terms", "counts"],
            )

    rows = docs.select(F.col(f"`{id_column}`").alias("id"), text_or_empty(text_column).alias("text"))
    schema = StructType([
        rows.schema["id"], StructField("n", LongType()), StructField("terms", ArrayType(IntegerType())), StructField("counts", ArrayType(LongType()))
    ])
    return rows.mapInArrow(split, schema)


class Treap:
    """A K2-treap: a grid of rows (terms) and columns (documents) cut in four again and again.

    Each level keeps its non-empty cells only: the largest impact within, which of the four quarters hold
    anything, and where the first of them lies on the level below.  Level 0 is the whole grid; on the last
    level a cell is one impact.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, side_bits: int):
        self.depth = side_bits
        code = np.zeros(len(rows), dtype=np.int64)
        for bit in range(side_bits):
            code |= ((rows >> bit) & 1).astype(np.int64) << (2 * bit + 1) | ((columns >> bit) & 1).astype(np.int64) << (2 * bit)
        order = np.argsort(code, kind="stable")
        code, most = code[order], impacts[order]
        #: From the whole grid down: the largest impacts, and per cell the places of its quarters (-1: empty).
        self.most, self.quarters = [most], [np.zeros((0, 4), dtype=np.int32)]
        for _ in range(side_bits):
            upper = code >> 2
            first = np.flatnonzero(np.concatenate([[True], upper[1:] != upper[:-1]])) if len(upper) else np.zeros(0, int)
            quarters = np.full((len(first), 4), -1, dtype=np.int32)
            cell = np.cumsum(np.bincount(first, minlength=len(code)).astype(bool)) - 1 if len(code) else code
            quarters[cell, code & 3] = np.arange(len(code))
            most = np.maximum.reduceat(most, first) if len(first) else most
            code = upper[first]
            self.most.append(most)
            self.quarters.append(quarters)
        self.most.reverse()
        self.quarters.reverse()

    def search(self, rows: np.ndarray, often: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """``(columns, scores, floor)``: all columns that may be among the ``k`` best by the summed impacts of ``rows``.

        The paths of all rows go down together over ranges of columns, best bound first: a range's bound sums
        the largest impacts of the cells its rows have reached.  Ranges below ``floor``, which the k-th best
        score found so far raises, are never opened.  What scores 0 is no result.
        """
        none = np.zeros(0, dtype=np.int64)
        if not len(self.most[0]):
            return none, none, floor
        paths = np.zeros((1, len(rows)), dtype=np.int32)
        # Waiting ranges by level: bound, first column, cell of each row (-1: nothing there).
        waiting = [(np.zeros(0, dtype=np.int64), none, paths[:0]) for _ in range(self.depth + 1)]
        bound = np.array([int(self.most[0][0]) * int(often.sum())], dtype=np.int64)
        waiting[0] = (bound, np.zeros(1, dtype=np.int64), paths)
        columns, scores = [], []
        best = none
        while True:
            tops = [w[0].max(initial=-1) for w in waiting[: self.depth]]
            level = max(range(self.depth), key=lambda i: (tops[i], i)) if self.depth else 0
            if not self.depth or tops[level] < max(floor, 1):
                break
            bounds, places, cells = waiting[level]
            if len(bounds) > OPENED:
                order = np.argpartition(-bounds, OPENED)
                now, later = order[:OPENED], order[OPENED:]
            else:
                now, later = np.arange(len(bounds)), np.zeros(0, dtype=np.int64)
            later = later[bounds[later] >= max(floor, 1)]
            now = now[bounds[now] >= max(floor, 1)]
            waiting[level] = (bounds[later], places[later], cells[later])
            # The half of the rows that each path goes to, and both halves of the columns.
            half = ((rows >> (self.depth - level - 1)) & 1)[None, :]
            quarters, own = self.quarters[level], cells[now]
            there, most = own >= 0, self.most[level + 1]
            for side in (0, 1):
                below = np.where(there, quarters[own, 2 * half + side], -1)
                value = np.where(below >= 0, most[below], 0) @ often
                keep = value >= max(floor, 1)
                at = places[now][keep] * 2 + side
                if level + 1 == self.depth:
                    columns.append(at)
                    scores.append(value[keep])
                    best = np.concatenate([best, value[keep]])
                    if len(best) >= k:
                        best = -np.partition(-best, k - 1)[:k]
                        floor = max(floor, int(best[k - 1]))
                else:
                    w = waiting[level + 1]
                    waiting[level + 1] = tuple(np.concatenate(x) for x in zip(w, (value[keep], at, below[keep]), strict=True))
        if not columns:
            return none, none, floor
        column, score = np.concatenate(columns), np.concatenate(scores)
        good = score >= max(floor, 1)
        return column[good], score[good], floor


class _Best:
    """The best documents of every item so far, in a task: scores, then ids in ascending order, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.rows, self.floors = k, [[] for _ in range(items)], [0] * items

    def add(self, item: int, ids: list, scores: list[int]) -> None:
        rows = self.rows[item] + list(zip(scores, ids, strict=True))
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
        self.rows[item] = rows[: self.k]
        if len(self.rows[item]) == self.k:
            self.floors[item] = self.rows[item][-1][0]


def _searched(k: int, n_docs: int, n_terms: int, shared: Broadcast):
    """The Arrow function that makes a grid of every so many documents and searches it for all items.

    ``shared`` holds the terms of each item (numbers in order of weight, and how often), the weights by that
    number, and that number by the one in the index.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight, place = shared.value
        best = _Best(len(wanted), k)
        kind = pa.int64()
        held: list[pa.RecordBatch] = []
        documents = found = 0

        def grid() -> None:
            ids = [i for b in held for i in b.column(0).to_pylist()]
            n = np.concatenate([b.column(1).to_numpy() for b in held])
            lists = [b.column(2) for b in held]
            sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
            rows = place[np.concatenate([x.flatten().to_numpy() for x in lists])]
            often = np.concatenate([b.column(3).flatten().to_numpy() for b in held])
            column = np.repeat(np.arange(len(ids)), sizes)
            share = 75 + (25 * n * n_docs) // n_terms
            impact = weight[rows] * ((1_000_000_000 * often) // (1000 * often + 12 * share[column]))
            some = impact > 0
            side = max(1, int(max(len(ids), len(weight)) - 1).bit_length())
            treap = Treap(rows[some], column[some], impact[some], side)
            for i, (terms, times) in enumerate(wanted):
                columns, scores, _ = treap.search(terms, times, k, best.floors[i])
                if len(columns):
                    best.add(i, [ids[c] for c in columns], scores.tolist())

        for batch in batches:
            kind = batch.schema.field(0).type
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                held.append(part)
                documents, found = documents + part.num_rows, found + len(part.column(2).flatten())
                if documents + 1024 > GRID_DOCUMENTS or found > GRID_POSTINGS:
                    grid()
                    held, documents, found = [], 0, 0
        if documents:
            grid()
        rows = [(item, doc, score) for item, own in enumerate(best.rows) for score, doc in own]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), kind, pa.int64()))], ["item", "id", "score"]
        )

    return search


def lexical_topk(
    docs: DataFrame, items: DataFrame, k: int = 20, item_column: str = "item_id", id_column: str = "doc_id", text_column: str = "text",
    vocabulary: int = VOCABULARY,
) -> DataFrame:
    """``(<item>, rank, <id>, score)``: the ``k`` documents that score highest for each row of ``items``.

    Terms are runs of letters, digits and non-ASCII characters of whole texts, only A-Z lower-cased.  With N
    documents that hold a term, L terms in all, and df of them holding a term, a term weighs
    ``w = floor(1000 ln((2N+2)/(2df+1)))``; a document of n terms scores the sum over an item's terms, repeats
    included, of ``w * ((10^9 tf) div (1000 tf + 12 m))`` with ``m = 75 + (25 n N) div L``.  Scores above 0 only;
    equal scores go by id, null last.  Null and empty texts have no terms; repeated rows compete with each
    other; rows of items with one id are searched for one by one; other columns are never read; an empty table
    on either side gives an empty result.

    Every document is indexed for the terms asked for: a K2-treap over each grid of some thousands of documents,
    terms in order of weight.  Items are searched for in passes of a bounded number of terms, so what is
    broadcast does not grow.
    """
    spark = docs.sparkSession
    terms = cut(item_terms(items, item_column, text_column))
    kinds = f"`{item_column}` {dict(terms.dtypes)['id']}, rank int, `{id_column}` {docs.select(F.col(f'`{id_column}`')).dtypes[0][1]}, score long"
    out = spark.createDataFrame([], kinds)
    for part in passes(terms, vocabulary):
        out = out.unionByName(_one_pass(docs, part, k, item_column, id_column, text_column))
    return out


def _one_pass(docs: DataFrame, terms: DataFrame, k: int, item_column: str, id_column: str, text_column: str) -> DataFrame:
    spark = docs.sparkSession
    asked = terms.select("item", "id", "term", "n").toArrow().to_pydict()
    words = sorted(set(asked["term"]))
    index = written(postings(docs, words, id_column, text_column))
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    seen = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    frequency = {r["t"]: r["df"] for r in seen.collect()}
    weights = np.array([_weight(n_docs, frequency.get(i, 0)) for i in range(len(words))], dtype=np.int64)
    # Terms of like weight are neighbours, so that a cell's largest impact says more about each of them.
    order = np.lexsort((np.arange(len(words)), weights))
    place = np.empty(len(words), dtype=np.int64)
    place[order] = np.arange(len(words))
    number = {word: i for i, word in enumerate(words) if i in frequency}
    by_item: dict[int, list[tuple[int, int]]] = {}
    names: dict[int, object] = {}
    for item, name, term, n in zip(asked["item"], asked["id"], asked["term"], asked["n"], strict=True):
        if term in number:
            names[item] = name
            by_item.setdefault(item, []).append((int(place[number[term]]), n))
    keys = sorted(by_item)
    wanted = [tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(by_item[i]), strict=True)) for i in keys]
    shared = spark.sparkContext.broadcast((wanted, weights[order], place))
    kind = index.schema["id"].dataType.simpleString()
    found = index.mapInArrow(_searched(k, n_docs, n_terms, shared), f"item int, id {kind}, score long")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    named = spark.createDataFrame([(i, names[key]) for i, key in enumerate(keys)], f"item int, name {dict(terms.dtypes)['id']}")
    return best.join(F.broadcast(named), "item").select(
        F.col("name").alias(item_column), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_column), "score"
    )


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) if df else 0
