"""Language-model scoring by prediction by partial matching over bytes, with a word-frequency base line."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import cut, id_remainder, text_or_empty, written

#: Bytes of context.  A context and its next byte fit into 64 bits.
ORDER = 5
#: A window with at least this share of all training bytes is sent to the executors with its score, so
#: at most ``1 / SHARE`` are; all other windows are joined by shuffle.
SHARE = 2.0**-22
#: Words whose counts are sent to the executors, at most; the others are joined by shuffle.
KNOWN_WORDS = 1 << 18
#: Stands before and after a text; it is no byte of UTF-8.
END = 0xFF
#: Positions whose windows are counted, and scored, at once; the latter fit into a processor's cache.
COUNT_SLICE, SCORE_SLICE = 1 << 21, 1 << 16


def _lowered(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes with A to Z in lower case, everything else as it is."""
    return [t.lower() for t in texts.cast(pa.binary()).to_pylist()]


def _joined(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each after ``order`` end signs and before one; where each begins."""
    before, after = bytes([END]) * order, bytes([END])
    starts = np.cumsum([0] + [len(t) + order + 1 for t in texts])
    return np.frombuffer(b"".join(x for t in texts for x in (before, t, after)), dtype=np.uint8), starts


def _windows(joined: np.ndarray, starts: np.ndarray, order: int, step: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of ``(first position, window codes, is scored)``; a code holds ``order`` bytes and the next one."""
    scored = np.ones(len(joined), dtype=bool)
    if len(starts) > 1 and order:
        scored[(starts[:-1, None] + np.arange(order)).ravel()] = False
    for first in range(0, len(joined), step):
        last = min(len(joined), first + step)
        piece = np.concatenate([np.zeros(max(0, order - first), np.uint8), joined[max(0, first - order) : last]])
        codes = np.zeros(last - first, dtype=np.uint64)
        for back in range(order + 1):
            codes |= piece[order - back : len(piece) - back].astype(np.uint64) << np.uint64(8 * back)
        yield first, codes, scored[first:last]


def window_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(window, n)`` over all positions of ``texts (text)``: counted by slice, then summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined, starts = _joined(_lowered(batch.column(0)), order)
            for _, codes, scored in _windows(joined, starts, order, COUNT_SLICE):
                codes = np.sort(codes[scored])
                at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.array([], int)
                n = np.diff(np.append(at, len(codes)))
                yield pa.RecordBatch.from_arrays([pa.array(codes[at].view(np.int64)), pa.array(n, pa.int64())], ["window", "n"])

    return texts.mapInArrow(count, "window long, n long").groupBy("window").agg(F.sum("n").alias("n"))


class Table:
    """Keys in a table with open addressing; ``find`` gives each key's place or -1."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.places = np.full(1 << self.bits, -1, dtype=np.int32)
        self.keys = keys.astype(np.uint64)
        slot, left = self._slot(self.keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.places[slot] < 0
            self.places[slot[free]] = left[free]
            lost = self.places[slot] != left
            slot, left = (slot[lost] + 1) & ((1 << self.bits) - 1), left[lost]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int32)
        if not len(self.keys):
            return out
        slot, left = self._slot(keys), None
        while True:
            place = self.places[slot]
            asked = keys if left is None else keys[left]
            same = (place >= 0) & (self.keys[place] == asked)
            if left is None:
                out[same] = place[same]
                left = np.flatnonzero(~same & (place >= 0))
                slot = slot[left]
            else:
                out[left[same]] = place[same]
                on = ~same & (place >= 0)
                left, slot = left[on], slot[on]
            if not len(left):
                return out
            slot = (slot + 1) & ((1 << self.bits) - 1)


@dataclass
class Common:
    """Common windows with the log10 probability of their last bytes."""

    order: int
    windows: Table
    top: np.ndarray

    def known(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each window's last byte if the window is common, else 0; which are not."""
        place = self.windows.find(codes)
        out = np.where(place >= 0, self.top[place], 0.0) if len(self.top) else np.zeros(len(codes))
        return out, np.flatnonzero(place < 0)


@dataclass
class Trie:
    """For each order: nodes (context and byte) with counts, and contexts.

    A context holds ``total + distinct`` and ``distinct + count of the nodes that were cut``, as they
    are without exclusion, and for its parent, one byte shorter, how much of the parent's count and how
    many of its symbols an escape from here excludes.
    """

    order: int
    nodes: list[Table]
    counts: list[np.ndarray]
    contexts: list[Table]
    stats: list[np.ndarray]
    top: np.ndarray

    def known(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each window's last byte if the longest context has seen it, else 0; which have not."""
        return Common(self.order, self.nodes[self.order], self.top).known(codes)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each window's last byte after its context."""
        out, missing = self.known(codes)
        out[missing] = self.escaping(codes[missing])
        return out

    def escaping(self, codes: np.ndarray) -> np.ndarray:
        """The same for windows that the longest context has not seen; equal windows are worked out once."""
        rare, back = np.unique(codes, return_inverse=True)
        return self._escaping(rare)[back]

    def _escaping(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        mass, symbols = np.zeros(len(codes)), np.zeros(len(codes))
        for k in range(self.order, -1, -1):
            own = codes[open_]
            context = self.contexts[k].find((own >> np.uint64(8)) & np.uint64((1 << (8 * k)) - 1))
            there = context >= 0
            if not there.any():
                continue
            node = self.nodes[k].find(own & np.uint64((1 << (8 * (k + 1))) - 1))
            full, escape, child_mass, child_symbols = self.stats[k][np.maximum(context, 0)].T
            whole = full - mass[open_] - symbols[open_]
            found = there & (node >= 0)
            out[open_[found]] += np.log10(self.counts[k][node[found]] / whole[found])
            on = there & ~found & (whole > 0)
            out[open_[on]] += np.log10((escape[on] - symbols[open_][on]) / whole[on])
            mass[open_] = np.where(there, child_mass, 0.0)
            symbols[open_] = np.where(there, child_symbols, 0.0)
            open_ = open_[~found]
        out[open_] -= np.log10(256 - symbols[open_])
        return out


def build_trie(windows: DataFrame, order: int = ORDER, share: float = SHARE) -> Trie:
    """The trie of all orders from the counts of the longest windows, on the driver; for small corpora.

    Nodes with less than ``share`` of all bytes are cut.  :func:`score_texts` cuts nothing: it uses
    :func:`context_table`.
    """
    windows = cut(windows)
    total = windows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    orders = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k")
    mask = F.expr("shiftrightunsigned(-1L, 56 - 8 * k)")
    nodes = windows.select("window", "n", orders).select("k", F.col("window").bitwiseAND(mask).alias("node"), "n")
    nodes = nodes.groupBy("k", "node").agg(F.sum("n").alias("n"))
    stays = F.col("n") >= max(1.0, total * share)
    found = (
        nodes.groupBy("k", F.shiftrightunsigned("node", 8).alias("context"))
        .agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("symbols"),
            F.collect_list(F.when(stays, F.struct(F.col("node").bitwiseAND(F.lit(255)).cast("int").alias("s"), "n"))).alias("kept"),
        )
        .where(F.size("kept") > 0)
    )
    rows = found.select("k", "context", "total", "symbols", F.explode("kept").alias("x"))
    flat = rows.select("k", "context", "total", "symbols", F.col("x.s").alias("s"), F.col("x.n").alias("n")).toArrow()
    k, context, total_, symbols, s, n = (flat.column(i).to_numpy() for i in range(6))
    tries = Trie(order, [], [], [], [], np.zeros(0))
    for level in range(order + 1):
        at = np.flatnonzero(k == level)
        at = at[np.lexsort((s[at], context[at].view(np.uint64)))]
        codes = (context[at].astype(np.uint64) << np.uint64(8)) | s[at].astype(np.uint64)
        count = n[at].astype(float)
        keys, first, inverse = np.unique(context[at].astype(np.uint64), return_index=True, return_inverse=True)
        whole, distinct = total_[at][first].astype(float), symbols[at][first].astype(float)
        stats = np.zeros((len(keys), 4))
        stats[:, 0] = whole + distinct
        stats[:, 1] = distinct + whole - np.bincount(inverse, count, len(keys))
        stats[:, 3] = np.bincount(inverse, minlength=len(keys))
        if level:
            parent = tries.nodes[-1].find(codes & np.uint64((1 << (8 * level)) - 1))
            stats[:, 2] = np.bincount(inverse, tries.counts[-1][parent], len(keys))
        tries.nodes.append(Table(codes))
        tries.counts.append(count)
        tries.contexts.append(Table(keys))
        tries.stats.append(stats)
        if level == order:
            tries.top = np.log10(count / stats[inverse, 0])
    return tries


def context_table(windows: DataFrame, order: int = ORDER) -> DataFrame:
    """``(k, context, total, symbols, excluded, seen)``: every context of every order, nothing cut.

    ``seen`` maps next bytes to their counts; ``excluded`` is how much of the count of the context that
    is one byte shorter belongs to these bytes.
    """
    orders = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k")
    mask = F.expr("shiftrightunsigned(-1L, 56 - 8 * k)")
    nodes = windows.select("window", "n", orders).select("k", F.col("window").bitwiseAND(mask).alias("node"), "n")
    nodes = cut(nodes.groupBy("k", "node").agg(F.sum("n").alias("n")))
    shorter = nodes.select(F.col("k").alias("_k"), F.col("node").alias("_node"), F.col("n").alias("_n"))
    suffix = F.when(F.col("k") > 0, F.col("node").bitwiseAND(F.expr("shiftrightunsigned(-1L, 64 - 8 * k)")))
    both = nodes.withColumn("_suffix", F.coalesce(suffix, F.col("node"))).join(
        shorter, (F.col("_k") == F.col("k") - 1) & (F.col("_node") == F.col("_suffix")), "left"
    )
    return both.groupBy("k", F.shiftrightunsigned("node", 8).alias("context")).agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("symbols"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("excluded"),
        F.map_from_entries(F.collect_list(F.struct(F.col("node").bitwiseAND(F.lit(255)).cast("int"), "n"))).alias("seen"),
    )


def window_scores(asked: DataFrame, contexts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(window, log10)`` for all of ``asked (window)``: one join per order, from the longest context down."""
    symbol = F.col("window").bitwiseAND(F.lit(255)).cast("int")
    before = F.shiftrightunsigned("window", 8)
    rows = asked.select("window", F.lit(0.0).alias("log10"), F.lit(0).cast("long").alias("mass"), F.lit(0).cast("long").alias("out"), F.lit(False).alias("done"))
    for k in range(order, -1, -1):
        at = contexts.where(F.col("k") == k).drop("k")
        # What is done meets no context, but stays spread over the tasks.
        key = F.when(F.col("done"), -1 - before).otherwise(before.bitwiseAND(F.lit((1 << (8 * k)) - 1)))
        # There are at most 257 contexts of the two shortest orders.
        rows = rows.withColumn("_key", key).join(F.broadcast(at) if k <= 1 else at, F.col("_key") == F.col("context"), "left")
        n, there = F.element_at("seen", symbol), F.col("context").isNotNull()
        whole = F.col("total") + F.col("symbols") - F.col("mass") - F.col("out")
        step = F.when(there & n.isNotNull(), F.log10(n / whole)).when(there & (whole > 0), F.log10((F.col("symbols") - F.col("out")) / whole))
        rows = rows.select(
            "window",
            (F.col("log10") + F.coalesce(step, F.lit(0.0))).alias("log10"),
            F.coalesce("excluded", F.lit(0)).alias("mass"),
            F.coalesce("symbols", F.lit(0)).alias("out"),
            (F.col("done") | (there & n.isNotNull())).alias("done"),
        )
    return rows.select("window", F.when(F.col("done"), F.col("log10")).otherwise(F.col("log10") - F.log10(256 - F.col("out"))).alias("log10"))


def common_windows(windows: DataFrame, order: int = ORDER, share: float = SHARE) -> Common:
    """The windows with at least ``share`` of all counts, scored by the uncut counts of their contexts."""
    total = windows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") >= max(1.0, total * share)
    # A context has at most 256 windows.
    context = F.shiftrightunsigned("window", 8).alias("context")
    found = windows.groupBy(context).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("symbols"), F.collect_list(F.when(often, F.struct("window", "n"))).alias("kept")
    )
    rows = found.select("total", "symbols", F.explode("kept").alias("x")).select("x.window", "x.n", "total", "symbols")
    window, n, whole, symbols = (column.to_numpy() for column in rows.toArrow().columns)
    return Common(order, Table(window.view(np.uint64)), np.log10(n / (whole + symbols)))


def known_lengths(model: Common | Trie, texts: list[bytes], sums: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Add log10 probabilities of known windows to ``sums`` of texts; all other windows, with their text's number."""
    joined, starts = _joined(texts, model.order)
    rare, owners, held = [], [], 0
    for first, codes, scored in _windows(joined, starts, model.order, SCORE_SLICE):
        at = np.flatnonzero(scored)
        value = np.zeros(len(codes))
        value[at], missing = model.known(codes[at])
        a, b = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, first + len(codes), "left")
        sums[a:b] += np.add.reduceat(value, np.maximum(starts[a:b] - first, 0))
        # Windows that are not known repeat across slices: they wait for one another.
        rare.append(codes[at[missing]])
        owners.append(np.searchsorted(starts, first + at[missing], "right") - 1)
        held += len(missing)
        if held >= COUNT_SLICE:
            yield np.concatenate(rare), np.concatenate(owners)
            rare, owners, held = [], [], 0
    if held:
        yield np.concatenate(rare), np.concatenate(owners)


def code_lengths(trie: Trie, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each whole text and its end."""
    sums = np.zeros(len(texts))
    for rare, owners in known_lengths(trie, texts, sums):
        sums += np.bincount(owners, trie.escaping(rare), len(texts))
    return sums


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over ``texts (text)``; words are bytes between ASCII blanks, lower-cased."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, size = [], 0
            for text in _lowered(batch.column(0)):
                words += text.split()
                size += len(text)
                if size >= COUNT_SLICE:
                    yield _counted(words)
                    words, size = [], 0
            if words:
                yield _counted(words)

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(words: list[bytes]) -> pa.RecordBatch:
    both = pa.array(words, pa.binary()).value_counts()
    return pa.RecordBatch.from_arrays([both.field(0), both.field(1)], ["word", "n"])


def _often(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The counts of the commonest words: all with a count that at most ``most`` words reach."""
    tally = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(most)
    least, room = math.inf, most
    for row in tally.toLocalIterator():
        room -= row["words"]
        if room < 0:
            break
        least = row["n"]
    chosen = counts.where(F.col("n") >= F.lit(least)) if math.isfinite(least) else counts.limit(0)
    table = chosen.toArrow()
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))


def score_texts(
    df: DataFrame, is_training: Column, id_column: str = "doc_id", text_column: str = "text",
    order: int = ORDER, share: float = SHARE, known_words: int = KNOWN_WORDS,
) -> DataFrame:
    """``(<id>, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``df``.

    ``score`` is the log10 probability of the whole lower-cased text and its end under a byte-context
    trie that is learned from the training rows: an escape is estimated by the number of different
    bytes seen in a context, and bytes of a longer context are excluded from the shorter ones.
    ``base_score`` is that of a smoothed word-frequency model of the same rows.  Null texts count as
    empty; repeated rows score alike; no training rows leave the uniform model; an empty table gives an
    empty result.  Other columns are ignored.

    Counts cover all training texts, and every context and next byte seen there is used.  The scores of
    windows that have at least ``share`` of all training bytes are broadcast; all other windows are
    joined by shuffle.  The counts of up to ``known_words`` common words are broadcast; all other words
    are joined by shuffle.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_column}`").alias("_id"), is_training.alias("_train"), text_or_empty(text_column).alias("text"))
    train = rows.where("_train").select("text")
    windows = cut(window_counts(train, order))
    common = spark.sparkContext.broadcast(common_windows(windows, order, share))
    contexts = written(context_table(windows, order))
    counts = written(word_counts(train))
    n_texts = train.count()
    n_words, n_kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, kinds = n_words + n_texts, n_kinds + (n_texts > 0)
    below = math.log10(total + 0.5 * (kinds + 1))
    often = spark.sparkContext.broadcast(_often(counts, known_words))
    end = math.log10(n_texts + 0.5) - below

    names = ["_id", "_uid", "n_tokens", "_known", "_base", "_score", "_rare", "_windows"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_of = {word: math.log10(n + 0.5) - below for word, n in often.value.items()}.get
        for batch in batches:
            tokens, known, base, others = [], [], [], []
            texts = _lowered(batch.column(2))
            for text in texts:
                words = text.split()
                found = list(map(log_of, words))
                missing = [w for w, x in zip(words, found, strict=True) if x is None] if None in found else []
                tokens.append(len(words) + 1)
                known.append(len(words) - len(missing) + int(n_texts > 0))
                base.append(sum(filter(None, found)) + end)
                others.append(missing)
            sums = np.zeros(len(texts))
            for codes, owners in known_lengths(common.value, texts, sums):
                # Rows of their own, so that no row holds all windows of a long text.
                ends = np.flatnonzero(np.append(owners[1:] != owners[:-1], True))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends + 1), pa.int32()), pa.array(codes.view(np.int64)))
                uids = batch.column(1).take(pa.array(owners[ends]))
                blank = [pa.nulls(len(ends), kind) for kind in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(ends), batch.column(0).type), uids, *blank, lists], names)
            columns = [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(sums)]
            lists = [pa.array(others, pa.list_(pa.binary())), pa.nulls(len(texts), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, *lists], names)

    kind = dict(rows.dtypes)["_id"]
    both = written(
        rows.select("_id", F.monotonically_increasing_id().alias("_uid"), "text").mapInArrow(
            score, f"_id {kind}, _uid long, n_tokens long, _known long, _base double, _score double, _rare array<binary>, _windows array<long>"
        )
    )
    scored = both.where(F.col("n_tokens").isNotNull()).drop("_windows")
    pairs = both.where(F.col("n_tokens").isNull()).select("_uid", F.explode("_windows").alias("window"))
    pairs = pairs.groupBy("_uid", "window").agg(F.count(F.lit(1)).alias("_tf"))
    asked = both.select(F.explode("_windows").alias("window")).distinct()
    lengths = (
        pairs.join(window_scores(asked, contexts, order), "window")
        .groupBy("_uid")
        .agg(F.sum(F.col("_tf") * F.col("log10")).alias("_length"))
    )
    rare = scored.select("_uid", F.explode("_rare").alias("word")).groupBy("_uid", "word").agg(F.count(F.lit(1)).alias("_tf"))
    n = F.coalesce("n", F.lit(0))
    rest = (
        rare.join(counts, "word", "left")
        .groupBy("_uid")
        .agg(
            F.sum(F.col("_tf") * (F.log10(n + 0.5) - below)).alias("_more"),
            F.sum(F.when(n > 0, F.col("_tf")).otherwise(0)).alias("_also"),
        )
    )
    return scored.drop("_rare").join(rest, "_uid", "left").join(lengths, "_uid", "left").select(
        F.col("_id").alias(id_column),
        "n_tokens",
        (F.col("_known") + F.coalesce("_also", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_more", F.lit(0.0))).alias("base_score"),
        (F.col("_score") + F.coalesce("_length", F.lit(0.0))).alias("score"),
    )


def language_model_scores(docs: DataFrame) -> DataFrame:
    """:func:`score_texts` with rows held out whose id's crc32 as text leaves remainder 1 modulo 5.

    A null id is not held out.
    """
    held = F.coalesce(id_remainder("doc_id", 5) == 1, F.lit(False))
    scored = score_texts(docs.select("doc_id", "text"), ~held)
    return scored.select("doc_id", held.alias("held_out"), *scored.columns[1:])
