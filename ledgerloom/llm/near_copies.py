"""Near-duplicate classes: consistent weighted sampling of TF-IDF shingles, banded and verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import cut, text_or_empty, written

WORDS, SIMILARITY = 5, 0.8
#: A pair of weighted Jaccard similarity 0.8 shares one of the bands with probability 0.998.
BANDS, BAND_ROWS = 12, 4
#: Bits of a shingle's hash; its leading bits are a place, where a first pass counts all shingles that share it.
HASH_BITS, PLACE_BITS = 44, 20
#: A shingle is frequent if its documents are at least this share of the occurrences of all shingles; there are at most 2^18 of them.
FREQUENT = 2.0**-18
#: Random draws in the table that a hash picks from.
DRAWS = 1 << 16
#: Characters of text and rows of shingles that are worked on at once.
TEXT_SLICE, ROW_SLICE = 1 << 21, 1 << 16
#: Buckets up to this size are paired row by row, larger ones tile by tile.
SMALL_BUCKET, TILE = 8, 128

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * _MORE
    return x ^ (x >> np.uint64(32))


def _slices(texts: list[str]) -> Iterator[slice]:
    """Consecutive texts of about TEXT_SLICE characters; a longer text is on its own."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > TEXT_SLICE:
            yield slice(first, i)
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield slice(first, len(texts))


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (lower case, between white space), and where each text's words end."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string()))))
    words = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    known = words.dictionary_encode()
    from xxhash import xxh3_64_intdigest

    table = np.fromiter(
        map(xxh3_64_intdigest, known.dictionary.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(known.dictionary)
    )
    hashes = table[known.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    blank = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)
    if blank.any():  # an empty text splits into one empty word
        owner = np.repeat(np.arange(len(texts)), counts)[~blank]
        hashes, counts = hashes[~blank], np.bincount(owner, minlength=len(texts))
    return hashes, np.cumsum(counts)


def _grams(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, shingle)`` of every place where a shingle starts, from the hashes of words."""
    n = np.diff(np.concatenate([[0], ends]))
    owner = np.repeat(np.arange(len(n)), n)
    width = np.minimum(n, WORDS)[owner]
    whole = np.zeros(len(hashes), dtype=np.uint64)
    for step in range(WORDS):
        nearby = np.concatenate([hashes[step:], np.zeros(min(step, len(hashes)), dtype=np.uint64)])
        whole = whole * _ODD + np.where(width > step, nearby, np.uint64(0))
    starts = np.arange(len(hashes)) + width <= ends[owner]
    return owner[starts], _mixed(whole[starts]) >> np.uint64(64 - HASH_BITS)


def _counted(owner: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, shingle, times)``, sorted."""
    keys = np.sort((owner.astype(np.uint64) << np.uint64(HASH_BITS)) | grams)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    times = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> np.uint64(HASH_BITS)).astype(int), keys & np.uint64((1 << HASH_BITS) - 1), times


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, shingle, times, fingerprints)`` of whole texts, sorted by text and shingle.

    A text of fewer than five words has one shingle, all of its words; one without words has none.
    The fingerprint (two numbers) stands for the exact sequence of words.
    """
    hashes, ends = _word_hashes(texts)
    n = np.diff(np.concatenate([[0], ends]))
    place = (np.arange(len(hashes)) - np.repeat(ends - n, n)).astype(np.uint64)
    prints = np.zeros((len(texts), 2), dtype=np.uint64)
    if len(hashes):
        full = np.flatnonzero(n)
        for i, odd in enumerate((_ODD, _MORE)):
            prints[full, i] = np.add.reduceat(_mixed(hashes + odd * (place + np.uint64(1))), (ends - n)[full])
    return *_counted(*_grams(hashes, ends)), prints


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(HASH_BITS - PLACE_BITS)).astype(np.int64)


@dataclass
class Weights:
    """Inverse document frequencies, from 1 (in every text) to 2: those of ``frequent`` shingles (sorted), and the one of all others."""

    frequent: np.ndarray
    weights: np.ndarray
    rare: float

    def __post_init__(self) -> None:
        self.places = np.zeros(1 << PLACE_BITS, dtype=bool)
        self.places[_places(self.frequent)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.rare, dtype=np.float32)
        maybe = np.flatnonzero(self.places[_places(hashes)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.frequent, hashes[maybe]), len(self.frequent) - 1)
            met = self.frequent[at] == hashes[maybe]
            out[maybe[met]] = self.weights[at[met]]
        return out


def _occurrences(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and of all shingles (repeats included) in every place; the table has a fixed size."""
    pieces = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(1 << PLACE_BITS, dtype=np.int64), 0
        for batch in batches:
            rows = batch.column(0).to_pylist()
            total += len(rows)
            for part in _slices(rows):
                seen += np.bincount(_places(_grams(*_word_hashes(rows[part]))[1]), minlength=len(seen))
        packed = [x.tobytes() for x in np.split(seen.astype(np.int32), pieces)]
        n = [total] + [0] * (pieces - 1)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array(packed), pa.array(n, pa.int64())], ["piece", "seen", "n"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros((1 << PLACE_BITS) // pieces, dtype=np.int64)
        for one in rows["seen"]:
            seen += np.frombuffer(one, dtype=np.int32)
        return pd.DataFrame({"piece": [rows["piece"].iloc[0]], "seen": [seen.tobytes()], "n": [rows["n"].sum()]})

    kind = "piece int, seen binary, n long"
    summed = texts.mapInArrow(count, kind).groupBy("piece").applyInPandas(add, kind).toPandas().sort_values("piece")
    total = int(summed["n"].sum())
    return total, np.concatenate([np.frombuffer(x, dtype=np.int64) for x in summed["seen"]]) if total else np.zeros(1 << PLACE_BITS, np.int64)


def inverse_frequencies(texts: DataFrame) -> Weights:
    """Weights of shingles by their exact document frequencies over all ``texts (text)``.

    A shingle in ``df`` of ``N`` texts weighs ``1 + ln(N/df) / ln(N/rare)``, where ``rare`` is the share FREQUENT of all
    occurrences of shingles (T); any shingle in fewer texts weighs 2.  So the weight depends on the share of texts and on
    their mean length, not on the number of texts.  A first pass counts occurrences by place: only in places with
    at least ``rare`` of them can a shingle be frequent.  The shingles of those places are then counted one by one.  As document
    frequencies add up to T at most, no more than 2^18 shingles reach the driver.
    """
    total, seen = _occurrences(texts)
    rare = float(seen.sum()) * FREQUENT
    if not rare or rare >= total:
        return Weights(np.zeros(0, np.uint64), np.zeros(0, np.float32), 2.0)
    wanted = texts.sparkSession.sparkContext.broadcast(np.packbits(seen >= rare))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = np.unpackbits(wanted.value).astype(bool)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for part in _slices(rows):
                owner, grams = _grams(*_word_hashes(rows[part]))
                some = open_[_places(grams)]
                found, n = np.unique(_counted(owner[some], grams[some])[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    frequent = texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("df")).where(F.col("df") >= rare).toArrow().sort_by("gram")
    df = frequent["df"].to_numpy()
    weights = 1 + np.log(total / df) / np.log(total / rare)
    return Weights(frequent["gram"].to_numpy().astype(np.uint64), weights.astype(np.float32), 2.0)


def random_draws(seed: int = 17) -> np.ndarray:
    """A table of ``r``, ``ln c`` and ``beta`` for consistent weighted sampling."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.gamma(2, 1, DRAWS), np.log(rng.gamma(2, 1, DRAWS)), rng.random(DRAWS)]).astype(np.float32)


def band_keys(owner: np.ndarray, hashes: np.ndarray, log_weight: np.ndarray, n_texts: int, draws: np.ndarray) -> np.ndarray:
    """``(n_texts, BANDS)`` keys; texts without shingles keep zeros.

    Sample ``j`` of a text is the shingle with the smallest ``ln a = ln c - r (t - beta) - r`` where
    ``t = floor(ln w / r + beta)``, together with ``t``; ``r``, ``c`` and ``beta`` depend on the shingle and ``j``.
    """
    keys = np.zeros((n_texts, BANDS), dtype=np.uint64)
    bounds = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, int)
    r_all, c_all, beta_all = draws
    group = 0
    while group < len(bounds):
        first = bounds[group]
        last_group = max(group + 1, int(np.searchsorted(bounds, first + ROW_SLICE)))
        last = bounds[last_group] if last_group < len(bounds) else len(owner)
        h, ln_w = hashes[first:last], log_weight[first:last]
        starts, texts = bounds[group:last_group] - first, owner[bounds[group:last_group]]
        low = h.astype(np.uint32)
        for j in range(BANDS * BAND_ROWS):
            factor = np.uint64((int(_ODD) * (2 * j + 1)) % (1 << 64))
            pick = ((h * factor + np.uint64(j)) * _MORE) >> np.uint64(48)
            pick = pick.astype(np.int64)
            r, beta = r_all[pick], beta_all[pick]
            t = np.floor(ln_w / r + beta)
            bits = (c_all[pick] - r * (t - beta) - r).view(np.uint32)
            # Floats as integers of the same order, above a sign for shingle and level.
            order = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
            sign = (low ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x85EBCA6B))).astype(np.uint64)
            least = np.minimum.reduceat((order << np.uint64(32)) | sign, starts)
            band = j // BAND_ROWS
            keys[texts, band] = _mixed(keys[texts, band] * _ODD + least + np.uint64(j + 1))
        group = last_group
    return keys


def _weighted(texts: list[str], weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owner, hashes, times, _ = shingles(texts)
    return owner, hashes, times * weights.of(hashes).astype(float)


def similarities(left: list[str], right: list[str], weights: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts; 1 for two texts without words."""
    (a, ha, wa), (b, hb, wb) = _weighted(left, weights), _weighted(right, weights)
    ka, kb = (a.astype(np.uint64) << np.uint64(HASH_BITS)) | ha, (b.astype(np.uint64) << np.uint64(HASH_BITS)) | hb
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    n = len(left)
    shared = np.bincount(a[i], np.minimum(wa[i], wb[j]), n)
    whole = np.bincount(a, wa, n) + np.bincount(b, wb, n) - shared
    return np.where(whole > 0, shared / np.maximum(whole, 1e-12), 1.0)


def _tile_links(rows: pd.DataFrame, weights: Weights, least: float) -> list[tuple[str, str]]:
    """Links of similar texts between a tile of the smaller classes and a tile of the whole bucket.

    Pairs that are in one class already, or come to be, are not compared.
    """
    few, many = rows[rows["_few"]], rows[~rows["_few"]]
    if few.empty or many.empty:
        return []
    names, classes = many["v"].to_numpy(), many["c"].to_numpy().copy()
    own = dict(zip(few["v"], few["c"], strict=True))
    owner, hashes, w = _weighted(list(many["text"]), weights)
    order = np.argsort(hashes, kind="stable")
    owner, hashes, w = owner[order], hashes[order], w[order]
    sums = np.bincount(owner, w, len(many))
    links = []
    for v, text in zip(few["v"], few["text"], strict=True):
        _, h, x = _weighted([text], weights)
        a, b = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        at = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
        shared = np.bincount(owner[at], np.minimum(w[at], np.repeat(x, b - a)), len(many))
        similar = shared >= least * (sums + x.sum() - shared)
        for i in np.flatnonzero(similar & (classes != own[v])):
            if classes[i] != own[v]:
                links.append((v, names[i]))
                old, new = own[v], classes[i]
                classes[classes == old] = new
                own = {k: new if c == old else c for k, c in own.items()}
    return links


def connected(edges: DataFrame) -> DataFrame:
    """``(v, c)``: the smallest vertex of each vertex's component, from ``edges (a, b)``.

    Every round takes the smallest label among neighbours and then the label of the label, so chains
    shorten by halves.  Each round is checkpointed; only counts come to the driver.
    """
    both = edges.select(F.col("a").alias("s"), F.col("b").alias("d")).unionByName(edges.select(F.col("b").alias("s"), F.col("a").alias("d")))
    both = cut(both.where("s <> d").distinct())
    labels = cut(both.groupBy(F.col("s").alias("v")).agg(F.least(F.col("s"), F.min("d")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("v").alias("d"), "c"), "d").groupBy(F.col("s").alias("v")).agg(F.min("c").alias("m"))
        joined = cut(labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c")))
        roots = joined.select(F.col("v").alias("c"), F.col("c").alias("root"))
        jumped = cut(joined.join(roots, "c").select("v", "old", F.col("root").alias("c")))
        labels = jumped.select("v", "c")
        if not jumped.where("old <> c").count():
            return labels


def _signatures(rows: DataFrame, weights: Broadcast) -> DataFrame:
    """``(_id, _hash, v, size, bands)`` of ``rows (_id, _hash, text)``; no bands where there are no words."""
    shared = rows.sparkSession.sparkContext.broadcast(random_draws())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, draws = weights.value, shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for part in _slices(texts):
                owner, hashes, times, prints = shingles(texts[part])
                n = part.stop - part.start
                keys = band_keys(owner, hashes, np.log(times * idf.of(hashes)).astype(np.float32), n, draws)
                some = np.zeros(n, dtype=bool)
                some[owner] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, n), batch.column(1).slice(part.start, n),
                        pa.array([f"{a:016x}{b:016x}" for a, b in prints.tolist()]),
                        pa.array([len(t) for t in texts[part]], pa.int64()),
                        pa.array([k if s else None for k, s in zip(keys.view(np.int64).tolist(), some, strict=True)], pa.list_(pa.int64())),
                    ],
                    ["_id", "_hash", "v", "size", "bands"],
                )

    return rows.mapInArrow(sign, f"_id {dict(rows.dtypes)['_id']}, _hash long, v string, size long, bands array<long>")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``(<id>, class_id, class_size, kept)``, one row per row of ``df``.

    Two texts are linked if the weighted Jaccard similarity of their five-word shingles (lower case,
    between white space), weighted by term frequency times inverse document frequency, is at least
    ``least``; a class is what links connect.  ``class_id`` is the smallest id of the class; its row is
    kept, once.  Texts with the same words in the same order are one text: null counts as empty, and
    all texts without words are one class.  Rows with a null id take part; they are kept only where no
    row of the class has an id.  Other columns are ignored.  An empty table gives an empty result.

    Equal texts are grouped first, so that a group of copies counts once.  In every bucket all texts are
    compared with the bucket's first; then, wherever a bucket still holds several classes, its texts
    outside the largest class are compared with all others of the bucket.  No pair that shares a
    bucket is left out unless both texts are in one class already, and no bucket is cut.
    """
    text = text_or_empty(text_column)
    rows = df.select(F.col(f"`{id_column}`").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(inverse_frequencies(rows.select("text")))
    signed = written(_signatures(rows, shared))
    first = F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_hash").alias("hash")))
    groups = cut(signed.groupBy("v").agg(first.alias("row"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")))

    @F.pandas_udf("double")
    def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            a, b = list(a), list(b)
            yield pd.Series([x for p in _slices([s + t for s, t in zip(a, b, strict=True)]) for x in similarities(a[p], b[p], shared.value)], dtype=float)

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts, "a").withColumnRenamed("text", "left").join(texts.select(F.col("a").alias("b"), F.col("text").alias("right")), "b")
        return both.where(similarity("left", "right") >= least).select("a", "b")

    placed = groups.where(F.col("bands").isNotNull()).select("v", F.posexplode("bands").alias("band", "key"))
    heads = placed.groupBy("band", "key").agg(F.min("v").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = cut(placed.join(heads, ["band", "key"]))
    members = buckets.select("v").distinct()
    wanted = groups.join(members, "v", "left_semi").select("v", "row.id", "row.hash")
    found = rows.join(wanted, (F.col("_hash") == F.col("hash")) & F.col("_id").eqNullSafe(F.col("id")))
    texts = written(found.groupBy(F.col("v").alias("a")).agg(F.first("text").alias("text")))
    stars = cut(linked(buckets.where("v <> head").select(F.col("v").alias("a"), F.col("head").alias("b")).distinct()))
    classes = connected(stars)

    own = buckets.where("n > 2").join(classes, "v", "left").withColumn("c", F.coalesce("c", "v"))
    sizes = own.groupBy("band", "key", "c").agg(F.count(F.lit(1)).alias("m"))
    mixed = sizes.groupBy("band", "key").agg(F.count(F.lit(1)).alias("classes"), F.max_by("c", F.struct("m", "c")).alias("largest")).where("classes > 1")
    open_ = cut(own.join(mixed, ["band", "key"]).select("band", "key", "v", "c", "n", "head", "largest"))
    x, y = open_.where(F.col("n") <= SMALL_BUCKET).alias("x"), open_.where(F.col("n") <= SMALL_BUCKET).alias("y")
    near = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.v") < F.col("y.v")) & (F.col("x.c") != F.col("y.c"))
    # The bucket's first text has met all others.
    pairs = x.join(y, near).where("x.v <> x.head").select(F.col("x.v").alias("a"), F.col("y.v").alias("b")).distinct()
    large = open_.where(F.col("n") > SMALL_BUCKET)
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    tile = F.pmod(F.xxhash64("v"), tiles).cast("int")
    every = F.explode(F.sequence(F.lit(0), tiles - 1))
    few = large.where("c <> largest").select("band", "key", "v", "c", tile.alias("s"), every.alias("t"), F.lit(True).alias("_few"))
    many = large.select("band", "key", "v", "c", every.alias("s"), tile.alias("t"), F.lit(False).alias("_few"))
    asked = few.select("band", "key", "s").distinct()
    tiled = few.unionByName(many.join(asked, ["band", "key", "s"], "left_semi").select(few.columns)).join(texts.withColumnRenamed("a", "v"), "v")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_tile_links(rows, shared.value, least), columns=["a", "b"], dtype=object)

    more = tiled.groupBy("band", "key", "s", "t").applyInPandas(compare, "a string, b string")
    # The classes of the first round are the vertices of the second, so its graph is small.
    first_a, first_b = classes.select(F.col("v").alias("a"), F.col("c").alias("_a")), classes.select(F.col("v").alias("b"), F.col("c").alias("_b"))
    between = linked(pairs).unionByName(more).join(first_a, "a", "left").join(first_b, "b", "left")
    between = between.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    merged = connected(between).select(F.col("v").alias("_first"), F.col("c").alias("_merged"))
    of_group = groups.join(classes, "v", "left").withColumn("_first", F.coalesce("c", "v")).join(merged, "_first", "left")
    of_group = of_group.select("v", "row", "copies", F.coalesce("_merged", "_first").alias("c"))
    best = of_group.groupBy("c").agg(F.min("row").alias("best"), F.sum("copies").alias("class_size"))
    named = of_group.join(best, "c").select("v", "best", "class_size")
    # Of rows that repeat id and text the first one stands for all.
    ranked = signed.select("_id", "_hash", "v").join(named, "v")
    is_best = F.col("_id").eqNullSafe(F.col("best.id")) & (F.col("_hash") == F.col("best.hash"))
    return ranked.select(
        F.col("_id").alias(id_column), F.col("best.id").alias("class_id"), "class_size", is_best.alias("kept"), F.col("_hash").alias("text_hash")
    )


def without_near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` that stand for their classes, with all their columns; one row a class."""
    kept = near_duplicates(df, id_column, text_column, least).where("kept")
    kept = kept.select(F.col(id_column).alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{id_column}`").alias("_of"), F.xxhash64(text_or_empty(text_column)).alias("_text"))
    met = packed.join(kept, F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")))
    one = met.groupBy("_of", "_text").agg(F.first("_row").alias("_row"))
    return one.select([F.col("_row").getField(c).alias(c) for c in df.columns])
