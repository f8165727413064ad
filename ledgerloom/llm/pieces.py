"""SentencePiece encoding and decoding by a relational lattice of word pieces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import text_or_empty, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose ids are sent to the executors, at most; the ids of all others travel by shuffle.
KNOWN_WORDS = 1 << 20
#: A position in a word up to here is one bit of a long integer.
MASK_BITS = 62
#: Stands for a blank in pieces (fixed value of the format).
BLANK = "▁"
#: Ways to cut a text into words, finest first: runs of letters and of other characters, or all between
#: blanks; each with the blanks before it.  One that cuts no piece in two cuts no encoding either.
NUMERALS = "²³¹¼-¾⁰-₟"  # word characters that are no letters
CUTS = (rf" *[^\W\d_{NUMERALS}]+| *(?:[^\w ]|[\d_{NUMERALS}])+| +", r" *[^ ]+| +")
#: Characters of text whose words are held at once.
TEXT_SLICE = 1 << 20
_CODEC = pa.Codec("zstd", compression_level=1)
#: Texts whose ids are put together at once.
ROW_SLICE = 512


@dataclass(frozen=True)
class Pieces:
    """The piece table: ``(piece with plain blanks, id, score)`` of whole pieces, and the ids of bytes."""

    table: tuple[tuple[str, int, float], ...]
    texts: tuple[bytes, ...]
    first_byte: int
    merging: bool
    cut: str

    @property
    def longest(self) -> int:
        return max(len(piece) for piece, _, _ in self.table)


def load_pieces(model: str | bytes = MODEL, merging: bool = True) -> Pieces:
    """Read the table on the driver.  ``merging``: the scores are an order of merges, not log probabilities."""
    import sentencepiece

    proto = model if isinstance(model, bytes) else open(model, "rb").read()
    reader = sentencepiece.SentencePieceProcessor(model_proto=proto)
    ids = range(len(reader))
    names = [reader.id_to_piece(i) for i in ids]
    single = [i for i in ids if reader.is_byte(i)]
    whole = [i for i in ids if not (reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i))]
    plain = [names[i].replace(BLANK, " ") for i in whole]
    cut = next((c for c in CUTS if all(len(re.findall(c, p)) == 1 for p in plain)), None)
    if cut is None:
        raise ValueError("a piece goes on after a word's end: words cannot be encoded one by one")
    texts = [b"" if reader.is_control(i) else bytes([single.index(i)]) if i in set(single) else names[i].replace(BLANK, " ").encode() for i in ids]
    table = tuple((names[i].replace(BLANK, " "), i, reader.get_score(i)) for i in whole)
    return Pieces(table, tuple(texts), single[0], merging, cut)


def _cutter(cut: str) -> Callable[[str], list[str]]:
    """Gives the words of a text, which begins with one more blank."""
    find = re.compile(cut).findall
    return lambda text: find(" " + text.replace(BLANK, " ")) if text else []


def distinct_words(texts: DataFrame, cut: str) -> DataFrame:
    """``(word, n)`` over ``texts (text)``: counted by slice, then summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _cutter(cut)
        for batch in batches:
            for part in _text_slices(batch.column(0).to_pylist()):
                both = pa.array([w for t in part for w in words(t)], pa.string()).value_counts()
                yield pa.RecordBatch.from_arrays([both.field(0), both.field(1)], ["word", "n"])

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _text_slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= TEXT_SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


# An edge of the lattice in one number: rank of the score, first and last border, id.  Borders are at most
# MASK_BITS; the highest id stands for a character that is no piece.
_EDGE = "(shiftleft(cast(rank AS bigint), 28) | shiftleft(cast(s AS bigint), 22) | shiftleft(cast(s + len AS bigint), 16) | coalesce(id, 65535))"
_S, _E = "cast(shiftright(x, 22) & 63 AS int)", "cast(shiftright(x, 16) & 63 AS int)"
_ENDS = f"(shiftright(m, {_S}) & shiftright(m, {_E}) & 1) = 1"
_INSIDE = f"(shiftleft(1L, {_E}) - shiftleft(2L, {_S}))"
#: All but the edges of single characters, of which each position has one; they come last and change nothing.
_LONGER = "slice(edges, 1, greatest(0, size(edges) - length(word)))"
#: Merge in rank order: an edge applies if its span is just two symbols, that is, one inner border.
_MERGED = f"aggregate({_LONGER}, ~shiftleft(-1L, length(word) + 1), (m, x) -> IF({_ENDS} AND bit_count(m & {_INSIDE}) = 1, m & ~{_INSIDE}, m))"
#: Best sum of scores up to each position: (sum, first character, id), edges by first character and length.
_BEST = """aggregate(
    edges, transform(sequence(0, length(word)), i -> named_struct('sum', IF(i = 0, 0D, CAST(NULL AS double)), 's', -1, 'id', -1)),
    (best, e) -> IF(best[e.s].sum IS NOT NULL AND (best[e.s + e.len].sum IS NULL OR best[e.s].sum + e.score > best[e.s + e.len].sum),
        transform(best, (b, i) -> IF(i = e.s + e.len, named_struct('sum', best[e.s].sum + e.score, 's', e.s, 'id', coalesce(e.id, 65535)), b)), best))"""
_PATH = """aggregate(
    sequence(1, length(word)), named_struct('at', length(word), 'path', CAST(array() AS array<bigint>)),
    (p, i) -> IF(p.at = 0, p, named_struct('at', best[p.at].s, 'path',
        concat(array(shiftleft(cast(best[p.at].s AS bigint), 22) | shiftleft(cast(p.at AS bigint), 16) | best[p.at].id), p.path)))).path"""


def _ids(first_byte: int) -> str:
    """Ids along ``path``; a character that is no piece becomes its bytes."""
    letter = f"hex(encode(substring(word, {_S} + 1, 1), 'utf-8'))"
    raw = f"transform(sequence(1, length({letter}), 2), i -> cast(conv(substring({letter}, i, 2), 16, 10) AS int) + {first_byte})"
    return f"flatten(transform(path, x -> IF((x & 65535) = 65535, {raw}, array(cast(x & 65535 AS int)))))"


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``(word, n, ids)`` for distinct ``words (word, n)``; ids are null beyond MASK_BITS characters.

    Substrings up to the longest piece are joined with the piece table (its size is fixed); the edges
    of a word meet in one row, where a fold finds the path.  A table with merge scores folds the edges
    in merge order over a bit mask of borders; one with log probabilities folds the best sums.  Where
    ``words`` is placed by word already, as a count leaves it, nothing is shuffled.
    """
    spark = words.sparkSession
    scores = sorted({score for _, _, score in pieces.table}, reverse=True)
    rank = {score: i for i, score in enumerate(scores)}
    rows = [(piece, i, min(rank[score], 65534), score) for piece, i, score in pieces.table]
    table = F.broadcast(spark.createDataFrame(rows, "piece string, id int, rank int, score double"))
    # A longer word stays, without edges.
    starts = F.explode_outer(F.expr(f"IF(length(word) <= {MASK_BITS}, sequence(0, length(word) - 1), array())"))
    spans = (
        words.select("word", "n", starts.alias("s"))
        .select("word", "n", "s", F.explode_outer(F.expr(f"sequence(1, least({pieces.longest}, length(word) - s))")).alias("len"))
        .select("word", "n", "s", "len", F.expr("substring(word, s + 1, len)").alias("piece"))
    )
    lost = min(score for _, _, score in pieces.table) - 10
    edges = spans.join(table, "piece", "left").where("id IS NOT NULL OR len = 1 OR len IS NULL")
    if pieces.merging:
        edges = edges.select("word", "n", F.expr(_EDGE.replace("rank AS", "IF(len = 1, 65535, rank) AS")).alias("edge"))
        met = edges.groupBy("word", "n").agg(F.sort_array(F.collect_list("edge")).alias("edges")).withColumn("m", F.expr(_MERGED))
        on_path = f"filter(edges, x -> {_ENDS} AND (m & {_INSIDE}) = 0)"
        path = met.select("word", "n", F.expr(f"sort_array(transform({on_path}, x -> x & {(1 << 28) - 1}))").alias("path"))
    else:
        edge = F.when(F.col("len").isNotNull(), F.struct("s", "len", F.coalesce("score", F.lit(lost)).alias("score"), "id"))
        met = edges.groupBy("word", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges")).withColumn("best", F.expr(_BEST))
        path = met.select("word", "n", F.when(F.size("edges") > 0, F.expr(_PATH)).alias("path"))
    ids = F.when(F.length("word") <= MASK_BITS, F.expr(_ids(pieces.first_byte)))
    return path.select("word", "n", ids.alias("ids"))


def _encode_long(word: str, ranks: dict[str, tuple[float, int]], pieces: Pieces) -> list[int]:
    """The same lattice and fold for one word beyond the bit mask."""
    n, longest = len(word), pieces.longest
    found = [(s, e, *ranks[word[s:e]]) for s in range(n) for e in range(s + 1, min(n, s + longest) + 1) if word[s:e] in ranks]
    ids = {(s, e): i for s, e, _, i in found}
    if pieces.merging:
        border = bytearray([1]) * (n + 1)
        for _, s, e in sorted((-score, s, e) for s, e, score, _ in found if e > s + 1):
            if border[s] and border[e] and sum(border[s + 1 : e]) == 1:
                border[s + 1 : e] = bytes(e - s - 1)
        cuts = [i for i in range(n + 1) if border[i]]
    else:
        lost = min(score for _, _, score in pieces.table) - 10
        best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        by_start = sorted([*found, *[(s, s + 1, lost, -1) for s in range(n) if (s, s + 1) not in ids]])
        for s, e, score, _ in by_start:
            if best[s] + score > best[e]:
                best[e], back[e] = best[s] + score, s
        cuts = [n]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
    out = []
    for s, e in zip(cuts, cuts[1:], strict=False):
        known = ids.get((s, e))
        out += [known] if known is not None else [b + pieces.first_byte for b in word[s:e].encode("utf-8", "replace")]
    return out


def _word_codes(words: pa.Array) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(words))


def _common_words(ids: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The commonest words, up to ``most``: ``(sorted hashes, their numbers, where ids end, ids)``.

    Numbers go by frequency, so that most are small.
    """
    tally = ids.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(most)
    least, room = None, most
    for row in tally.toLocalIterator():
        room -= row["words"]
        if room < 0:
            break
        least = row["n"]
    chosen = ids.where(F.col("n") >= F.lit(least)) if least is not None else ids.limit(0)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = pa.array(_word_codes(batch.column(0)).view(np.int64))
            yield pa.RecordBatch.from_arrays([codes, batch.column(1), batch.column(2)], ["code", "n", "ids"])

    table = chosen.select("word", "n", "ids").mapInArrow(coded, "code long, n long, ids array<int>").toArrow()
    codes, often = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    order = np.lexsort((codes, -often))
    lists = table.column(2).combine_chunks().take(pa.array(order))
    ends = np.cumsum(np.diff(lists.offsets.to_numpy())) if len(order) else np.zeros(0, int)
    codes = codes[order]
    numbers = np.argsort(codes)
    # An edge of the lattice holds an id in 16 bits as well.
    return codes[numbers], numbers.astype(np.int32), ends.astype(np.int32), lists.flatten().to_numpy().astype(np.uint16)


def _packed(refs: np.ndarray, ends: list[int]) -> Iterator[bytes]:
    """By text, numbers of words (other words are odd), byte plane by byte plane, compressed; four bytes of length first."""
    codes = np.where(refs >= 0, refs.astype(np.int64) * 2, -2 * refs.astype(np.int64) - 1).astype("<u4").view(np.uint8).reshape(-1, 4)
    for first, last in zip(ends, ends[1:], strict=False):
        planes = codes[first:last].T.tobytes()
        yield len(planes).to_bytes(4, "little") + _CODEC.compress(planes, asbytes=True)


def _unpacked(packed: pa.BinaryScalar) -> np.ndarray:
    raw = packed.as_buffer()
    size = int.from_bytes(raw[:4], "little")
    codes = np.frombuffer(_CODEC.decompress(raw[4:], size), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
    return np.where(codes % 2 == 0, codes // 2, -(codes + 1) // 2)


def _other_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(_uid, place, word)`` of the words of each text that have no number."""
    for batch in batches:
        others = batch.column(3)
        n = np.diff(others.offsets.to_numpy())
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        uid = np.repeat(batch.column(1).to_numpy(), n)
        yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(place.astype(np.int32)), others.flatten()], ["_uid", "place", "word"])


def encode(
    df: DataFrame, pieces: Pieces | None = None, id_column: str = "doc_id", text_column: str = "text",
    known_words: int = KNOWN_WORDS,
) -> DataFrame:
    """``(<id>, ids, n_ids)`` for every row of ``df``: the piece ids of its whole text.

    A null or empty text has no ids.  Blanks are kept, one blank is put before the text, and what no
    piece covers becomes bytes, so :func:`decode` gives the text back (U+2581, which stands for a blank,
    becomes one).  Repeated rows are encoded alike; ids of rows may be null; other columns are
    ignored; an empty table gives an empty result.

    Every distinct word of the corpus is encoded once by :func:`encode_words`; words longer than
    MASK_BITS by the same steps in an Arrow function.  Ids of the ``known_words`` commonest words are
    broadcast; a text's other words are sent to the word table, and their ids back, by shuffle.  Between
    the two a text travels as numbers of words, not as text.  ``df`` must be the same when it is read
    again.
    """
    pieces = pieces or load_pieces()
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_column}`").alias("_id"), text_or_empty(text_column).alias("text"))
    shared = spark.sparkContext.broadcast(pieces)

    def long_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = {piece: (score, i) for piece, i, score in shared.value.table}
        for batch in batches:
            batch["ids"] = [_encode_long(w, ranks, shared.value) for w in batch["word"]]
            yield batch[["word", "n", "ids"]]

    short = written(encode_words(distinct_words(rows.select("text"), pieces.cut), pieces))
    # Written, so that no later task needs two Python workers at once.
    far = written(short.where("ids IS NULL").select("word", "n").mapInPandas(long_words, "word string, n long, ids array<int>"))
    table = short.where("ids IS NOT NULL").unionByName(far)
    codes, numbers, ends, flat = _common_words(table, known_words)
    # Each step is sent only what it reads.
    numbers_of = spark.sparkContext.broadcast((codes, numbers))
    ids_of = spark.sparkContext.broadcast((ends, flat))

    cut = pieces.cut  # all of the piece table that this step needs

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (codes, numbers), words_of = numbers_of.value, _cutter(cut)
        for batch in batches:
            first = 0
            for part in _text_slices(batch.column(2).to_pylist()):
                words, ends = [], [0]
                for t in part:
                    words += words_of(t)
                    ends.append(len(words))
                known = pa.array(words, pa.string()).dictionary_encode()
                del words
                hashed = _word_codes(known.dictionary)
                at = np.minimum(np.searchsorted(codes, hashed), max(0, len(codes) - 1))
                number = np.where(codes[at] == hashed, numbers[at], -1) if len(codes) else np.full(len(hashed), -1)
                index = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                refs = number[index].astype(np.int32)
                # Other words get numbers below 0, by text.
                rare = refs < 0
                text = np.repeat(np.arange(len(part)), np.diff(ends))[rare]
                own, back = np.unique(text * len(number) + index[rare], return_inverse=True)
                begins = np.searchsorted(own, np.arange(len(part) + 1) * len(number))
                refs[rare] = -1 - (back - begins[text])
                others = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), known.dictionary.take(pa.array(own % max(1, len(number)))))
                packed = pa.array(_packed(refs, ends), pa.binary())
                ids = [batch.column(i).slice(first, len(part)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, packed, others], ["_id", "_uid", "refs", "others"])
                first += len(part)

    kind = dict(rows.dtypes)["_id"]
    sent = rows.select("_id", F.monotonically_increasing_id().alias("_uid"), "text").mapInArrow(
        numbered, f"_id {kind}, _uid long, refs binary, others array<string>"
    )
    # Both uses below read all columns of this exchange, so Spark makes it once.
    sent = sent.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_uid")
    asked = sent.mapInArrow(_other_words, "_uid long, place int, word string")
    found = asked.join(table.select("word", "ids"), "word").groupBy("_uid").agg(F.array_sort(F.collect_list(F.struct("place", "ids"))).alias("found"))

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, flat = ids_of.value
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else np.zeros(0, int)
        for whole in batches:
            for first in range(0, whole.num_rows, ROW_SLICE):
                batch = whole.slice(first, ROW_SLICE)
                parts = [_unpacked(x) for x in batch.column(1)]
                words = np.array([len(x) for x in parts], dtype=np.int64)
                refs = np.concatenate([*parts, np.zeros(0, np.int64)])
                # A text's own words: lists of ids, in the order of their places.
                own = batch.column(3)
                own_first = own.offsets.to_numpy()[:-1].astype(np.int64)
                lists = own.values.field("ids")
                own_ends, own_ids = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
                rare = refs < 0
                place = np.repeat(own_first, words)[rare] - 1 - refs[rare]
                begin, size = np.zeros(len(refs), np.int64), np.zeros(len(refs), np.int64)
                begin[~rare], size[~rare] = starts[refs[~rare]], ends[refs[~rare]] - starts[refs[~rare]]
                begin[rare], size[rare] = own_ends[place], own_ends[place + 1] - own_ends[place]
                at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
                by_rare = np.repeat(rare, size)
                ids = np.empty(len(at), dtype=np.int32)
                ids[~by_rare], ids[by_rare] = flat[at[~by_rare]], own_ids[at[by_rare]]
                total = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(words)])]
                out = pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0), out], ["_id", "ids"])

    ids = sent.join(found, "_uid", "left").select("_id", "refs", "others", "found").mapInArrow(resolved, f"_id {kind}, ids array<int>")
    return ids.select(F.col("_id").alias(id_column), "ids", F.size("ids").alias("n_ids"))


def decode(df: DataFrame, pieces: Pieces | None = None, ids_column: str = "ids", name: str = "text") -> DataFrame:
    """``df`` with the text of its ids in ``name``; null ids give null, bytes that are no UTF-8 are replaced."""
    pieces = pieces or load_pieces()
    shared = df.sparkSession.sparkContext.broadcast(pieces.texts)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = shared.value
        for lists in batches:
            raw = [None if x is None else b"".join([table[i] for i in x]).decode("utf-8", "replace") for x in lists]
            yield pd.Series([x[1:] if x is not None and x.startswith(" ") else x for x in raw], dtype=object)

    return df.withColumn(name, text(F.col(ids_column)))
