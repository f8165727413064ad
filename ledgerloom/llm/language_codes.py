"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ledgerloom.llm.shared import cut, id_remainder, text_or_empty, written
from ledgerloom.scale import small_side

#: n-grams of these many characters are counted, all in one table of hashed places.
ORDERS = (1, 2, 3)
PLACES = 1 << 16
SMOOTHING = 0.5
#: Up to here every way to cut the languages in two is a bit; beyond, seeded random bits, some for each doubling.
EXHAUSTIVE, BITS_PER_DOUBLING, DRAWS = 5, 10, 64
#: Labelled rows that the bits' margins are calibrated on, at most (about), for each language.
CALIBRATION_ROWS = 1500
#: One of so many training rows is for calibration, the others are counted.
CALIBRATION_FOLD = 8
#: A prediction is ambiguous if its probability leads the next one by less.
LEAD = 0.2
#: Numbers (characters times bits) that one step holds, about.
STEP_NUMBERS = 1 << 22
UNDETERMINED = "und"
_BLANK, _TAIL = 32, max(ORDERS) - 1


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 for each language, columns different from each other and from their complements.

    Few languages get every cut in two; more get random columns, the best of some draws by the
    smallest distance between rows.
    """
    if languages <= 1:
        return np.ones((languages, 0), dtype=np.int8)
    if languages <= EXHAUSTIVE:
        cuts = [c for c in itertools.product((1, -1), repeat=languages - 1) if -1 in c]
        return np.array([(1, *c) for c in cuts], dtype=np.int8).T.copy()
    bits, rng = BITS_PER_DOUBLING * math.ceil(math.log2(languages)), np.random.default_rng(seed)
    best, most = None, -1
    for _ in range(DRAWS):
        drawn = np.where(rng.random((languages, 4 * bits)) < 0.5, 1, -1).astype(np.int8)
        drawn *= drawn[0]
        drawn = np.unique(drawn[:, np.abs(drawn.sum(axis=0)) < languages], axis=1)
        code = drawn[:, rng.permutation(drawn.shape[1])[:bits]]
        agree = code.astype(np.int32) @ code.T
        np.fill_diagonal(agree, -code.shape[1])
        if (least := code.shape[1] - int(agree.max())) > most:
            best, most = code, least
    return best


_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0][codes]


@dataclass
class _Step:
    """n-grams of some texts: by order and end character the place (PLACES: none), where each text begins
    among the characters, its row, and by row the n-grams and letters."""

    places: list[np.ndarray]
    starts: np.ndarray
    rows: np.ndarray
    grams: np.ndarray
    letters: np.ndarray


def _steps(texts: list[str], size: int) -> Iterator[_Step]:
    """The n-grams of ``texts``, some characters at a time.

    Letters are lower-cased, all between two words is one blank, and no n-gram spans two texts.  A text
    longer than ``size`` comes in parts; each part knows the last characters of the one before.
    """
    part: list[tuple[int, str]] = []
    held = 0
    for row, text in enumerate(texts):
        for first in range(0, len(text), size):
            piece = text[first : first + size]
            if part and held + len(piece) > size:
                yield _places(part, len(texts))
                # A text that goes on keeps its tail.
                part, held = ([_tail(part)] if first else []), 0
            part.append((row, piece))
            held += len(piece)
    if part:
        yield _places(part, len(texts))


def _tail(part: list[tuple[int, str]]) -> tuple[int, str]:
    """What n-grams of the last text's next piece may reach back to; marked by a negative row."""
    row = part[-1][0]
    text = "".join(piece for of, piece in part[-2:] if of in (row, -1 - row))
    end: list[str] = []
    for c in reversed(text):
        if c.isalpha():
            end.append(c)
        elif not end or end[-1] != " ":
            end.append(" ")
        if len(end) > _TAIL:
            break
    return -1 - row, "".join(reversed(end))


def _places(part: list[tuple[int, str]], n_rows: int) -> _Step:
    codes, rows, lengths, old = [], [], [], []
    before = None
    for row, text in part:
        own = row if row >= 0 else -1 - row
        raw = np.frombuffer(text.replace("\0", " ").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        if own != before:  # an end between texts, then a blank
            raw = np.concatenate([np.array([0, _BLANK], dtype=np.uint32), raw])
            before = own
        codes.append(raw)
        rows.append(own)
        lengths.append(len(raw))
        old.append(row < 0)
    code, row = np.concatenate(codes), np.repeat(np.array(rows, dtype=np.int32), lengths)
    letter = _is_letter(code)
    gap = ~letter & (code != 0)
    code[gap] = _BLANK
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    new = None
    if any(old):
        new = ~np.repeat(np.array(old), lengths)
        letter &= new
        new = new[keep]
    letters = np.bincount(row[letter], minlength=n_rows)
    code, row = code[keep], row[keep]
    ends = code == 0
    hashed, places, grams = code, [], np.zeros(n_rows)
    barred = ends.copy()
    for order in ORDERS:
        # The hash of the n-gram that ends here, from that of the one before it; it must not reach beyond the text.
        if order > 1:
            hashed = np.concatenate([np.zeros(1, np.uint32), hashed[:-1]]) * np.uint32(0x01000193) + code
            barred[order - 1 :] |= ends[: len(ends) - order + 1]
        place = (((hashed + np.uint32(order)) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
        none = barred | (code == _BLANK) if order == 1 else barred
        none = none if new is None else none | ~new
        place[none] = PLACES
        grams += np.bincount(row[~none], minlength=n_rows)
        places.append(place)
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    return _Step(places, starts, row[starts], grams, letters)


def ngram_counts(rows: DataFrame) -> DataFrame:
    """``(lang, place, n)`` over ``rows (lang, text)``; counted by task, summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                there = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(there), pa.string()), pa.array(there.astype(np.int32)), pa.array(n[there])], ["lang", "place", "n"]
                )

        for batch in batches:
            known = batch.column(0).dictionary_encode()
            names, index = known.dictionary.to_pylist(), known.indices.to_numpy(zero_copy_only=False)
            for step in _steps(batch.column(1).to_pylist(), STEP_NUMBERS // 32):
                lang = np.repeat(index[step.rows], np.diff([*step.starts, len(step.places[0])]))
                for i in np.unique(index[step.rows]):
                    n = sum(np.bincount(places[lang == i], minlength=PLACES + 1)[:PLACES] for places in step.places)
                    sums[names[i]] = sums[names[i]] + n if names[i] in sums else n
            if len(sums) > 64:  # keeps a task small where languages are many
                yield from out()
                sums.clear()
        yield from out()

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, place int, n long")
    return counted.groupBy("lang", "place").agg(F.sum("n").alias("n"))


def bit_weights(counts: DataFrame, totals: dict[str, int], code: np.ndarray) -> np.ndarray:
    """Log odds of each bit for each place, ``PLACES + 1`` rows; the languages of a side weigh alike."""
    languages = sorted(totals)
    number = {lang: i for i, lang in enumerate(languages)}
    size = np.array([totals[lang] for lang in languages], dtype=float) + SMOOTHING * PLACES
    weights = np.zeros((PLACES + 1, code.shape[1]), dtype=np.float32)
    if not code.shape[1]:
        return weights
    block = 1024

    def weigh(rows: pd.DataFrame) -> pd.DataFrame:
        places, at = np.unique(rows["place"].to_numpy(), return_inverse=True)
        n = np.full((len(places), len(languages)), SMOOTHING)
        n[at, rows["lang"].map(number).to_numpy()] += rows["n"].to_numpy()
        share = n / size
        plus, minus = (code > 0).astype(float), (code < 0).astype(float)
        odds = np.log(share @ (plus / plus.sum(axis=0))) - np.log(share @ (minus / minus.sum(axis=0)))
        return pd.DataFrame({"place": places, "odds": list(odds.astype(np.float32))})

    grouped = counts.where(F.col("lang").isin(languages)) if len(languages) < 100 else counts
    found = grouped.groupBy(F.floor(F.col("place") / block)).applyInPandas(weigh, "place int, odds array<float>").toArrow()
    weights[found.column(0).to_numpy()] = np.vstack([*found.column(1).combine_chunks().flatten().to_numpy().reshape(-1, code.shape[1])])
    return weights


def margins(df: DataFrame, weights: np.ndarray, kept: list[str]) -> DataFrame:
    """``kept`` columns of ``df (.., text)`` with ``margins`` (per bit, null without letters)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    bits = weights.shape[1]
    size = max(1 << 12, STEP_NUMBERS // (4 * max(1, bits)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            n_rows = batch.num_rows
            total, grams, letters = np.zeros((n_rows, bits)), np.zeros(n_rows), np.zeros(n_rows, np.int64)
            for step in _steps(batch.column(batch.num_columns - 1).to_pylist(), size):
                letters += step.letters
                grams += step.grams
                odds = table.take(step.places[0], axis=0)
                for places in step.places[1:]:
                    odds += table.take(places, axis=0)
                total[step.rows] += np.add.reduceat(odds, step.starts, axis=0)
            margin = total / np.sqrt(np.maximum(grams, 1.0))[:, None]
            flat = pa.ListArray.from_arrays(pa.array((np.arange(n_rows + 1) * bits).astype(np.int32)), pa.array(margin.ravel()))
            lists = pa.array([x if k else None for x, k in zip(flat.to_pylist(), letters, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*kept, "margins"])

    schema = StructType([*df.select(*kept).schema.fields, StructField("margins", ArrayType(DoubleType()))])
    return df.select(*kept, "text").mapInArrow(scored, schema)


@dataclass
class LanguageModel:
    """Code of the languages, log odds of n-grams by bit, calibration and weight of each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    slopes: np.ndarray
    offsets: np.ndarray
    bit_shares: np.ndarray
    sharpness: float

    def predict(self, df: DataFrame, text_column: str = "text") -> DataFrame:
        """``df`` with ``lang_pred``, ``score`` and ``ambiguous`` (these names replace columns of the input).

        The score is the probability of the chosen language among all learned ones.  A text without
        letters (null and empty ones too) is ``und`` with score 0, and so is every text if nothing was learned.
        """
        own = ("lang_pred", "score", "ambiguous")
        kept = [c for c in df.columns if c.lower() not in own]
        row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row")
        packed = df.select(row, text_or_empty(text_column).alias("text"))
        if not self.languages:
            return packed.select("_row.*", F.lit(UNDETERMINED).alias(own[0]), F.lit(0.0).alias(own[1]), F.lit(False).alias(own[2]))
        model = LanguageModel(self.languages, self.code, self.weights[:0], self.slopes, self.offsets, self.bit_shares, self.sharpness)

        @F.pandas_udf("struct<lang_pred string, score double, ambiguous boolean>")
        def decoded(lists: pd.Series) -> pd.DataFrame:
            return model.decode(lists)

        out = margins(packed, self.weights, ["_row"]).select("_row", decoded("margins").alias("_found"))
        return out.select("_row.*", *[F.col(f"_found.{c}") for c in own])

    def probabilities(self, found: np.ndarray) -> np.ndarray:
        """Loss-weighted decoding: a language's loss sums the logistic losses of its bits, by their weights."""
        logits = np.clip(found * self.slopes + self.offsets, -30, 30)
        loss = np.log1p(np.exp(-logits[:, None, :] * self.code[None, :, :])) @ self.bit_shares
        likely = -self.sharpness * loss
        likely = np.exp(likely - likely.max(axis=1, keepdims=True))
        return likely / likely.sum(axis=1, keepdims=True)

    def decode(self, lists: pd.Series) -> pd.DataFrame:
        there = lists.notna().to_numpy()
        pred, score = np.full(len(lists), UNDETERMINED, dtype=object), np.zeros(len(lists))
        ambiguous = np.zeros(len(lists), bool)
        if there.any():
            found = np.array([np.asarray(x, dtype=float) for x in lists[there]]).reshape(there.sum(), -1)
            chance = self.probabilities(found)
            best = chance.argmax(axis=1)  # the first of equal ones
            pred[there], score[there] = np.array(self.languages, dtype=object)[best], chance.max(axis=1)
            if chance.shape[1] > 1:
                two = np.partition(chance, -2, axis=1)[:, -2:]
                ambiguous[there] = two[:, 1] - two[:, 0] < LEAD
        return pd.DataFrame({"lang_pred": pred, "score": score, "ambiguous": ambiguous})


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit with a small penalty on the slope."""
    scale = max(float(np.abs(x).mean()), 1e-9)
    features = np.column_stack([x / scale, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        slope = features.T @ (weight * (p - y)) + 1e-3 * weight.sum() * beta * [1, 0]
        curve = (features * (weight * p * (1 - p))[:, None]).T @ features + np.diag([1e-3 * weight.sum(), 1e-9])
        step = np.linalg.solve(curve, slope)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def fit_languages(rows: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> LanguageModel:
    """Learn from ``rows (doc_id, text, lang)``; null languages and texts without letters teach nothing.

    All rows are counted but one in CALIBRATION_FOLD (by a hash of id and text), from which about
    ``calibration_rows`` of each language at most fit slope, offset and weight of every bit.  A language
    that has rows only there is counted from them.
    """
    held = F.pmod(F.xxhash64(F.lit(3), F.col("doc_id"), F.col("text")), F.lit(CALIBRATION_FOLD)) == 0
    known = rows.where(F.col("lang").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    counts = written(ngram_counts(known.where(~held)))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).toLocalIterator()}
    sizes = known.where(held).groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))
    place = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id"), F.col("text")), F.lit(1 << 20))
    share = F.least(F.lit(1.0), F.lit(float(calibration_rows)) / F.col("_rows")) * (1 << 20)
    sample = known.where(held).join(small_side(sizes), "lang").where(place < share)
    if not totals:  # too few rows to set any apart
        counts = written(ngram_counts(known))
        totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).toLocalIterator()}
    else:
        rest = known.where(held).join(small_side(counts.select("lang").distinct()), "lang", "left_anti")
        late = written(ngram_counts(rest))
        more = {r["lang"]: r["n"] for r in late.groupBy("lang").agg(F.sum("n").alias("n")).toLocalIterator()}
        if more:
            counts, totals = counts.unionByName(late), totals | more
    languages = sorted(totals)
    code = codewords(len(languages))
    bits = code.shape[1]
    weights = bit_weights(counts, totals, code)
    model = LanguageModel(languages, code, weights, np.ones(bits), np.zeros(bits), np.ones(bits) / max(1, bits), 1.0)
    if not bits:
        return model
    seen = cut(margins(sample, weights, ["lang"]).where("margins IS NOT NULL")).toPandas()
    seen = seen[seen["lang"].isin(languages)]
    # Rows in a fixed order, so that reruns add up alike.
    seen = seen.assign(key=[tuple(m) for m in seen["margins"]]).sort_values(["lang", "key"])
    if not len(seen):
        return model
    found = np.array([np.asarray(m, dtype=float) for m in seen["margins"]])
    number = {lang: i for i, lang in enumerate(languages)}
    of = seen["lang"].map(number).to_numpy()
    weight = 1.0 / np.bincount(of, minlength=len(languages))[of]
    for b in range(bits):
        y = (code[of, b] > 0).astype(float)
        if 0 < y.sum() < len(y):
            model.slopes[b], model.offsets[b] = _platt(found[:, b], y, weight)
    right = ((found * model.slopes + model.offsets) * code[of] > 0).astype(float)
    error = np.clip((weight[:, None] * (1 - right)).sum(axis=0) / weight.sum(), 1e-3, 0.499)
    share = np.log((1 - error) / error)
    model.bit_shares = share / share.sum()
    # One sharpness for all: the one under which the right languages are likeliest.
    tried = []
    for sharpness in 2.0 ** np.arange(-1, 7):
        model.sharpness = float(sharpness)
        chance = model.probabilities(found)[np.arange(len(of)), of]
        tried.append((-float((weight * np.log(np.maximum(chance, 1e-12))).sum()), float(sharpness)))
    model.sharpness = min(tried)[1]
    return model


def languages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, ambiguous)`` for every row of ``docs (doc_id, text, lang)``.

    Held out are ids whose crc32 as text leaves remainder 2 modulo 4 (a null id is not); they teach nothing.
    Null, empty and letterless texts are ``und`` with score 0; repeated rows are scored alike; other columns
    are never read; equal scores go to the smaller language.  An empty table gives an empty result, and
    without any language to learn every text is ``und``.
    """
    held = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    model = fit_languages(docs.where(~held).select("doc_id", "text", "lang"))
    rows = model.predict(docs.select("doc_id", "text"))
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
