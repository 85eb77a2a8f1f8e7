"""Quality rules: exact base counts, and a calibrated logistic regression over hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import BYTE_CODE, U64, mix, slices, span_hashes, text_bytes, words

BUCKET_BITS = 18
#: Lengths in bytes of the character n-grams, and in words of the word n-grams.
CHARACTERS, WORDS = (1, 2, 3), (1, 2)
#: Labelled rows of either label that training takes at most: the documented bound of the fitting sample.
SAMPLE_EACH = 2000
#: One sample row in so many calibrates the probability and isn't fitted on.
CALIBRATES = 4
#: A text is kept from this calibrated probability of good quality on.
KEEP = 0.5
#: A text fails the base rules under this number of words, or over this percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED, REPEAT_WIDTH = 50, 50, 3

_ODD = U64(0xC2B2AE3D27D4EB4F)
#: An odd factor a kind of n-gram, made by rule.
_FACTORS = mix(np.arange(1, 17, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of every word of a slice."""
    starts, ends, rows = words(data, offsets)
    return starts, ends, rows, span_hashes(data, starts, ends)


def _features(data: np.ndarray, offsets: np.ndarray, found: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row (in order) and bucket of every n-gram, one pair of arrays a kind; each kind spreads over the buckets by a factor of its own."""
    _, _, owner, code = found
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    with np.errstate(over="ignore"):
        for base, of, lengths, kind in ((BYTE_CODE[data], row, CHARACTERS, 0), (code, owner, WORDS, 8)):
            folded = base
            for size in range(1, lengths[-1] + 1):
                if size > 1:
                    folded = folded[:-1] * _ODD + base[size - 1 :]
                if not len(folded):
                    break
                if size in lengths:
                    bucket = (folded * _FACTORS[kind + size]) >> U64(64 - BUCKET_BITS)
                    inside = np.flatnonzero(of[: len(folded)] == of[len(of) - len(folded) :])
                    yield of[inside], bucket[inside].astype(np.int32)


@dataclass
class Model:
    """``weight`` of each bucket, and the calibration ``chance = 1 / (1 + exp(-(slope * logit + shift)))``."""

    weight: np.ndarray
    slope: float
    shift: float

    def logits(self, data: np.ndarray, offsets: np.ndarray, found: tuple | None = None) -> np.ndarray:
        """Of each text: the sum over the kinds of the mean weight of its n-grams."""
        n = len(offsets) - 1
        out = np.zeros(n)
        for row, bucket in _features(data, offsets, found or _words(data, offsets)):
            count = np.bincount(row, minlength=n)
            full = np.flatnonzero(count)
            if len(full):
                first = (np.cumsum(count) - count)[full]
                out[full] += np.add.reduceat(self.weight[bucket], first, dtype=float) / count[full]
        return out

    def chances(self, data: np.ndarray, offsets: np.ndarray, found: tuple | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(data, offsets, found) + self.shift, -30, 30)))


#: Without labels of both kinds there is no verdict: every text is good.
NO_MODEL = Model(np.zeros(1 << BUCKET_BITS, np.float32), 0.0, 30.0)


def _rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of the sample's sparse matrix: each n-gram's share among those of its kind."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    for part, data, offsets in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
        for row, bucket in _features(data, offsets, _words(data, offsets)):
            key, times = np.unique((row.astype(np.int64) << BUCKET_BITS) | bucket, return_counts=True)
            of = key >> BUCKET_BITS
            found.append((of + at, key & ((1 << BUCKET_BITS) - 1), times / np.bincount(row, minlength=part.num_rows)[of]))
        at += part.num_rows
    row, bucket, value = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order].astype(np.int32), bucket[order].astype(np.int32), value[order].astype(np.float32)


def _descend(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, good: np.ndarray, weigh: np.ndarray, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the regression that ``weigh`` weighs rows in: Adam over the whole sample."""
    used, bucket = np.unique(bucket, return_inverse=True)
    n, w, bias = len(good), np.zeros(len(used)), 0.0
    mean, spread = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        chance = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[bucket] * value, minlength=n) + bias, -30, 30)))
        error = (chance - good) * weigh
        slope = np.concatenate((np.bincount(bucket, weights=error[row] * value, minlength=len(used)) + decay * w, [error.sum()]))
        mean += 0.1 * (slope - mean)
        spread += 0.01 * (slope * slope - spread)
        move = rate * (1 - step / (steps + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-9)
        w -= move[:-1]
        bias -= 0.1 * move[-1]
    weight = np.zeros(1 << BUCKET_BITS, np.float32)
    weight[used] = w
    return weight, bias


def _calibrate(logit: np.ndarray, good: np.ndarray, weigh: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's sigmoid by Newton steps, with his smoothed targets."""
    most, least = good.sum(), len(good) - good.sum()
    target = np.where(good == 1, (most + 1) / (most + 2), 1 / (least + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(slope * logit + shift, -30, 30)))
        error, curve = weigh * (chance - target), weigh * chance * (1 - chance) + 1e-9
        g = np.array([error @ logit, error.sum()])
        h = np.array([[curve @ (logit * logit), curve @ logit], [curve @ logit, curve.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4 / np.abs(step).max()) if np.abs(step).max() else 1.0
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(slope), 1e-3), float(shift)


def fit(texts: pa.Array, good: np.ndarray, share_good: float | None = None, steps: int = 120, rate: float = 2.0, decay: float = 1e-6) -> Model:
    """The regression on three quarters of the sample, calibrated on the rest (every CALIBRATES-th row of either label).

    Both labels weigh alike in the regression; the calibration weighs them as ``share_good`` says, the good rows' share among all labels.
    """
    good = np.asarray(good, dtype=float)
    held = np.zeros(len(good), dtype=bool)
    for label in (0, 1):
        held[np.flatnonzero(good == label)[CALIBRATES - 1 :: CALIBRATES]] = True
    if len(np.unique(good[~held])) < 2:
        return NO_MODEL
    even = lambda of, share: np.where(of == 1, share / max(of.sum(), 1), (1 - share) / max((1 - of).sum(), 1))
    row, bucket, value = _rows(texts)
    weigh = np.zeros(len(good))
    weigh[~held] = even(good[~held], 0.5)
    weight, bias = _descend(row, bucket, value, good, weigh, steps, rate, decay)
    if len(np.unique(good[held])) < 2:
        return Model(weight, 1.0, float(bias))
    logit = np.bincount(row, weights=weight[bucket] * value, minlength=len(good))[held] + bias
    share = good.mean() if share_good is None else share_good
    slope, shift = _calibrate(logit, good[held], even(good[held], share) * held.sum())
    return Model(weight, slope, slope * float(bias) + shift)


def train(docs: DataFrame, labels: DataFrame, sample_each: int = SAMPLE_EACH, **options) -> Model:
    """Fit on at most ``sample_each`` labelled rows of either label (``quality`` 0 or 1), those with the smallest hash of the id.

    The labels' shares are counted over all labels.  ``docs`` is read once; only the sample's texts reach the one task that fits, and the driver
    gets the weights.  Rows with a null id or label are ignored; a doc_id that repeats in ``labels`` takes its smallest label.  Without
    both labels every text counts as good.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
    share = known.agg(F.avg("good")).first()[0]
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("good = 1").orderBy(*order).limit(sample_each).unionByName(known.where("good = 0").orderBy(*order).limit(sample_each))
    sample = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # 2 * sample_each rows at most
    sample = sample.select("text", "good").repartition(1).sortWithinPartitions("good", F.xxhash64("text"), "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        model = fit(whole.column("text").cast(pa.large_string()).combine_chunks(), whole.column("good").to_numpy(), share, **options)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.slope]), pa.array([model.shift])], names=["weight", "slope", "shift"])

    row = sample.mapInArrow(learn, "weight binary, slope double, shift double").first()
    return NO_MODEL if row is None else Model(np.frombuffer(row["weight"], np.float32), row["slope"], row["shift"])


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line; a text of k ``\\n`` has k + 1."""
    breaks = np.flatnonzero(data == 0x0A)
    starts, ends = np.concatenate((offsets[:-1], breaks + 1)), np.concatenate((breaks, offsets[1:]))
    rows = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1))
    # a line that a text's end cuts off: both are sorted by (row, place)
    order, closing = np.lexsort((starts, rows)), np.lexsort((ends, np.concatenate((rows[len(offsets) - 1 :], rows[: len(offsets) - 1]))))
    return starts[order], ends[closing], rows[order]


def _seen(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry: its number among equal ones of its row (from 0, in order), and how many there are."""
    order = np.lexsort((np.arange(len(key)), key, rows))
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key[order][1:] != key[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    at = np.flatnonzero(first)
    size = np.diff(np.concatenate((at, [len(key)])))
    nth, count = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    nth[order], count[order] = np.arange(len(key)) - np.repeat(at, size), np.repeat(size, size)
    return nth, count


def base_counts(data: np.ndarray, offsets: np.ndarray, found: tuple | None = None) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a slice (its UTF-8 bytes and offsets)."""
    n = len(offsets) - 1
    starts, ends, rows, code = found or _words(data, offsets)
    size = np.bincount(rows, minlength=n)
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    letters = np.bincount(rows, weights=before[ends] - before[starts], minlength=n)
    symbols = np.diff(np.searchsorted(np.flatnonzero(_SYMBOLS[data]), offsets))

    first, last, line_row = _lines(data, offsets)
    spoken = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    nth, _ = _seen(span_hashes(data, first[spoken], last[spoken]), line_row[spoken])
    lines = np.bincount(line_row[spoken][nth > 0], minlength=n)

    windows = max(0, len(code) - REPEAT_WIDTH + 1)
    folded = np.zeros(windows, U64)
    with np.errstate(over="ignore"):
        for k in range(REPEAT_WIDTH):
            folded = folded * _ODD + code[k : k + windows]
    at = np.flatnonzero(rows[:windows] == rows[REPEAT_WIDTH - 1 :][:windows])
    _, count = _seen(mix(folded[at]), rows[at])
    covered = np.zeros(len(code), dtype=bool)
    for k in range(REPEAT_WIDTH):
        covered[at[count > 1] + k] = True
    repeated = np.bincount(rows[covered], minlength=n)
    return {"n_words": size, "word_chars": letters, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeated}


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_rules(docs: DataFrame, model: Model, column: str = "quality_rules", keep: float = KEEP) -> DataFrame:
    """``docs`` with a struct ``column``: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept``.

    A word is a run of characters outside ``[\\x20\\x09-\\x0D]``.  word_chars: code points in words; n_symbols: characters of ``[#*$%&|<>]``;
    n_dup_lines: lines (between ``\\n``) with a word that equal an earlier line of the text; n_repeat_words: words in three-word windows
    that the text holds twice or more.  base_failed: fewer than 50 words, or over half of the words repeated.  score is the calibrated
    probability of good quality; kept: not base_failed and ``score >= keep``.

    Every row and column stays; each text is read whole, in Arrow batches cut into slices, so a task's memory follows the longest text.  A
    null text counts as empty: zeros, base_failed.  Equal texts get equal results, repeated rows too; an empty table stays empty; a column that is already
    called ``column`` is replaced.
    """
    docs = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.slope, model.shift))  # 1 MB, whatever the input
    struct = T.StructType([*(T.StructField(f, T.LongType()) for f in _FIELDS), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for part, data, offsets in slices(batches):
            found = _words(data, offsets)
            base, score = base_counts(data, offsets, found), own.chances(data, offsets, found)
            failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
            columns = [*(pa.array(base[f].astype(np.int64)) for f in _FIELDS), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(columns, names=[f.name for f in struct.fields])], names=[*part.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, struct)]))
