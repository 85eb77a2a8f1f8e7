"""Toxicity: character n-gram embeddings, averaged a bag, under a linear softmax; trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import BYTE_CODE, LOWER, SIGNS, SLICE_BYTES, U64, slices, span_hashes, text_bytes, words

#: n-gram lengths in bytes, with a mark before and behind each word.
LENGTHS = (3, 4, 5)
BUCKET_BITS = 18
DIMENSIONS = 4
#: Labelled rows of either label that training takes at most: the documented bound of the fitting sample.
SAMPLE_EACH = 1500
#: A bag is a passage of so many words; passages begin every STEP words.
PASSAGE, STEP = 2, 1
#: How much a text's passages of high score count: a passage weighs exp(SHARPNESS * score).  ``cross_validate`` compares both.
SHARPNESS = 8.0
THRESHOLD = 0.7

_ODD = U64(0xC2B2AE3D27D4EB4F)
_OPEN, _CLOSE = 0x3C, 0x3E


def _marked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words as one buffer of ``<word>``, each one's start in it, and the word of each byte."""
    sizes = ends - starts + 2
    at = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(starts)), sizes)
    source = np.arange(at[-1]) - at[owner] - 1 + starts[owner]
    out = data[np.clip(source, 0, max(0, len(data) - 1))] if len(data) else np.zeros(0, np.uint8)
    out[at[:-1]], out[at[1:] - 1] = _OPEN, _CLOSE
    return out, at, owner


def _grams(marked: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: positions of the n-grams that lie in one word, and their buckets."""
    code, n = BYTE_CODE[marked], len(marked)
    with np.errstate(over="ignore"):
        folded = code
        for size in range(2, LENGTHS[-1] + 1):
            if n < size:
                return
            folded = folded[: n - size + 1] * _ODD + code[size - 1 :]
            if size in LENGTHS:
                at = np.flatnonzero(owner[: n - size + 1] == owner[size - 1 :])
                yield at, ((folded[at] * U64(0x9E3779B97F4A7C15)) >> U64(64 - BUCKET_BITS)).astype(np.int64)


def _passages(at: np.ndarray, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word behind the last, and text of each passage; ``at``: where each text's words begin.  Texts without words have none."""
    n = np.diff(at)
    count = np.where(n > 0, 1 + -(-np.maximum(n - passage, 0) // STEP), 0)
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = at[:-1][text] + STEP * nth
    return first, np.minimum(first + passage, at[1:][text]), text


def _pooled(scores: np.ndarray, text: np.ndarray, n: int, sharpness: float = SHARPNESS) -> tuple[np.ndarray, np.ndarray]:
    """Mean of each text's passage scores, weighted by exp(sharpness * score) (-inf for a text without passages), and the weights.

    A mean, so that more passages of the same score don't lift it.
    """
    size = np.bincount(text, minlength=n)
    full = np.flatnonzero(size)
    out = np.full(n, -np.inf)
    if not len(full):
        return out, np.zeros(0)
    first = (np.cumsum(size) - size)[full]
    weight = np.exp(sharpness * (scores - np.repeat(np.maximum.reduceat(scores, first), size[full])))
    weight /= np.repeat(np.add.reduceat(weight, first), size[full])
    out[full] = np.add.reduceat(weight * scores, first)
    return out, weight


@dataclass
class Model:
    """``weight``: each bucket's embedding times the softmax weights' difference; exact, as both are linear."""

    weight: np.ndarray
    bias: float
    passage: int = PASSAGE
    sharpness: float = SHARPNESS

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        starts, ends, rows = words(data, offsets, SIGNS)
        if not len(starts):
            return np.full(n, -np.inf)
        low = LOWER[data]
        _, one, which = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
        marked, begin, owner = _marked(low, starts[one], ends[one])
        total, count = np.zeros(len(marked)), np.zeros(len(marked))
        for where, bucket in _grams(marked, owner):
            total[where] += self.weight[bucket]
            count[where] += 1
        score = np.add.reduceat(total, begin[:-1]) / np.add.reduceat(count, begin[:-1])
        first, last, text = _passages(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))), self.passage)
        run = np.concatenate(([0.0], np.cumsum(score[which])))
        return _pooled((run[last] - run[first]) / (last - first), text, n, self.sharpness)[0] + self.bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(data, offsets), -30, 30)))


def fit(texts: pa.Array, toxic: np.ndarray, steps: int = 60, seed: int = 17, rate: float = 0.6, decay: float = 1e-5, passage: int = PASSAGE, sharpness: float = SHARPNESS) -> Model:
    """Train embeddings and softmax weights together on texts and their labels."""
    size, labels, n = 1 << BUCKET_BITS, toxic.astype(float), len(texts)
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, rows = words(data, offsets, SIGNS)
    used_rows = np.bincount(rows, minlength=n) > 0
    if not used_rows.any() or labels[used_rows].min() == labels[used_rows].max():
        return Model(np.zeros(size, np.float32), -30.0)
    code, row = np.empty(len(starts), np.uint64), 0
    while row < n:  # hashing takes several times a piece's bytes
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        own = slice(*np.searchsorted(rows, [row, stop]))
        code[own] = span_hashes(data[offsets[row] : offsets[stop]], starts[own] - offsets[row], ends[own] - offsets[row])
        row = stop
    _, one, member = np.unique(code, return_index=True, return_inverse=True)
    member = member.astype(np.int32)
    first, last, text = _passages(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))), passage)
    length, n_words = (last - first).astype(float), len(one)
    marked, _, owner = _marked(data, starts[one], ends[one])
    pairs = [(owner[where].astype(np.int32), bucket.astype(np.int32)) for where, bucket in _grams(marked, owner)]
    word, bucket = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    order = np.argsort(word, kind="stable")
    word, bucket = word[order], bucket[order]
    del pairs, order, marked, owner, code
    used, bucket = np.unique(bucket, return_inverse=True)
    bucket = bucket.astype(np.int32)
    grams = np.bincount(word, minlength=n_words)
    start = np.concatenate(([0], np.cumsum(grams)))[:-1]
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (len(used), DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, 2), np.float32)
    out[:, 1] = rng.normal(0, 0.3, DIMENSIONS)
    toxic_share = labels[used_rows].mean()
    bias, share = -4.0, np.where(labels == 1, 0.5 / toxic_share, 0.5 / (1 - toxic_share)) * used_rows / used_rows.sum()
    moments = [np.zeros_like(embed), np.zeros_like(embed), np.zeros_like(out), np.zeros_like(out), 0.0, 0.0]
    by_bucket = np.argsort(bucket, kind="stable").astype(np.int32)
    bucket_start = np.concatenate(([0], np.cumsum(np.bincount(bucket))))[:-1]
    for step in range(1, steps + 1):
        average = np.add.reduceat(embed[bucket], start, axis=0) / grams[:, None]
        direction = out[:, 1] - out[:, 0]
        run = np.concatenate(([0.0], np.cumsum((average @ direction)[member], dtype=float)))
        score = (run[last] - run[first]) / length
        pooled, weight = _pooled(score, text, n, sharpness)
        chance = 1 / (1 + np.exp(-np.clip(pooled + bias, -30, 30)))
        error = (chance - labels) * share
        part = error[text] * weight * (1 + sharpness * (score - pooled[text])) / length
        spread = np.bincount(first, weights=part, minlength=len(member) + 1) - np.bincount(last, weights=part, minlength=len(member) + 1)
        by_word = np.bincount(member, weights=np.cumsum(spread)[:-1], minlength=n_words).astype(np.float32)
        g_direction = average.T @ by_word
        g_out = np.stack([-g_direction, g_direction], axis=1) + decay * out
        by_gram = (by_word / grams).astype(np.float32)[word][by_bucket]
        g_embed = np.add.reduceat(by_gram, bucket_start)[:, None] * direction[None, :] + decay * embed
        speed = rate * (1 - step / (steps + 1))
        for k, (value, grad) in enumerate(((embed, g_embed), (out, g_out))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= speed * (0.3 if k == 0 else 1.0) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        g = float(error.sum())
        moments[4] += 0.1 * (g - moments[4])
        moments[5] += 0.01 * (g * g - moments[5])
        bias -= speed * (moments[4] / (1 - 0.9**step)) / (np.sqrt(moments[5] / (1 - 0.99**step)) + 1e-9)
    weight = np.zeros(size, np.float32)
    weight[used] = embed @ (out[:, 1] - out[:, 0])
    return Model(weight, bias, passage, sharpness)


def cross_validate(texts: pa.Array, toxic: np.ndarray, choices: list[tuple[int, float]], folds: int = 3, **options) -> list[tuple[int, float, float, float]]:
    """(passage, sharpness, share of toxic texts caught, share of clean ones wrong) of each choice, over folds of the learnable rows (every ``folds``-th row of either label).

    This is how PASSAGE is chosen: rows that are held out for good have no part in it.
    """
    toxic = np.asarray(toxic)
    fold = np.zeros(len(toxic), int)
    for label in (0, 1):
        at = np.flatnonzero(toxic == label)
        fold[at] = np.arange(len(at)) % folds
    out = []
    for passage, sharpness in choices:
        hit = np.zeros(len(toxic), dtype=bool)
        for k in range(folds):
            model = fit(texts.filter(pa.array(fold != k)), toxic[fold != k], passage=passage, sharpness=sharpness, **options)
            hit[fold == k] = model.scores(*text_bytes(texts.filter(pa.array(fold == k)))) >= THRESHOLD
        out.append((passage, sharpness, float(hit[toxic == 1].mean()), float(hit[toxic == 0].mean())))
    return out


def in_held_out(doc_id) -> F.Column:
    """Rows that never serve for learning: crc32(doc_id as text) mod 3 is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_each: int = SAMPLE_EACH, **options) -> Model:
    """Fit on at most ``sample_each`` labelled rows of either label, those with the smallest hash of the id.

    Held-out rows are left out.  The sample's ids are chosen from ``labels`` alone, so ``docs`` is read once and
    only the sample's texts reach the one task that fits; the driver gets the weights.  Rows with a null id or label are ignored; a doc_id that
    repeats in ``labels`` takes its largest label.  Without both labels the model scores every text near 0.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~in_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("toxic = 1").orderBy(*order).limit(sample_each).unionByName(known.where("toxic = 0").orderBy(*order).limit(sample_each))
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # 2 * sample_each rows at most
    sample = sample.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")).repartition(1).sortWithinPartitions("text", "toxic")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        model = fit(whole.column("text").cast(pa.large_string()).combine_chunks(), whole.column("toxic").to_numpy(), **options)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias])], names=["weight", "bias"])

    row = sample.mapInArrow(learn, "weight binary, bias double").first()
    return Model(np.zeros(1 << BUCKET_BITS, np.float32), -30.0) if row is None else Model(np.frombuffer(row["weight"], np.float32), row["bias"])


def score_toxicity(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """``docs`` with the model's score of each whole text (0 to 1) in ``column``; every row and column stays.

    A bag is a passage of PASSAGE words: the mean of its words' embeddings, which are means of n-gram embeddings, goes into the softmax.
    The text's logit is the passages' mean, in which those of high score weigh most, so that one toxic passage tells in a
    short and in a very long text, and clean passages add nothing by their number.  Null and empty texts, and
    texts of signs only, score near 0.  A column that is already called ``column`` is replaced.
    """
    docs = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))  # 1 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for part, data, offsets in slices(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.scores(data, offsets), pa.float64())], names=[*part.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))
