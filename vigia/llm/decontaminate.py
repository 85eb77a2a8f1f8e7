"""Benchmark decontamination: every passage is a BM25 query against an inverted index of the test items."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import LOWER, SIGNS, U64, list_array, mix, slices, span_hashes, text_bytes, words
from .storage import cut

K1, B = 1.2, 0.75
#: Share of an item's score against itself from which a passage retrieves it.
THRESHOLD = 0.5
#: Share of the question's and of the answer's word 3-grams that must stand in the passage.
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.6, 0.5
#: Words of half a passage at least; a passage is two neighbouring halves, so each item lies whole in one.  Longer items have
#: passages of their own: halves of twice, four times ... as many words.
HALF = 64
#: Items under one block maximum.
BLOCK = 4
#: Words of the items of one index, and of all indexes that go to the executors at once; a larger benchmark takes more passes.
INDEX_WORDS, PASS_WORDS = 100_000, 1_000_000
#: Share of its score that an item's non-essential postings stay under; below THRESHOLD.
SLACK = 0.3
MAYBE_BITS = 20

_ODD = U64(0x9FB21C651E98DF25)


def _grams(code: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = code[: max(0, len(code) - n + 1)]
        for k in range(1, n):
            out = out * _ODD + code[k : k + len(out)]
    return mix(out)


@dataclass
class Index:
    """Postings with impacts as shares of each item's own score.

    ``codes``/``impact``/``at`` hold every item's terms (for scoring).  ``terms`` are the essential terms: an item's
    postings of smallest impact that together can't lift it over SLACK are left out, and ``rest`` is what they could add to
    an item of a block.  ``block_at``/``block``/``block_top``: an essential term's largest impact in each block of items.
    ``maybe`` tells by a hash's first bits whether it can be an essential term.
    """

    ids: np.ndarray
    codes: np.ndarray
    impact: np.ndarray
    at: np.ndarray
    terms: np.ndarray
    maybe: np.ndarray
    block_at: np.ndarray
    block: np.ndarray
    block_top: np.ndarray
    rest: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    sizes: list[tuple[int, int]]
    half: int


def _item_words(texts: list[str | None]) -> list[np.ndarray]:
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    starts, ends, rows = words(data, offsets, SIGNS)
    code = span_hashes(LOWER[data], starts, ends)
    return np.split(code, np.cumsum(np.bincount(rows, minlength=len(texts)))[:-1])


def half_of(words: int) -> int:
    """Words of half a passage for an item of so many words: HALF, doubled until the item fits."""
    half = HALF
    while half < words:
        half *= 2
    return half


def build_index(items: list[tuple[int, str | None, str | None]], half: int = HALF) -> Index:
    """``items``: (item_id, question, answer), which are all of the benchmark.  An item without words is in no posting and never retrieved."""
    questions, answers = _item_words([q for _, q, _ in items]), _item_words([a for _, _, a in items])
    terms = [np.unique(np.concatenate(x)) for x in zip(questions, answers, strict=True)]
    known, df = np.unique(np.concatenate(terms) if terms else np.zeros(0, U64), return_counts=True)
    mean = float(np.mean([len(q) + len(a) for q, a in zip(questions, answers, strict=True)]))
    longest = max((len(q) + len(a) for q, a in zip(questions, answers, strict=True)), default=0)
    return index_of(np.array([i for i, _, _ in items], dtype=np.int64), questions, answers, known, df, len(items), mean, max(half, longest))


def index_of(ids: np.ndarray, questions: list[np.ndarray], answers: list[np.ndarray], known: np.ndarray, known_df: np.ndarray, n_items: int, mean: float, half: int) -> Index:
    """Index of some items (word codes of question and answer).  ``known`` (sorted) and ``known_df``: items of the whole benchmark that
    hold each term; ``n_items`` and ``mean``: its items and their mean number of words."""
    whole = [np.concatenate(x) for x in zip(questions, answers, strict=True)]
    sizes = np.array([len(x) for x in whole])
    items = ids
    code, owner = np.concatenate(whole), np.repeat(np.arange(len(items)), sizes)
    terms, number = np.unique(code, return_inverse=True)
    posting, tf = np.unique(owner * max(1, len(terms)) + number, return_counts=True)
    item, term = posting // max(1, len(terms)), posting % max(1, len(terms))
    df = known_df[np.searchsorted(known, terms)] if len(terms) else np.zeros(0)
    idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / max(1.0, mean)))
    impact = impact / np.bincount(item, weights=impact, minlength=len(items))[item]
    at = np.concatenate(([0], np.cumsum(np.bincount(item, minlength=len(items)))))
    # smallest impacts first: what stays under SLACK in sum needs no list
    order = np.lexsort((impact, item))
    run = np.cumsum(impact[order])
    run = run - np.concatenate(([0.0], run))[at[item[order]]]
    essential = np.ones(len(item), dtype=bool)
    essential[order[run < SLACK]] = False
    left = np.bincount(item[~essential], weights=impact[~essential], minlength=len(items))
    rest = np.zeros(len(items) // BLOCK + 1)
    np.maximum.at(rest, np.arange(len(items)) // BLOCK, left)
    used, number = np.unique(term[essential], return_inverse=True)
    key, inverse = np.unique(number * len(rest) + item[essential] // BLOCK, return_inverse=True)
    block_top = np.zeros(len(key))
    np.maximum.at(block_top, inverse, impact[essential])
    block_at = np.concatenate(([0], np.cumsum(np.bincount(key // len(rest), minlength=len(used)))))
    maybe = np.zeros(1 << MAYBE_BITS, dtype=bool)
    maybe[terms[used] >> U64(64 - MAYBE_BITS)] = True
    grams = lambda parts: [np.unique(_grams(x, min(3, max(1, len(x))))) for x in parts]
    return Index(ids, terms[term], impact, at, terms[used], maybe, block_at, key % len(rest), block_top, rest, grams(questions), grams(answers), [(len(q), len(a)) for q, a in zip(questions, answers, strict=True)], half)


def _spread(at: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry's term its postings: (number of the entry, place of the posting)."""
    n = at[term + 1] - at[term]
    entry = np.repeat(np.arange(len(term)), n)
    return entry, np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + at[term][entry]


def search(index: Index, data: np.ndarray, offsets: np.ndarray, threshold: float = THRESHOLD, question_overlap: float = QUESTION_OVERLAP, answer_overlap: float = ANSWER_OVERLAP) -> list[tuple[int, int, float, float, float]]:
    """(row, item number, score, question overlap, answer overlap) of verified hits, the best passage of each.

    Block-max WAND for many passages at once: the passages' distinct essential terms add up their block maxima, and
    a block of items is skipped unless that sum and the block's ``rest`` reach the threshold.  Only items of the
    blocks left are scored, with all terms, so that no item above the threshold is missed.
    """
    return _search(index, *_coded(data, offsets), threshold, question_overlap, answer_overlap)


def _coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words, each one's text, and the words of each text."""
    starts, ends, rows = words(data, offsets, SIGNS)
    return span_hashes(LOWER[data], starts, ends), rows, np.bincount(rows, minlength=len(offsets) - 1)


def _search(index: Index, code: np.ndarray, rows: np.ndarray, count: np.ndarray, threshold: float = THRESHOLD, question_overlap: float = QUESTION_OVERLAP, answer_overlap: float = ANSWER_OVERLAP) -> list[tuple[int, int, float, float, float]]:
    if threshold <= SLACK:
        raise ValueError(f"a threshold of {SLACK} or less would miss items, as terms of that share have no lists")
    if not len(code) or not len(index.terms):
        return []
    begin = np.concatenate(([0], np.cumsum(count)))
    halves = -(-count // index.half)
    half_at = np.concatenate(([0], np.cumsum(halves)))
    hits = np.flatnonzero(index.maybe[code >> U64(64 - MAYBE_BITS)])
    term = np.minimum(np.searchsorted(index.terms, code[hits]), len(index.terms) - 1)
    known = index.terms[term] == code[hits]
    hits, term = hits[known], term[known]
    half = half_at[rows[hits]] + (hits - begin[rows[hits]]) // index.half
    # passage p is the halves p and p + 1 of one text
    first = half > half_at[rows[hits]]
    pairs = np.unique(np.concatenate((half, half[first] - 1)) * len(index.terms) + np.concatenate((term, term[first])))
    passage, query = pairs // len(index.terms), pairs % len(index.terms)
    entry, posting = _spread(index.block_at, query)
    keys, inverse = np.unique(passage[entry] * len(index.rest) + index.block[posting], return_inverse=True)
    bound = np.bincount(inverse, weights=index.block_top[posting], minlength=len(keys)) + index.rest[keys % len(index.rest)]
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    half_row = np.repeat(np.arange(len(count)), halves)
    for key in keys[bound >= threshold - 1e-9].tolist():
        k, block = divmod(key, len(index.rest))
        row = int(half_row[k])
        lo = begin[row] + (k - half_at[row]) * index.half
        part = code[lo : min(begin[row + 1], lo + 2 * index.half)]
        a, b = index.at[block * BLOCK], index.at[min(len(index.ids), (block + 1) * BLOCK)]
        ordered = np.sort(part)
        there = ordered[np.minimum(np.searchsorted(ordered, index.codes[a:b]), len(ordered) - 1)] == index.codes[a:b]
        inside = np.concatenate(([0.0], np.cumsum(np.where(there, index.impact[a:b], 0.0))))
        edges = index.at[block * BLOCK : min(len(index.ids), (block + 1) * BLOCK) + 1] - a
        for n, score in enumerate((inside[edges[1:]] - inside[edges[:-1]]).tolist()):
            if score >= threshold - 1e-9:
                item = block * BLOCK + n
                share = [float(np.isin(want, _grams(part, min(3, size))).mean()) if size else 1.0 for want, size in zip((index.question[item], index.answer[item]), index.sizes[item], strict=True)]
                if share[0] >= question_overlap and share[1] >= answer_overlap:
                    best[row, item] = max(best.get((row, item), (0.0, 0.0, 0.0)), (score, *share))
    return [(row, item, *x) for (row, item), x in sorted(best.items())]


def question_and_answer(benchmark: DataFrame) -> DataFrame:
    """``item_id, question, answer``: the table's own columns, or ``text`` with its last third of words as the answer."""
    if {"question", "answer"} <= set(benchmark.columns):
        return benchmark.select("item_id", "question", "answer")
    parts = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), " ")
    cut = F.ceil(F.size(parts) * 2 / 3).cast("int")
    return benchmark.select("item_id", F.array_join(F.slice(parts, 1, cut), " ").alias("question"), F.array_join(F.slice(parts, cut + 1, F.size(parts)), " ").alias("answer"))


def _item_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        q, a = ([x.view(np.int64) for x in _item_words(batch.column(c).to_pylist())] for c in ("question", "answer"))
        half = [half_of(len(x) + len(y)) for x, y in zip(q, a, strict=True)]
        size = [len(x) + len(y) for x, y in zip(q, a, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("item_id"), list_array(q, pa.int64()), list_array(a, pa.int64()), pa.array(size, pa.int64()), pa.array(half, pa.int64())], names=["uid", "item_id", "q", "a", "words", "half"])


def _passes(benchmark: DataFrame) -> Iterator[list[Index]]:
    """Indexes of the whole benchmark, by the items' passage length, in lists of at most PASS_WORDS words of items.

    Spark counts items, their mean length and the items of each term over all of the benchmark, and makes the indexes, of INDEX_WORDS words each
    (one longer item is an index of its own), so that no score depends on which other items share an index.
    """
    items = question_and_answer(benchmark).withColumn("uid", F.monotonically_increasing_id())
    items = items.select("uid", F.coalesce(F.col("item_id").cast("bigint"), F.lit(_NO_ID)).alias("item_id"), F.col("question").cast("string").alias("question"), F.col("answer").cast("string").alias("answer"))
    coded = cut(items.mapInArrow(_item_codes, "uid bigint, item_id bigint, q array<bigint>, a array<bigint>, words bigint, half bigint"))
    n_items, mean = coded.agg(F.count("*"), F.avg("words")).first()
    if not n_items:
        return
    parts = coded.groupBy("half").agg(F.ceil(F.sum("words") / INDEX_WORDS).cast("int").alias("parts"))
    dealt = coded.join(F.broadcast(parts), "half").withColumn("shard", F.pmod(F.xxhash64("uid"), F.greatest("parts", F.lit(1))).cast("int"))  # a row a power of two
    terms = dealt.select("half", "shard", "uid", F.explode(F.array_distinct(F.concat("q", "a"))).alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    df = terms.select("half", "shard", "term").distinct().join(df, "term")

    def build(key: tuple, own: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["item_id", "uid"])
        known, number = counts["term"].to_numpy(np.int64).view(U64), counts["df"].to_numpy()
        order = np.argsort(known)
        codes = lambda c: [np.asarray(x, np.int64).view(U64) for x in own[c]]
        index = index_of(own["item_id"].to_numpy(np.int64), codes("q"), codes("a"), known[order], number[order], n_items, mean, int(key[0]))
        return pd.DataFrame({"words": [int(own["words"].sum())], "data": [pickle.dumps(index)]})

    made = dealt.select(*[F.col(c).alias(c) for c in ("half", "shard", "uid", "item_id", "q", "a", "words")]).groupBy("half", "shard").cogroup(df.groupBy("half", "shard")).applyInPandas(build, "words bigint, data binary")
    held, total = [], 0
    for row in cut(made).toLocalIterator():
        if held and total + row["words"] > PASS_WORDS:
            yield held
            held, total = [], 0
        held.append(pickle.loads(row["data"]))
        total += row["words"]
    if held:
        yield held


#: Stands for a null item_id inside the indexes.
_NO_ID = -(1 << 63)
_MATCHES = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"


def contamination(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """Verified matches, one row each: ``doc_id, item_id, score, question_overlap, answer_overlap``.

    Every whole text is cut into overlapping passages; each is a BM25 query.  ``score`` is the share of the item's score
    against itself.  Words are runs of letters and digits, A-Z lower-cased.  The documents are never shuffled and read once for
    PASS_WORDS words of benchmark items, which is the bound of what goes to the executors at once.  Null and
    empty texts, an empty benchmark and items without words match nothing; a repeated item_id matches once a row; rows
    with a null doc_id and items with a null item_id carry it in the result; other columns are ignored.  The matches of one pass are written before
    the next pass's indexes go out.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sc = docs.sparkSession.sparkContext

    def one(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, data, offsets in slices(batches):
                coded = _coded(data, offsets)
                for index in shared.value:
                    found = _search(index, *coded, **limits)
                    if found:
                        row, item, *rest = zip(*found, strict=True)
                        ids = part.column("doc_id").cast(pa.int64()).take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(index.ids[list(item)]), *(pa.array(x, pa.float64()) for x in rest)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return docs.mapInArrow(run, _MATCHES).withColumn("item_id", F.nullif("item_id", F.lit(_NO_ID)))

    parts = []
    for indexes in _passes(benchmark):
        shared = sc.broadcast(indexes)
        parts.append(cut(one(shared)))
        shared.unpersist()
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], _MATCHES)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """``docs`` without the rows in which any benchmark item is found; columns and other rows stay as they are."""
    sc = docs.sparkSession.sparkContext
    for indexes in _passes(benchmark):
        shared = sc.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part, data, offsets in slices(batches):
                keep, coded = np.ones(part.num_rows, dtype=bool), _coded(data, offsets)
                for index in shared.value:
                    keep[[x[0] for x in _search(index, *coded, **limits)]] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return docs
