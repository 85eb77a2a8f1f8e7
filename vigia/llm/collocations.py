"""Phrase collocations: n-grams as DataFrame rows, counted per language, scored by their weakest cut, without parts of longer phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import LOWER, U64, mix, slices, span_hashes, text_bytes, words
from .storage import cut

#: Longest phrase in words, least count of a phrase, and phrases of a language that are returned: the feature's own limits.
MAX_N, LEAST, TOP = 4, 30, 2000
#: A phrase goes when a longer one that holds it has so many percent of its count.
COVERED = 80
UNKNOWN = "und"
#: Text that a task combines before its n-grams become rows.
SLICE = 2 << 20
#: A filter of frequent n-grams has 16 bits an n-gram, but 32 MB at most; a fuller one lets more rows through and loses none.
FILTER_BITS = 1 << 28
#: Parts that a language's ranking is first cut into.
PARTS = 64

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*(ord(c) for c in ".,;:!?"), *range(0x0A, 0x0E)]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[0x20] = True
_ODD = U64(0xC2B2AE3D27D4EB4F)
_GRAMS = "lang string, gram string, c bigint"


def _codes(lang: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words and the first one's language."""
    n = max(0, len(word) - size + 1)
    with np.errstate(over="ignore"):
        folded = lang[:n]
        for k in range(size):
            folded = folded * _ODD + word[k : k + n]
        return mix(folded)


def _probes(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (code & U64(bits - 1)).astype(np.int64), ((code >> U64(32)) & U64(bits - 1)).astype(np.int64)


def _maybe(found: np.ndarray, code: np.ndarray) -> np.ndarray:
    """False where the filter ``found`` (a Bloom filter in 64-bit words) surely lacks the code."""
    out = np.ones(len(code), dtype=bool)
    for at in _probes(code, 64 * len(found)):
        out &= (found[at >> 6] >> (at & 63).astype(U64)) & U64(1) > 0
    return out


def _hashes(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    return span_hashes(data, offsets[:-1], offsets[1:])


def _exploded(sizes: tuple[int, ...], found: tuple[int, object] | None):
    """The n-grams of ``sizes`` of a text as rows, equal ones of a slice combined; with ``found`` (a size and the
    filter of its frequent n-grams) only those whose parts of that size may be frequent.  For size 1 an
    empty n-gram counts all words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, limit=SLICE):
            starts, ends, rows = words(data, offsets, _APART)
            if not len(starts):
                continue
            ink = LOWER[data[~_APART[data]]]
            length = ends - starts
            at = np.concatenate(([0], np.cumsum(length)))
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ink)]).dictionary_encode()
            langs = part.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[rows]
            names = langs.dictionary
            _, word = np.unique(lang * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
            n_words = int(word.max()) + 1
            broken = np.concatenate(([0], np.cumsum(_BREAK[data], dtype=np.int32)))
            piece = np.concatenate(([0], np.cumsum((broken[starts[1:]] > broken[ends[:-1]]) | (rows[1:] != rows[:-1]), dtype=np.int32)))
            del broken
            # the words with one space behind each: every n-gram is a run of these bytes
            place = at + np.arange(len(at))
            spaced = np.full(place[-1], 0x20, np.uint8)
            spaced[np.arange(len(ink)) + np.repeat(np.arange(len(length)), length)] = ink

            if sizes[0] == 1:
                total = np.bincount(lang, minlength=len(names))
                yield pa.RecordBatch.from_arrays([names, pa.array([""] * len(names)), pa.array(total.astype(np.int64))], names=["lang", "gram", "c"])
            inside = np.ones(len(word), dtype=bool)
            if found is not None:
                size = found[0]
                own = _hashes(pa.array(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]
                inside = (piece[: max(0, len(word) - size + 1)] == piece[size - 1 :]) & _maybe(found[1].value, _codes(_hashes(names)[lang], own, size))
                for _ in range(size, sizes[0]):
                    inside = inside[:-1] & inside[1:]
            for size in sizes:
                if size > sizes[0]:
                    inside = inside[:-1] & inside[1:]
                if not len(inside):
                    break
                first = np.flatnonzero(inside & (piece[: len(inside)] == piece[size - 1 :][: len(inside)]))
                ident = word[first]
                for k in range(1, size):
                    _, ident = np.unique(ident * n_words + word[first + k], return_inverse=True)
                _, one, count = np.unique(ident, return_index=True, return_counts=True)
                if not len(one):
                    continue
                one = first[one]
                begin, wide = place[one], place[one + size] - 1 - place[one]
                edge = np.concatenate(([0], np.cumsum(wide)))
                grams = spaced[np.repeat(begin - edge[:-1], wide) + np.arange(edge[-1])]
                text = pa.LargeStringArray.from_buffers(len(one), pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(grams)).cast(pa.string())
                del first, ident, edge, begin, wide, grams
                yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[one])), text, pa.array(count.astype(np.int64))], names=["lang", "gram", "c"])

    return run


def _filter(grams: DataFrame) -> np.ndarray:
    """A Bloom filter of the n-grams, two probes each; tasks set the bits, the driver gets them put together by words of 64."""
    bits = 1 << 16
    n = grams.count()
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "gram"):
            starts, ends, rows = words(data, offsets, _BLANK)
            if not len(starts):
                continue
            size = np.bincount(rows, minlength=part.num_rows)
            own, lang = span_hashes(data, starts, ends), _hashes(part.column("lang"))[rows]
            code = _codes(lang, own, int(size.max()))[(np.cumsum(size) - size)[size == size.max()]]
            at = np.concatenate(_probes(code, bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], names=["at", "bit"])

    set_ = grams.mapInArrow(run, "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, U64)
    out[set_.column("at").to_numpy()] = set_.column("bits").to_numpy().view(U64)
    return out


def frequent_grams(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """``lang, gram, c``: every n-gram of 1 to ``max_n`` words with at least ``least`` occurrences in its language, and all words' number as the empty one.

    Texts are exploded into n-gram rows twice: words and pairs, then longer ones.  An n-gram can't be more frequent than its parts, so
    the second time only n-grams whose pairs may be frequent become rows: a filter of at most 32 MB says which, and
    one that fills up lets rows through that the count drops.  Counts are exact: equal n-grams are combined by value in each
    slice, then by hash aggregation.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # mostly rare n-grams, combined by slice: a second table of them before the shuffle takes memory and saves little
    rows = docs.mapInArrow(_exploded((1, 2)[:max_n], None), _GRAMS).repartition("lang", "gram")
    short = cut(_counted(rows, least), gather=True)
    if max_n < 3:
        return short
    found = docs.sparkSession.sparkContext.broadcast(_filter(short.where("gram like '% %'")))
    return short.unionByName(cut(_counted(docs.mapInArrow(_exploded(tuple(range(3, max_n + 1)), (2, found)), _GRAMS), least), gather=True))


def _counted(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("lang", "gram").agg(F.sum("c").alias("c")).where(F.col("c") >= least)


def _joined(parts: F.Column, first: F.Column | int, length: F.Column | int) -> F.Column:
    return F.array_join(F.slice(parts, first, length), " ")


def mine(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``max_n`` words: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z are lower-cased; a text (null: empty) falls into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words ``[^\\x20\\x09]+``; a null
    language is ``und``.  n counts the words of the language, f a phrase's occurrences within pieces, overlapping ones
    too.  A candidate has a = f(phrase) >= ``least``.  A cut behind its k-th word has l and r, the counts of the two parts, and
    score floor(2000000 * a / (l + r)) in Decimal; the lowest cut counts, of equal ones that of the smallest k.  A candidate goes when a
    longer candidate that holds its words has at least ``covered`` percent of its count: the longer phrase's parts of one
    word less are as frequent as it is, so one-word extensions show all of them.  Ranks go by score and a, descending, and phrase in byte order.

    Repeated rows count each time; an empty table gives no rows; columns besides ``lang`` and ``text`` are ignored.  A language is ranked
    in parts first, so that no task sorts more than ``PARTS * top`` rows of it.
    """
    grams = frequent_grams(docs, max_n, least)
    large = lambda c: F.col(c).cast("decimal(38,0)")
    words_of = grams.withColumn("parts", F.split("gram", " "))
    phrases = cut(words_of.where(F.size("parts") > 1).select("lang", F.col("gram").alias("phrase"), F.col("c").alias("a"), "parts"), gather=True)

    cuts = phrases.select("lang", "phrase", "a", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("parts"), 1, F.col("k")).alias("left"), _joined(F.col("parts"), F.col("k") + 1, F.size("parts")).alias("right"))
    cuts = cuts.join(grams.select("lang", F.col("gram").alias("left"), F.col("c").alias("l")), ["lang", "left"])
    cuts = cuts.join(grams.select("lang", F.col("gram").alias("right"), F.col("c").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("(2000000bd * cast(a as decimal(38,0))) div (cast(l as decimal(38,0)) + cast(r as decimal(38,0)))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low")).select("lang", "phrase", "a", "low.l", "low.r", "low.score")

    longer = phrases.where(F.size("parts") > 2)
    held = longer.select("lang", F.explode(F.array(_joined(F.col("parts"), 1, F.size("parts") - 1), _joined(F.col("parts"), 2, F.size("parts")))).alias("phrase"), "a")
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    gone = phrases.join(held, ["lang", "phrase"]).where(large("most") * 100 >= large("a") * covered).select("lang", "phrase")
    left = scored.join(gone, ["lang", "phrase"], "left_anti")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    totals = grams.where("gram = ''").select("lang", F.col("c").alias("n"))
    return left.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for the rows of op12_collocations over the view ``documents``.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS p FROM worded WHERE len(ws) > 0),
sized AS (SELECT lang, ws, p, unnest(range(1, least(4, len(ws) - p + 1) + 1)) AS k FROM starts),
grams AS (SELECT lang, array_to_string(ws[p:p + k - 1], ' ') AS gram, k, count(*) AS c FROM sized GROUP BY ALL),
totals AS (SELECT lang, sum(c)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
phrases AS (SELECT lang, gram AS phrase, k AS size, c AS a, string_split(gram, ' ') AS ws FROM grams WHERE k > 1 AND c >= 30),
cuts AS (SELECT *, unnest(range(1, size)) AS cut FROM phrases),
scored AS (
  SELECT p.lang, p.phrase, p.a, p.cut, x.c AS l, y.c AS r, (2000000 * p.a::HUGEINT // (x.c + y.c))::BIGINT AS score
  FROM cuts p JOIN grams x ON x.lang = p.lang AND x.gram = array_to_string(p.ws[1:p.cut], ' ') JOIN grams y ON y.lang = p.lang AND y.gram = array_to_string(p.ws[p.cut + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (SELECT lang, a AS most, size AS longer, ws, unnest(range(2, size)) AS short FROM phrases WHERE size > 2),
inside AS (SELECT lang, most, ws, short, unnest(range(1, longer - short + 2)) AS p FROM held),
parts AS (SELECT lang, array_to_string(ws[p:p + short - 1], ' ') AS phrase, max(most) AS most FROM inside GROUP BY ALL),
kept AS (SELECT w.* FROM lowest w LEFT JOIN parts h USING (lang, phrase) WHERE h.most IS NULL OR 100 * h.most::HUGEINT < 80 * w.a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
