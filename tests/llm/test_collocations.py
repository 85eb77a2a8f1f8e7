"""Collocations against a plain count on small tables, hard cases among them."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vigia.llm import collocations

SEPARATORS = re.compile(r"[.,;:!?\x0A-\x0D]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, max_n, least, top, covered):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in SEPARATORS.split((text or "").translate(LOWER)):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(ws)
            for n in range(1, max_n + 1):
                for i in range(len(ws) - n + 1):
                    counts[lang][tuple(ws[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items())
            if not inside:
                score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    stock = ["Le", "le", "chat", "É", "é", "new", "York", "city", "hall", "a", "a", "—", "x y"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(stock) + rng.choice([" ", " ", "  ", "\t", " ", ". ", "\n", ","]) for _ in range(rng.randrange(0, 60)))
        rows.append((rng.choice(["en", "en", "fr", None, ""]), text))
    rows += [("en", None), (None, ""), ("en", " ,. "), ("xx", "alone")] + [("en", "new york city hall. ")] * 40 + [("en", "a " * 500)]
    return rows


@pytest.mark.parametrize(("max_n", "least", "top", "covered"), [(4, 30, 2000, 80), (2, 5, 7, 80), (3, 2, 50, 50), (4, 1, 2000, 100)])
def test_equals_plain_counts(spark, texts, max_n, least, top, covered):
    docs = spark.createDataFrame([(lang, text, 1, 2) for lang, text in texts], "lang string, text string, rank int, phrase int").repartition(5)
    assert rows_of(collocations.mine(docs, max_n, least, top, covered)) == plain(texts, max_n, least, top, covered)


def test_slices_and_full_filters_change_nothing(spark, texts, monkeypatch):
    docs = spark.createDataFrame(texts, "lang string, text string")
    want = plain(texts, 4, 10, 2000, 80)
    whole = np.full(4, np.iinfo(np.uint64).max, np.uint64)  # a filter that lets everything through
    monkeypatch.setattr(collocations, "_filter", lambda grams: whole)
    assert rows_of(collocations.mine(docs, 4, 10)) == want


def test_filter_holds_every_gram(spark):
    grams = spark.createDataFrame([("en", f"w{i} v{i % 7}") for i in range(5000)] + [("fr", "é è")], "lang string, gram string")
    found = collocations._filter(grams)
    import pyarrow as pa

    def codes(rows):
        lang, words = collocations._hashes(pa.array([r[0] for r in rows for _ in range(2)])), collocations._hashes(pa.array([w for r in rows for w in r[1].split(" ")]))
        return collocations._codes(lang, words, 2)[::2]

    assert collocations._maybe(found, codes([tuple(r) for r in grams.collect()])).all()
    assert collocations._maybe(found, codes([("de", f"w{i} u{i}") for i in range(5000)])).mean() < 0.1


def test_counts_past_64_bits(spark, monkeypatch):
    """Scores of counts whose product with 2000000 passes 64 bits."""
    a, l, r = 9 * 10**15, 10**16, 2 * 10**16
    grams = spark.createDataFrame([("en", "", 5 * 10**16), ("en", "x", l), ("en", "y", r), ("en", "x y", a)], "lang string, gram string, c bigint")
    monkeypatch.setattr(collocations, "frequent_grams", lambda *_: grams)
    assert rows_of(collocations.mine(grams)) == [("en", 1, "x y", a, l, r, 5 * 10**16, 2000000 * a // (l + r))]


def test_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).collect() == []
