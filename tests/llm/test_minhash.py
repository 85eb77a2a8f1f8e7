import random
import re

import numpy as np
from pyspark.sql import functions as F

from vigia.llm.kernels import shingles
from vigia.llm.minhash import near_duplicates

SPACE = re.compile("[\x20\x09-\x0d]+")


def word_sets(rows):
    out = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in SPACE.split(low) if x]
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute(rows):
    sets, ids = word_sets(rows), [r[0] for r in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return {(d, len(s), find(d), find(d) == d) for d, s in zip(ids, sets, strict=True)}


def result(df):
    return {tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()}


def test_against_brute_force_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(near_duplicates(docs)) == brute(rows)


def family(rng, words, n, edits, start):
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(n):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((start + i, " ".join(copy)))
    return rows


def test_large_groups_chains_and_common_passages(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    common = " ".join(rng.choice(words) for _ in range(60))
    rows = family(rng, words, 90, 3, 0) + family(rng, words, 60, 2, 1000)
    rows += [(2000 + i, common + " " + " ".join(rng.choice(words) for _ in range(rng.choice((20, 60, 200))))) for i in range(90)]
    chain = [rng.choice(words) for _ in range(200)]
    for i in range(20):
        rows.append((3000 + i, " ".join(chain)))
        for _ in range(3):
            chain[rng.randrange(200)] = rng.choice(words)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(near_duplicates(docs, list_cap=6)) == brute(rows)
    assert result(near_duplicates(docs)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two"), (7, "a b c d e"), (8, "a b c d e"), (9, "x " * 5000), (10, "x " * 4000)]
    docs = spark.createDataFrame([(*r, r[0], "s") for r in rows], "doc_id bigint, text string, id bigint, component string")
    assert result(near_duplicates(docs)) == brute(rows)
    nulls = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e")], "doc_id bigint, text string")
    assert result(near_duplicates(nulls)) == {(None, 1, None, True), (1, 1, 1, True)}
    assert near_duplicates(docs.limit(0)).count() == 0


def test_blocks_find_what_leaders_miss(spark):
    import vigia.llm.minhash as m

    rng = random.Random(3)
    words = [f"v{i}" for i in range(2000)]
    rows = family(rng, words, 40, 5, 0)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text"))
    old, m.BLOCK = m.BLOCK, 7
    try:
        assert result(near_duplicates(docs, list_cap=2)) == brute(rows)
    finally:
        m.BLOCK = old


def test_hot_families_of_whole_and_cut_sets(spark):
    def sketch(text, k=64):
        data = np.frombuffer(text.encode(), np.uint8)
        return set(shingles(data, np.array([0, len(data)]))[0][:k].tolist())

    rng, rows, found = random.Random(11), [], 0
    own = lambda n: [f"r{rng.getrandbits(60)}" for _ in range(n)]
    while found < 5:  # 64 shingles, all of them in a text of 85, whose sketch leaves 17 or more of them out
        inner = own(68)
        pair = " ".join(inner), " ".join(inner + own(21))
        if len(sketch(pair[0]) - sketch(pair[1])) < 17:
            continue
        rows += [(1000 * found + i, text) for i, text in enumerate(pair)]
        # texts that share the small values of both, so that all their lists are long, and are no links
        rows += [(1000 * found + 2 + i, " ".join(own(16) + inner + own(16))) for i in range(40)]
        found += 1
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(near_duplicates(docs, list_cap=6)) == brute(rows)
