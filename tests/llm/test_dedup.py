import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from vigia.llm import exactdedup, linededup


def cut_lines(rows):
    """Brute force: rows in order; returns the text left of each."""
    clean = [[re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ") for x in (t or "").split("\n")] for _, t in rows]
    seen, out = set(), []
    for (_, text), lines in sorted(zip(rows, clean, strict=True), key=lambda x: x[0][0]):
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        raw = (text or "").split("\n")
        out.append(None if text is None else "\n".join(x for i, x in enumerate(raw) if i not in gone))
    return out


def test_line_dedup_against_brute_force(spark, sf_dir):
    rng = random.Random(5)
    passage = [f"common line {i}" for i in range(6)]
    rows = []
    for i in range(120):
        lines = [rng.choice("abcdefg") * 3 for _ in range(rng.randrange(1, 9))]
        if i % 3 == 0:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = passage[rng.randrange(3) :]
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n\n\n\n"), (203, "x\ny"), (204, "same\nsame\nsame\nsame\nsame")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"pos": F.lit(1), "cut": F.lit("c"), "n_lines": F.lit("old")})
    got = linededup.remove_repeated_lines(docs).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == cut_lines(rows)
    assert got[0]["cut"] == "c" and len(got) == len(rows)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = [tuple(r) for r in table.select("doc_id", "text").collect()]
    assert [r["text"] for r in linededup.remove_repeated_lines(table).orderBy("doc_id").collect()] == cut_lines(whole)


def test_line_dedup_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd")], "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in linededup.remove_repeated_lines(docs).collect())
    assert got == [("1", "", 3), ("1", "", 3), ("2", "d", 3), ("None", "a\nb\nc", 0)]
    assert linededup.remove_repeated_lines(docs.limit(0)).count() == 0


def test_perfect_hash_fills_every_slot_once():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (5000, 4), dtype=np.uint64)
    table = exactdedup.MinimalPerfectHash(keys)
    assert sorted(table.slots(keys)) == list(range(5000))
    other = rng.integers(0, 1 << 63, (5000, 4), dtype=np.uint64)
    slots = table.slots(other)
    held = np.zeros_like(keys)
    held[table.slots(keys)] = keys
    assert not (held[slots[slots >= 0]] == other[slots >= 0]).all(axis=1).any()


def brute_groups(rows):
    key = {}
    for i, (d, t) in enumerate(rows):
        key.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for text, at in key.items():
        ids = [rows[i][0] for i in at if rows[i][0] is not None]
        keep = min(ids) if ids else None
        out += [(rows[i][0], keep, len(at), rows[i][0] == keep, hashlib.sha256(text.encode()).hexdigest()) for i in at]
    return sorted(out, key=str)


def test_exact_groups_with_any_history(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a  b", "a\tb", "a b ", "c", "d\n", "d ", f"u{i}"])) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "\n"), (7, "again"), (7, "a  b"), (None, "c"), (None, "only null"), (2000, "x" * 200_000), (2001, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"digest": F.lit(1), "winner": F.lit(2), "n": F.lit(3)})
    for below in (None, 0, 150, 10_000):
        got = exactdedup.exact_groups(docs, history_below=below, shard_keys=16).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_groups(rows)
    assert exactdedup.exact_groups(docs.limit(0)).count() == 0
