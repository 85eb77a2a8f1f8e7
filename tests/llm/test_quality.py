"""Quality rules against plain counts over whole tables, the regression against a plain scorer and held-out rows."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vigia.llm import quality
from vigia.llm.kernels import text_bytes
from vigia.llm.queries import op11_quality_rules

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def plain(text):
    words = [w for w in SPACE.split(text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if SPACE.sub("", line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(covered), failed


def test_base_counts_of_whole_tables(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op11_quality_rules(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain(texts[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.KEEP)


ODD = [None, "", " \n\t", "a", "é" * 40, "a b c a b c a b c", "x y\n\nx y\n x y\nx y", "#*$%&|<>\x0b\x0cé #", "one\n" * 60, ("w " * 3000).strip(), "\n\n\na\na\n", "a b c d e f g " * 20, " ".join(map(str, range(60)))]


def test_odd_texts_equal_plain_counts_in_any_slice(spark):
    docs = spark.createDataFrame([(i if i % 4 else None, t, "clash") for i, t in enumerate(ODD * 2)], "doc_id long, text string, q string")
    out = quality.apply_rules(docs, quality.NO_MODEL, "q").collect()
    assert len(out) == 2 * len(ODD)
    for r in out:
        assert tuple(r["q"])[:6] == tuple(plain(r["text"])[i] for i in (0, 1, 2, 3, 4, 5))
        assert r["q"]["kept"] == (not r["q"]["base_failed"])
    assert quality.apply_rules(docs.limit(0), quality.NO_MODEL).count() == 0


def test_logits_equal_a_plain_sum_over_grams():
    rng = np.random.default_rng(5)
    model = quality.Model(rng.normal(size=1 << quality.BUCKET_BITS).astype(np.float32), 0.7, -0.2)
    texts = ["Aa bb Aa ççç", "", "x", "one two  three\nfour one two"]
    data, offsets = text_bytes(pa.array(texts))
    got = model.logits(data, offsets)
    for i, text in enumerate(texts):
        alone = text_bytes(pa.array([text]))
        want = 0.0
        kinds = 0
        for _, bucket in quality._features(*alone, quality._words(*alone)):
            kinds += 1
            if len(bucket):
                want += np.mean([float(model.weight[b]) for b in bucket])
        assert got[i] == pytest.approx(want, abs=1e-6)
        raw, n = text.encode(), len(SPACE.split(text.strip())) if text.strip() else 0
        sizes = [len(b) for _, b in quality._features(*alone, quality._words(*alone))]
        assert sizes == [x for x in [len(raw), len(raw) - 1, len(raw) - 2, n, n - 1] if x > 0] or kinds == 0


def test_fit_separates_kinds_and_probabilities_are_calibrated():
    rng = np.random.default_rng(1)
    make = lambda stock, n: [" ".join(rng.choice(stock, 60)) for _ in range(n)]
    kinds = (["the", "of", "house", "river", "stone"], ["CLICK!!", "MENU|", "###", "BUY$$"])
    texts = make(kinds[0], 330) + make(kinds[1], 330)
    labels = np.array([1] * 300 + [0] * 30 + [0] * 300 + [1] * 30)  # one in eleven lies
    order = rng.permutation(660)
    model = quality.fit(pa.array([texts[i] for i in order], pa.large_string()), labels[order])
    good, bad = (model.chances(*text_bytes(pa.array(make(kind, 300), pa.large_string()))) for kind in kinds)
    assert (good > 0.5).mean() > 0.95 and (bad < 0.5).mean() > 0.95
    assert 0.75 < good.mean() < 0.97 and 0.03 < bad.mean() < 0.25
    assert quality.fit(pa.array(["a", "b"], pa.large_string()), np.array([1, 1])) is quality.NO_MODEL


def test_calibration_minimises_the_plain_loss():
    rng = np.random.default_rng(2)
    logit = rng.normal(size=400) * 3
    good = (rng.random(400) < 1 / (1 + np.exp(-(0.4 * logit - 0.5)))).astype(float)
    slope, shift = quality._calibrate(logit, good, np.ones(400))
    most, least = good.sum(), 400 - good.sum()
    target = np.where(good == 1, (most + 1) / (most + 2), 1 / (least + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * logit + b)))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum()

    assert all(loss(slope, shift) <= loss(slope + d, shift + e) + 1e-9 for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))


def test_held_out_labels(spark, sf_dir):
    """A third of the labels is held out here; of the rest the model learns."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out_of = {i for i in known if zlib.crc32(str(i).encode()) % 3 == 1}
    model = quality.train(docs, labels.where(~labels["doc_id"].isin(list(out_of))))
    rows = [r for r in quality.apply_rules(docs, model, "q").select("doc_id", "q.*").collect() if r["doc_id"] in out_of]
    good, bad = [r for r in rows if known[r["doc_id"]] == 1], [r for r in rows if known[r["doc_id"]] == 0]
    assert sum(r["kept"] for r in bad) <= 0.05 * len(bad)
    assert sum(not r["base_failed"] and not r["kept"] for r in good) <= 0.02 * len(good)


def test_training_ignores_rows_without_id_or_label(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 5)], "doc_id long, quality int")
    assert quality.train(docs, labels) is quality.NO_MODEL
