import datetime
import math

import numpy as np
import pytest

from vigia.operators import boosting, econometrics, inference, spatial


def test_normal_and_exceedance(spark):
    df = spark.createDataFrame([(1.2, 1.0, 1.44), (1.0, 1.0, 1.0)], "rr double, lo double, hi double")
    out = inference.exceedance_probability(df, "rr", "lo", "hi", [1.0, 1.2]).collect()
    assert out[0]["p_gt_1_0"] == pytest.approx(0.975, abs=1e-3) and out[0]["p_gt_1_2"] == pytest.approx(0.5, abs=1e-6)
    assert out[1]["p_gt_1_0"] is None


def test_projection_widens(spark):
    rows = inference.project_risk(spark.createDataFrame([("a", 0.1, 0.0, 0.01)], "k string, l double, s double, v double"), "k", "l", "s", "v", 3).orderBy("step").collect()
    widths = [r["rr_hi"] - r["rr_lo"] for r in rows]
    assert widths == sorted(widths) and rows[0]["rr"] == pytest.approx(math.exp(0.1))


def test_permutations_find_a_gradient(spark):
    cells = [(i, float(i // 6)) for i in range(36)]
    links = [(a, b) for a in range(36) for b in range(36) if a != b and abs(a // 6 - b // 6) + abs(a % 6 - b % 6) == 1]
    w = spatial.row_weights(spark.createDataFrame(links, "src int, dst int"))
    row = econometrics.permutation_test(spark.createDataFrame(cells, "k int, v double"), w, "k", "v", 199).first()
    assert row["moran_i"] > 0.6 and row["p_value"] == pytest.approx(1 / 200)


def test_meta_regression(spark):
    rng = np.random.default_rng(3)
    rows = [("g", float(0.5 + 0.3 * x + rng.normal(0, 0.05)), 0.05, float(x)) for x in rng.normal(size=60)]
    out = {r["term"]: r for r in inference.meta_regression(spark.createDataFrame(rows, "g string, e double, se double, x double"), "g", "e", "se", ["x"]).collect()}
    assert out["x"]["estimate"] == pytest.approx(0.3 * np.std([r[3] for r in rows]), abs=0.05) and out["x"]["p_value"] < 1e-6


def test_attributable_interval_holds_the_number(spark):
    df = spark.createDataFrame([("a", 10.0, 0.2, 0.05)] * 20, "k string, n double, l double, se double")
    row = inference.attributable_interval(df, "k", "n", "l", "se", 300).first()
    assert row["an"] == pytest.approx(200 * (1 - math.exp(-0.2))) and row["an_lo"] < row["an"] < row["an_hi"]


def test_gaps_are_filled_near_the_truth(spark):
    start = datetime.datetime(2020, 1, 1)
    truth = [20 + 8 * math.sin(2 * math.pi * k / 24) for k in range(600)]
    rows = [("s", start + datetime.timedelta(hours=k), None if k % 9 == 4 else truth[k]) for k in range(600)] + [("bad", start + datetime.timedelta(hours=k), None) for k in range(50)]
    out = boosting.fill_gaps(spark.createDataFrame(rows, "s string, t timestamp, v double"), "s", "t", "v").orderBy("t").collect()
    assert len(out) == 600
    made = [(r["v"], truth[k]) for k, r in enumerate(out) if r["is_imputed_v"]]
    assert len(made) == 67 and max(abs(a - b) for a, b in made) < 1.0


def test_boosted_trees_keep_groups_whole(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), float(x), float(x > 0) * 5) for g in range(12) for x in rng.normal(size=20)]
    out, _, _ = boosting.out_of_fold(spark.createDataFrame(rows, "g int, x double, y double"), "y", ["x"], "g", folds=2, rounds=30, depth=2)
    got = out.collect()
    assert len(got) == 240 and np.mean([(r["y"] - r["prediction"]) ** 2 for r in got]) < 1.0
