"""Residual test, lag surfaces, pooled vectors and matched sets against dense or enumerated versions."""

import datetime
import math
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigia.functions import kernels
from vigia.operators import fits, lagmodels

DAY = datetime.date(2020, 1, 1)


def test_ljung_box_equals_its_formula(spark):
    rng = np.random.default_rng(1)
    series = {"a": rng.normal(size=60), "b": np.cumsum(rng.normal(size=45)), "flat": np.ones(30), "short": rng.normal(size=8)}
    rows = [(k, i, float(v) if (k, i) != ("a", 7) else None) for k, x in series.items() for i, v in enumerate(x)]
    got = {r["k"]: r for r in lagmodels.ljung_box(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], "t", "v", 10).collect()}
    for k in ("a", "b"):
        x = np.delete(series[k], 7) if k == "a" else series[k]
        q, p = lagmodels._ljung(x, 10)
        assert got[k]["q"] == pytest.approx(q) and got[k]["p_value"] == pytest.approx(p) and got[k]["n"] == len(x)
    assert got["b"]["p_value"] < 0.001
    assert got["flat"]["q"] is None and got["short"]["q"] is None


@pytest.fixture(scope="module")
def daily(spark):
    rng = np.random.default_rng(5)
    cases, climate = [], []
    for place in range(3):
        t = 22 + 5 * np.sin(2 * np.pi * np.arange(500) / 365) + rng.normal(0, 2, 500)
        for i in range(500):
            day = DAY + datetime.timedelta(days=i)
            climate.append((place, day, float(t[i])))
            recent = t[max(0, i - 3) : i + 1].mean()
            cases.append((place, day, int(rng.poisson(math.exp(2.5 + 0.03 * (1 + place / 4) * (recent - 22))))))
    return spark.createDataFrame(cases, "k int, date date, n int"), spark.createDataFrame(climate, "k int, date date, t double")


def test_surface_adds_up_to_the_overall_curve(spark, daily):
    found = lagmodels.lag_fits(*daily, "k", "n", "t", lags=7, reference=22.0)
    rows = found.collect()
    assert len(rows) == 3 and all(r["dispersion_class"] == "adequate" and len(r["coef"]) == 12 and r["autocorr_p"] > 1e-4 and math.isfinite(r["aic_poisson"]) for r in rows)
    curve = fits.distributed_lag_model(*daily, "k", "n", "t", lags=7, points=9, reference=22.0).collect()
    at = sorted({(r["k"], r["exposure"]) for r in curve})
    for k in range(3):
        own = [x for p, x in at if p == k]
        surface = lagmodels.lag_surface(found.where(F.col("k") == k), "k", own).collect()
        last = {r["exposure"]: r for r in surface if r["lag"] == 7}
        for r in curve:
            if r["k"] == k:
                assert last[r["exposure"]]["cum_log_rr"] == pytest.approx(r["log_rr"], abs=1e-9) and last[r["exposure"]]["cum_se"] == pytest.approx(r["se"], abs=1e-9)
                parts = [s["log_rr"] for s in surface if s["exposure"] == r["exposure"]]
                assert len(parts) == 8 and sum(parts) == pytest.approx(r["log_rr"], abs=1e-9)
        warm = min(surface, key=lambda s: (s["lag"] != 7, -s["exposure"]))
        assert warm["cum_rr"] > 1 and warm["cum_rr_lo"] < warm["cum_rr"] < warm["cum_rr_hi"]
    slices = lagmodels.lag_response(found, "k").collect()
    assert len(slices) == 24 and all(s["rr_lo"] <= s["rr"] <= s["rr_hi"] for s in slices)


def test_pooled_curves_on_a_common_basis(spark, daily):
    knots, bounds = [18.0, 22.0, 26.0], (10.0, 34.0)
    found = lagmodels.lag_fits(*daily, "k", "n", "t", lags=7, knots=knots, bounds=bounds, reference=22.0)
    pooled = lagmodels.pool_vectors(found, "k")
    assert pooled.n == 3 and pooled.df == 8 and 0 <= pooled.p_value <= 1 and pooled.blups.count() == 3
    curve = {r["exposure"]: r for r in lagmodels.curve(spark, pooled.mean, pooled.cov, knots, bounds, 22.0, [18.0, 22.0, 27.0]).collect()}
    assert curve[22.0]["rr"] == 1 and curve[27.0]["rr"] > 1 > curve[18.0]["rr"]


def vectors(spark, y, s):
    return spark.createDataFrame([(i, [float(v) for v in a], [float(v) for v in b.ravel()]) for i, (a, b) in enumerate(zip(y, s, strict=True))], "k int, reduced array<double>, reduced_cov array<double>")


def level(y, s, psi):
    w = np.linalg.inv(s + psi)
    a = w.sum(axis=0)
    beta = np.linalg.solve(a, np.einsum("iab,ib->a", w, y))
    e = y - beta
    return -0.5 * (np.linalg.slogdet(s + psi)[1].sum() + np.linalg.slogdet(a)[1] + np.einsum("ia,iab,ib->", e, w, e))


def test_one_term_is_the_scalar_fit(spark):
    rng = np.random.default_rng(2)
    s = rng.uniform(0.01, 0.05, 12)
    y = 0.3 + rng.normal(0, 0.25, 12) + rng.normal(0, np.sqrt(s))
    want = kernels.pool_effects(y, s)
    got = lagmodels.pool_vectors(vectors(spark, y[:, None], s[:, None, None]), "k")
    assert (got.mean[0], math.sqrt(got.cov[0, 0]), got.between[0, 0], got.q, got.i2, got.p_value) == pytest.approx((want["effect"], want["se"], want["tau2"], want["q"], want["i2"], want["p"]), rel=1e-5)


def test_vectors_reach_the_highest_likelihood_and_shrink(spark):
    rng = np.random.default_rng(3)
    k, n = 3, 25
    root = rng.normal(size=(k, k)) * 0.3
    s = np.array([(m := rng.normal(size=(k, k)) * 0.2) @ m.T + 0.02 * np.eye(k) for _ in range(n)])
    y = np.array([1.0, -0.5, 0.2]) + rng.normal(size=(n, k)) @ root.T + np.array([rng.multivariate_normal(np.zeros(k), v) for v in s])
    got = lagmodels.pool_vectors(vectors(spark, y, s), "k")
    best = level(y, s, got.between)
    assert got.log_likelihood == pytest.approx(best, abs=1e-8)
    for _ in range(200):
        d = rng.normal(size=(k, k)) * rng.choice([1e-3, 1e-2, 0.1])
        m = got.between + d + d.T
        if np.linalg.eigvalsh(m).min() >= 0:
            assert level(y, s, m) <= best + 1e-7
    w = np.linalg.inv(s + got.between)
    assert got.cov == pytest.approx(np.linalg.inv(w.sum(axis=0)))
    for r in got.blups.collect():
        i = r["k"]
        assert r["blup"] == pytest.approx(got.mean + got.between @ w[i] @ (y[i] - got.mean), abs=1e-9)
    one = lagmodels.pool_vectors(vectors(spark, y[:1], s[:1]), "k")
    assert one.mean == pytest.approx(y[0]) and one.cov == pytest.approx(s[0]) and one.df == 0


def test_conditional_logit_equals_enumeration(spark):
    rng = np.random.default_rng(4)
    rows, sets = [], {}
    for key in "ab":
        for stratum in range(25):
            n = int(rng.integers(2, 8))
            x = rng.normal(size=(n, 2))
            y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - 0.5 * x[:, 1])))).astype(int)
            sets[key, stratum] = (x, y)
            rows += [(key, stratum, int(c) * 3, float(v[0]), float(v[1])) for v, c in zip(x, y, strict=True)]
    rows.append(("a", 99, 1, None, 0.0))
    design = spark.createDataFrame(rows, "k string, stratum int, n int, u double, v double")
    got = {(r["k"], r["term"]): r for r in lagmodels.conditional_logit(design, "k", "stratum", "n", ["u", "v"]).collect()}

    def likelihood(key, beta):
        total = 0.0
        for (k, _), (x, y) in sets.items():
            if k == key and 0 < y.sum() < len(y):
                total += (x[y > 0] @ beta).sum() - math.log(sum(math.exp((x[list(c)] @ beta).sum()) for c in combinations(range(len(y)), int(y.sum()))))
        return total

    for key in "ab":
        beta = np.array([got[key, t]["estimate"] for t in "uv"])
        best = likelihood(key, beta)
        h = 1e-3
        for i in range(2):
            e = h * (np.arange(2) == i)
            assert abs(likelihood(key, beta + e) - likelihood(key, beta - e)) / (2 * h) < 1e-4
        curve = np.array([[(likelihood(key, beta + h * (np.arange(2) == i) + h * (np.arange(2) == j)) - likelihood(key, beta + h * (np.arange(2) == i)) - likelihood(key, beta + h * (np.arange(2) == j)) + best) / h**2 for i in range(2)] for j in range(2)])
        assert [got[key, t]["se"] for t in "uv"] == pytest.approx(list(np.sqrt(np.diag(np.linalg.inv(-curve)))), rel=1e-2)
        assert got[key, "u"]["n_strata"] == sum(k == key and 0 < y.sum() < len(y) for (k, _), (_, y) in sets.items())


def test_branches_run_common_steps_once(spark):
    from vigia.plans import recipe
    from vigia.plans.meta import HealthFrame

    rows = [(DAY + datetime.timedelta(days=i), "350000" if i % 3 else "0", i % 2) for i in range(200)]
    source = HealthFrame(spark.createDataFrame(rows, "date date, muni string, sex int"))
    steps = [{"name": "drop_invalid_geo", "parameters": {"column": "muni"}}, {"name": "aggregate_series", "parameters": {"date": "date", "unit": "day", "by": ["muni"]}}]
    import inspect

    from vigia.operators import aggregate

    names = list(inspect.signature(aggregate.drop_invalid_geo).parameters)[1], list(inspect.signature(aggregate.aggregate_series).parameters)[1:3]
    steps[0]["parameters"] = {names[0]: "muni"}
    steps[1]["parameters"] = {names[1][0]: "date", names[1][1]: "day", "by": ["muni"]}
    recipes = [r for unit in ("day", "week", "month") for r in [{"steps": [steps[0], {**steps[1], "parameters": steps[1]["parameters"] | {names[1][1]: unit}}]}] * 2]
    stored = []

    def store(df):
        stored.append(df)
        return df

    results, ran = recipe.run_branches(recipes, source, store=store)
    assert ran == 4 and len(stored) == 1  # one common step and three units, each wanted twice
    for r, own in zip(results, recipes, strict=True):
        alone = recipe.run(own, source)
        assert sorted(map(tuple, r.df.collect()), key=repr) == sorted(map(tuple, alone.df.collect()), key=repr) and r.meta == alone.meta


def test_counterfactual_of_interruptions(spark):
    from vigia.operators import fits, models

    days = [(f"2020-{m:02d}-01", k, float(100 + 2 * m - 30 * (m >= 7))) for m in range(1, 13) for k in ("a", "b")]
    design = models.interrupted_design(spark.createDataFrame(days, "date string, k string, n double"), "date", "2020-07-01", 0)
    coefs = fits.interrupted_series(design, "k", "n", ["time", "step", "slope"])
    out = models.interruption_counterfactual(design, coefs, "n", "k")
    rows = out.collect()
    assert len(rows) == 24
    for r in rows:
        assert abs(r["fitted"] - r["n"]) < 1.5
        before = r["date"] < "2020-07-01"
        assert r["segment"] == (0 if before else 1)
        assert abs(r["counterfactual"] - r["fitted"]) < 1e-9 if before else r["counterfactual"] > r["fitted"] + 20
    means = {r["segment"]: r for r in models.segment_means(out, "n", "k").where("k = 'a'").collect()}
    assert means[0]["mean_observed"] == 107 and means[1]["mean_observed"] == 89
    assert abs(means[0]["change_percent"]) < 0.5 and -30 < means[1]["change_percent"] < -20
    with pytest.raises(ValueError, match="no column"):
        models.interruption_counterfactual(design.drop("slope"), coefs, "n", "k")
    one = models.interruption_counterfactual(design.where("k = 'a'"), coefs.where("k = 'a'").drop("k"), "n")
    assert one.count() == 12 and models.segment_means(one, "n").count() == 2


def test_matched_set_of_risks_far_apart_is_finite():
    x, y = np.array([[0.0], [1.0], [2.0], [5.0]]), np.array([0.0, 1.0, 0.0, 1.0])
    level, slope, info = lagmodels._stratum(x, y, np.array([-900.0]))
    assert level == pytest.approx(-900 * 5) and slope == pytest.approx([5.0]) and info == pytest.approx(np.zeros((1, 1)), abs=1e-9)
    beta = 0.7
    sums = np.array([x[list(pair), 0].sum() for pair in combinations(range(4), 2)])
    share = np.exp(beta * sums) / np.exp(beta * sums).sum()
    level, slope, info = lagmodels._stratum(x, y, np.array([beta]))
    assert level == pytest.approx(beta * 6 - np.log(np.exp(beta * sums).sum()))
    assert slope == pytest.approx([6 - share @ sums]) and info[0, 0] == pytest.approx(share @ sums**2 - (share @ sums) ** 2)


def test_separated_sets_take_all_rounds_on_plans_of_one_size(spark, capsys):
    """Cases that x tells from their controls have no finite estimate, so no round is the last; the planner's size of the state was squared by each, 38,855 digits after eleven."""
    sets = {("a", s): [(int(i == 2), i + s * 0.1) for i in range(3)] for s in range(3)} | {("b", s): [(int(i == s % 2), i + s * 0.1) for i in range(3)] for s in range(5)}
    design = spark.createDataFrame([(*k, *row) for k, rows in sets.items() for row in rows], "k string, stratum int, n int, x double")
    found = lagmodels.conditional_logit(design, "k", "stratum", "n", ["x"], rounds=11)
    capsys.readouterr()
    found.explain("cost")
    sizes = re.findall(r"sizeInBytes=[\d.]+(?:E\+(\d+))?", capsys.readouterr().out)
    assert sizes and max(int(x or 0) for x in sizes) < 1000
    got = {r["k"]: r for r in found.collect()}
    for key in "ab":
        own = [np.array(rows, float) for (k, _), rows in sets.items() if k == key]
        beta = np.zeros(1)
        for _ in range(11):
            parts = [lagmodels._stratum(x[:, 1:], x[:, 0], beta) for x in own]
            slope, info = sum(p[1] for p in parts), sum(p[2] for p in parts)
            scale = math.sqrt(info[0, 0] / len(own))
            step = slope[0] / info[0, 0]
            beta = beta + step * min(1.0, 2.0 / abs(step * scale))
        assert got[key]["estimate"] == pytest.approx(beta[0]) and got[key]["se"] == pytest.approx(1 / math.sqrt(info[0, 0]))
        assert got[key]["n_cases"] == got[key]["n_strata"] == len(own)
    assert got["a"]["estimate"] > 8
