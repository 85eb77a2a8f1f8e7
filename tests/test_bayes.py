"""The spatial Bayesian models against dense solutions."""

import math

import numpy as np
import pytest

from vigia.operators import bayes


def lattice(side):
    w = np.zeros((side * side, side * side))
    for i in range(side):
        for j in range(side):
            for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                if 0 <= i + a < side and 0 <= j + b < side:
                    w[side * i + j, side * (i + a) + j + b] = 1
    return w


def counts(side, seed):
    rng = np.random.default_rng(seed)
    w = lattice(side)
    n = len(w)
    q = 0.9 * (np.diag(w.sum(1)) - w) + 0.1 * np.eye(n)
    u = np.linalg.solve(np.linalg.cholesky(q).T, rng.normal(size=n)) * 0.5
    x, e = rng.normal(size=n), rng.uniform(5, 40, size=n)
    return w, x, e, rng.poisson(e * np.exp(0.1 + 0.3 * x + u))


def tables(spark, w, **columns):
    names = list(columns)
    areas = spark.createDataFrame([(i, *(float(columns[c][i]) for c in names)) for i in range(len(w))], "k long, " + ", ".join(f"{c} double" for c in names))
    links = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "src long, dst long, w double")
    return areas, links


def dense(w, x, y, off, rho, tau2, family="poisson", trials=None):
    """Mode and covariance of (fixed effects, u) at given hyperparameters."""
    n, p = len(y), x.shape[1]
    f = np.hstack((x, np.eye(n)))
    prior = np.zeros((p + n, p + n))
    prior[p:, p:] = (rho * (np.diag(w.sum(1)) - w) + (1 - rho) * np.eye(n)) / tau2
    at = np.zeros(p + n)
    for _ in range(100):
        eta = f @ at + off
        mu = np.exp(eta) if family == "poisson" else trials / (1 + np.exp(-eta))
        v = mu if family == "poisson" else mu * (1 - mu / trials)
        info = f.T @ (v[:, None] * f) + prior
        new = np.linalg.solve(info, f.T @ (v * (f @ at) + y - mu))
        if abs(new - at).max() < 1e-12:
            break
        at = new
    return at, np.linalg.inv(info), f


@pytest.mark.parametrize("family", bayes.FAMILIES)
def test_mode_and_spread_equal_a_dense_solve(spark, family):
    w, x, e, y = counts(4, 3)
    trials = e.round() + 60
    areas, links = tables(spark, w, x=x, e=e, y=y if family == "poisson" else np.minimum(y, trials), n=trials)
    options = {"expected": "e"} if family == "poisson" else {"trials": "n"}
    fit = bayes.car_model(areas, links, "k", "y", ["x"], family=family, rho=0.8, tau2=0.3, draws=200, **options)
    design = np.column_stack((np.ones(len(x)), x))
    at, cov, f = dense(w, design, y if family == "poisson" else np.minimum(y, trials), np.log(e) if family == "poisson" else 0.0, 0.8, 0.3, family, trials)
    fixed = {r["term"]: r for r in fit.fixed.collect()}
    for m, term in enumerate(("intercept", "x")):
        sd = math.sqrt(cov[m, m])
        assert abs(fixed[term]["mean"] - at[m]) < 0.25 * sd
        assert abs(fixed[term]["sd"] / sd - 1) < 0.2
    sd = np.sqrt(np.diag(cov))[2:]
    for r in fit.areas.collect():
        assert abs(r["effect"] - at[2 + r["k"]]) < 0.3 * sd[r["k"]]
        assert abs(r["effect_sd"] / sd[r["k"]] - 1) < 0.25
        line = f @ at
        assert r["rr_lo"] < math.exp(line[r["k"]]) < r["rr_hi"]
    lines = {}
    for r in fit.draws.collect():
        lines.setdefault(r["k"], {})[r["i"]] = r["eta"]
    drawn = np.array([[v[i] for i in range(len(w))] for v in lines.values()])
    truth = f @ cov @ f.T  # neighbours move together as they should
    assert abs(np.cov(drawn.T) - truth).max() < 0.3 * np.diag(truth).max()
    model = fit.model.first()
    assert 0 < model["p_d"] < len(w) and model["dic"] > model["deviance"]


def test_hyperparameters_meet_the_dense_fixed_point(spark):
    w, x, e, y = counts(4, 8)
    areas, links = tables(spark, w, x=x, e=e, y=y)
    fit = bayes.car_model(areas, links, "k", "y", ["x"], expected="e", draws=100, powers=24).model.first()
    n, design = len(y), np.column_stack((np.ones(len(x)), x))
    lap = np.diag(w.sum(1)) - w
    values = np.linalg.eigvalsh(lap)
    rho, tau2 = 0.5, 0.1
    for _ in range(400):
        at, cov, _ = dense(w, design, y, np.log(e), rho, tau2)
        second = cov[2:, 2:] + np.outer(at[2:], at[2:])
        rough, one = float((lap * second).sum()), float(np.trace(second))
        grid = np.linspace(0, 0.99, 400)
        tau = lambda v: (0.02 + v * rough + (1 - v) * one) / (n + 4)  # noqa: B023, E731
        rho = max(grid, key=lambda v: np.log(v * values + 1 - v).sum() / 2 - (n / 2 + 2) * math.log(tau(v)))
        tau2 = tau(rho)
    assert abs(fit["rho"] - rho) < 0.12
    assert abs(math.log(fit["tau2"] / tau2)) < 0.3


def test_steps_in_time_share_strength(spark):
    rng = np.random.default_rng(5)
    w = lattice(3)
    rows = [(i, t, 20.0, float(rng.poisson(20 * math.exp(0.2 * t - 0.4)))) for i in range(9) for t in range(5) if (i, t) != (4, 2)]
    panel = spark.createDataFrame([*rows, (None, 1, 20.0, 3.0)], "k long, t long, e double, y double")
    links = tables(spark, w, x=np.zeros(9))[1]
    edges = bayes.space_time_links(links, panel, "k", "t", 2.0)
    assert edges.where("src.time = dst.time").count() == 24 * 5 - 8
    assert {r["w"] for r in edges.where("src.key = 4 and src.time = 1 and dst.time = 3").collect()} == {1.0}  # two steps bridged
    fit = bayes.space_time_model(panel, links, "k", "t", "y", expected="e", rho=0.95, tau2=0.1, draws=60, over_time=2.0)
    means = {r["t"]: r["rr"] for r in fit.areas.groupBy("t").agg({"rr": "avg"}).withColumnRenamed("avg(rr)", "rr").collect()}
    assert fit.areas.count() == 44
    assert all(means[t] < means[t + 1] for t in range(4))


def test_odd_input(spark):
    areas, links = tables(spark, lattice(2), y=np.array([3, 0, 5, 2]))
    islands = bayes.car_model(areas, links.where("false"), "k", "y", rho=0.5, tau2=0.2, draws=50).areas
    assert islands.count() == 4
    with pytest.raises(ValueError, match="one row"):
        bayes.car_model(areas.unionByName(areas), links, "k", "y", rho=0.5, tau2=0.2)
    with pytest.raises(ValueError, match="no area"):
        bayes.car_model(areas.where("false"), links, "k", "y", rho=0.5, tau2=0.2)
    with pytest.raises(ValueError, match="family"):
        bayes.car_model(areas, links, "k", "y", family="gamma")
