"""Spatial models against dense likelihoods, permutation tests against plain loops."""

import hashlib
import math

import numpy as np
import pytest

from vigia.operators import econometrics


def lattice(side, islands=0):
    w = np.zeros((side * side + islands, side * side + islands))
    for i in range(side):
        for j in range(side):
            for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                if 0 <= i + a < side and 0 <= j + b < side:
                    w[side * i + j, side * (i + a) + j + b] = 1
    total = w.sum(axis=1, keepdims=True)
    return np.divide(w, total, out=np.zeros_like(w), where=total > 0)


def tables(spark, w, columns):
    names = list(columns)
    areas = spark.createDataFrame([(i, *(float(columns[c][i]) for c in names)) for i in range(len(w))], "k long, " + ", ".join(f"{c} double" for c in names))
    links = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "src long, dst long, w double")
    return areas, links


def dense(y, x, w, model, rho, lam):
    """Log-likelihood at its best coefficients, and these."""
    n = len(y)
    a, b = np.eye(n) - rho * w, np.eye(n) - lam * w
    v, z = b @ a @ y, b @ x
    beta = np.linalg.lstsq(z, v, rcond=None)[0]
    s2 = ((v - z @ beta) ** 2).mean()
    return np.linalg.slogdet(a)[1] + np.linalg.slogdet(b)[1] - n / 2 * (math.log(2 * math.pi * s2) + 1), beta, s2


@pytest.mark.parametrize("model", econometrics.MODELS)
def test_models_equal_dense_likelihood(spark, model):
    rng = np.random.default_rng(3)
    w = lattice(5, islands=2 if model == "lag" else 0)
    n = len(w)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    rho, lam = (0.55 if model != "error" else 0.0), (0.5 if model in ("error", "sac") else 0.0)
    mean = 1 + 2 * x1 - x2 + (0.7 * (w @ x1) if model == "durbin" else 0)
    y = np.linalg.solve(np.eye(n) - rho * w, mean + np.linalg.solve(np.eye(n) - lam * w, rng.normal(size=n) * 0.6))
    areas, links = tables(spark, w, {"y": y, "a": x1, "b": x2})
    coef, impacts = econometrics.spatial_likelihood(areas, links, "k", "y", ["a", "b"], model, powers=30, probes=64)
    got = {r["term"]: r for r in coef.collect()}
    x = np.column_stack([np.ones(n), x1, x2, *([w @ x1, w @ x2] if model == "durbin" else [])])
    r, q = got.get("rho", {"estimate": 0.0})["estimate"], got.get("lambda", {"estimate": 0.0})["estimate"]
    level, beta, s2 = dense(y, x, w, model, r, q)
    assert got["log_likelihood"]["estimate"] == pytest.approx(level, abs=0.02)
    names = ["intercept", "a", "b", *(["lag_a", "lag_b"] if model == "durbin" else [])]
    assert [got[t]["estimate"] for t in names] == pytest.approx(list(beta), abs=1e-6)
    assert got["sigma2"]["estimate"] == pytest.approx(s2, rel=1e-6)
    grid = [(a, b) for a in (np.linspace(-0.95, 0.95, 77) if model != "error" else [0.0]) for b in (np.linspace(-0.95, 0.95, 77) if model in ("error", "sac") else [0.0])]
    assert level >= max(dense(y, x, w, model, a, b)[0] for a, b in grid) - 0.02
    assert all(0 < got[t]["se"] < 2 for t in names)
    effect = {r["covariate"]: r for r in impacts.collect()}
    if model == "error":
        assert not effect
        return
    inverse = np.linalg.inv(np.eye(n) - r * w)
    for k, c in enumerate("ab"):
        s = inverse @ (np.eye(n) * beta[1 + k] + (w * beta[3 + k] if model == "durbin" else 0))
        assert effect[c]["direct"] == pytest.approx(np.trace(s) / n, rel=1e-3)
        assert effect[c]["total"] == pytest.approx(s.sum() / n, rel=1e-3)
        assert effect[c]["indirect"] == pytest.approx(effect[c]["total"] - effect[c]["direct"])


def test_traces_by_probes_are_near_the_exact_ones(spark):
    w = lattice(12)
    _, links = tables(spark, w, {"y": np.zeros(len(w))})
    links = links.selectExpr("src as i", "dst as j", "w")
    got = econometrics.weight_traces(spark.range(len(w)).withColumnRenamed("id", "i"), links, 6, 48)
    want = [np.trace(np.linalg.matrix_power(w, k)) for k in range(1, 7)]
    assert got[:2] == pytest.approx(want[:2], abs=1e-9)
    assert got[2:] == pytest.approx(want[2:], abs=6)


def number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def test_local_permutations_equal_a_loop(spark):
    rng = np.random.default_rng(8)
    w = lattice(5, islands=1)
    v = rng.normal(size=len(w)) + np.arange(len(w)) % 5
    areas, links = tables(spark, w, {"v": v})
    got = {r["k"]: r for r in econometrics.local_moran_permuted(areas, links, "k", "v", 50, seed=3).collect()}
    z, n = (v - v.mean()) / v.std(), len(v)
    for i in range(n):
        ws = [w[i, j] for j in range(n) if w[i, j] > 0]
        if not ws:
            assert got[i]["p_value"] is None and got[i]["p_sim"] is None and got[i]["local_i"] == 0
            continue
        sims = []
        for draw in range(1, 51):
            taken = []
            for t in range(1, len(ws) + 1):
                top = n - 2 - len(ws) + t
                x = number(3, i, draw, t) % (top + 1)
                taken.append(top if x in taken else x)
            assert len(set(taken)) == len(ws)
            sims.append(z[i] * sum(a * z[j + (j >= i)] for a, j in zip(ws, taken, strict=True)))
        own = z[i] * (w[i] @ z)
        assert got[i]["local_i"] == pytest.approx(own) and got[i]["mean_i"] == pytest.approx(np.mean(sims)) and got[i]["sd_i"] == pytest.approx(np.std(sims, ddof=1))
        assert got[i]["p_value"] == pytest.approx(math.erfc(abs(own - np.mean(sims)) / np.std(sims, ddof=1) / math.sqrt(2)), abs=1e-6)
        tail = min(sum(s >= own - 1e-12 for s in sims), sum(s <= own + 1e-12 for s in sims))
        assert got[i]["p_sim"] == pytest.approx((tail + 1) / 51)


def test_permutations_of_one_value(spark):
    w = lattice(3)
    areas, links = tables(spark, w, {"v": np.ones(9)})
    assert {r["p_value"] for r in econometrics.local_moran_permuted(areas, links, "k", "v", 9).collect()} == {None}
