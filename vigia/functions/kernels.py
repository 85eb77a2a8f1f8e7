"""Numeric kernels in numpy: special functions, splines, regression.  They run on small groups inside tasks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution, by Newton steps from a rough start."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    t = math.sqrt(-2 * math.log(min(p, 1 - p)))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    x = -x if p < 0.5 else x
    for _ in range(4):
        gap = normal_cdf(x) - p
        step = gap * math.sqrt(2 * math.pi) * math.exp(min(700.0, x * x / 2))
        x -= step / (1 + x * step / 2)
    return x


def gamma_quantile(a: float, p: float) -> float:
    """Quantile of the standard gamma distribution, by bisection in the logarithm."""
    if p <= 0:
        return 0.0
    lo, hi = -60.0, math.log(a + 10 * math.sqrt(a) + 50)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(a, math.exp(mid)) < p else (lo, mid)
    return math.exp((lo + hi) / 2)


def poisson_interval(n: float, level: float = 0.95) -> tuple[float, float]:
    """Exact bounds of a Poisson mean."""
    half = (1 - level) / 2
    return (gamma_quantile(n, half) if n > 0 else 0.0), gamma_quantile(n + 1, 1 - half)


def natural_spline(x: np.ndarray, knots: np.ndarray, low: float, high: float) -> np.ndarray:
    """Natural cubic spline basis (truncated powers, linear beyond the boundary), without the constant."""
    every = np.concatenate(([low], knots, [high]))
    cube = lambda k: np.maximum(x - k, 0) ** 3
    d = lambda j: (cube(every[j]) - cube(every[-1])) / (every[-1] - every[j])
    columns = [x] + [d(j) - d(len(every) - 2) for j in range(len(every) - 2)]
    scale = max(high - low, 1e-12)
    return np.column_stack([columns[0] / scale, *[c / scale**2 for c in columns[1:]]])


def spline_knots(x: np.ndarray, df: int) -> np.ndarray:
    return np.quantile(x, np.linspace(0, 1, df + 1)[1:-1])


@dataclass
class Fit:
    coef: np.ndarray
    cov: np.ndarray
    fitted: np.ndarray
    dispersion: float
    deviance: float


def poisson_regression(x: np.ndarray, y: np.ndarray, quasi: bool = True, offset: np.ndarray | None = None, rounds: int = 50) -> Fit:
    """Log-linear model by iteratively reweighted least squares; the covariance is scaled by Pearson's dispersion if ``quasi``."""
    offset = np.zeros(len(y)) if offset is None else offset
    mu = y + 0.5
    eta, last = np.log(mu), np.inf
    for _ in range(rounds):
        z = eta - offset + (y - mu) / mu
        xtw = x.T * mu
        info = xtw @ x
        coef = np.linalg.lstsq(info, xtw @ z, rcond=None)[0]
        eta = np.clip(x @ coef + offset, -700, 700)
        mu = np.exp(eta)
        with np.errstate(divide="ignore", invalid="ignore"):
            deviance = 2 * float(np.sum(np.where(y > 0, y * np.log(y / mu), 0.0) - (y - mu)))
        if abs(deviance - last) < 1e-10 * (abs(deviance) + 0.1):
            break
        last = deviance
    phi = float(np.sum((y - mu) ** 2 / mu) / max(1, len(y) - x.shape[1]))
    return Fit(coef, np.linalg.pinv(info) * (phi if quasi else 1.0), mu, phi, deviance)


def cross_basis(lagged: np.ndarray, var_df: int = 4, lag_df: int = 3, knots: np.ndarray | None = None, bounds: tuple[float, float] | None = None) -> tuple[np.ndarray, dict]:
    """Distributed-lag basis of a matrix of lagged exposures (rows days, columns lag 0 to L); ``knots`` and ``bounds`` of the exposure from its own values, if not given."""
    known = lagged[~np.isnan(lagged)]
    low, high = bounds or (known.min(), known.max())
    spec = {"knots": spline_knots(known, var_df) if knots is None else np.asarray(knots, float), "low": low, "high": high, "lags": lagged.shape[1]}
    over_lag = lag_basis(spec["lags"], lag_df)
    spec["lag_basis"] = over_lag
    parts = [natural_spline(lagged[:, k], spec["knots"], spec["low"], spec["high"]) for k in range(lagged.shape[1])]
    return sum(np.einsum("ni,j->nij", b, over_lag[k]) for k, b in enumerate(parts)).reshape(len(lagged), -1), spec


def lag_basis(n: int, df: int) -> np.ndarray:
    lags = np.arange(n, dtype=float)
    if n <= df:
        return np.eye(n)
    knots = np.exp(np.linspace(0, math.log(n), df + 1))[1:-1] - 1
    return np.column_stack((np.ones(n), natural_spline(lags, np.clip(knots[: df - 2], 0.5, n - 1.5), 0.0, n - 1.0)))[:, :df]


def overall_curve(spec: dict, fit: Fit, at: np.ndarray, reference: float, first: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Log relative risk summed over lags at exposures ``at`` against ``reference``, and its standard error."""
    basis = lambda v: natural_spline(np.asarray(v, float), spec["knots"], spec["low"], spec["high"])
    gap = basis(at) - basis([reference])
    design = np.einsum("ni,j->nij", gap, spec["lag_basis"].sum(axis=0)).reshape(len(at), -1)
    k = slice(first, first + design.shape[1])
    return design @ fit.coef[k], np.sqrt(np.maximum(0, np.einsum("ni,ij,nj->n", design, fit.cov[k, k], design)))


def pool_effects(effects: np.ndarray, variances: np.ndarray, rounds: int = 200) -> dict[str, float]:
    """Random-effects meta-analysis of one effect per place by restricted maximum likelihood."""
    tau = max(0.0, float(effects.var(ddof=1) - variances.mean())) if len(effects) > 1 else 0.0
    for _ in range(rounds):
        w = 1 / (variances + tau)
        mean = float((w * effects).sum() / w.sum())
        new = max(0.0, float((w**2 * ((effects - mean) ** 2 - variances)).sum() / (w**2).sum() + 1 / w.sum())) if len(effects) > 1 else 0.0
        if abs(new - tau) < 1e-12:
            break
        tau = new
    w0 = 1 / variances
    fixed = float((w0 * effects).sum() / w0.sum())
    q, df = float((w0 * (effects - fixed) ** 2).sum()), len(effects) - 1
    w = 1 / (variances + tau)
    return {"effect": float((w * effects).sum() / w.sum()), "se": float(1 / math.sqrt(w.sum())), "tau2": tau, "q": q, "i2": max(0.0, (q - df) / q) if q > 0 else 0.0, "p": 1 - gamma_p(df / 2, q / 2) if df else 1.0}
