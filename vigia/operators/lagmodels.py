"""Distributed-lag models whole: lag-response surfaces, residual tests, pooling of coefficient vectors, and conditional logit of matched sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.storage import cut
from .exposure import distributed_lag
from .fits import _time_basis

# --- residual test --------------------------------------------------------------------------------


def chi2_upper(x: Column, df: int) -> Column:
    """Upper tail of a chi-square variable with an even number of degrees of freedom: a finite sum."""
    if df % 2 or df < 2:
        raise ValueError("an even number of degrees of freedom")
    half = x / 2
    term, total = F.lit(1.0), F.lit(1.0)
    for j in range(1, df // 2):
        term = term * half / j
        total = total + term
    return F.least(F.lit(1.0), F.exp(-half) * total)


def ljung_box(df: DataFrame, keys: list[str], order: str, value: str, lags: int = 10) -> DataFrame:
    """Ljung-Box test of each series: keys, ``n, q, p_value``; q sums the squared autocorrelations to ``lags`` (even), each over the rows it is made of.

    Rows follow one another by ``order``; null values are left out first.  A series without spread, or of ``lags`` rows or fewer, has nulls.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    level = df.groupBy(*keys).agg(F.avg(value).alias("__m"))
    rows = df.where(F.col(value).isNotNull()).join(level, keys).withColumn("__e", F.col(value) - F.col("__m"))
    rows = rows.withColumns({f"__p{k}": F.col("__e") * F.lag("__e", k).over(w) for k in range(1, lags + 1)})
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("__e") * F.col("__e")).alias("__s"), *[F.sum(f"__p{k}").alias(f"__p{k}") for k in range(1, lags + 1)])
    n = F.col("n").cast("double")
    share = lambda k: F.pow(F.col(f"__p{k}") / F.nullif("__s", F.lit(0.0)), 2) / (n - k)
    enough = F.when(F.col("n") > lags, n)
    q = n * (n + 2) * reduce(lambda a, b: a + b, [F.when(enough.isNotNull(), share(k)) for k in range(1, lags + 1)])
    return sums.withColumn("q", q).select(*keys, "n", "q", chi2_upper(F.col("q"), lags).alias("p_value"))


# --- fits and surfaces ----------------------------------------------------------------------------

_FIT = "n bigint, coef array<double>, cov array<double>, knots array<double>, low double, high double, lags int, lag_df int, reference double, p01 double, p75 double, p99 double, dispersion double, dispersion_class string, deviance double, aic_poisson double, autocorr_q double, autocorr_p double, reduced array<double>, reduced_cov array<double>"


def _ljung(e: np.ndarray, lags: int) -> tuple[float | None, float | None]:
    e = e - e.mean()
    if len(e) <= lags or not e @ e > 0:
        return None, None
    q = len(e) * (len(e) + 2) * sum((e[k:] @ e[:-k] / (e @ e)) ** 2 / (len(e) - k) for k in range(1, lags + 1))
    return float(q), 1 - kernels.gamma_p(lags / 2, q / 2)


def lag_fits(
    health: DataFrame, climate: DataFrame, key: str, cases: str, exposure: str, lags: int = 21, var_df: int = 4, lag_df: int = 3, per_year: int = 4, knots: list[float] | None = None, bounds: tuple[float, float] | None = None,
    reference: float | None = None, covariates: list[str] | None = None, least: int = 60, test_lags: int = 10,
) -> DataFrame:
    """A distributed-lag model of each place's daily series, one row a place: coefficients of the exposure x lag basis and their covariance, and diagnostics.

    ``coef`` (var_df x lag_df, lag fastest) and ``cov`` (row by row) belong to the natural-spline basis of ``knots``, ``low``, ``high`` and ``lag_df``; ``knots`` and ``bounds``
    given make the bases of all places the same, as pooling needs.  ``reduced`` and ``reduced_cov`` are summed over lags.  The model is quasi-Poisson with a natural
    spline of time (``per_year`` terms a year) and ``covariates``.  Diagnostics: dispersion (and adequate under 1.5, moderate under 3, high), deviance, AIC of the Poisson
    model, Ljung-Box test of the deviance residuals.  Places with fewer than ``least`` whole rows have no row.  A place's daily series, bounded by the calendar, is fitted in one task.
    """
    lagged = distributed_lag(health, climate, key, exposure, lags)
    columns, more = [f"{exposure}_lag{k}" for k in range(lags + 1)], list(covariates or [])
    names = [key, *(f.split()[0] for f in _FIT.split(", "))]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").dropna(subset=[*columns, cases, *more])
        if len(pdf) < least:
            return pd.DataFrame(columns=names)
        cross, spec = kernels.cross_basis(pdf[columns].to_numpy(float), var_df, lag_df, None if knots is None else np.array(knots), bounds)
        x = np.column_stack((np.ones(len(pdf)), cross, _time_basis(pdf["date"], per_year), pdf[more].to_numpy(float)))
        y = pdf[cases].to_numpy(float)
        model = kernels.poisson_regression(x, y)
        at = slice(1, 1 + cross.shape[1])
        coef, cov, mu = model.coef[at], model.cov[at, at], model.fitted
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = np.where(y > 0, y * np.log(y / mu), 0.0) - (y - mu)
        rest = np.sign(y - mu) * np.sqrt(np.maximum(0.0, 2 * unit))
        likelihood = float(np.sum(y * np.log(np.maximum(mu, 1e-300)) - mu)) - sum(math.lgamma(v + 1) for v in y)
        q, p = _ljung(rest, test_lags)
        seen = pdf[columns[0]].to_numpy(float)
        p01, p50, p75, p99 = np.quantile(seen, [0.01, 0.5, 0.75, 0.99])
        over = np.kron(np.eye(len(coef) // spec["lag_basis"].shape[1]), spec["lag_basis"].sum(axis=0))
        phi = model.dispersion
        row = [len(pdf), coef, cov.ravel(), spec["knots"], spec["low"], spec["high"], lags, spec["lag_basis"].shape[1], p50 if reference is None else reference, p01, p75, p99]
        row += [phi, "adequate" if phi < 1.5 else "moderate" if phi < 3 else "high", model.deviance, 2 * x.shape[1] - 2 * likelihood, q, p, over @ coef, (over @ cov @ over.T).ravel()]
        return pd.DataFrame([[pdf[key].iloc[0], *row]], columns=names)

    return lagged.select(key, "date", cases, *more, *columns).groupBy(key).applyInPandas(fit, f"{key} {dict(health.dtypes)[key]}, {_FIT}")


def _basis(row, at: np.ndarray) -> np.ndarray:
    spline = lambda v: kernels.natural_spline(np.atleast_1d(np.asarray(v, float)), np.asarray(row.knots, float), row.low, row.high)
    return spline(at) - spline(row.reference)


def lag_surface(fits: DataFrame, key: str, at: list[float] | None = None, points: int = 25, level_z: float = 1.959963984540054) -> DataFrame:
    """The surface of each fit: ``key, exposure, lag, log_rr, se, rr, rr_lo, rr_hi, cum_log_rr, cum_se, cum_rr, cum_rr_lo, cum_rr_hi``.

    Exposures: ``at``, or ``points`` from the 1st to the 99th percentile of the place.  Risks are against the fit's reference, at each lag alone and summed from lag 0 on; the
    last lag's sum is the overall curve.  Fits are dealt over tasks and each gives its grid of rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                where = np.asarray(at, float) if at is not None else np.linspace(row.p01, row.p99, points)
                own, by_lag = _basis(row, where), kernels.lag_basis(row.lags + 1, row.lag_df)
                cov = np.asarray(row.cov, float).reshape(len(row.coef), -1)
                out = {key: [], "exposure": [], "lag": []} | {c: [] for c in ("log_rr", "se", "cum_log_rr", "cum_se")}
                for lag in range(row.lags + 1):
                    for name, weights in (("", by_lag[lag]), ("cum_", by_lag[: lag + 1].sum(axis=0))):
                        design = np.einsum("ni,j->nij", own, weights).reshape(len(where), -1)
                        out[f"{name}log_rr"].append(design @ np.asarray(row.coef, float))
                        out[f"{name}se"].append(np.sqrt(np.maximum(0.0, np.einsum("ni,ij,nj->n", design, cov, design))))
                    out[key].append(np.full(len(where), getattr(row, key)))
                    out["exposure"].append(where)
                    out["lag"].append(np.full(len(where), lag))
                yield pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})

    rows = fits.mapInPandas(run, f"{key} {dict(fits.dtypes)[key]}, exposure double, lag int, log_rr double, se double, cum_log_rr double, cum_se double")
    band = lambda b, s, sign: F.exp(F.col(b) + sign * level_z * F.col(s))
    return rows.withColumns({f"{n}{c}": band(f"{n}log_rr", f"{n}se", k) for n in ("", "cum_") for c, k in (("rr", 0), ("rr_lo", -1), ("rr_hi", 1))})


def lag_response(fits: DataFrame, key: str) -> DataFrame:
    """Each place's risk by lag at the 75th percentile of its exposure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                own, by_lag = _basis(row, np.array([row.p75])), kernels.lag_basis(row.lags + 1, row.lag_df)
                design = np.einsum("i,lj->lij", own[0], by_lag).reshape(row.lags + 1, -1)
                cov = np.asarray(row.cov, float).reshape(len(row.coef), -1)
                yield pd.DataFrame({key: getattr(row, key), "exposure": row.p75, "lag": range(row.lags + 1), "log_rr": design @ np.asarray(row.coef, float), "se": np.sqrt(np.maximum(0.0, np.einsum("ni,ij,nj->n", design, cov, design)))})

    rows = fits.mapInPandas(run, f"{key} {dict(fits.dtypes)[key]}, exposure double, lag int, log_rr double, se double")
    return rows.withColumns({"rr": F.exp("log_rr"), "rr_lo": F.exp(F.col("log_rr") - 1.959963984540054 * F.col("se")), "rr_hi": F.exp(F.col("log_rr") + 1.959963984540054 * F.col("se"))})


# --- pooling --------------------------------------------------------------------------------------


@dataclass
class Pooled:
    """Mean vector, its covariance, the covariance between places, Cochran's Q with its test, I2 and the number of places; ``blups``: a row a place."""

    mean: np.ndarray
    cov: np.ndarray
    between: np.ndarray
    q: float
    df: int
    p_value: float
    i2: float
    n: int
    log_likelihood: float
    blups: DataFrame


def _stacked(pdf: pd.DataFrame, coef: str, cov: str) -> tuple[np.ndarray, np.ndarray]:
    y = np.array(pdf[coef].tolist(), float)
    return y, np.array(pdf[cov].tolist(), float).reshape(len(y), y.shape[1], y.shape[1])


def _sums(df: DataFrame, coef: str, cov: str, psi: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over places that a round of scoring needs, made by tasks and added up by Spark: W, Wy, (Wy)(Wy)', (Wy) x W, W x W, y'Wy and log det V."""
    k = len(psi)
    shapes = {"w": (k, k), "wy": (k,), "p": (k, k), "t": (k, k, k), "k": (k, k, k, k), "ywy": (), "logdet": (), "n": ()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if pdf.empty:
                continue
            y, s = _stacked(pdf, coef, cov)
            v = s + psi
            w = np.linalg.inv(v)
            wy = np.einsum("iab,ib->ia", w, y)
            parts = [w.sum(axis=0), wy.sum(axis=0), wy.T @ wy, np.einsum("ia,ibc->abc", wy, w), np.einsum("iab,icd->abcd", w, w), np.einsum("ia,ia->", y, wy), np.linalg.slogdet(v)[1].sum(), len(y)]
            flat = np.concatenate([np.ravel(x) for x in parts])
            total = flat if total is None else total + flat
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "v": total})

    found = df.select(coef, cov).mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toPandas()  # k^4 numbers, whatever the places
    flat, out, at = found["v"].to_numpy(), {}, 0
    for name, shape in shapes.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape) if len(flat) else np.zeros(shape)
        at += size
    return out


def pool_vectors(fits: DataFrame, key: str, coef: str = "reduced", cov: str = "reduced_cov", rounds: int = 60, tolerance: float = 1e-9) -> Pooled:
    """Random-effects mean of places' coefficient vectors by restricted maximum likelihood, with each place's best prediction.

    y_i ~ N(mean, S_i + Psi), Psi a whole k x k covariance.  Fisher scoring: each round is one pass over the places in Spark, whose tasks add up small matrices; the
    driver solves for the k (k + 1) / 2 parameters, keeps Psi non-negative, halves a step that lowers the likelihood, and stops where none is left.  Places with a null or singular covariance have to be left out
    before.  ``blups``: ``key, blup, blup_cov``; with one place it is that place's own vector.
    """
    fits = cut(fits.where(F.col(coef).isNotNull() & F.col(cov).isNotNull()).select(key, F.col(coef).alias("y"), F.col(cov).alias("s")))
    first = fits.select(F.size("y")).first()
    if first is None:
        raise ValueError("no places to pool")
    k = first[0]
    fixed = _sums(fits, "y", "s", np.zeros((k, k)))
    n, base = int(fixed["n"]), np.linalg.pinv(fixed["w"])
    mean = base @ fixed["wy"]
    q, df = float(fixed["ywy"] - mean @ fixed["wy"]), k * (n - 1)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    unit = np.zeros((len(pairs), k, k))
    for r, (a, b) in enumerate(pairs):
        unit[r, a, b] = unit[r, b, a] = 1

    def level(s: dict) -> float:
        beta = np.linalg.solve(s["w"], s["wy"])
        return float(-0.5 * (s["logdet"] + np.linalg.slogdet(s["w"])[1] + s["ywy"] - beta @ s["wy"]))

    def positive(m: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        return (vectors * np.maximum(values, 0.0)) @ vectors.T

    psi = np.diag(np.diag(base) * n / 2) if n > 1 else np.zeros((k, k))
    now = _sums(fits, "y", "s", psi)
    for _ in range(rounds if n > 1 else 0):
        inverse = np.linalg.inv(now["w"])
        beta = inverse @ now["wy"]
        u = now["p"] - np.einsum("abc,c->ab", now["t"], beta) - np.einsum("bac,c->ab", now["t"], beta) + np.einsum("acbd,c,d->ab", now["k"], beta, beta)
        g = np.einsum("acdb,cd->ab", now["k"], inverse)
        score = 0.5 * np.einsum("rab,ab->r", unit, u + g - now["w"])
        info = 0.5 * np.einsum("pqst,rqs,utp->ru", now["k"], unit, unit)
        step = np.einsum("r,rab->ab", np.linalg.pinv(info) @ score, unit)
        here, size = level(now), 1.0
        while True:
            new = positive(psi + size * step)
            then = _sums(fits, "y", "s", new)
            gain = level(then) - here
            if gain >= -1e-12 or size < 0.1:
                break
            size /= 2
        if gain < -1e-12:  # no step from here goes up: the bound of a covariance, or the highest point within rounding
            break
        moved = np.abs(new - psi).max()
        psi, now = new, then
        if moved <= tolerance * (1 + np.abs(psi).max()) or gain <= tolerance**1.5:
            break
    inverse = np.linalg.inv(now["w"])
    mean = inverse @ now["wy"]

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            y, s = _stacked(pdf, "y", "s")
            gain = psi @ np.linalg.inv(s + psi) if n > 1 else np.broadcast_to(np.eye(k), s.shape)
            blup = mean + np.einsum("iab,ib->ia", gain, y - mean)
            rest = np.eye(k) - gain
            spread = psi - gain @ psi + rest @ inverse @ rest.transpose(0, 2, 1) if n > 1 else s
            yield pd.DataFrame({key: pdf[key], "blup": list(blup), "blup_cov": list(spread.reshape(len(y), -1))})

    kind = dict(fits.dtypes)[key]
    blups = fits.mapInPandas(predict, f"{key} {kind}, blup array<double>, blup_cov array<double>")
    p = 1 - kernels.gamma_p(df / 2, q / 2) if df > 0 else 1.0
    return Pooled(mean, inverse, psi, q, df, p, max(0.0, (q - df) / q) if q > 0 else 0.0, n, level(now), blups)


def curve(spark, coef: np.ndarray, cov: np.ndarray, knots: list[float], bounds: tuple[float, float], reference: float, at: list[float]) -> DataFrame:
    """``exposure, log_rr, se, rr, rr_lo, rr_hi`` of a reduced coefficient vector on a common basis."""
    spline = lambda v: kernels.natural_spline(np.asarray(v, float), np.asarray(knots, float), *bounds)
    gap = spline(at) - spline([reference])
    log_rr, se = gap @ coef, np.sqrt(np.maximum(0.0, np.einsum("ni,ij,nj->n", gap, cov, gap)))
    z = 1.959963984540054
    rows = [tuple(map(float, r)) for r in zip(at, log_rr, se, np.exp(log_rr), np.exp(log_rr - z * se), np.exp(log_rr + z * se), strict=True)]
    return spark.createDataFrame(rows, "exposure double, log_rr double, se double, rr double, rr_lo double, rr_hi double")


# --- matched sets ---------------------------------------------------------------------------------


def _stratum(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Exact conditional log-likelihood of one matched set with d cases, its slope and curvature.

    The denominator sums the products of risks over all sets of d rows: elementary symmetric polynomials, built row by row.  Each order keeps its logarithm and, in place of
    its derivatives, the mean sum of x and the mean square of that sum over its sets, so that none under- or overflows, however far risks lie apart.
    """
    d, p = int(y.sum()), x.shape[1]
    x = x - x.mean(axis=0)
    eta = x @ beta
    b, g, h = np.full(d + 1, -np.inf), np.zeros((d + 1, p)), np.zeros((d + 1, p, p))
    b[0] = 0.0
    for e, v in zip(eta, x, strict=True):
        taken = b[:-1] + e
        total = np.logaddexp(b[1:], taken)
        share = np.exp(taken - np.where(np.isfinite(total), total, 0.0))  # of the sets that hold this row
        gv = np.einsum("ja,b->jab", g[:-1], v)
        h[1:] += share[:, None, None] * (h[:-1] + gv + gv.transpose(0, 2, 1) + np.outer(v, v) - h[1:])
        g[1:] += share[:, None] * (g[:-1] + v - g[1:])
        b[1:] = total
    return float(eta[y > 0].sum() - b[d]), x[y > 0].sum(axis=0) - g[d], h[d] - np.outer(g[d], g[d])


def conditional_logit(design: DataFrame, key: str, stratum: str, case: str, terms: list[str], rounds: int = 25) -> DataFrame:
    """Conditional logistic regression of matched sets, with the exact likelihood: ``key, term, estimate, se, z, odds_ratio, lo, hi, n_cases, n_strata``.

    A row is a case where ``case`` > 0.  Rows with a null in any column are left out; sets without a case or without a control say nothing.  Sets are dealt over tasks by (key, stratum); a round of Newton's method is
    one pass in which tasks add up the sets' slopes and curvatures per key, for all keys at once.  A set (a month's days) is one task's work.  What a key keeps from round to round goes along
    with the sums: the planner's size of a join is the product of both sides', so a second join to the state would square that number each round.
    """
    p = len(terms)
    rows = design.select(key, stratum, (F.col(case) > 0).cast("double").alias("__y"), *[F.col(t).cast("double").alias(f"__x{k}") for k, t in enumerate(terms)]).dropna()
    told = rows.groupBy(key, stratum).agg(F.sum("__y").alias("__d"), F.count("*").alias("__n")).where("__d > 0 and __d < __n").select(key, stratum)
    rows = cut(rows.join(told, [key, stratum]).repartition(key, stratum).sortWithinPartitions(key, stratum))
    kind, xs, kept = dict(design.dtypes)[key], [f"__x{k}" for k in range(p)], [key, "n_cases", "n_strata", "beta"]
    state = rows.groupBy(key).agg(F.sum("__y").cast("bigint").alias("n_cases"), F.countDistinct(stratum).alias("n_strata")).withColumn("beta", F.array(*[F.lit(0.0)] * p))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(group: pd.DataFrame) -> pd.DataFrame:
            level, slope, info = _stratum(group[xs].to_numpy(), group["__y"].to_numpy(), np.asarray(group["beta"].iloc[0], float))
            return group[kept].head(1).assign(flat=[np.concatenate(([level], slope, info.ravel()))])

        left: pd.DataFrame | None = None
        for pdf in batches:
            left = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
            groups = list(left.groupby([key, stratum], sort=False, dropna=False))
            for _, group in groups[:-1]:
                yield flush(group)
            left = groups[-1][1] if groups else None
        if left is not None and len(left):
            yield flush(left)

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = pdf.sort_values("at")["v"].to_numpy()
        info = flat[1 + p :].reshape(p, p)
        step = np.linalg.pinv(info) @ flat[1 : 1 + p]
        scale = np.sqrt(np.maximum(np.diag(info), 1e-300) / max(1.0, pdf["n_cases"].iloc[0]))
        step *= min(1.0, 2.0 / max(1e-300, float(np.abs(step * scale).max())))
        beta = np.asarray(pdf["beta"].iloc[0], float) + step
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n_cases": [int(pdf["n_cases"].iloc[0])], "n_strata": [int(pdf["n_strata"].iloc[0])], "beta": [beta], "cov": [np.linalg.pinv(info).ravel()], "moved": [float(np.abs(step * scale).max())]})

    shape = f"{key} {kind}, n_cases bigint, n_strata bigint, beta array<double>"
    for _ in range(rounds):
        found = rows.join(state.select(*kept), key).sortWithinPartitions(key, stratum).mapInPandas(sums, f"{shape}, flat array<double>")
        added = found.select(*kept, F.posexplode("flat").alias("at", "v")).groupBy(*kept, "at").agg(F.sum("v").alias("v"))
        state = cut(added.groupBy(key).applyInPandas(move, f"{shape}, cov array<double>, moved double"))
        most = state.agg(F.max("moved")).first()[0]
        if most is None or most < 1e-9:
            break
    if "cov" not in state.columns:
        state = state.withColumn("cov", F.array().cast("array<double>"))
    one = F.array(*[F.struct(F.lit(t).alias("term"), F.get("beta", F.lit(k)).alias("estimate"), F.sqrt(F.greatest(F.lit(0.0), F.get("cov", F.lit(k * p + k)))).alias("se")) for k, t in enumerate(terms)])
    out = state.select(key, F.explode(one).alias("t"), "n_cases", "n_strata").select(key, "t.*", "n_cases", "n_strata")
    z, e = 1.959963984540054, F.col("estimate")
    return out.select(key, "term", "estimate", "se", (e / F.nullif("se", F.lit(0.0))).alias("z"), F.exp(e).alias("odds_ratio"), F.exp(e - z * F.col("se")).alias("lo"), F.exp(e + z * F.col("se")).alias("hi"), "n_cases", "n_strata")
