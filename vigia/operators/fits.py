"""Models fitted per place: grouped numpy kernels on aggregated daily series.

A group is one place's daily series, bounded by the calendar; the rows come from an aggregation in Spark.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from .exposure import distributed_lag


def drought_spi(monthly: DataFrame, key: str, rain: str, scale: int = 3, least: int = 24, first: str | None = None, last: str | None = None) -> DataFrame:
    """Standardised precipitation of rolling sums: gamma by moments with a share of zeros, then the normal quantile.

    The gamma is fitted on the months from ``first`` to ``last`` (all, if not given); probabilities keep machine epsilon from 0 and 1.
    """
    from ..functions.windows import complete_rolling_sum

    df = monthly.withColumn("rolling", complete_rolling_sum(rain, [key], "date", scale))
    inside = [F.col("rolling").isNotNull(), *([F.col("date") >= F.lit(first).cast("date")] if first else []), *([F.col("date") <= F.lit(last).cast("date")] if last else [])]
    stats = df.where(reduce(and_, inside)).groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("rolling") > 0).alias("n_pos"), F.avg(F.when(F.col("rolling") > 0, F.col("rolling"))).alias("m"), F.var_samp(F.when(F.col("rolling") > 0, F.col("rolling"))).alias("v"))

    @F.pandas_udf("double")
    def standardise(x: pd.Series, n: pd.Series, n_pos: pd.Series, m: pd.Series, v: pd.Series) -> pd.Series:
        x, n, n_pos, m, v = (s.to_numpy(float, na_value=np.nan) for s in (x, n, n_pos, m, v))
        out = np.full(len(x), np.nan)
        eps = np.finfo(float).eps
        for k in np.flatnonzero(~np.isnan(x) & (v > 0) & (n >= least) & (n_pos >= 4)):
            zero = 1 - n_pos[k] / n[k]
            p = zero + (1 - zero) * kernels.gamma_p(m[k] * m[k] / v[k], x[k] * m[k] / v[k]) if x[k] > 0 else zero
            out[k] = kernels.normal_quantile(min(1 - eps, max(eps, p)))
        return pd.Series(out).astype("float64").where(~np.isnan(out), None)

    return df.join(stats, key, "left").withColumn("spi", standardise("rolling", "n", "n_pos", "m", "v")).drop("n", "n_pos", "m", "v")


def poisson_bounds(df: DataFrame, count: str, level: float = 0.95) -> DataFrame:
    """Exact Poisson interval of a count."""

    @F.pandas_udf("lo double, hi double")
    def bounds(n: pd.Series) -> pd.DataFrame:
        known = {x: kernels.poisson_interval(x, level) for x in n.dropna().unique()}
        return pd.DataFrame([known.get(x, (None, None)) for x in n], columns=["lo", "hi"])

    return df.withColumn("__b", bounds(F.col(count).cast("double"))).withColumns({f"{count}_lo": F.col("__b.lo"), f"{count}_hi": F.col("__b.hi")}).drop("__b")


def _time_basis(dates: pd.Series, per_year: int) -> np.ndarray:
    t = (pd.to_datetime(dates) - pd.to_datetime(dates).min()).dt.days.to_numpy(float)
    df = max(2, round(per_year * (t.max() + 1) / 365.25))
    return kernels.natural_spline(t, kernels.spline_knots(t, df), t.min(), t.max() + 1e-9)


def distributed_lag_model(health: DataFrame, climate: DataFrame, key: str, cases: str, exposure: str, lags: int = 21, per_year: int = 4, points: int = 25, covariates: list[str] | None = None, reference: float | None = None, reference_quantile: float = 0.5, family: str = "quasipoisson") -> DataFrame:
    """Exposure-response curve per place: ``key, exposure, log_rr, se, rr, dispersion``, centred at ``reference`` or the exposure's quantile.

    ``covariates``: further numeric columns of ``health``.  ``family``: quasipoisson, or poisson (dispersion 1).

    ``health``: daily cases per key and date; ``climate``: daily exposure.  The lag matrix is made in Spark; the quasi-Poisson
    fit of each place runs in one task on its daily series.  Places with too few days give no rows.
    """
    lagged = distributed_lag(health, climate, key, exposure, lags)
    columns = [f"{exposure}_lag{k}" for k in range(lags + 1)]
    more = list(covariates or [])
    if family not in ("quasipoisson", "poisson"):
        raise ValueError(f"unknown family: {family}; one of quasipoisson, poisson")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [key, "exposure", "log_rr", "se", "rr", "dispersion"]
        pdf = pdf.sort_values("date").dropna(subset=[*columns, cases, *more])
        if len(pdf) < 60:
            return pd.DataFrame(columns=names)
        cross, spec = kernels.cross_basis(pdf[columns].to_numpy(float))
        x = np.column_stack((np.ones(len(pdf)), cross, _time_basis(pdf["date"], per_year), pdf[more].to_numpy(float)))
        model = kernels.poisson_regression(x, pdf[cases].to_numpy(float))
        seen = pdf[columns[0]].to_numpy(float)
        at = np.linspace(*np.quantile(seen, [0.01, 0.99]), points)
        log_rr, se = kernels.overall_curve(spec, model, at, float(np.quantile(seen, reference_quantile)) if reference is None else reference)
        if family == "poisson":
            se = se / np.sqrt(max(model.dispersion, 1e-300))
        return pd.DataFrame({key: pdf[key].iloc[0], "exposure": at, "log_rr": log_rr, "se": se, "rr": np.exp(log_rr), "dispersion": model.dispersion})

    kind = dict(health.dtypes)[key]
    return lagged.select(key, "date", cases, *more, *columns).groupBy(key).applyInPandas(fit, f"{key} {kind}, exposure double, log_rr double, se double, rr double, dispersion double")


def baseline(series: DataFrame, key: str, cases: str, control_until: str, per_year: int = 2, harmonics: int = 2, trend: str = "linear") -> DataFrame:
    """Expected cases per key and date, from a seasonal log-linear model of the days before ``control_until``.

    ``trend``: linear, or a natural spline of ``per_year`` terms a year over these days that goes on as a line.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        day = pd.to_datetime(pdf["date"])
        t = (day - day.min()).dt.days.to_numpy(float)
        wave = [f(2 * np.pi * k * day.dt.dayofyear / 365.25) for k in range(1, harmonics + 1) for f in (np.sin, np.cos)]
        y = pdf[cases].to_numpy(float)
        use = (day < pd.Timestamp(control_until)).to_numpy() & ~np.isnan(y)
        line = (t / max(1.0, t.max()))[:, None]
        if trend == "spline" and use.sum() > 10:
            own = t[use]
            terms = max(2, round(per_year * (own.max() + 1) / 365.25))
            line = kernels.natural_spline(t, kernels.spline_knots(own, terms), own.min(), own.max() + 1e-9)
        x = np.column_stack((np.ones(len(pdf)), line, *wave))
        if use.sum() <= x.shape[1]:
            return pdf.assign(expected=np.nan)
        model = kernels.poisson_regression(x[use], y[use])
        return pdf.assign(expected=np.exp(np.clip(x @ model.coef, -700, 700)))

    out = ", ".join(f"{n} {t}" for n, t in series.select(key, "date", cases).dtypes)
    return series.select(key, "date", cases).groupBy(key).applyInPandas(fit, out + ", expected double")


def interrupted_series(design: DataFrame, key: str, cases: str, terms: list[str]) -> DataFrame:
    """Coefficients of the segmented log-linear model per key: ``key, term, estimate, se, ratio``."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna()
        x = np.column_stack([np.ones(len(pdf)), *[pdf[t].to_numpy(float) for t in terms]])
        model = kernels.poisson_regression(x, pdf[cases].to_numpy(float))
        se = np.sqrt(np.maximum(0, np.diag(model.cov)))
        return pd.DataFrame({key: pdf[key].iloc[0], "term": ["intercept", *terms], "estimate": model.coef, "se": se, "ratio": np.exp(np.clip(model.coef, -700, 700))})

    kind = dict(design.dtypes)[key]
    return design.select(key, cases, *terms).groupBy(key).applyInPandas(fit, f"{key} {kind}, term string, estimate double, se double, ratio double")


def pooled(effects: DataFrame, group: str, effect: str, se: str) -> DataFrame:
    """Random-effects summary of places' effects within each group."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna()
        out = kernels.pool_effects(pdf[effect].to_numpy(float), pdf[se].to_numpy(float) ** 2)
        return pd.DataFrame([{group: pdf[group].iloc[0], **out, "n": len(pdf)}])

    kind = dict(effects.dtypes)[group]
    return effects.select(group, effect, se).where(F.col(se) > 0).groupBy(group).applyInPandas(fit, f"{group} {kind}, effect double, se double, tau2 double, q double, i2 double, p double, n bigint")


def drought_scales(monthly: DataFrame, key: str, rain: str, scales: list[int], **options) -> DataFrame:
    """``spi_<scale>`` of several scales in one table."""
    out = monthly
    for scale in scales:
        one = drought_spi(monthly.select(key, "date", rain), key, rain, scale, **options).select(key, "date", F.col("spi").alias(f"spi_{scale}"))
        out = out.join(one, [key, "date"], "left")
    return out


def conditional_fit(design: DataFrame, key: str, cases: str, terms: list[str]) -> DataFrame:
    """Conditional Poisson fit of a case-crossover design: ``key, term, estimate, se, ratio``.

    Each stratum's number of cases is held fixed, so that its own level drops out of the likelihood: cases share a stratum's days in proportion to exp(terms).
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [key, "term", "estimate", "se", "ratio"]
        pdf = pdf.dropna()
        if pdf.empty:
            return pd.DataFrame(columns=names)
        x, y = pdf[terms].to_numpy(float), pdf[cases].to_numpy(float)
        scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
        x = (x - x.mean(axis=0)) / scale
        _, at = np.unique(pdf["stratum"].to_numpy(), return_inverse=True)
        total = np.bincount(at, weights=y)
        coef = np.zeros(len(terms))
        for _ in range(50):
            e = np.exp(np.clip(x @ coef, -50, 50))
            share = e / np.bincount(at, weights=e)[at]
            centre = np.column_stack([np.bincount(at, weights=share * c) for c in x.T])[at]
            mu = total[at] * share
            info = ((x - centre).T * mu) @ (x - centre)
            step = np.linalg.pinv(info) @ (x.T @ (y - mu))
            coef = coef + np.clip(step, -2, 2)
            if np.abs(step).max(initial=0) < 1e-10:
                break
        se = np.sqrt(np.maximum(0, np.diag(np.linalg.pinv(info))))
        return pd.DataFrame({key: pdf[key].iloc[0], "term": terms, "estimate": coef / scale, "se": se / scale, "ratio": np.exp(np.clip(coef / scale, -700, 700))})

    kind = dict(design.dtypes)[key]
    return design.select(key, "stratum", cases, *terms).groupBy(key).applyInPandas(fit, f"{key} {kind}, term string, estimate double, se double, ratio double")


def pooled_moments(effects: DataFrame, group: list[str], effect: str, se: str) -> DataFrame:
    """Random-effects mean (DerSimonian-Laird) in closed form, by sums alone: ``n, effect, se, tau2, q, i2`` per group."""
    w = 1 / F.pow(se, 2)
    known = effects.where((F.col(se) > 0) & F.col(effect).isNotNull())
    one = known.groupBy(*group).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * w).alias("ww"), F.sum(w * F.col(effect)).alias("wy"), F.sum(w * F.pow(effect, 2)).alias("wyy"))
    q = F.greatest(F.col("wyy") - F.pow("wy", 2) / F.col("w"), F.lit(0.0))
    tau2 = F.greatest((q - (F.col("n") - 1)) / F.nullif(F.col("w") - F.col("ww") / F.col("w"), F.lit(0.0)), F.lit(0.0))
    one = one.select(*group, "n", q.alias("q"), F.coalesce(tau2, F.lit(0.0)).alias("tau2"))
    again = known.join(one.select(*group, "tau2"), group) if group else known.crossJoin(one.select("tau2"))
    v = 1 / (F.pow(se, 2) + F.col("tau2"))
    two = again.groupBy(*group).agg((F.sum(v * F.col(effect)) / F.sum(v)).alias("effect"), (1 / F.sqrt(F.sum(v))).alias("se"))
    out = one.join(two, group) if group else one.crossJoin(two)
    return out.withColumn("i2", F.when(F.col("q") > 0, F.greatest((F.col("q") - (F.col("n") - 1)) / F.col("q"), F.lit(0.0))).otherwise(0.0))


def pooled_curves(curves: DataFrame, by: str = "exposure") -> DataFrame:
    """Places' exposure-response curves (``exposure, log_rr, se`` on one grid) pooled point by point, with the relative risk and its interval."""
    out = pooled_moments(curves, [by], "log_rr", "se")
    return out.withColumns({"rr": F.exp("effect"), "rr_lo": F.exp(F.col("effect") - 1.96 * F.col("se")), "rr_hi": F.exp(F.col("effect") + 1.96 * F.col("se"))})
