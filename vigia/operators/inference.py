"""Inference on fitted or aggregated tables: exceedance, projection, meta-regression, intervals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels


def normal_cdf(x: Column) -> Column:
    """Normal distribution by the rational approximation 7.1.26 of the error function (error under 1.5e-7)."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return 0.5 * (1 + F.signum(x) * erf)


def exceedance_probability(df: DataFrame, estimate: str, low: str, high: str, thresholds: list[float], level_z: float = 1.96) -> DataFrame:
    """Chance that a relative risk with a log-normal interval exceeds each threshold: columns ``p_gt_<threshold>``."""
    sigma = (F.log(high) - F.log(low)) / (2 * level_z)
    out = {f"p_gt_{str(t).replace('.', '_')}": F.when(sigma > 0, 1 - normal_cdf((math.log(t) - F.log(estimate)) / sigma)) for t in thresholds}
    return df.withColumns(out)


def geometric_aggregate(df: DataFrame, by: list[str], estimate: str) -> DataFrame:
    """Geometric mean of relative risks."""
    return df.groupBy(*by).agg(F.exp(F.avg(F.log(estimate))).alias(estimate), F.count("*").alias("n"))


def project_risk(last: DataFrame, key: str, log_rr: str, slope: str, variance: str, horizon: int, z: float = 1.96) -> DataFrame:
    """Random-walk projection: the log risk drifts by ``slope`` a step and its variance grows with the steps."""
    ahead = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    mu, sd = F.col(log_rr) + F.col(slope) * F.col("step"), F.sqrt(F.col(variance) * F.col("step"))
    return ahead.select(key, "step", F.exp(mu).alias("rr"), F.exp(mu - z * sd).alias("rr_lo"), F.exp(mu + z * sd).alias("rr_hi"))


def meta_regression(effects: DataFrame, group: str, effect: str, se: str, covariates: list[str]) -> DataFrame:
    """Random-effects regression of places' effects on standardised covariates, with Wald tests, per group."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna()
        x = pdf[covariates].to_numpy(float)
        x = np.column_stack((np.ones(len(pdf)), (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)))
        y, v, tau = pdf[effect].to_numpy(float), pdf[se].to_numpy(float) ** 2, 0.0
        for _ in range(200):
            w = 1 / (v + tau)
            cov = np.linalg.pinv((x.T * w) @ x)
            coef = cov @ (x.T * w) @ y
            res = y - x @ coef
            trace = float(w.sum() - np.trace(cov @ (x.T * w**2) @ x))
            new = max(0.0, tau + (float((w**2 * res**2).sum()) - trace) / max(float((w**2).sum()), 1e-300))
            if abs(new - tau) < 1e-12:
                break
            tau = new
        errors = np.sqrt(np.diag(cov))
        wald = (coef / np.where(errors > 0, errors, np.inf)) ** 2
        return pd.DataFrame({group: pdf[group].iloc[0], "term": ["intercept", *covariates], "estimate": coef, "se": errors, "p_value": [1 - kernels.gamma_p(0.5, q / 2) for q in wald], "tau2": tau})

    kind = dict(effects.dtypes)[group]
    return effects.select(group, effect, se, *covariates).where(F.col(se) > 0).groupBy(group).applyInPandas(fit, f"{group} {kind}, term string, estimate double, se double, p_value double, tau2 double")


def attributable_interval(df: DataFrame, key: str, cases: str, log_rr: str, se: str, draws: int = 500, seed: int = 42) -> DataFrame:
    """Attributable number per key and its 95 % interval from draws of the curve's level (one draw moves all of a key's days)."""
    factor = df.select(key).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    u1, u2 = (F.pmod(F.xxhash64(F.col(key), F.col("draw"), F.lit(seed + k)), F.lit(1_000_003)) / 1_000_003.0 for k in (0, 1))
    normal = F.when(F.col("draw") == 0, 0.0).otherwise(F.sqrt(-2 * F.log(1 - u1)) * F.cos(2 * math.pi * u2))
    moved = df.join(factor.withColumn("e", normal), key)
    an = moved.groupBy(key, "draw").agg(F.sum(F.col(cases) * (1 - F.exp(-(F.col(log_rr) + F.col("e") * F.col(se))))).alias("an"))
    return an.groupBy(key).agg(F.max(F.when(F.col("draw") == 0, F.col("an"))).alias("an"), F.percentile(F.when(F.col("draw") > 0, F.col("an")), 0.025).alias("an_lo"), F.percentile(F.when(F.col("draw") > 0, F.col("an")), 0.975).alias("an_hi"))
