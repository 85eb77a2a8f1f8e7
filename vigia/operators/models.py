"""What models need before and after the fit: designs, attributable numbers, rankings, indices."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import with_rank


def attributable(df: DataFrame, cases: str, rr: str, exposure: str, low: float | None = None, high: float | None = None, by: list[str] | None = None) -> DataFrame:
    """Attributable number sum(y (1 - 1/RR)) over the exposure range, and its fraction of all cases."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col(exposure) >= low)
    if high is not None:
        inside = inside & (F.col(exposure) <= high)
    an = F.coalesce(F.sum(F.when(inside, F.col(cases) * (1 - 1 / F.col(rr)))), F.lit(0.0))
    return df.groupBy(*(by or [])).agg(an.alias("an"), F.sum(cases).alias("total")).withColumn("af", F.col("an") / F.nullif(F.col("total").cast("double"), F.lit(0.0)))


def burden_ranking(df: DataFrame, key: str, an: str, top: int | None = None) -> DataFrame:
    """Rank by attributable number, share of the total, cumulative share; ``top`` rows, if given, as a report."""
    total, w = F.sum(an).over(Window.partitionBy()), Window.orderBy(F.desc(an), key)  # one row a city
    out = df.select(key, an).withColumns({"rank": F.rank().over(Window.orderBy(F.desc(an))), "pct": 100 * F.col(an) / total, "cum_pct": 100 * F.sum(an).over(w.rowsBetween(Window.unboundedPreceding, 0)) / total})
    return out.where(F.col("rank") <= top) if top else out


def excess(df: DataFrame, observed: str, expected: str, order: str, by: list[str] | None = None, z: float = 1.96) -> DataFrame:
    """Excess over the baseline, its z-score and flag, and the running total."""
    o, e = F.col(observed), F.col(expected)
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"excess": o - e, "z": F.when(e > 0, (o - e) / F.sqrt(e)), "flag": F.when(e > 0, (o - e) / F.sqrt(e) > z), "cum_excess": F.sum(o - e).over(w)})


def interrupted_design(df: DataFrame, date: str, interruption: str | list[str], harmonics: int = 2) -> DataFrame:
    """Time, step and slope after the interruption, and yearly harmonics; of several interruptions, ``step1``, ``slope1``, ``step2`` and so on."""
    first = df.agg(F.min(F.col(date).cast("date")).alias("__first"))
    d = F.col(date).cast("date")
    dates = {"": interruption} if isinstance(interruption, str) else {str(k): x for k, x in enumerate(interruption, 1)}
    terms = {"time": F.datediff(d, "__first")}
    for k, x in dates.items():
        start = F.lit(x).cast("date")
        terms |= {f"step{k}": (d >= start).cast("int"), f"slope{k}": F.greatest(F.datediff(d, start), F.lit(0))}
    df = df.crossJoin(first).withColumns(terms).drop("__first")
    wave = {f"{name}{k}": F.round(fun(2 * pi * k * F.dayofyear(d) / 365.25), 9) for k in range(1, harmonics + 1) for name, fun in (("sin", F.sin), ("cos", F.cos))}
    return df.withColumns(wave)


def case_crossover(df: DataFrame, date: str, cases: str, exposure: str, lag: int = 0, key: list[str] | None = None, stratum: str = "month") -> DataFrame:
    """Days with their stratum and the lagged exposure; strata without cases are left out, as they tell nothing."""
    w = Window.partitionBy(*(key or [])).orderBy(date)
    iso_year = F.year(F.date_add(F.trunc(date, "week"), 3))
    name = F.date_format(date, "yyyy-MM") if stratum == "month" else F.format_string("%d-W%02d", iso_year, F.weekofyear(date))
    df = df.withColumns({"stratum": F.concat_ws("|", *(key or []), name), "exposure": F.lag(exposure, lag).over(w) if lag else F.col(exposure)})
    return df.withColumn("__n", F.sum(cases).over(Window.partitionBy("stratum"))).where("__n > 0").drop("__n")


def interpolate_at(grid: DataFrame, key: str, x: str, y: str, at: DataFrame, point: str) -> DataFrame:
    """Linear interpolation of y at each key's ``point``; outside the grid the end's value."""
    w = Window.partitionBy(key).orderBy(x)
    pieces = grid.select(key, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), F.lag(x).over(w).isNull().alias("first"))
    inside = ((F.col(point) >= F.col("x0")) & ((F.col(point) < F.col("x1")) | F.col("x1").isNull())) | (F.col("first") & (F.col(point) < F.col("x0")))
    value = F.when((F.col(point) <= F.col("x0")) | F.col("x1").isNull(), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col(point) - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return at.join(pieces, key).where(inside).select(key, point, value.alias("value"))


def vulnerability_index(df: DataFrame, key: str, pillars: dict[str, float], inverted: tuple[str, ...] = ()) -> DataFrame:
    """Min-max normalised pillars (``inverted`` ones from the top), weighted mean of those that are there, rank."""
    span = df.agg(*[f(c).alias(f"{n}_{c}") for c in pillars for n, f in (("lo", F.min), ("hi", F.max))])
    df = df.select(key, *pillars).crossJoin(span)
    score = {}
    for c in pillars:
        s = F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).when(F.col(c).isNotNull(), 0.5)
        score[f"{c}_score"] = 1 - s if c in inverted else s
    df = df.withColumns(score)
    top = sum((F.coalesce(F.col(f"{c}_score") * w, F.lit(0.0)) for c, w in pillars.items()), F.lit(0.0))
    mass = sum((F.when(F.col(f"{c}_score").isNotNull(), w).otherwise(0.0) for c, w in pillars.items()), F.lit(0.0))
    df = df.withColumn("index", top / F.nullif(mass, F.lit(0.0)))
    return df.select(key, *score, "index", F.rank().over(Window.orderBy(F.desc_nulls_last("index"))).alias("rank"))  # one row a city


def quadrant_scores(long: DataFrame, key: str, quadrant: str, value: str, edges: tuple[float, ...] = (25, 50, 75)) -> DataFrame:
    """Mean indicator per quadrant, one column each, and its class."""
    names = ("strengths", "weaknesses", "opportunities", "threats")
    wide = long.groupBy(key).pivot(quadrant, list(names)).agg(F.avg(value))
    grade = lambda c: F.when(F.col(c) < edges[0], "low").when(F.col(c) < edges[1], "moderate").when(F.col(c) < edges[2], "high").when(F.col(c).isNotNull(), "very high")
    return wide.withColumns({f"{c}_class": grade(c) for c in names})


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    e = F.col(truth) - F.col(predicted)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(truth) * F.count(truth))).alias("r2"), F.corr(truth, predicted).alias("pearson"))


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Fold number by a hash of the group, so that a group is never split."""
    return df.withColumn("fold", F.pmod(F.crc32(F.col(group).cast("string").cast("binary")), F.lit(k)).cast("int"))


def sensitivity_ranking(curves: DataFrame, stratum: str, hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Relative risk of each stratum at its hot and cold exposure, the sensitivity index (sum of the log risks), and ranks.

    ``curves``: ``stratum, exposure, log_rr``; ``hot`` and ``cold``: ``stratum, point``.
    """
    at = lambda points, name: interpolate_at(curves, stratum, "exposure", "log_rr", points, "point").select(stratum, F.col("value").alias(name))
    df = at(hot, "hot_log_rr").join(at(cold, "cold_log_rr"), stratum, "full")
    rank = lambda c: F.when(F.col(c).isNotNull(), F.rank().over(Window.orderBy(F.desc_nulls_last(c))))  # noqa: E731  one row a stratum
    return df.select(stratum, F.exp("hot_log_rr").alias("hot_rr"), F.exp("cold_log_rr").alias("cold_rr"), (F.col("hot_log_rr") + F.col("cold_log_rr")).alias("sensitivity_index"), rank("hot_log_rr").alias("hot_rank"), rank("cold_log_rr").alias("cold_rank"))


def normalised(x: str, how: str = "minmax") -> tuple[list, object]:
    """Aggregates and the score (0 to 1, or standard deviations) of a column under a normalisation."""
    if how == "minmax":
        return [F.min(x).alias(f"__a_{x}"), F.max(x).alias(f"__b_{x}")], lambda: F.when(F.col(f"__b_{x}") > F.col(f"__a_{x}"), (F.col(x) - F.col(f"__a_{x}")) / (F.col(f"__b_{x}") - F.col(f"__a_{x}"))).when(F.col(x).isNotNull(), 0.5)
    if how == "zscore":
        return [F.avg(x).alias(f"__a_{x}"), F.stddev_samp(x).alias(f"__b_{x}")], lambda: (F.col(x) - F.col(f"__a_{x}")) / F.nullif(F.col(f"__b_{x}"), F.lit(0.0))
    raise ValueError(f"unknown normalisation: {how}; one of minmax, zscore, rank")


def weighted_pillars(df: DataFrame, key: str, pillars: dict[str, dict[str, float]], how: str = "minmax", inverted: tuple[str, ...] = ()) -> DataFrame:
    """Each pillar as the weighted mean of its normalised indicators (of those that are there); ``how``: minmax, zscore or rank."""
    columns = [c for group in pillars.values() for c in group]
    if how == "rank":
        score = {}
        for c in columns:
            df = with_rank(df, c, f"__r_{c}").crossJoin(df.agg(F.count(c).alias(f"__n_{c}")))
            score[c] = (F.col(f"__r_{c}") - 0.5) / F.col(f"__n_{c}")
    else:
        made = {c: normalised(c, how) for c in columns}
        df = df.crossJoin(df.agg(*[a for aggs, _ in made.values() for a in aggs]))
        score = {c: f() for c, (_, f) in made.items()}
    flip = {c: ((1 - s) if how != "zscore" else -s) if c in inverted else s for c, s in score.items()}
    out = {}
    for name, group in pillars.items():
        top = sum((F.coalesce(flip[c] * w, F.lit(0.0)) for c, w in group.items()), F.lit(0.0))
        mass = sum((F.when(flip[c].isNotNull(), w).otherwise(0.0) for c, w in group.items()), F.lit(0.0))
        out[name] = top / F.nullif(mass, F.lit(0.0))
    return df.select(key, *[x.alias(n) for n, x in out.items()])


def interruption_counterfactual(design: DataFrame, coefs: DataFrame, cases: str, key: str | None = None) -> DataFrame:
    """The segmented model's fitted cases, and those expected without the interruptions: ``segment, fitted, counterfactual, avoided, ratio`` besides the design.

    ``design`` comes from ``interrupted_design``, ``coefs`` (``[key,] term, estimate``) from ``fits.interrupted_series``: a few rows a key.  The counterfactual leaves out all ``step*`` and ``slope*`` terms;
    ``segment`` counts the interruptions begun.  Rows of a key without coefficients are left out; a term of the fit that the design lacks is an error, a null term gives nulls.
    """
    keys = [key] if key else []
    terms = [c for c in design.columns if c == "time" or c.rstrip("0123456789") in ("step", "slope", "sin", "cos")]
    steps = [c for c in terms if c.rstrip("0123456789") == "step"]
    wide = coefs.groupBy(*keys).agg(F.max(F.when(F.col("term") == "intercept", F.col("estimate"))).alias("__intercept"), *[F.coalesce(F.max(F.when(F.col("term") == t, F.col("estimate"))), F.lit(0.0)).alias(f"__{t}") for t in terms])
    strange = coefs.where(~F.col("term").isin("intercept", *terms)).limit(1).collect()
    if strange:
        raise ValueError(f"the design has no column {strange[0]['term']}")
    joined = design.join(F.broadcast(wide), keys) if keys else design.crossJoin(F.broadcast(wide))  # without a key, one row
    gone = sum((F.col(f"__{t}") * F.col(t) for t in terms if t.startswith(("step", "slope"))), F.lit(0.0))
    kept = sum((F.col(f"__{t}") * F.col(t) for t in terms if not t.startswith(("step", "slope"))), F.col("__intercept"))
    out = joined.withColumns({"segment": sum((F.col(s) for s in steps), F.lit(0)), "fitted": F.exp(kept + gone), "counterfactual": F.exp(kept)})
    out = out.withColumns({"avoided": F.col("counterfactual") - F.col(cases), "ratio": F.exp(gone)})
    return out.drop("__intercept", *[f"__{t}" for t in terms])


def segment_means(counterfactual: DataFrame, cases: str, key: str | None = None) -> DataFrame:
    """A row a segment (and key): ``n, mean_observed, mean_fitted, mean_counterfactual, change_percent``, the last of observed against counterfactual sums (null where that is 0)."""
    by = [key, "segment"] if key else ["segment"]
    change = 100 * (F.sum(cases) / F.nullif(F.sum("counterfactual"), F.lit(0.0)) - 1)
    return counterfactual.groupBy(*by).agg(F.count("*").alias("n"), F.avg(cases).alias("mean_observed"), F.avg("fitted").alias("mean_fitted"), F.avg("counterfactual").alias("mean_counterfactual"), change.alias("change_percent"))
