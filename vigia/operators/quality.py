"""Quality control, gap features and quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import run_ids, runs

#: Plausible ranges; what lies outside is removed, negative rain, radiation and wind become 0.
RANGES = {"tair_dry_bulb_c": (-90, 60), "tair_max_c": (-90, 60), "tair_min_c": (-90, 60), "dew_tmean_c": (-90, 60), "rh_mean_porc": (0, 100), "rh_max_porc": (0, 100), "rh_min_porc": (0, 100), "patm_mb": (700, 1100), "patm_max_mb": (700, 1100), "patm_min_mb": (700, 1100), "rainfall_mm": (0, 500), "sr_kj_m2": (0, 40000), "ws_2_m_s": (0, 100), "ws_gust_m_s": (0, 100), "wd_degrees": (0, 360)}
FLOORED = ("rainfall_mm", "sr_kj_m2", "ws_2_m_s", "ws_gust_m_s")
#: Pairs (smaller, larger): the first is removed where the order is broken, but of the maximum the second.
ORDERED = (("tair_min_c", "tair_dry_bulb_c", 0), ("tair_dry_bulb_c", "tair_max_c", 1), ("dew_tmean_c", "tair_dry_bulb_c", 0), ("rh_min_porc", "rh_mean_porc", 0), ("rh_mean_porc", "rh_max_porc", 1), ("patm_min_mb", "patm_mb", 0), ("patm_mb", "patm_max_mb", 1))


def quality_control(df: DataFrame) -> DataFrame:
    """Remove values that break an order or a range, in that sequence; columns that are not there are skipped."""
    for low, high, gone in ORDERED:
        if low in df.columns and high in df.columns:
            name = (low, high)[gone]
            df = df.withColumn(name, F.when(F.coalesce(F.col(low) > F.col(high), F.lit(False)), None).otherwise(F.col(name)))
    for c, (lo, hi) in RANGES.items():
        if c in df.columns:
            x = F.greatest(F.col(c), F.lit(0.0)) if c in FLOORED else F.col(c)
            x = F.when(F.col(c).isNotNull(), x)
            df = df.withColumn(c, F.when(x.between(lo, hi), x))
    return df


def stuck_runs(df: DataFrame, value: str, keys: list[str], order: str, longer_than: int) -> DataFrame:
    """``value`` made null in runs of one repeated value longer than ``longer_than`` rows."""
    marked = run_ids(df, F.col(value), keys, order, "__run")
    n = F.count("*").over(Window.partitionBy(*keys, "__run"))
    return marked.withColumn(value, F.when(n <= longer_than, F.col(value))).drop("__run")


def time_features(df: DataFrame, timestamp: str) -> DataFrame:
    from math import pi

    h, day = F.hour(timestamp), F.dayofyear(timestamp)
    wave = lambda x, n: (F.round(F.sin(2 * pi * x / n), 6), F.round(F.cos(2 * pi * x / n), 6))
    return df.withColumns({"hour": h, "day_of_week": F.weekday(timestamp) + 1, "hour_sin": wave(h, 24)[0], "hour_cos": wave(h, 24)[1], "day_sin": wave(day, 365.25)[0], "day_cos": wave(day, 365.25)[1], "is_night": (h >= 18) | (h < 6)})


def lag_features(df: DataFrame, value: str, keys: list[str], order: str, steps: tuple[int, ...] = (1, 2, 3, 12, 24, 168)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    out = {f"{value}_lag{k}": F.lag(value, k).over(w) for k in steps} | {f"{value}_lead{k}": F.lead(value, k).over(w) for k in steps}
    return df.withColumns(out | {f"{value}_diff": F.col(value) - F.lag(value).over(w)})


def rolling_features(df: DataFrame, value: str, keys: list[str], order: str, sizes: tuple[int, ...] = (3, 6, 12, 24)) -> DataFrame:
    w = lambda n: Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.withColumns({f"{value}_mean{n}": F.avg(value).over(w(n)) for n in sizes} | {f"{value}_sd{n}": F.stddev_samp(value).over(w(n)) for n in sizes})


def gap_segments(df: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    """Runs of missing values: keys, run, start, end, n_rows."""
    return runs(df, F.col(value).isNull(), keys, order)


def imputation_metrics(df: DataFrame, truth: str, predicted: str, outliers_over: float | None = 3.0) -> DataFrame:
    """Errors of filled values, one row: n, n_outliers, rmse, mae, bias, r2, smape, slope.

    Rows whose truth lies over ``outliers_over`` standard deviations from the mean of all truths go first (None: none go), then rows
    without a value on either side.  r2 is 1 - SSE / SST and negative where the mean would do better; null without spread.
    """
    level = df.agg(F.avg(truth).alias("__mean"), F.stddev_samp(truth).alias("__sd"))
    far = F.coalesce(F.abs(F.col(truth) - F.col("__mean")) > F.lit(outliers_over) * F.col("__sd"), F.lit(False)) if outliers_over is not None else F.lit(False)
    df = df.join(F.broadcast(level)).withColumn("__far", far)  # one row
    known = ~F.col("__far") & F.col(truth).isNotNull() & F.col(predicted).isNotNull()
    t, q = F.when(known, F.col(truth)), F.when(known, F.col(predicted))
    e = q - t
    return df.agg(
        F.count(e).alias("n"), F.count_if("__far").alias("n_outliers"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), (1 - F.sum(e * e) / F.nullif(F.var_pop(t) * F.count(e), F.lit(0.0))).alias("r2"),
        F.avg(200 * F.abs(e) / F.nullif(F.abs(t) + F.abs(q), F.lit(0.0))).alias("smape"), F.regr_slope(q, t).alias("slope"),
    )


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns and exact duplicates; equal rows are counted by group before anything is shuffled."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicates"))


def missingness(df: DataFrame) -> DataFrame:
    """Missing values of each column: number, percentage, and ok (< 5), warning (< 20) or critical."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m_{k}") for k, c in enumerate(df.columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{k}").alias("n_missing")) for k, c in enumerate(df.columns)]))
    out = one.select("n", rows.alias("r")).select("r.column", "r.n_missing", F.when(F.col("n") > 0, 100 * F.col("r.n_missing") / F.col("n")).otherwise(0.0).alias("pct_missing"))
    return out.withColumn("flag", F.when(F.col("pct_missing") < 5, "ok").when(F.col("pct_missing") < 20, "warning").otherwise("critical"))


def completeness_score(report: DataFrame) -> DataFrame:
    return report.agg((100 * (F.count_if(F.col("flag") == "ok") + 0.5 * F.count_if(F.col("flag") == "warning")) / F.count("*")).alias("score"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Counts and percentages of a column's values, missing ones included."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("total"))).select("value", "n", (100 * F.col("n") / F.col("total")).alias("pct"))


def date_report(df: DataFrame, column: str, today: Column | None = None) -> DataFrame:
    d = F.col(column).cast("date")
    return df.agg(F.count_if(d.isNull()).alias("n_missing"), F.count_if(d > (F.current_date() if today is None else today)).alias("n_future"), F.count_if(d < F.lit("1900-01-01").cast("date")).alias("n_before_1900"), F.min(d).alias("first"), F.max(d).alias("last"))


def diagnosis_report(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """The most frequent chapters (first letters) of valid codes: a top-k report."""
    valid = df.where(F.col(column).rlike("^[A-Za-z][0-9]{2}"))
    return valid.groupBy(F.upper(F.substring(column, 1, 1)).alias("chapter")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chapter").limit(top)


def weighted_score(parts: dict[str, float | None], weights: dict[str, float] | None = None) -> float | None:
    """Weighted mean of the scores that are there."""
    weights = weights or {"completeness": 0.4, "demographics": 0.2, "diagnosis": 0.2, "dates": 0.2}
    there = {k: v for k, v in parts.items() if v is not None and k in weights}
    mass = sum(weights[k] for k in there)
    return sum(weights[k] * v for k, v in there.items()) / mass if mass else None


def kolmogorov_p(x: Column, terms: int = 100) -> Column:
    """Chance that the largest absolute value of a Brownian bridge passes ``x``: the alternating series, 1 below 0.1 where it is 1 to 16 digits."""
    k = F.sequence(F.lit(1), F.lit(terms)).cast("array<double>")
    series = F.aggregate(k, F.lit(0.0), lambda total, i: total + F.when(F.pmod(i, F.lit(2.0)) == 1, 1.0).otherwise(-1.0) * F.exp(-2 * i * i * x * x))
    return F.when(x < 0.1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))


def cusum_break(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """OLS-CUSUM test of a constant mean, one row a series: keys, ``n_values, cusum, break_pval``.

    cusum is the largest absolute prefix sum of the residuals over their standard deviation times sqrt(n); its limit law under no break is that of a
    Brownian bridge.  Null values are left out; a series without spread has a null statistic.  Rows of equal ``order`` count as
    one step, so that ties have no order.
    """
    known = df.where(F.col(value).isNotNull())
    level = known.groupBy(*keys).agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd"), F.count("*").alias("n_values"))
    steps = known.groupBy(*keys, order).agg(F.sum(value).alias("__sum"), F.count("*").alias("__rows"))
    steps = steps.join(level, keys).withColumn("__e", F.col("__sum") - F.col("__rows") * F.col("__mean"))
    path = F.abs(F.sum("__e").over(Window.partitionBy(*keys).orderBy(order)))
    most = steps.withColumn("__path", path).groupBy(*keys).agg(F.max("n_values").alias("n_values"), (F.max("__path") / F.nullif(F.first("__sd") * F.sqrt(F.first("n_values")), F.lit(0.0))).alias("cusum"))
    return most.withColumn("break_pval", kolmogorov_p(F.col("cusum")))


def series_quality(
    df: DataFrame, key: str, date: str, value: str, least_complete: float = 0.9, max_gap: int = 7, alpha: float = 0.05, max_outlier_months: int = 3, least_rows: int = 30
) -> DataFrame:
    """Whether each daily series is fit for a model: ``key, n_obs, n_expected, completeness, has_break, break_pval, n_outlier_months, n_gaps, score,
    include, reasons``.

    completeness is rows over days of the span (rounded to 4 digits); a break is an OLS-CUSUM p-value under ``alpha``, tested from ``least_rows`` rows on; an outlier
    month's sum lies over Q3 + 1.5 IQR; a gap is a run of over ``max_gap`` rows of null or 0.  From 100 the score loses 60 times the missing share if
    completeness is under ``least_complete``, 25 for a break, 10 for more than ``max_outlier_months``, and 5 a gap, up to two; 0 at least.  A
    series without any of these is included; ``reasons`` lists what speaks against the others, joined by "; ".
    """
    day = F.col(date).cast("date")
    days = df.groupBy(key).agg(F.count("*").alias("n_obs"), (F.datediff(F.max(day), F.min(day)) + 1).cast("bigint").alias("n_expected"))
    breaks = cusum_break(df.withColumn("__day", day), [key], "__day", value).select(key, "break_pval")
    months = df.groupBy(key, F.trunc(day, "month").alias("m")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("s"))
    limits = months.groupBy(key).agg((2.5 * F.percentile("s", 0.75) - 1.5 * F.percentile("s", 0.25)).alias("limit"))
    outliers = months.join(limits, key).groupBy(key).agg(F.count_if(F.col("s") > F.col("limit")).alias("n_outlier_months"))
    gaps = runs(df, F.col(value).isNull() | (F.col(value) == 0), [key], date, max_gap + 1).groupBy(key).agg(F.count("*").alias("n_gaps"))
    out = reduce(lambda a, b: a.join(b, key, "left"), (days, breaks, outliers, gaps)).na.fill({"n_gaps": 0})
    tested = F.when(F.col("n_obs") >= least_rows, F.col("break_pval"))
    share = F.col("n_obs") / F.col("n_expected")
    out = out.withColumns({"break_pval": tested, "has_break": tested < alpha})
    thin, broken, odd = share < least_complete, F.coalesce("has_break", F.lit(False)), F.col("n_outlier_months") > max_outlier_months
    loss = F.when(thin, F.round((1 - share) * 60)).otherwise(0) + F.when(broken, 25).otherwise(0) + F.when(odd, 10).otherwise(0) + 5 * F.least("n_gaps", F.lit(2))
    why = F.array_compact(F.array(
        F.when(thin, F.concat(F.lit("completeness="), F.round(100 * share).cast("int").cast("string"), F.lit("%"))), F.when(broken, F.concat(F.lit("break (p="), F.format_number("break_pval", 3), F.lit(")"))),
        F.when(odd, F.concat(F.lit("outlier_months="), F.col("n_outlier_months").cast("string"))), F.when(F.col("n_gaps") > 0, F.concat(F.lit(f"gaps>{max_gap}d="), F.col("n_gaps").cast("string"))),
    ))
    return out.select(
        key, "n_obs", "n_expected", F.round(share, 4).alias("completeness"), "has_break", "break_pval", "n_outlier_months", "n_gaps", F.greatest(F.lit(0), 100 - loss).cast("bigint").alias("score"),
        (~thin & ~broken & ~odd & (F.col("n_gaps") == 0)).alias("include"), F.array_join(why, "; ").alias("reasons"),
    )


def diurnal_range(hourly: DataFrame, station: str, timestamp: str, high: str = "tair_max_c", low: str = "tair_min_c", mean: str = "tair_dry_bulb_c") -> DataFrame:
    """Daily range per station: maximum less minimum of the extreme columns, where the daily mean gap of these varies by over 0.5 (they
    are then daily or hourly extremes), else of the air temperature."""
    day = F.to_date(timestamp).alias("date")
    per_day = hourly.groupBy(station, day).agg(F.avg(F.col(high) - F.col(low)).alias("gap"), (F.max(high) - F.min(low)).alias("extremes"), (F.max(mean) - F.min(mean)).alias("plain"))
    spread = per_day.groupBy(station).agg(F.stddev_samp("gap").alias("sd"))
    return per_day.join(spread, station).select(station, "date", F.round(F.when(F.col("sd") > 0.5, F.col("extremes")).otherwise(F.col("plain")), 2).alias("diurnal_range"))


def place_report(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """Distinct and missing municipalities, distinct states (first two digits), and the most frequent ones: a top-k report."""
    code = F.trim(F.col(column).cast("string"))
    known = F.when(code.rlike("^[0-9]{6,7}$"), code)
    counts = df.groupBy(known.alias("code")).agg(F.count("*").alias("n"))
    total = counts.agg(F.count("code").alias("n_municipalities"), F.countDistinct(F.substring("code", 1, 2)).alias("n_states"), F.coalesce(F.sum(F.when(F.col("code").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"))
    return counts.where("code is not null").orderBy(F.desc("n"), "code").limit(top).crossJoin(total)


#: Variables that the derivation stage adds.
DERIVED = ("age_years", "age_group", "year", "month", "day_of_week", "epidemiological_week", "season", "climate_risk_group", "climatic_season")


def derived_presence(df: DataFrame, names: tuple[str, ...] = DERIVED) -> DataFrame:
    """Which derived variables the table has, and how complete they are."""
    there = [n for n in names if n in df.columns]
    one = df.agg(F.count("*").alias("n"), *[F.count(n).alias(f"k_{n}") for n in there])
    rows = F.array(*[F.struct(F.lit(n).alias("variable"), F.lit(n in there).alias("present"), (F.col(f"k_{n}") if n in there else F.lit(0)).cast("bigint").alias("n_known")) for n in names])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def quality_report(df: DataFrame, diagnosis: str | None = None, date: str | None = None, demographics: list[str] | None = None, place: str | None = None, top: int = 10) -> DataFrame:
    """All parts of the report as one long table: ``section, item, value``; the score is the weighted mean of the parts there are.

    Completeness comes from the flags of the columns, demographics and places from the share of known values, dates from the share
    neither missing nor before 1900 nor in the future, diagnoses from the share of valid codes.
    """
    item = lambda section, name, value: F.struct(F.lit(section).alias("section"), F.lit(name).alias("item"), value.cast("double").alias("value"))
    n = F.count("*")
    share = lambda good: F.when(n > 0, 100 * F.count_if(good) / n)
    known = lambda c: F.coalesce(~F.lower(F.trim(F.col(c).cast("string"))).isin("ignorado", "ignored", "9", "99", ""), F.lit(False))
    columns = [c for c in df.columns]
    aggs = {"rows": n, **{f"missing {c}": F.when(n > 0, 100 * F.count_if(F.col(c).isNull()) / n) for c in columns}}
    parts: dict[str, Column] = {}
    if date:
        d = F.col(date).cast("date")
        parts["dates"] = share(d.between(F.lit("1900-01-01").cast("date"), F.current_date()))
    if diagnosis:
        parts["diagnosis"] = share(F.coalesce(F.col(diagnosis).rlike("^[A-Za-z][0-9]{2}"), F.lit(False)))
    for c in demographics or []:
        aggs[f"known {c}"] = share(known(c))
    if demographics:
        parts["demographics"] = reduce(lambda a, b: a + b, [share(known(c)) for c in demographics]) / len(demographics)
    if place:
        aggs["known place"] = share(F.coalesce(F.trim(F.col(place).cast("string")).rlike("^[0-9]{6,7}$"), F.lit(False)))
    one = df.agg(*[x.alias(f"a{k}") for k, x in enumerate(aggs.values())], *[x.alias(f"p_{k}") for k, x in parts.items()])
    missing = [f"a{k}" for k, name in enumerate(aggs) if name.startswith("missing ")]
    grade = reduce(lambda a, b: a + b, [F.when(F.col(c) < 5, 1.0).when(F.col(c) < 20, 0.5).otherwise(0.0) for c in missing]) * 100 / len(missing)
    one = one.withColumn("p_completeness", grade)
    weights = {"completeness": 0.4, "demographics": 0.2, "diagnosis": 0.2, "dates": 0.2}
    used = ["completeness", *parts]
    score = reduce(lambda a, b: a + b, [weights[k] * F.col(f"p_{k}") for k in used]) / sum(weights[k] for k in used)
    section = {"rows": "overview", "missing": "missing", "known": "demographics"}
    rows = [item("places" if name == "known place" else section[name.split(" ")[0]], name.split(" ", 1)[-1], F.col(f"a{k}")) for k, name in enumerate(aggs)]
    rows += [item("parts", k, F.col(f"p_{k}")) for k in used] + [item("score", "score", score)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


#: Rules for the scale on which a variable's gaps are predicted: part of its name, transform.
TRANSFORMS = (("rainfall", "log1p"), ("ws_", "sqrt"), ("gust", "sqrt"), ("sr_kj", "sqrt"))


def transform_of(variable: str) -> str:
    return next((kind for part, kind in TRANSFORMS if part in variable), "none")


def transformed(x: Column, kind: str) -> Column:
    return {"log1p": F.log1p(x), "sqrt": F.sqrt(x), "none": x}[kind]


def restored(x: Column, kind: str) -> Column:
    """Back from the transform's scale; what lies under its range is 0."""
    low = F.greatest(x, F.lit(0.0))
    return {"log1p": F.expm1(low), "sqrt": low * low, "none": x}[kind]


def smooth_extremes(df: DataFrame, predicted: str, truth: str, keys: list[str], times: float = 5.0, share: float = 0.3) -> DataFrame:
    """Predictions over ``times`` interquartile ranges outside the known values' quartiles are drawn to the known mean by ``share``."""
    q = F.percentile(truth, F.array(F.lit(0.25), F.lit(0.75)))
    known = df.groupBy(*keys).agg(q.alias("__q"), F.avg(truth).alias("__mean"))
    df = df.join(known, keys)
    width = times * (F.col("__q")[1] - F.col("__q")[0])
    far = (F.col(predicted) < F.col("__q")[0] - width) | (F.col(predicted) > F.col("__q")[1] + width)
    return df.withColumn(predicted, F.when(far, share * F.col("__mean") + (1 - share) * F.col(predicted)).otherwise(F.col(predicted))).drop("__q", "__mean")


def zero_nights(df: DataFrame, timestamp: str, radiation: str = "sr_kj_m2", start: int = 18, end: int = 6) -> DataFrame:
    """Missing radiation at night is 0."""
    h = F.hour(timestamp)
    return df.withColumn(radiation, F.when(((h >= start) | (h < end)) & F.col(radiation).isNull(), 0.0).otherwise(F.col(radiation)))


def inject_gaps(df: DataFrame, value: str, order: list[str], share: float = 0.2, mechanism: str = "MCAR", depends_on: list[str] | None = None, seed: int = 42) -> DataFrame:
    """``value`` made missing in a share of the rows, with the truth kept in ``<value>_truth``.

    MCAR: rows by a keyed hash.  MAR: more often where ``depends_on`` are high.  MNAR: more often where the value is far from its mean.
    Each row draws by u ** (1 / weight), u a hash of ``order`` (the row's key); the rows with the largest draws lose their value, which is weighted
    sampling without replacement; the cut is the exact quantile of the draws.
    """
    u = (F.pmod(F.crc32(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in order]).cast("binary")), F.lit(1_000_003)) + 1) / 1_000_004.0
    if mechanism == "MCAR":
        weighted = df.withColumn("__w", F.lit(1.0))
    elif mechanism == "MAR":
        if not depends_on:
            raise ValueError("MAR needs depends_on")
        stats = df.agg(*[f(c).alias(f"__{n}_{c}") for c in depends_on for n, f in (("m", F.avg), ("s", F.stddev_samp))])
        z = reduce(lambda a, b: a + b, [F.coalesce((F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in depends_on]) / len(depends_on)
        scored = df.crossJoin(stats).withColumn("__z", z).drop(*stats.columns)
        span = scored.agg(F.min("__z").alias("__lo"), F.max("__z").alias("__hi"))
        weighted = scored.crossJoin(span).withColumn("__w", F.coalesce((F.col("__z") - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)), F.lit(0.5))).drop("__z", "__lo", "__hi")
    elif mechanism == "MNAR":
        stats = df.agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
        weighted = df.crossJoin(stats).withColumn("__w", F.abs(F.col(value) - F.col("__m")) / F.col("__s")).drop("__m", "__s")
    else:
        raise ValueError(f"unknown mechanism: {mechanism}; one of MCAR, MAR, MNAR")
    drawn = weighted.withColumn("__u", F.when(F.col(value).isNotNull() & (F.col("__w") > 0), F.pow(u, 1 / F.col("__w"))).otherwise(0.0))
    cut = drawn.agg(F.percentile("__u", 1 - share).alias("__cut"))
    out = drawn.crossJoin(cut).withColumn(f"{value}_truth", F.col(value))
    return out.withColumn(value, F.when(F.coalesce(F.col("__u") > F.col("__cut"), F.lit(False)), None).otherwise(F.col(value))).drop("__w", "__u", "__cut")
