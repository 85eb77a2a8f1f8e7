"""Heat and cold events, anomalies, drought indices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import exact_mean, fused
from ..functions.windows import complete_rolling_sum, run_ids

#: Rows that a run needs, by method.
LEAST = {"WHO": 3, "WMO": 5, "INMET": 5, "EHF": 3, "UTCI": 3, "WBGT": 3, "HI": 3, "ECF": 3}
#: Methods that hold an index's daily maximum against its own percentile.
INDEX_METHODS = ("UTCI", "WBGT", "HI")


def daily_extremes(hourly: DataFrame, station: str, timestamp: str, temperature: str, index: str | None = None) -> DataFrame:
    """tmax, tmin, tmean (and the index's maximum) per station and day; tmean is the same to the last bit each time that it is computed."""
    more = [F.max(index).alias("index_max")] if index else []
    return hourly.groupBy(station, F.to_date(timestamp).alias("date")).agg(F.max(temperature).alias("tmax"), F.min(temperature).alias("tmin"), exact_mean(F.col(temperature)).alias("tmean"), *more)


def day_baseline(days: DataFrame, station: str, percentile: float = 0.9, around: int = 15, least: int = 10, first: str | None = None, last: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Percentiles and means per station and day of the year, over the days ``around`` it in all years of the baseline.

    ``station, doy, tmax_p, tmin_p, tmax_hist, tmin_hist`` and ``<column>_p`` of each column of ``more``; a percentile needs ``least`` values of its own.
    The baseline are the days from ``first`` to ``last``, either of them open.  All columns share one explosion and one aggregation.
    A level between two values that differ in their last bit is one of the two; it is interpolated with one rounding, so that it is the one that the SQL finds.
    """
    base = days
    if first:
        base = base.where(F.col("date") >= F.lit(first).cast("date"))
    if last:
        base = base.where(F.col("date") <= F.lit(last).cast("date"))
    levels = list(dict.fromkeys(("tmax", "tmin", *more)))
    base = base.select(station, "date", *levels)
    spread = base.withColumn("k", F.explode(F.sequence(F.lit(-around), F.lit(around)))).withColumn("doy", F.pmod(F.dayofyear("date") - 1 + F.col("k"), F.lit(366)) + 1)
    # a list holds a day of the year's own values: those of the days around it
    out = spread.groupBy(station, "doy").agg(*[F.array_sort(F.collect_list(F.col(c).cast("double"))).alias(f"__{c}") for c in levels], exact_mean(F.col("tmax")).alias("tmax_hist"), exact_mean(F.col("tmin")).alias("tmin_hist"))
    out = out.withColumns({f"__at_{c}": percentile * (F.size(f"__{c}") - 1) for c in levels})
    near = lambda c, side: F.get(f"__{c}", side(f"__at_{c}").cast("int"))
    out = out.withColumns({f"__lo_{c}": near(c, F.floor) for c in levels} | {f"__hi_{c}": near(c, F.ceil) for c in levels} | {f"__part_{c}": F.col(f"__at_{c}") - F.floor(f"__at_{c}") for c in levels})
    lo, hi, part = (lambda c, k=k: F.col(f"__{k}_{c}") for k in ("lo", "hi", "part"))
    level = lambda c: F.when(F.size(f"__{c}") >= least, F.when(lo(c) == hi(c), lo(c)).otherwise(fused(lo(c), 1 - part(c), hi(c) * part(c)))).alias(f"{c}_p")
    return out.select(station, "doy", *map(level, levels), "tmax_hist", "tmin_hist")


def wave_flags(days: DataFrame, baseline: DataFrame, station: str, cold: bool = False) -> DataFrame:
    """Days with the methods' flags: WHO (beyond the percentile), WMO (both extremes beyond), INMET (5 degrees from the mean)."""
    df = days.withColumn("doy", F.dayofyear("date")).join(baseline, [station, "doy"], "left")
    if cold:
        who, wmo, inmet = F.col("tmin") < F.col("tmin_p"), (F.col("tmin") < F.col("tmin_p")) & (F.col("tmax") < F.col("tmax_p")), F.col("tmin") < F.col("tmin_hist") - 5
        anomaly = F.col("tmin_hist") - F.col("tmin")
    else:
        who, wmo, inmet = F.col("tmax") > F.col("tmax_p"), (F.col("tmax") > F.col("tmax_p")) & (F.col("tmin") > F.col("tmin_p")), F.col("tmax") > F.col("tmax_hist") + 5
        anomaly = F.col("tmax") - F.col("tmax_hist")
    no = F.lit(False)
    return df.withColumns({"WHO": F.coalesce(who, no), "WMO": F.coalesce(wmo, no), "INMET": F.coalesce(inmet, no), "anomaly": anomaly})


def excess_heat(days: DataFrame, station: str, cold: bool = False) -> DataFrame:
    """EHF (or the cold factor): three-day mean against the station's 95th (5th) percentile and the 30 days before."""
    w = Window.partitionBy(station).orderBy("date")
    df = days.withColumns({"t3": F.when(F.count("tmean").over(w.rowsBetween(-2, 0)) == 3, F.avg("tmean").over(w.rowsBetween(-2, 0))), "t30": F.avg("tmean").over(w.rowsBetween(-32, -3))})
    share = 0.05 if cold else 0.95
    df = df.join(days.groupBy(station).agg(F.percentile("tmean", share).alias("limit")), station)
    sign = -1 if cold else 1
    df = df.withColumn("factor", sign * (F.col("t3") - F.col("limit")) * F.greatest(F.lit(1.0), sign * (F.col("t3") - F.col("t30"))))
    name = "ECF" if cold else "EHF"
    return df.withColumn(name, F.coalesce(F.max(F.when(F.col("factor") > 0, True).otherwise(False)).over(w.rowsBetween(0, 2)), F.lit(False)))


def keep_runs(df: DataFrame, flag: str, keys: list[str], order: str, least: int) -> DataFrame:
    """``flag`` only where its run has at least ``least`` rows."""
    marked = run_ids(df, F.col(flag), keys, order, "__run")
    return marked.withColumn(flag, F.col(flag) & (F.count("*").over(Window.partitionBy(*keys, "__run")) >= least)).drop("__run")


def wave_events(flags: DataFrame, method: str, station: str, value: str, least: int | None = None, cold: bool = False) -> DataFrame:
    """One row an event: start, end, calendar duration, mean and peak of ``value``, anomalies, severity, id."""
    marked = run_ids(flags, F.col(method), [station], "date").where(F.col(method))
    peak = F.min(value) if cold else F.max(value)
    out = marked.groupBy(station, "run").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("n_days"), F.avg(value).alias("mean_value"), peak.alias("peak_value"), F.avg("anomaly").alias("mean_anomaly"), F.sum("anomaly").alias("total_anomaly")
    ).where(F.col("n_days") >= (least or LEAST[method]))
    out = out.withColumn("duration", F.datediff("end_date", "start_date") + 1).withColumn("severity", F.col("duration") * F.col("mean_anomaly"))
    n = F.row_number().over(Window.partitionBy(station).orderBy("start_date"))
    return out.withColumn("event_id", F.concat_ws("_", F.col(station).cast("string"), F.lit(method), n.cast("string"))).drop("run")


#: What an event of a method is measured by, and against which column of the baseline.
MEASURES = {"WHO": ("tmax", "tmax_p"), "WMO": ("tmax", "tmax_p"), "INMET": ("tmax", "tmax_hist"), "EHF": ("tmean", "tmean"), "UTCI": ("utci_max", "utci_max_p"), "WBGT": ("wbgt_max", "wbgt_max_p"), "HI": ("hi_max", "hi_max_p")}
#: Classes of an event by its peak factor against the 85th percentile of the positive ones.
INTENSITY = ((3.0, "Extreme (EHW)"), (1.0, "Severe (SHW)"))
LOW_INTENSITY = "Low Intensity (LIHW)"


def method_events(waves: DataFrame, station: str, methods: list[str]) -> DataFrame:
    """Events of several methods from ``wave_days``, one row each: ``station, method, event_id, start_date, end_date, duration_days, temp_mean,
    temp_peak, anomaly_mean, anomaly_cumulative, severity_index, ehf_peak, ehf_mean, intensity_class``.

    A run of flagged rows is an event; its anomaly is the method's value less its own level.  Ids number a method's events over all stations by start
    date and station.  Only EHF events have a peak and mean factor and a class: Extreme from three times the 85th percentile of all positive
    factors of the stations with events on, Severe from that percentile on, Low Intensity above 0.  Methods without a column give no events.
    """
    there = [m for m in methods if MEASURES[m][0] in waves.columns]
    forth = Window.partitionBy(station).orderBy("date")
    rows = waves.withColumn("__n", F.row_number().over(forth))
    rows = rows.withColumns({f"__r_{m}": F.when(~F.col(m).eqNullSafe(F.lag(m).over(forth)) | (F.col("__n") == 1), F.col("__n")) for m in there})
    rows = rows.withColumns({f"__r_{m}": F.max(f"__r_{m}").over(forth) for m in there})
    none = F.lit(None).cast("double")
    one = lambda m: F.struct(F.lit(m).alias("method"), F.col(m).alias("flag"), F.col(f"__r_{m}").alias("run"), F.col(MEASURES[m][0]).cast("double").alias("value"), (F.col(MEASURES[m][0]) - F.col(MEASURES[m][1])).cast("double").alias("anomaly"), (F.col("factor") if m == "EHF" else none).alias("factor"))
    marked = rows.select(station, "date", F.explode(F.array(*map(one, there))).alias("e")).where("e.flag").select(station, "date", "e.*")
    out = marked.groupBy(station, "method", "run").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("duration_days"), F.avg("value").alias("temp_mean"), F.max("value").alias("temp_peak"),
        F.avg("anomaly").alias("anomaly_mean"), F.sum("anomaly").alias("anomaly_cumulative"), F.max("factor").alias("ehf_peak"), F.avg("factor").alias("ehf_mean"),
    ).withColumn("severity_index", F.col("duration_days") * F.col("anomaly_mean")).drop("run")
    # the number of a method's events before a day is summed over days, of which there are few, not over events
    per_day = out.groupBy("method", "start_date").agg(F.count("*").alias("n"))
    before = per_day.select("method", "start_date", (F.sum("n").over(Window.partitionBy("method").orderBy("start_date")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("method", "start_date").orderBy(station)) + F.col("before")
    out = out.join(before, ["method", "start_date"]).withColumn("event_id", F.concat_ws("_", F.col(station).cast("string"), "method", nth.cast("string"))).drop("before")
    if "factor" not in waves.columns:
        return out.withColumn("intensity_class", F.lit(None).cast("string"))
    hit = F.max("EHF").over(Window.partitionBy(station))
    high = waves.select("factor", hit.alias("hit")).where("hit and factor > 0").agg(F.percentile("factor", 0.85).alias("p85"))
    share = F.col("ehf_peak") / F.col("p85")
    named = F.when(share >= INTENSITY[0][0], INTENSITY[0][1]).when(share >= INTENSITY[1][0], INTENSITY[1][1]).when(F.col("ehf_peak") > 0, LOW_INTENSITY)
    return out.join(F.broadcast(high)).withColumn("intensity_class", named).drop("p85")  # one row


def wave_summary(events: DataFrame, station: str) -> DataFrame:
    return events.groupBy(station, F.year("start_date").alias("year")).agg(F.count("*").alias("n_events"), F.sum("duration").cast("bigint").alias("total_days"), F.avg("duration").alias("mean_duration"), F.max("peak_value").alias("peak_value"), F.avg("severity").alias("mean_severity"))


def climate_anomaly(observed: DataFrame, normals: DataFrame, station: str, value: str, rule: str = "mean", scale: str = "month") -> DataFrame:
    """Difference, percentage and z-score of monthly (or ten-day) values from the normals: ``station, month[, dekad], normal``."""
    d = F.col("date")
    parts = {"year": F.year(d), "month": F.month(d)} | ({"dekad": F.when(F.dayofmonth(d) <= 10, 1).when(F.dayofmonth(d) <= 20, 2).otherwise(3)} if scale == "dekad" else {})
    keys = [station, *parts]
    seen = observed.withColumns(parts).groupBy(*keys).agg((F.sum if rule == "sum" else F.avg)(value).alias("observed"))
    on = [k for k in keys if k != "year"]
    spread = seen.groupBy(*on).agg(F.stddev_samp("observed").alias("sd"))
    df = seen.join(normals, on, "left").join(spread, on, "left")
    gap = F.col("observed") - F.col("normal")
    return df.withColumns({"anomaly": gap, "anomaly_pct": F.when(F.abs("normal") > 1e-9, 100 * gap / F.col("normal")), "z": F.when(F.col("sd") > 0, gap / F.col("sd"))}).drop("sd")


def thornthwaite(monthly: DataFrame, station: str, temperature: str, hours: float = 12.0) -> DataFrame:
    """Monthly potential evapotranspiration in mm from monthly mean temperatures (``date`` is the month's first day)."""
    months = monthly.groupBy(station, F.month("date").alias("m")).agg(F.avg(temperature).alias("t"))
    index = months.groupBy(station).agg(F.sum(F.pow(F.greatest(F.col("t"), F.lit(0.0)) / 5, 1.514)).alias("i"))
    i = F.col("i")
    a = 6.75e-7 * i * i * i - 7.71e-5 * i * i + 1.792e-2 * i + 0.49239
    days = F.dayofmonth(F.last_day("date"))
    pet = 16 * F.pow(10 * F.col(temperature) / i, a) * days / 30 * hours / 12
    return monthly.join(index, station).withColumn("pet", F.when((F.col(temperature) > 0) & (i > 0), pet).otherwise(0.0)).drop("i")


def hazen_position(monthly: DataFrame, station: str, rain: str, pet: str, scale: int = 3) -> DataFrame:
    """Plotting position (rank - 0.5) / n of the rolling water balance; what the drought index takes to a normal quantile."""
    df = monthly.withColumn("balance", F.col(rain) - F.col(pet))
    df = df.withColumn("rolling", complete_rolling_sum("balance", [station], "date", scale))
    w = Window.partitionBy(station, F.col("rolling").isNull()).orderBy("rolling")
    n = F.count("rolling").over(Window.partitionBy(station))
    return df.withColumn("position", F.when(F.col("rolling").isNotNull(), (F.rank().over(w) - 0.5) / n))


def _long_runs(df: DataFrame, least: dict[str, int], station: str) -> DataFrame:
    """Each flag only in runs of enough rows; one pass forth and one back for all flags: a run's first and last row number."""
    forth, back = Window.partitionBy(station).orderBy("date"), Window.partitionBy(station).orderBy(F.desc("date"))
    new = lambda m, w: ~F.col(m).eqNullSafe(F.lag(m).over(w)) | (F.row_number().over(w) == 1)
    df = df.withColumn("__n", F.row_number().over(forth)).withColumns({f"__s_{m}": F.when(new(m, forth), F.col("__n")) for m in least} | {f"__e_{m}": F.when(new(m, back), F.col("__n")) for m in least})
    df = df.withColumns({f"__s_{m}": F.max(f"__s_{m}").over(forth) for m in least} | {f"__e_{m}": F.min(f"__e_{m}").over(back) for m in least})
    return df.withColumns({m: F.col(m) & (F.col(f"__e_{m}") - F.col(f"__s_{m}") + 1 >= n) for m, n in least.items()}).drop("__n", *[f"__{k}_{m}" for k in "se" for m in least])


def wave_days(days: DataFrame, station: str, methods: list[str], percentile: float = 0.9, least: int | None = None, cold: bool = False, first: str | None = None, last: str | None = None) -> DataFrame:
    """``days`` with each method's flag, the levels of the baseline that they are held against, and the factor of EHF or ECF.

    ``days``: one row a station and day with tmax, tmin, tmean, and ``utci_max``, ``wbgt_max`` or ``hi_max`` for the methods on
    these indices; where such a column is missing, its method's flag is null.  All levels are taken from the days of the baseline period alone (all days, if none is
    given), in one aggregation, and meet the days in one join; flags hold only in runs of ``least`` rows, or the method's own number.
    """
    indices = {m: f"{m.lower()}_max" for m in methods if m in INDEX_METHODS}
    there = tuple(c for c in indices.values() if c in days.columns)
    out = wave_flags(days, day_baseline(days, station, 1 - percentile if cold else percentile, first=first, last=last, more=there), station, cold)
    factor = "ECF" if cold else "EHF"
    if factor in methods:
        out = excess_heat(out, station, cold).drop("t3", "t30", "limit")
    for method, index in indices.items():
        out = out.withColumn(method, F.coalesce(F.col(index) > F.col(f"{index}_p"), F.lit(False)) if index in there else F.lit(None).cast("boolean"))
    if unknown := [m for m in methods if m not in out.columns]:
        raise ValueError(f"unknown methods: {', '.join(unknown)}")
    return _long_runs(out, {m: least or LEAST[m] for m in methods if indices.get(m, "tmax") in days.columns}, station)


def waves(days: DataFrame, station: str, methods: list[str], percentile: float = 0.9, least: int | None = None, cold: bool = False, first: str | None = None, last: str | None = None) -> DataFrame:
    """``wave_days`` without the baseline's levels, and ``any`` of the methods' flags."""
    out = wave_days(days, station, methods, percentile, least, cold, first, last)
    out = out.drop("doy", "tmax_hist", "tmin_hist", *[c for c in out.columns if c.endswith("_p")])
    return out.drop(*[m for m in ("WHO", "WMO", "INMET") if m not in methods]).withColumn("any", F.coalesce(F.array_max(F.array(*methods)), F.lit(False)))


def active_days(flags: DataFrame, method: str, station: str) -> DataFrame:
    """Days of each station on which the method's flag holds, per year."""
    return flags.where(F.col(method)).groupBy(station, F.year("date").alias("year")).agg(F.count("*").alias("n_days"), F.min("date").alias("first"), F.max("date").alias("last"))


#: Coefficients of the normal quantile's rational approximation.
_QUANTILE = (
    (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239),
    (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0),
    (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783),
    (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0),
)


def _poly(k: tuple[float, ...], x):
    out = F.lit(k[0]) if isinstance(x, Column) else k[0]
    for v in k[1:]:
        out = out * x + v
    return out


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile by a rational approximation (relative error under 1.2e-9)."""
    a, b, c, d = _QUANTILE
    q = p - 0.5
    r = q * q
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    return F.when(p < 0.02425, _poly(c, low) / _poly(d, low)).when(p <= 1 - 0.02425, q * _poly(a, r) / _poly(b, r)).otherwise(-_poly(c, high) / _poly(d, high))


def normal_quantile_of(p: float) -> float:
    """``normal_quantile`` of a number."""
    a, b, c, d = _QUANTILE
    if 0.02425 <= p <= 1 - 0.02425:
        q = p - 0.5
        return q * _poly(a, q * q) / _poly(b, q * q)
    tail = math.sqrt(-2 * math.log(p if p < 0.5 else 1 - p))
    return (1 if p < 0.5 else -1) * _poly(c, tail) / _poly(d, tail)


def drought_spei(monthly: DataFrame, station: str, rain: str, pet: str, scale: int = 3, first: str | None = None, last: str | None = None, least: int = 24) -> DataFrame:
    """Standardised rolling water balance: its Hazen position among the calibration months, as a normal quantile.

    A value's rank is the number of calibration values up to it; calibration months are those from ``first`` to ``last`` (all, if not given),
    and a station with fewer than ``least`` of them gets nulls.
    """
    df = monthly.withColumn("balance", F.col(rain) - F.col(pet))
    df = df.withColumn("rolling", complete_rolling_sum("balance", [station], "date", scale))
    inside = F.col("rolling").isNotNull()
    if first:
        inside = inside & (F.col("date") >= F.lit(first).cast("date"))
    if last:
        inside = inside & (F.col("date") <= F.lit(last).cast("date"))
    upto = Window.partitionBy(station).orderBy("rolling").rangeBetween(Window.unboundedPreceding, 0)
    rank = F.sum(inside.cast("int")).over(upto)
    n = F.sum(inside.cast("int")).over(Window.partitionBy(station))
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), (rank - 0.5) / n))
    return df.withColumn("spei", F.when(F.col("rolling").isNotNull() & (n >= least), normal_quantile(p)))


def drought_class(index: Column) -> Column:
    """Class of a standardised drought index."""
    return F.when(index <= -2, "extremely dry").when(index <= -1.5, "severely dry").when(index <= -1, "moderately dry").when(index < 1, "near normal").when(index < 1.5, "moderately wet").when(index < 2, "very wet").when(index.isNotNull(), "extremely wet")
