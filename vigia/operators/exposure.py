"""Exposure windows: climate series joined to health rows by ten temporal strategies.

Climate is first one row a key and day.  Every windowed strategy then is one pass of a range frame over the key's days: the
days that health rows have and the climate days are united, the frame runs over the day number, and health rows join by key and
day, so that a large place's rows never lie in one task.  No range join, no explosion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import circular_mean

MIN_SHARE = 0.7
RULES = {"rainfall_mm": "sum", "sr_kj_m2": "sum", "wd_degrees": "circular"}


def daily(climate: DataFrame, key: str, date: str, variables: list[str], rules: dict[str, str] | None = None) -> DataFrame:
    """One row a key and day: sums for rain and radiation, circular mean for wind direction, else means."""
    rules = RULES | (rules or {})
    pick = lambda v: {"sum": F.sum, "circular": circular_mean}.get(rules.get(v, "mean"), F.avg)(F.col(v))
    return climate.groupBy(key, F.col(date).cast("date").alias("date")).agg(*[pick(v).alias(v) for v in variables])


def _over_days(health: DataFrame, climate: DataFrame, key: str, value: str, make: Callable[[Window], dict[str, Column]], start: int, end: int) -> DataFrame:
    """Columns of ``make`` for each health row, from the climate days start..end relative to its date.

    ``climate``: one row a key and day.  Health rows may share key and day; they carry a null value.
    """
    health = health.withColumn("date", F.col("date").cast("date"))
    wanted = health.select(key, "date").distinct().select(key, "date", F.lit(True).alias("__keep"), F.lit(None).cast("double").alias("__x"))
    known = climate.where(F.col(value).isNotNull()).select(key, "date", F.lit(False).alias("__keep"), F.col(value).cast("double").alias("__x"))
    frame = Window.partitionBy(key).orderBy(F.unix_date("date")).rangeBetween(start, end)
    days = wanted.unionByName(known).withColumns(make(frame)).where("__keep").select(key, "date", *make(frame))
    return health.join(days, [key, "date"], "left")


def _guarded(x: Column, n: Column, size: int, share: float) -> Column:
    return F.when(n / size >= share, x)


def exact(health: DataFrame, climate: DataFrame, key: str, value: str) -> DataFrame:
    return health.join(climate.select(key, "date", value), [key, "date"], "left")


def discrete_lag(health: DataFrame, climate: DataFrame, key: str, value: str, lag: int) -> DataFrame:
    moved = climate.select(key, F.date_add("date", lag).alias("date"), F.col(value).alias(f"lag{lag}_{value}"))
    return health.join(moved, [key, "date"], "left")


def distributed_lag(health: DataFrame, climate: DataFrame, key: str, value: str, lags: int) -> DataFrame:
    """Columns ``<value>_lag0`` to ``<value>_lag<lags>``, from one pass over the days (sum of the one value at that distance)."""
    frame = Window.partitionBy(key).orderBy(F.unix_date("date"))
    days = climate.where(F.col(value).isNotNull()).select(key, "date", value)
    wanted = health.select(key, F.col("date").cast("date").alias("date")).distinct().withColumn("__h", F.lit(True)).join(days, [key, "date"], "full")
    out = {f"{value}_lag{k}": F.max(value).over(frame.rangeBetween(-k, -k)) for k in range(lags + 1)}
    table = wanted.withColumns(out).where("__h").select(key, "date", *out)
    return health.join(table, [key, "date"], "left")


def moving_window(health: DataFrame, climate: DataFrame, key: str, value: str, days: int, share: float = MIN_SHARE) -> DataFrame:
    """Mean of the last ``days`` days and the day itself, if enough of them have a value."""
    return _over_days(health, climate, key, value, lambda w: {f"{value}_mean_w{days}": _guarded(F.avg("__x").over(w), F.count("__x").over(w), days + 1, share)}, -days, 0)


def offset_window(health: DataFrame, climate: DataFrame, key: str, value: str, near: int, far: int, rule: str = "mean", share: float = MIN_SHARE) -> DataFrame:
    """Sum or mean of the days ``far`` to ``near`` days before."""
    pick = F.sum if rule == "sum" else F.avg
    return _over_days(health, climate, key, value, lambda w: {f"off{near}to{far}_{value}": _guarded(pick("__x").over(w), F.count("__x").over(w), far - near + 1, share)}, -far, -near)


def degree_days(health: DataFrame, climate: DataFrame, key: str, value: str, days: int, base: float, share: float = MIN_SHARE) -> DataFrame:
    name = f"gdd_w{days}tbase{base:g}"
    return _over_days(health, climate, key, value, lambda w: {name: _guarded(F.sum(F.greatest(F.col("__x") - base, F.lit(0.0))).over(w), F.count("__x").over(w), days + 1, share)}, -days, 0)


def exceedance(health: DataFrame, climate: DataFrame, key: str, value: str, days: int, threshold: float, above: bool = True, share: float = MIN_SHARE, cold: bool = False) -> DataFrame:
    """Number and share of the valid days beyond the threshold; for cold waves, the days below it."""
    beyond = (F.col("__x") > threshold) if above and not cold else (F.col("__x") < threshold)
    tag = f"{threshold:g}".replace(".", "p")
    names = (f"ncold{days}_lt{tag}_{value}", f"pcold{days}_lt{tag}_{value}") if cold else tuple(f"{k}exc{days}_{'gt' if above else 'lt'}{tag}_{value}" for k in "np")

    def make(w: Window) -> dict[str, Column]:
        n, hits = F.count("__x").over(w), F.sum(beyond.cast("int")).over(w)
        return {names[0]: _guarded(hits, n, days + 1, share), names[1]: _guarded(F.round(hits / n, 4), n, days + 1, share)}

    return _over_days(health, climate, key, value, make, -days, 0)


def weighted_window(health: DataFrame, climate: DataFrame, key: str, value: str, weights: list[float] | None = None, days: int = 7, rule: str = "mean", share: float = MIN_SHARE) -> DataFrame:
    """Weighted mean (or sum) by lag; without ``weights`` they fall evenly from 1 to 0.1."""
    weights = weights or [1 - 0.9 * k / days for k in range(days + 1)]
    lagged = distributed_lag(health, climate, key, value, len(weights) - 1)
    cols = [F.col(f"{value}_lag{k}") for k in range(len(weights))]
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in zip(cols, weights, strict=True)), F.lit(0.0))
    mass = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in zip(cols, weights, strict=True)), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    out = top if rule == "sum" else top / mass
    return lagged.select(*health.columns, _guarded(out, n, len(weights), share).alias(f"wwin{len(weights) - 1}_{value}"))


def seasonal(health: DataFrame, climate: DataFrame, key: str, value: str, least_days: int = 60) -> DataFrame:
    """Mean of the calendar year's season that the row lies in (December counts with its own year), from ``least_days`` valid days."""
    season = lambda d: F.element_at(F.array(*map(F.lit, ("DJF", "MAM", "JJA", "SON"))), (F.floor((F.month(d) % 12) / 3) + 1).cast("int"))
    means = climate.groupBy(key, F.year("date").alias("__y"), season(F.col("date")).alias("__s")).agg(F.avg(value).alias(f"season_{value}"), F.count(value).alias("__n")).where(F.col("__n") >= least_days).drop("__n")
    return health.withColumns({"__y": F.year("date"), "__s": season(F.col("date"))}).join(means, [key, "__y", "__s"], "left").drop("__y", "__s")


#: Strategies by name, with the arguments that each needs.
STRATEGIES = {
    "exact": (exact, ()), "discrete_lag": (discrete_lag, ("lag",)), "distributed_lag": (distributed_lag, ("lags",)), "moving_window": (moving_window, ("days",)), "offset_window": (offset_window, ("near", "far")),
    "degree_days": (degree_days, ("days", "base")), "seasonal": (seasonal, ()), "threshold_exceedance": (exceedance, ("days", "threshold")), "weighted_window": (weighted_window, ()), "cold_wave_exceedance": (exceedance, ("days", "threshold")),
}


def join_climate(health: DataFrame, climate: DataFrame, key: str, date: str, variables: list[str], strategy: str = "exact", stations: DataFrame | None = None, rules: dict[str, str] | None = None, **options) -> DataFrame:
    """Climate joined to health rows by a named strategy, one variable after the other.

    ``climate``: rows of places and times, or of stations if ``stations`` (``key, station``: each place's station) is given; it is made a row
    a place and day first.  ``options`` go to the strategy.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}; one of {', '.join(STRATEGIES)}")
    run, needed = STRATEGIES[strategy]
    if missing := [n for n in needed if n not in options]:
        raise ValueError(f"{strategy} needs {', '.join(missing)}")
    if strategy == "cold_wave_exceedance":
        options["cold"] = True
    if stations is not None:
        climate = climate.join(stations.select(key, "station").distinct(), "station")
    days = daily(climate, key, date, variables, rules)
    for v in variables:
        health = run(health, days.select(key, "date", v), key, v, **options)
    return health
