"""Gridded sources as tables: unit conversions, merges of variables, events and points per municipality."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import outer_merge
from .spatial import points_in_polygons

#: Reanalysis variables: output column, factor and offset, aggregate over the day.
REANALYSIS = {
    "t2m": ("tair_dry_bulb_c", 1.0, -273.15, "mean"), "t2m_max": ("tair_max_c", 1.0, -273.15, "max"), "t2m_min": ("tair_min_c", 1.0, -273.15, "min"), "td2m": ("dew_point_c", 1.0, -273.15, "mean"),
    "u10": ("ws_10m_u_m_s", 1.0, 0.0, "mean"), "v10": ("ws_10m_v_m_s", 1.0, 0.0, "mean"), "sp": ("patm_hpa", 0.01, 0.0, "mean"), "tp": ("rainfall_mm", 1000.0, 0.0, "sum"),
}
#: Pollutants that come by the year only, and those that come by the day.
ANNUAL_ONLY, DAILY = ("o3", "co"), ("pm25",)


def convert_reanalysis(df: DataFrame) -> DataFrame:
    """Variables in their standard units and names; unknown columns stay."""
    known = {c: spec for c, spec in REANALYSIS.items() if c in df.columns}
    return df.select(*[c for c in df.columns if c not in known], *[(F.col(c) * f + o).alias(name) for c, (name, f, o, _) in known.items()])


def valid_rain(x: Column) -> Column:
    """Fill values under -999 are missing."""
    return F.when(x >= -999, x)


def merge_pollutants(frames: dict[str, DataFrame], years: list[int] | None = None) -> DataFrame:
    """One panel of several pollutants: ``code_muni, date`` and a column each; the year filter runs before the joins."""
    parts = []
    for name, df in frames.items():
        df = df.where(F.year("date").isin(years)) if years else df
        parts.append(df.select("code_muni", "date", F.col("value").alias(name)))
    return outer_merge(parts, ["code_muni", "date"])


def flash_droughts(events: DataFrame, unit: str = "year") -> DataFrame:
    """Events (code_muni, fstdate, lstdate, sv) per municipality and year or month of their first day."""
    spent = events.withColumns({"date": F.trunc("fstdate", unit), "days": F.datediff("lstdate", "fstdate") + 1})
    return spent.groupBy("code_muni", "date").agg(F.count("*").alias("n_fd_events"), F.coalesce(F.sum("days"), F.lit(0)).cast("bigint").alias("fd_total_days"), F.avg("sv").alias("fd_mean_severity"), F.max("sv").alias("fd_max_severity"))


def fires_by_municipality(fires: DataFrame, polygons: DataFrame) -> DataFrame:
    """Fire points (id, x, y, date, frp) counted per polygon and day, with their mean radiative power."""
    place = points_in_polygons(fires, polygons, "id", "code_muni")
    return fires.join(place, "id").groupBy("code_muni", "date").agg(F.count("*").alias("n_fires"), F.avg("frp").alias("frp_mean"))


def cleared_area(overlaps: DataFrame) -> DataFrame:
    """Cleared area (code_muni, year, biome, uid, km2 of overlap) per municipality, year and biome."""
    return overlaps.groupBy("code_muni", "year", "biome").agg(F.sum("km2").alias("area_km2"), F.countDistinct("uid").alias("n_polygons"))


#: Approximate Köppen zones.  States (none: all), bounds of latitude and longitude (over, under; the equator side of -23 and -15 is
#: included where marked), zone.  The first row that fits counts.
ZONES = (
    ((22, 23, 24, 25, 26, 27), {"lat>": -12, "lon>": -45}, "BSh"),
    ((41, 42, 43), {"lat<": -23}, "Cf"),
    ((33,), {"lon>": -44}, "Cf"),
    ((31, 32, 35, 52, 53), {"lat<": -15}, "Cw"),
    ((41, 42, 43), {"lat>=": -23}, "Cw"),
    ((11, 12, 14, 17, 21, 50, 51, 52, 53), {}, "Aw"),
    ((31, 35), {"lat>=": -15}, "Aw"),
    ((29,), {"lat>": -14}, "Aw"),
    ((21, 22, 26, 27, 28, 29), {"lon>": -40}, "As"),
    ((13, 15, 16), {}, "Am"),
    ((11, 12, 14, 16), {"lat>": -5}, "Af"),
    ((), {"lat>": -23}, "Aw"),
    ((), {}, "Cf"),
)


def climate_zone(state: Column, lat: Column, lon: Column) -> Column:
    """Approximate Köppen zone by state code and coordinates: the first row of ZONES that fits; a missing value fits no bound."""
    value, compare = {"lat": lat, "lon": lon}, {">": operator.gt, "<": operator.lt, ">=": operator.ge}
    out = F.lit(None).cast("string")
    for states, bounds, zone in reversed(ZONES):
        fits = [state.isin(*states)] if states else []
        fits += [compare[name[3:]](value[name[:3]], bound) for name, bound in bounds.items()]
        out = F.when(reduce(operator.and_, fits), zone).otherwise(out) if fits else F.lit(zone)
    return out


def zone_by_area(overlaps: DataFrame, key: str = "code_muni") -> DataFrame:
    """Zone that covers most of each place: ``overlaps`` has the key, zone and km2; ties go to the first name."""
    area = overlaps.groupBy(key, "zone").agg(F.sum("km2").alias("km2"))
    return area.groupBy(key).agg(F.min_by("zone", F.struct(-F.col("km2"), "zone")).alias("zone"), F.sum("km2").alias("area_km2"))


def available_resolution(pollutant: str, wanted: str) -> str:
    """The wanted resolution, or annual where the pollutant has no finer one."""
    if pollutant in ANNUAL_ONLY and wanted in ("monthly", "daily"):
        return "annual"
    return "annual" if wanted == "daily" and pollutant not in DAILY else wanted


def pollutant_panel(panels: dict[tuple[str, str], DataFrame], pollutants: list[str], resolution: str) -> DataFrame:
    """``code_muni, date, pollutant, value, resolution``: each pollutant at the wanted resolution or the one it has.

    ``panels``: {(pollutant, resolution): table with code_muni, date, value}; an annual value stands on the year's first day.
    """
    parts = []
    for name in pollutants:
        at = available_resolution(name, resolution)
        if (name, at) in panels:
            parts.append(panels[name, at].select("code_muni", F.col("date").cast("date").alias("date"), F.lit(name).alias("pollutant"), F.col("value").cast("double").alias("value"), F.lit(at).alias("resolution")))
    if not parts:
        raise ValueError("none of the pollutants has a panel at its resolution")
    return union_sources(parts)


def drought_severity(cells: DataFrame, weights: DataFrame, cell: str = "cell", zone: str = "code_muni") -> DataFrame:
    """Monthly Palmer index per municipality: the covered cells' weighted mean, and its class."""
    from .spatial import zonal_mean

    x = F.col("pdsi")
    grade = F.when(x <= -4, "extreme drought").when(x <= -3, "severe drought").when(x <= -2, "moderate drought").when(x <= -1, "mild drought").when(x < 1, "normal").when(x < 2, "slightly wet").when(x < 3, "moderately wet").when(x < 4, "very wet").otherwise("extremely wet")
    return zonal_mean(cells, weights, cell, zone, "pdsi", ["date"]).withColumn("class", F.when(x.isNotNull(), grade))


def daily_reanalysis(hourly: DataFrame, key: str = "code_muni", timestamp: str = "ts") -> DataFrame:
    """Hourly variables in standard units, rolled up by each one's rule to a row a place and day."""
    from .aggregate import roll_up_hours

    rules = {name: rule for source, (name, _, _, rule) in REANALYSIS.items() if source in hourly.columns}
    return roll_up_hours(convert_reanalysis(hourly), [key], timestamp, rules)


def coverage_ratio(health: DataFrame, grid: DataFrame, date: str = "date") -> DataFrame:
    """Share of the health table's days that the grid has."""
    days = health.select(F.col(date).cast("date").alias("d")).distinct()
    there = grid.select(F.col(date).cast("date").alias("d"), F.lit(1).alias("hit")).distinct()
    return days.join(there, "d", "left").agg((F.count("hit") / F.count("*")).alias("coverage"))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
