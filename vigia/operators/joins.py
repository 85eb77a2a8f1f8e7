"""Joins of records with municipalities, census, grids and stations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import fold
from ..functions.stats import aggregate, haversine_km
from ..functions.storage import cut


def spatial_key_join(df: DataFrame, places: DataFrame, key: str, place_key: str) -> DataFrame:
    """Inner join on the first six digits of the codes."""
    six = lambda c: F.substring(F.col(c).cast("string"), 1, 6)
    return df.withColumn("__k", six(key)).join(places.withColumn("__k", six(place_key)), "__k").drop("__k")


def zip_join(df: DataFrame, zips: DataFrame, key: str = "zip_code", order: list[str] | None = None) -> DataFrame:
    """Left join on the eight-digit zip code with the first match (by ``order``, else by all columns) of each code."""
    pad = F.lpad(F.regexp_replace(F.col(key).cast("string"), "[^0-9]", ""), 8, "0")
    one = zips.withColumn("__zip", pad)
    one = one.withColumn("__n", F.row_number().over(Window.partitionBy("__zip").orderBy(*(order or zips.columns)))).where("__n = 1").drop("__n", key)
    return df.withColumn("__zip", pad).join(one, "__zip", "left").drop("__zip")


def census_join(df: DataFrame, census: DataFrame, key: str, fun: str = "sum", variables: list[str] | None = None) -> DataFrame:
    """Left join of census variables aggregated per municipality; columns are called ``<variable>_<fun>``."""
    numeric = [c for c, t in census.dtypes if c != key and t in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    values = census.groupBy(key).agg(*[aggregate(fun, F.col(v)).alias(f"{v}_{fun}") for v in variables or numeric])
    return df.join(values, key, "left")


def grid_join(df: DataFrame, grid: DataFrame, by: tuple[str, ...] = ("code_muni", "date")) -> DataFrame:
    """Left join of a grid panel; a value column whose name is taken gets the suffix ``_grid``."""
    taken = set(df.columns) - set(by)
    return df.join(grid.withColumnsRenamed({c: f"{c}_grid" for c in grid.columns if c in taken}), list(by), "left")


def outer_merge(frames: list[DataFrame], by: list[str]) -> DataFrame:
    """Full join of several panels on their keys."""
    return reduce(lambda a, b: a.join(b, by, "full"), frames)


def upsert(base: DataFrame, patch: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Values of ``patch`` where it has them, else those of ``base``."""
    new = patch.select(*by, *[F.col(c).alias(f"__{c}") for c in columns])
    return base.join(new, by, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


#: Sides in degrees of the cells of the station search, from near to far: the last one's neighbours are the whole globe.
CELLS = (5, 15, 45, 180)
_KM_A_DEGREE = 111.19


def _nearest(places: DataFrame, stations: DataFrame, place: str, station: str, k: int, within_km: float | None = None) -> DataFrame:
    """``place, station, distance_km, nth``: the k nearest stations of each place, ties to the smaller key.

    Places and stations meet in cells and the eight around them (across the date line too).  A place is done when its k-th station is nearer than anything beyond these cells
    can be: the cells' side along the meridian, or the arc to the meridian a side away.  Only the others go on to larger cells; each round's result is written to the shared folder.
    """
    s = stations.select(F.col(station).alias("__s"), F.col("lat").cast("double").alias("lat_s"), F.col("lon").cast("double").alias("lon_s"))
    left = places.select(F.col(place).alias("__p"), F.col("lat").cast("double").alias("lat_p"), F.col("lon").cast("double").alias("lon_p"))
    key, done = ["__p", "lat_p", "lon_p"], []
    for side in CELLS:
        n, last = 360 // side, side == CELLS[-1]
        column = lambda lon, side=side, n=n: F.pmod(F.floor((F.col(lon) + 180) / side), F.lit(n))
        around = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in ((-1, 0, 1) if n > 2 else (0, 1)) for y in (-1, 0, 1)]
        own = s.withColumns({"cx": column("lon_s"), "cy": F.floor((F.col("lat_s") + 90) / side)})
        near = left.withColumn("d", F.explode(F.array(*around))).withColumns({"cx": F.pmod(column("lon_p") + F.col("d.x"), F.lit(n)), "cy": F.floor((F.col("lat_p") + 90) / side) + F.col("d.y")}).drop("d")
        pairs = near.join(own, ["cx", "cy"]).withColumn("km", F.round(haversine_km(F.col("lat_p"), F.col("lon_p"), F.col("lat_s"), F.col("lon_s")), 6))
        if within_km is not None:
            pairs = pairs.where(F.col("km") <= within_km)
        best = pairs.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("km", "__s"))).where(F.col("nth") <= k).select(*key, "__s", "km", "nth")
        best = cut(best)
        if last:
            done.append(best)
            break
        arc = F.degrees(F.asin(F.cos(F.radians("lat_p")) * F.sin(F.radians(F.lit(float(side))))))
        safe = F.least(F.lit(float(side)), arc) * (_KM_A_DEGREE - 0.01)
        enough = (F.col("nth") == k) & (F.col("km") <= safe)
        sure = best.where(enough).select(*key)
        if within_km is not None:
            sure = sure.unionByName(left.where(safe >= within_km).select(*key))
        sure = sure.distinct()
        done.append(best.join(sure, key, "left_semi"))
        left = cut(left.join(sure, key, "left_anti"))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, done).select(F.col("__p").alias(place), F.col("__s").alias(station), F.col("km").alias("distance_km"), "nth")


def nearest_station(places: DataFrame, stations: DataFrame, place: str, station: str) -> DataFrame:
    """Nearest station of each place: ``place, station, distance_km``; both tables have lat and lon, ties go to the smaller key.  Places without coordinates have no row."""
    return _nearest(places, stations, place, station, 1).drop("nth")


def station_missing_share(df: DataFrame, station: str, variables: list[str]) -> DataFrame:
    """Share of missing values of each variable per station."""
    return df.groupBy(station).agg(*[F.avg(F.col(v).isNull().cast("double")).alias(f"missing_{v}") for v in variables])


def level_join(df: DataFrame, places: DataFrame, levels: DataFrame, key: str, level: str) -> DataFrame:
    """Records with the area of a level (semi-arid, metropolitan, health region, biome ...) that their municipality belongs to.

    ``levels``: ``code_muni, level`` and the area's columns, one or more rows a municipality (a municipality in two areas gives two rows).  The
    join is inner on the first six digits, after ``places`` (if any) has added the municipality's own columns.
    """
    wanted = levels.where(F.lower("level") == level.lower())
    out = spatial_key_join(df, places.drop("level"), key, "code_muni").drop("code_muni") if places is not None else df
    return spatial_key_join(out, wanted.drop("level"), key, "code_muni").drop("code_muni")


def level_join_by_name(df: DataFrame, areas: DataFrame, name: str, state: str, area_name: str = "name", area_state: str = "state") -> DataFrame:
    """Records with the areas (schools, indigenous lands) of their municipality's name and state; inner.

    Names are compared without accents, case and outer blanks, states in upper case.  An area in several municipalities has a row each; columns of the areas that the
    records have too get the prefix ``area_``.
    """
    keys = lambda n, s: {"__n": fold(F.col(n)), "__s": F.upper(F.trim(F.col(s)))}
    taken = {c.lower() for c in df.columns}
    own = areas.withColumns(keys(area_name, area_state)).drop(area_name, area_state)
    own = own.withColumnsRenamed({c: f"area_{c}" for c in own.columns if c.lower() in taken})
    return df.withColumns(keys(name, state)).join(own, ["__n", "__s"]).drop("__n", "__s")


def facility_join(df: DataFrame, facilities: DataFrame, key: str = "facility_code") -> DataFrame:
    """Left join on the seven-digit facility code with the latest row of each facility (by ``update_date`` where there is one)."""
    pad = lambda c: F.lpad(F.regexp_replace(F.col(c).cast("string"), "[^0-9]", ""), 7, "0")
    order = [F.desc("update_date")] if "update_date" in facilities.columns else []
    one = facilities.withColumn("__f", pad(key))
    one = one.withColumn("__n", F.row_number().over(Window.partitionBy("__f").orderBy(*order, *[c for c in facilities.columns if c != key]))).where("__n = 1").drop("__n", key)
    return df.withColumn("__f", pad(key)).join(one, "__f", "left").drop("__f")


def station_quality(df: DataFrame, station: str, variables: list[str], how: str = "any") -> DataFrame:
    """Share of known values of each station: of rows with any of the variables, with all of them, or the mean over the variables."""
    known = [F.col(v).isNotNull() for v in variables]
    rule = {"any": lambda: F.avg(reduce(lambda a, b: a | b, known).cast("double")), "all": lambda: F.avg(reduce(lambda a, b: a & b, known).cast("double")), "mean": lambda: reduce(lambda a, b: a + b, [F.avg(k.cast("double")) for k in known]) / len(known)}
    if how not in rule:
        raise ValueError(f"unknown rule: {how}; one of any, all, mean")
    return df.groupBy(station).agg(rule[how]().alias("quality"))


def match_stations(places: DataFrame, stations: DataFrame, quality: DataFrame, place: str, station: str, k: int = 3, least: float = 0.7, within_km: float | None = None) -> DataFrame:
    """The ``k`` nearest stations of good quality of each place: ``place, station, distance_km, quality, nth``.

    Stations whose share of known values is under ``least`` are left out; the others are searched as by ``nearest_station``, so that a place meets the
    stations near it alone.
    """
    good = quality.where(F.col("quality") >= least).select(station, "quality")
    found = _nearest(places, stations.join(good, station, "left_semi"), place, station, k, within_km)
    return found.join(good, station).select(place, station, "distance_km", "quality", "nth")


def recover_coordinates(df: DataFrame, stations: DataFrame, station: str) -> DataFrame:
    """Missing or impossible coordinates replaced by the station table's (one row a station: the mean of valid ones)."""
    valid = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    known = stations.where(valid).groupBy(station).agg(F.avg("lat").alias("__lat"), F.avg("lon").alias("__lon"))
    keep = F.coalesce(valid, F.lit(False))
    out = df.join(known, station, "left")
    return out.withColumns({"lat": F.when(keep, F.col("lat")).otherwise(F.col("__lat")), "lon": F.when(keep, F.col("lon")).otherwise(F.col("__lon"))}).drop("__lat", "__lon")
