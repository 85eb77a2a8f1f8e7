"""Reading and writing record tables, station files and panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions (with common slips) and the reader for each.
FORMATS = {"parquet": "parquet", "parq": "parquet", "pq": "parquet", "csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "jsonl": "json", "geojson": "json", "orc": "orc"}
#: Columns of a station file in order, after date and hour.
STATION_COLUMNS = ("rainfall_mm", "patm_mb", "patm_max_mb", "patm_min_mb", "sr_kj_m2", "tair_dry_bulb_c", "dew_tmean_c", "tair_max_c", "tair_min_c", "dew_tmax_c", "dew_tmin_c", "rh_max_porc", "rh_min_porc", "rh_mean_porc", "wd_degrees", "ws_gust_m_s", "ws_2_m_s")


#: Names of the months in climate normals, without accents.
MONTHS = {"janeiro": 1, "fevereiro": 2, "marco": 3, "abril": 4, "maio": 5, "junho": 6, "julho": 7, "agosto": 8, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12}


def read_records(spark: SparkSession, paths: str | list[str], kind: str | None = None, sep: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Tables of one or more files, united by column name; the format comes from the extension if not given.

    CSV columns are text.  ``sep`` is the separator (default comma, a tab for .tsv), ``encoding`` the files' (ISO-8859-1 for Latin-1).
    """
    frames = []
    for path in [paths] if isinstance(paths, str) else paths:
        end = path.rstrip("/").rpartition(".")[2].lower()
        use = kind or FORMATS.get(end)
        if use is None:
            raise ValueError(f"unknown format of {path}")
        reader = spark.read
        if use == "csv":
            reader = reader.option("header", True).option("sep", sep or ("\t" if end == "tsv" else ",")).option("encoding", encoding).option("inferSchema", False)
        frames.append(reader.format(use).load(path))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_records(df: DataFrame, path: str, kind: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Write as parquet (zstd), csv (header, empty for null), json or orc; partitioned if asked."""
    if kind not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"unknown format: {kind}")
    writer = df.write.mode(mode)
    writer = writer.option("compression", "zstd") if kind == "parquet" else writer
    writer = writer.option("header", True).option("nullValue", "").option("emptyValue", "") if kind == "csv" else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(path)


def read_national(spark: SparkSession, root: str, system: str, states: list[str] | None = None, years: list[int] | None = None, months: list[int] | None = None) -> DataFrame:
    """Records under ``root/system=.../uf=.../year=.../month=...``; the conditions prune folders before any file is read."""
    df = spark.read.parquet(root).where(F.col("system") == system)
    for column, wanted in (("uf", states), ("year", years), ("month", months)):
        if wanted:
            df = df.where(F.col(column).isin(wanted))
    return df


def read_station_files(spark: SparkSession, path: str) -> DataFrame:
    """Hourly station files: eight lines of ``key:;value``, a heading, then rows with decimal commas and -9999 for missing.

    A file is one station and one year, so it is read whole (Latin-1); files are spread over the tasks.
    """
    text = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "ISO-8859-1").alias("t"))
    lines = F.split("t", "\r?\n")
    value = lambda n: F.trim(F.element_at(F.split(F.get(lines, F.lit(n)), ";"), 2))
    number = lambda c: F.nullif(F.regexp_replace(F.trim(c), ",", ".").try_cast("double"), F.lit(-9999.0))
    head = text.select(value(0).alias("region"), value(1).alias("UF"), value(2).alias("station_name"), value(3).alias("station_code"), number(value(4)).alias("latitude"), number(value(5)).alias("longitude"), number(value(6)).alias("altitude"), F.slice(lines, 10, F.greatest(F.lit(0), F.size(lines) - 9)).alias("rows"))
    rows = head.withColumn("r", F.explode("rows")).where(F.trim("r") != "").withColumn("c", F.split("r", ";"))
    date = F.regexp_replace(F.get("c", F.lit(0)), "/", "-")
    hour = F.lpad(F.regexp_extract(F.get("c", F.lit(1)), "([0-9]{1,4})", 1), 4, "0")
    when = F.try_to_timestamp(F.concat_ws(" ", date, F.substring(hour, 1, 2)), F.lit("yyyy-MM-dd HH"))
    cells = [number(F.get("c", F.lit(i + 2))).alias(name) for i, name in enumerate(STATION_COLUMNS)]
    return rows.select(when.alias("date"), *cells, "region", "UF", "station_code", "station_name", F.year(when).alias("year"), "latitude", "longitude", "altitude")


def rain_gauges(data: DataFrame, gauges: DataFrame, years: list[int] | None = None, states: list[str] | None = None, to: str = "day") -> DataFrame:
    """Gauge readings with their station, summed by hour, day, month or year."""
    df = data.join(gauges, "gauge_code", "left")
    if years:
        df = df.where(F.year("datetime").isin(years))
    if states:
        df = df.where(F.col("state").isin(states))
    return df.groupBy("gauge_code", "city", "state", "lat", "long", F.date_trunc(to, "datetime").alias("date")).agg(F.sum("rain_mm").alias("rainfall_mm"))


def normals_long(wide: DataFrame, code: str, variable: str) -> DataFrame:
    """Columns ``<month>_<decade>`` to rows ``codigo, mes, decada, valor, var_code``."""
    values = [c for c in wide.columns if c != code]
    long = wide.unpivot([code], values, "__k", "valor")
    parts = F.split("__k", "_")
    return long.select(F.col(code).alias("codigo"), F.get(parts, F.lit(0)).alias("mes"), F.get(parts, F.lit(1)).try_cast("int").alias("decada"), "valor", F.lit(variable).alias("var_code"))


def particulate_matter(df: DataFrame) -> DataFrame:
    """PM2.5 in µg/m³ from aerosol mass fractions in kg/m³."""
    return df.withColumn("pm25", (F.col("dust") + F.col("sea_salt") + F.col("black_carbon") + 1.4 * F.col("organic_carbon") + F.col("sulfate")) * 1e9)


def numbered_months(normals: DataFrame) -> DataFrame:
    """Normals (``codigo, mes, decada, valor, var_code``) with the month's number for its name; yearly rows (no month) are left out."""
    from ..functions.codes import fold

    table = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    month = F.coalesce(F.col("mes").cast("string").try_cast("int"), F.try_element_at(table, fold(F.col("mes"))))
    return normals.withColumn("mes", month).where(F.col("mes").isNotNull())
