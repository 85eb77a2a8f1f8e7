"""Registered queries of the library's own operators on the driver's tables, each with its SQL.

Stand-ins: orders and events are health records, l_linenumber or a nation is a place or station, daily means of
lineitem quantities are a climate series, part types are coded diagnoses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, thermal, windows
from .operators import aggregate, derive, events, exposure, filters, fits, grids, indicators, joins, models, quality, spatial, standardize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly records per group, zero-filled."""
    return QUERIES["agg_complete_calendar"](spark, sf_dir)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else c for c, t in df.dtypes])


# --- temporal aggregation -------------------------------------------------------------------------

_BUCKETS = {
    "day": "CAST(o_orderdate AS DATE)",
    "week": "CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER)",
    "month": "CAST(date_trunc('month', o_orderdate) AS DATE)",
    "quarter": "CAST(date_trunc('quarter', o_orderdate) AS DATE)",
    "year": "CAST(date_trunc('year', o_orderdate) AS DATE)",
    "5 days": "make_date(year(o_orderdate), month(o_orderdate), ((day(o_orderdate) - 1) // 5) * 5 + 1)",
    "season": "CAST(date_trunc('quarter', o_orderdate + INTERVAL 1 MONTH) - INTERVAL 1 MONTH AS DATE)",
}
for _unit, _sql in _BUCKETS.items():

    def _by_unit(spark: SparkSession, sf_dir: str, unit: str = _unit) -> DataFrame:
        return aggregate.aggregate_series(table(spark, sf_dir, "orders"), "o_orderdate", unit, "count", ["o_orderstatus"])

    register(f"agg_count_{_unit.replace(' ', '')}", f"SELECT {_sql} AS date, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")(_by_unit)

_FUNS = {
    "sum": "sum(l_extendedprice)", "mean": "avg(l_extendedprice)", "median": "median(l_extendedprice)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)", "sd": "stddev_samp(l_extendedprice)",
    "q25": "quantile_cont(l_extendedprice, 0.25)", "q75": "quantile_cont(l_extendedprice, 0.75)", "q95": "quantile_cont(l_extendedprice, 0.95)", "q99": "quantile_cont(l_extendedprice, 0.99)",
}


@register("agg_named_list", f"SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_returnflag, {', '.join(f'round({s}, {2 if n == "sum" else 7}) AS {n}' for n, s in _FUNS.items())} FROM lineitem GROUP BY ALL")
def agg_named_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate.aggregate_series(table(spark, sf_dir, "lineitem"), "l_shipdate", "month", {n: (n, "l_extendedprice") for n in _FUNS}, ["l_returnflag"])
    return _rounded(out.withColumn("sum", F.round("sum", 2)), 7)


@register("agg_complete_calendar", """
WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
g AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM m), (SELECT max(date) FROM m), INTERVAL 1 MONTH)) AS DATE) AS date)
SELECT g.date, p.o_orderpriority, coalesce(m.n, 0) AS n FROM g CROSS JOIN (SELECT DISTINCT o_orderpriority FROM m) p LEFT JOIN m ON m.date = g.date AND m.o_orderpriority = p.o_orderpriority""")
def agg_complete_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.aggregate_series(table(spark, sf_dir, "orders"), "o_orderdate", "month", "count", ["o_orderpriority"], complete=True)


@register("agg_geo_valid", "SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS date, count(*) AS n FROM orders WHERE o_custkey % 10 <> 0 GROUP BY ALL")
def agg_geo_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    geo = F.when(F.col("o_custkey") % 10 == 0, "000000").otherwise(F.col("o_custkey").cast("string"))
    return aggregate.aggregate_series(aggregate.drop_invalid_geo(table(spark, sf_dir, "orders").withColumn("geo", geo), "geo"), "o_orderdate", "year")


@register("agg_hours_to_days", """
SELECT user_id % 10 AS station, CAST(ts AS DATE) AS date, round(sum(value), 6) AS rain, round(avg(value), 6) AS temp, max(value) AS tmax, min(value) AS tmin,
 round(degrees(atan2(avg(sin(radians(event_id % 360))), avg(cos(radians(event_id % 360))))), 6) AS wind FROM events GROUP BY ALL""")
def agg_hours_to_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("station"), "ts", F.col("value").alias("rain"), F.col("value").alias("temp"), F.col("value").alias("tmax"), F.col("value").alias("tmin"), (F.col("event_id") % 360).alias("wind"))
    return _rounded(aggregate.roll_up_hours(df, ["station"], "ts", {"rain": "sum", "temp": "mean", "tmax": "max", "tmin": "min", "wind": "circular"}))


# --- filters --------------------------------------------------------------------------------------

_ICD = "chr(CAST(65 + p_partkey % 26 AS INTEGER)) || lpad(CAST(p_size * 2 % 100 AS VARCHAR), 2, '0') || CAST(p_partkey % 10 AS VARCHAR)"


def _diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.chr((65 + F.col("p_partkey") % 26).cast("int")), F.lpad((F.col("p_size") * 2 % 100).cast("string"), 2, "0"), (F.col("p_partkey") % 10).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("icd"))


@register("cid_starts_with", f"SELECT p_partkey, icd FROM (SELECT p_partkey, {_ICD} AS icd FROM part) WHERE regexp_matches(icd, '^(J0[0-9]|J1[0-9]|I2[0-5])')")
def cid_starts_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_diagnosis(_diagnoses(spark, sf_dir), "icd", ["J00-J19", "I20-I25"])


@register("cid_exact", f"SELECT p_partkey, icd FROM (SELECT p_partkey, {_ICD} AS icd FROM part) WHERE icd IN ('A220', 'B561', 'C102', 'D743')")
def cid_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_diagnosis(_diagnoses(spark, sf_dir), "icd", ["A220", "B561", "C102", "D743"], how="exact")


@register("cid_contains", f"SELECT p_partkey, icd FROM (SELECT p_partkey, {_ICD} AS icd FROM part) WHERE regexp_matches(icd, 'E10|E12|F4')")
def cid_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_diagnosis(_diagnoses(spark, sf_dir), "icd", ["E10", "E12", "F4"], how="range")


@register("cid_group", f"SELECT p_partkey, icd FROM (SELECT p_partkey, {_ICD} AS icd FROM part) WHERE regexp_matches(icd, '^(I[0-9][0-9])')")
def cid_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_diagnosis(_diagnoses(spark, sf_dir), "icd", group="cardiovascular")


@register("demo_filter", "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 100 BETWEEN 20 AND 60 AND c_nationkey IN (3, 7, 11)")
def demo_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").withColumns({"segment": F.lower("c_mktsegment"), "age_years": F.col("c_custkey") % 100, "code_muni": F.concat((F.col("c_nationkey") + 300000).cast("string"), F.lit("9"))})
    out = filters.filter_demographics(df, {"segment": ["building", "machinery"]}, age=(20, 60), municipalities=["300003", "3000079", "300011"])
    return out.select("c_custkey", "c_mktsegment", "c_nationkey")


@register("demo_drop_ignored", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('FURNITURE') AND c_custkey % 5 <> 0")
def demo_drop_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("c_mktsegment") == "FURNITURE", " Ignorado ").when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    return filters.drop_ignored(table(spark, sf_dir, "customer").withColumn("answer", answer), ["answer"]).select("c_custkey")


@register("region_states", "SELECT n_nationkey FROM nation WHERE n_nationkey % 5 IN (0, 1, 2)")
def region_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    uf = F.element_at(F.array(*map(F.lit, ("PR", "rs", "SC", "SP", "AM"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return filters.filter_demographics(table(spark, sf_dir, "nation").withColumn("uf", uf), region="south").select("n_nationkey")


@register("fuzzy_names", "SELECT n_name, levenshtein(lower(n_name), 'nation_1') AS distance FROM nation WHERE levenshtein(lower(n_name), 'nation_1') <= 2 OR starts_with(lower(n_name), 'nation_1') ORDER BY 2, 1 LIMIT 5")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.suggest_names(table(spark, sf_dir, "nation"), "n_name", "Natión_1")


# --- derived variables and standardisation ---------------------------------------------------------

_D = "CAST(o_orderdate AS DATE)"


@register("calendar_variables", f"""
SELECT o_orderkey, year(d) AS year, month(d) AS month, quarter(d) AS quarter, CASE WHEN month(d) <= 6 THEN 1 ELSE 2 END AS semester, dayofyear(d) AS day_of_year, isodow(d) AS day_of_week, isodow(d) >= 6 AS is_weekend,
 CAST(ceil(dayofyear(d - CAST(dayofweek(d) AS INTEGER) + 3) / 7.0) AS INTEGER) AS epi_week, year(d - CAST(dayofweek(d) AS INTEGER) + 3) AS epi_year, monthname(d) AS month_name, dayname(d) AS day_name,
 CASE WHEN month(d) IN (12, 1, 2) THEN 'summer' WHEN month(d) <= 5 THEN 'autumn' WHEN month(d) <= 8 THEN 'winter' ELSE 'spring' END AS season,
 CASE WHEN month(d) IN (11, 12, 1, 2, 3) THEN 'rainy' WHEN month(d) IN (4, 10) THEN 'transition' ELSE 'dry' END AS climatic_season, CASE WHEN month(d) IN (11, 12, 1, 2, 3) THEN 'rainy' ELSE 'dry' END AS dry_rainy
FROM (SELECT o_orderkey, {_D} AS d FROM orders)""")
def calendar_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.calendar_variables(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", region="Sudeste").drop("o_orderdate")


_GROUPS = "CASE WHEN a >= 0 AND a < 5 THEN '0-4' WHEN a < 15 THEN '5-14' WHEN a < 60 THEN '15-59' WHEN a >= 60 THEN '60+' END AS age_group, CASE WHEN a >= 80 THEN '80+' WHEN a >= 0 THEN CAST(a // 5 * 5 AS VARCHAR) || '-' || CAST(a // 5 * 5 + 4 AS VARCHAR) END AS five_year_group, CASE WHEN a <= 4 THEN '0-4' WHEN a <= 64 THEN '5-64' WHEN a > 64 THEN '65+' END AS risk_group"


@register("age_from_dates", f"SELECT o_orderkey, a AS age_years, {_GROUPS} FROM (SELECT o_orderkey, CAST(floor(({_D} - DATE '1995-01-01' + (o_custkey % 90) * 365) / 365.25) AS INTEGER) AS a FROM orders)")
def age_from_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("birth", F.date_sub(F.lit("1995-01-01").cast("date"), ((F.col("o_custkey") % 90) * 365).cast("int")))
    return derive.age_variables(df, "o_orderdate", "birth").select("o_orderkey", "age_years", "age_group", "five_year_group", "risk_group")


@register("age_from_code", f"SELECT o_orderkey, a AS age_years, {_GROUPS} FROM (SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN (o_custkey % 100) // 12 WHEN 4 THEN o_custkey % 100 WHEN 5 THEN o_custkey % 100 + 100 END AS INTEGER) AS a FROM orders)")
def age_from_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat((F.col("o_orderkey") % 6).cast("string"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"))
    return derive.age_variables(table(spark, sf_dir, "orders").withColumn("code", code), code="code").select("o_orderkey", "age_years", "age_group", "five_year_group", "risk_group")


@register("parse_dates", f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE {_D} END AS d FROM orders")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "ddMMyyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "yyyyMMdd")).otherwise("n/a")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(text).alias("d"))


@register("standardize_records", f"SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' WHEN 0 THEN 'Ignored' ELSE '3' END AS sex, CASE c_nationkey % 3 WHEN 0 THEN 'White' WHEN 1 THEN 'Brown' ELSE '7' END AS race, DATE '2020-02-01' + CAST(c_custkey % 28 AS INTEGER) AS death_date FROM customer")
def standardize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(F.date_add(F.lit("2020-02-01").cast("date"), (F.col("c_custkey") % 28).cast("int")), "ddMMyyyy")
    race = F.element_at(F.array(*map(F.lit, "147")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    raw = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 4).cast("string").alias("SEXO"), race.alias("RACACOR"), day.alias("DTOBITO"))
    return standardize.standardize(raw).select("c_custkey", "sex", "race", "death_date")


@register("repair_encoding", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' São Tomé' ELSE n_name || ' plain' END AS name FROM nation")
def repair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("n_nationkey") % 4 == 0, F.encode(F.concat("n_name", F.lit(" São Tomé")), "ISO-8859-1")).when(F.col("n_nationkey") % 2 == 0, F.encode(F.concat("n_name", F.lit(" São Tomé")), "UTF-8")).otherwise(F.encode(F.concat("n_name", F.lit(" plain")), "UTF-8"))
    return table(spark, sf_dir, "nation").select("n_nationkey", standardize.repair_text(raw).alias("name"))


# --- joins ----------------------------------------------------------------------------------------


@register("spatial_key_join", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def spatial_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    six = lambda c: F.lpad(F.col(c).cast("string"), 6, "0")
    places = table(spark, sf_dir, "nation").select(F.concat(six("n_nationkey"), F.lit("5")).alias("muni7"), "n_name")
    return joins.spatial_key_join(table(spark, sf_dir, "customer").withColumn("muni6", six("c_nationkey")), places, "muni6", "muni7").select("c_custkey", "n_name")


@register("zip_join", "SELECT c_custkey, s_name FROM customer LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def zip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    zips = table(spark, sf_dir, "supplier").select(F.format_string("%08d", F.col("s_nationkey")).alias("zip_code"), "s_name")
    df = table(spark, sf_dir, "customer").withColumn("zip_code", F.col("c_nationkey").cast("string"))
    return joins.zip_join(df, zips, order=["s_name"]).select("c_custkey", "s_name")


@register("census_join", "SELECT s_suppkey, round(c_acctbal_mean, 6) AS c_acctbal_mean FROM supplier LEFT JOIN (SELECT c_nationkey, avg(c_acctbal) AS c_acctbal_mean FROM customer GROUP BY 1) ON s_nationkey = c_nationkey")
def census_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    census = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("s_nationkey"), "c_acctbal")
    return _rounded(joins.census_join(table(spark, sf_dir, "supplier"), census, "s_nationkey", "mean").select("s_suppkey", "c_acctbal_mean"))


@register("outer_merge", """
WITH a AS (SELECT o_custkey % 50 AS k, CAST(date_trunc('year', o_orderdate) AS DATE) AS d, count(*) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_custkey % 50 AS k, CAST(date_trunc('year', o_orderdate) AS DATE) AS d, count(*) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL),
c AS (SELECT o_custkey % 50 AS k, CAST(date_trunc('year', o_orderdate) AS DATE) AS d, count(*) AS c FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL)
SELECT k, d, a, b, c FROM a FULL JOIN b USING (k, d) FULL JOIN c USING (k, d)""")
def outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k"), F.to_date(F.date_trunc("year", "o_orderdate")).alias("d"), "o_orderstatus")
    return joins.outer_merge([o.where(F.col("o_orderstatus") == s).groupBy("k", "d").agg(F.count("*").alias(n)) for s, n in (("F", "a"), ("O", "b"), ("P", "c"))], ["k", "d"])


@register("upsert", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return joins.upsert(c, c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"], ["c_acctbal"])


_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@register("nearest_station", f"""
WITH a AS (SELECT n_nationkey, -30 + n_nationkey * 1.1 AS lat, -70 + (n_nationkey * 7 % 25) * 1.3 AS lon FROM nation), b AS (SELECT s_suppkey, -32 + (s_suppkey * 37 % 300) / 10.0 AS lat, -72 + (s_suppkey * 53 % 360) / 10.0 AS lon FROM supplier),
r AS (SELECT n_nationkey, s_suppkey, round({_KM}, 6) AS distance_km FROM a CROSS JOIN b) SELECT n_nationkey, s_suppkey, distance_km FROM r QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY distance_km, s_suppkey) = 1""")
def nearest_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").select("n_nationkey", (-30 + F.col("n_nationkey") * 1.1).alias("lat"), (-70 + (F.col("n_nationkey") * 7 % 25) * 1.3).alias("lon"))
    stations = table(spark, sf_dir, "supplier").select("s_suppkey", (-32 + (F.col("s_suppkey") * 37 % 300) / 10.0).alias("lat"), (-72 + (F.col("s_suppkey") * 53 % 360) / 10.0).alias("lon"))
    return joins.nearest_station(places, stations, "n_nationkey", "s_suppkey")


# --- exposure windows -----------------------------------------------------------------------------

_CLIMATE = "SELECT l_linenumber AS k, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS x FROM lineitem GROUP BY ALL"
_HEALTH = "SELECT o_orderkey, CAST(o_custkey % 7 + 1 AS INTEGER) AS k, CAST(o_orderdate AS DATE) AS date FROM orders"


def _series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("k"), F.col("l_shipdate").alias("date"), F.col("l_quantity").alias("x"))
    health = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7 + 1).cast("int").alias("k"), F.to_date("o_orderdate").alias("date"))
    return health, exposure.daily(raw, "k", "date", ["x"])


def _range_sql(near: int, far: int, columns: str) -> str:
    return f"WITH c AS ({_CLIMATE}), h AS ({_HEALTH}) SELECT h.o_orderkey, h.k, h.date, {columns} FROM h LEFT JOIN c ON c.k = h.k AND c.date BETWEEN h.date - {far} AND h.date - {near} GROUP BY ALL"


@register("clim_exact", f"WITH c AS ({_CLIMATE}), h AS ({_HEALTH}) SELECT h.o_orderkey, h.k, h.date, round(x, 6) AS x FROM h LEFT JOIN c USING (k, date)")
def clim_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(exposure.exact(*_series(spark, sf_dir), "k", "x"))


@register("clim_discrete_lag", f"WITH c AS ({_CLIMATE}), h AS ({_HEALTH}) SELECT h.o_orderkey, h.k, h.date, round(x, 6) AS lag3_x FROM h LEFT JOIN c ON c.k = h.k AND c.date = h.date - 3")
def clim_discrete_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(exposure.discrete_lag(*_series(spark, sf_dir), "k", "x", 3))


@register("clim_distributed_lag", _range_sql(0, 4, ", ".join(f"round(max(CASE WHEN c.date = h.date - {k} THEN x END), 6) AS x_lag{k}" for k in range(5))))
def clim_distributed_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(exposure.distributed_lag(*_series(spark, sf_dir), "k", "x", 4))


@register("clim_moving_window", _range_sql(0, 7, "CASE WHEN count(x) / 8.0 >= 0.7 THEN round(avg(x), 6) END AS x_mean_w7"))
def clim_moving_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(exposure.moving_window(*_series(spark, sf_dir), "k", "x", 7))


@register("clim_offset_window", _range_sql(7, 13, "CASE WHEN count(x) / 7.0 >= 0.7 THEN round(sum(x), 6) END AS off7to13_x"))
def clim_offset_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(exposure.offset_window(*_series(spark, sf_dir), "k", "x", 7, 13, "sum"))


@register("clim_degree_days", _range_sql(0, 7, "CASE WHEN count(x) / 8.0 >= 0.7 THEN round(sum(greatest(x - 20, 0.0)) FILTER (WHERE x IS NOT NULL), 6) END AS gdd_w7tbase20"))
def clim_degree_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(exposure.degree_days(*_series(spark, sf_dir), "k", "x", 7, 20))


@register("clim_exceedance", _range_sql(0, 7, "CASE WHEN count(x) / 8.0 >= 0.7 THEN count(CASE WHEN x > 27.5 THEN 1 END) END AS nexc7_gt27p5_x, CASE WHEN count(x) / 8.0 >= 0.7 THEN round(count(CASE WHEN x > 27.5 THEN 1 END) / count(x), 4) END AS pexc7_gt27p5_x"))
def clim_exceedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.exceedance(*_series(spark, sf_dir), "k", "x", 7, 27.5)


@register("clim_cold_wave", _range_sql(0, 5, "CASE WHEN count(x) / 6.0 >= 0.7 THEN count(CASE WHEN x < 20 THEN 1 END) END AS ncold5_lt20_x, CASE WHEN count(x) / 6.0 >= 0.7 THEN round(count(CASE WHEN x < 20 THEN 1 END) / count(x), 4) END AS pcold5_lt20_x"))
def clim_cold_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.exceedance(*_series(spark, sf_dir), "k", "x", 5, 20, cold=True)


@register("clim_weighted_window", _range_sql(0, 3, "CASE WHEN count(x) / 4.0 >= 0.7 THEN round(sum(x * (1 - 0.3 * (h.date - c.date))) / sum(CASE WHEN x IS NOT NULL THEN 1 - 0.3 * (h.date - c.date) END), 6) END AS wwin3_x"))
def clim_weighted_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(exposure.weighted_window(*_series(spark, sf_dir), "k", "x", days=3))


_SEASON = "CASE WHEN month({0}) IN (12, 1, 2) THEN 'DJF' WHEN month({0}) <= 5 THEN 'MAM' WHEN month({0}) <= 8 THEN 'JJA' ELSE 'SON' END"


@register("clim_seasonal", f"WITH c AS ({_CLIMATE}), h AS ({_HEALTH}), s AS (SELECT k, year(date) AS y, {_SEASON.format('date')} AS s, avg(x) AS season_x, count(x) AS n FROM c GROUP BY ALL HAVING count(x) >= 60) SELECT o_orderkey, h.k, h.date, round(season_x, 6) AS season_x FROM h LEFT JOIN s ON s.k = h.k AND s.y = year(h.date) AND s.s = {_SEASON.format('h.date')}")
def clim_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(exposure.seasonal(*_series(spark, sf_dir), "k", "x"))


# --- thermal indices ------------------------------------------------------------------------------

_WEATHER = "SELECT event_id, 5 + (value * 1.0137) % 35 AS t, user_id % 100 + 0.37 AS rh, (event_id % 83) / 9.7 AS ws, (event_id % 3001) * 1.013 AS sr, month(ts) AS m FROM events"


def _weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (5 + (F.col("value") * 1.0137) % 35).alias("t"), (F.col("user_id") % 100 + 0.37).alias("rh"), ((F.col("event_id") % 83) / 9.7).alias("ws"), ((F.col("event_id") % 3001) * 1.013).alias("sr"), F.month("ts").alias("m"))


_ES = "0.6108 * exp(17.27 * t / (t + 237.3))"
_WBGT = f"0.7 * ((t * atan(0.16 * sqrt(greatest(rh / 100 * {_ES}, 0.01) + 0.1)) + 3.0 + t + 0.33 * (rh / 100) * exp(0.0514 * t) - 4.0) / 2) + 0.2 * (t + 0.0144 * pow(greatest(sr / 3.6, 0), 0.6) / pow(greatest(ws, 0.1), 0.2) - 2.0) + 0.1 * t"


@register("index_wbgt", f"WITH w AS ({_WEATHER}) SELECT event_id, round({_WBGT}, 2) AS wbgt, CASE WHEN round({_WBGT}, 2) > 33 THEN 'Extreme' WHEN round({_WBGT}, 2) > 30 THEN 'Very High' WHEN round({_WBGT}, 2) > 28 THEN 'High' WHEN round({_WBGT}, 2) > 25 THEN 'Moderate' WHEN round({_WBGT}, 2) > 20 THEN 'Low' ELSE 'None' END AS risk FROM w")
def index_wbgt(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _weather(spark, sf_dir).withColumn("wbgt", thermal.wbgt(F.col("t"), F.col("rh"), F.col("sr"), F.col("ws")))
    return df.select("event_id", "wbgt", thermal.heat_stress_class(F.col("wbgt")).alias("risk"))


_F = "(t * 9 / 5 + 32)"
_HI = f"(-42.379 + 2.04901523 * {_F} + 10.14333127 * rh - 0.22475541 * {_F} * rh - 0.00683783 * {_F} * {_F} - 0.05481717 * rh * rh + 0.00122874 * {_F} * {_F} * rh + 0.00085282 * {_F} * rh * rh - 0.00000199 * {_F} * {_F} * rh * rh)"


@register("index_heat", f"WITH w AS ({_WEATHER}) SELECT event_id, CASE WHEN t >= 26.7 AND rh >= 40 THEN round(least(({_HI} + CASE WHEN rh < 13 AND {_F} BETWEEN 80 AND 112 THEN -(13 - rh) / 4 * sqrt(greatest(17 - abs({_F} - 95), 0) / 17) WHEN rh > 85 AND {_F} BETWEEN 80 AND 87 THEN (rh - 85) / 10 * ((87 - {_F}) / 5) ELSE 0 END - 32) * 5 / 9, 60), 2) END AS hi, round(t - (1 - rh / 100) * (t - 14.4) / 2, 2) AS thi FROM w")
def index_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weather(spark, sf_dir).select("event_id", thermal.heat_index(F.col("t"), F.col("rh")).alias("hi"), thermal.temperature_humidity(F.col("t"), F.col("rh")).alias("thi"))


@register("index_cold", f"WITH w AS ({_WEATHER}) SELECT event_id, CASE WHEN t <= 10 AND ws > 1.3 THEN round(13.12 + 0.6215 * t - 11.37 * pow(greatest(ws * 3.6, 0.01), 0.16) + 0.3965 * t * pow(greatest(ws * 3.6, 0.01), 0.16), 2) END AS wcet, CASE WHEN t <= 10 AND ws > 1.3 THEN round((35.74 + 0.6215 * {_F} - 35.75 * pow(greatest(ws * 0.621371, 0.01), 0.16) + 0.4275 * {_F} * pow(greatest(ws * 0.621371, 0.01), 0.16) - 32) * 5 / 9, 2) END AS wct, CASE WHEN ws >= 0.2 THEN round(greatest(t - 0.4 * (t - 10) * (1 - rh / 100) - 1.1 * sqrt(greatest(ws - 0.2, 0)), -273.15), 2) END AS et FROM w")
def index_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, rh, ws = F.col("t"), F.col("rh"), F.col("ws")
    return _weather(spark, sf_dir).select("event_id", thermal.wind_chill_metric(t, ws).alias("wcet"), thermal.wind_chill_imperial(t, ws).alias("wct"), thermal.effective_temperature(t, rh, ws).alias("et"))


@register("index_comfort", f"WITH w AS ({_WEATHER}) SELECT event_id, round(least(greatest(t + 0.048 * (rh / 100 * {_ES} * 1000 - 1000) / 100 - 0.29 * ln(greatest(ws * 1.5, 0.5) + 0.1) + 0.016 * (0.07 * (sr / 3.6) - 1.5) + 0.010 * (0.07 * (sr / 3.6) - 1.5) * (0.07 * (sr / 3.6) - 1.5) / 10 - 0.00006 * (0.07 * (sr / 3.6) - 1.5) * (0.07 * (sr / 3.6) - 1.5) * greatest(ws * 1.5, 0.5), -60), 50), 2) AS utci, round(t + 0.10 * (rh - 50) / 10 - 0.30 * greatest(ws, 0.1) + 0.05 * (0.06 * (sr / 3.6) - 2.0) + 0.50 * (1 - 0.6 * CASE WHEN m IN (12, 1, 2) THEN 0.5 WHEN m IN (3, 4, 5, 9, 10, 11) THEN 0.7 ELSE 0.9 END), 2) AS pet FROM w")
def index_comfort(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, rh, ws, sr = F.col("t"), F.col("rh"), F.col("ws"), F.col("sr")
    return _weather(spark, sf_dir).select("event_id", thermal.utci(t, rh, ws, sr).alias("utci"), thermal.pet(t, rh, ws, sr, F.col("m")).alias("pet"))


@register("index_degrees", f"WITH w AS ({_WEATHER}) SELECT event_id, round(greatest(t - 18, 0), 1) AS cdd, round(greatest(18 - t, 0), 1) AS hdd, round(least(greatest(t, 10), 30) - 10, 1) AS gdd, round({_ES} * (rh / 100), 3) AS vp, CASE WHEN rh < 30 THEN 'Arid' WHEN rh < 50 THEN 'Semi-arid' WHEN rh < 70 THEN 'Humid' ELSE 'Perhumid' END AS humidity, round(237.7 * (ln(rh / 100) + 17.27 * t / (237.7 + t)) / (17.27 - (ln(rh / 100) + 17.27 * t / (237.7 + t))), 6) AS dew FROM w")
def index_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, rh = F.col("t"), F.col("rh")
    return _weather(spark, sf_dir).select("event_id", thermal.cooling_degrees(t).alias("cdd"), thermal.heating_degrees(t).alias("hdd"), thermal.growing_degrees(t).alias("gdd"), thermal.vapour_pressure(t, rh).alias("vp"), thermal.humidity_class(rh).alias("humidity"), F.round(thermal.dew_point(t, rh), 6).alias("dew"))


# --- quality control and gaps ---------------------------------------------------------------------


@register("quality_control", """
SELECT event_id, CASE WHEN t BETWEEN -90 AND 60 THEN t END AS tair_dry_bulb_c, CASE WHEN tmin > t THEN NULL WHEN tmin BETWEEN -90 AND 60 THEN tmin END AS tair_min_c,
 CASE WHEN greatest(rain, 0) <= 500 THEN greatest(rain, 0) END AS rainfall_mm
FROM (SELECT event_id, value AS t, 55.0 AS tmax, CAST(event_id % 70 AS DOUBLE) AS tmin, CAST(event_id % 900 - 100 AS DOUBLE) AS rain FROM events)""")
def quality_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("tair_dry_bulb_c"), F.lit(55.0).alias("tair_max_c"), (F.col("event_id") % 70).cast("double").alias("tair_min_c"), (F.col("event_id") % 900 - 100).cast("double").alias("rainfall_mm"))
    return quality.quality_control(raw).select("event_id", "tair_dry_bulb_c", "tair_min_c", "rainfall_mm")


@register("gap_features", """
SELECT event_id, lag(value, 1) OVER w AS value_lag1, lag(value, 3) OVER w AS value_lag3, lead(value, 1) OVER w AS value_lead1, lead(value, 3) OVER w AS value_lead3, round(value - lag(value) OVER w, 6) AS value_diff, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS value_mean3,
 round(stddev_samp(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS value_sd3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def gap_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.lag_features(table(spark, sf_dir, "events"), "value", ["user_id"], "event_id", (1, 3))
    df = quality.rolling_features(df, "value", ["user_id"], "event_id", (3,))
    return _rounded(df.select("event_id", "value_lag1", "value_lag3", "value_lead1", "value_lead3", "value_diff", "value_mean3", "value_sd3"))


_HOLES = "SELECT event_id, user_id, CASE WHEN event_id % 4 <> 0 AND event_id % 7 <> 0 THEN value END AS v FROM events"


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.when((F.col("event_id") % 4 != 0) & (F.col("event_id") % 7 != 0), F.col("value")).alias("v"))


@register("gap_interpolation", f"""
WITH h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM ({_HOLES})),
s AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS a, first_value(v IGNORE NULLS) OVER f AS b, last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER b AS i, first_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER f AS j FROM h
 WINDOW b AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN a IS NOT NULL AND b IS NOT NULL THEN a + (b - a) * (n - i) / (j - i) ELSE coalesce(a, b) END, 6) AS v_filled FROM s""")
def gap_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(windows.interpolate(_holes(spark, sf_dir), "v", ["user_id"], "event_id").select("event_id", "v_filled"))


@register("gap_segments", f"""
WITH h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, v IS NULL ORDER BY event_id) AS g FROM ({_HOLES}))
SELECT user_id, min(event_id) AS start, max(event_id) AS "end", count(*) AS n_rows FROM h WHERE v IS NULL GROUP BY user_id, g""")
def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gap_segments(_holes(spark, sf_dir), "v", ["user_id"], "event_id").select("user_id", "start", "end", "n_rows")


@register("imputation_metrics", """WITH e AS (SELECT CASE WHEN event_id % 13 > 0 THEN value + CASE WHEN event_id % 997 = 0 THEN 5000 ELSE 0 END END AS v, CASE WHEN event_id % 17 > 0 THEN value * 0.5 + event_id % 211 + 40 END AS p FROM events),
m AS (SELECT avg(v) AS mu, stddev_samp(v) AS sd FROM e), k AS (SELECT v, p FROM e, m WHERE v IS NOT NULL AND p IS NOT NULL AND NOT coalesce(abs(v - mu) > 3 * sd, false))
SELECT count(*) AS n, (SELECT count(*) FILTER (WHERE abs(v - mu) > 3 * sd) FROM e, m) AS n_outliers, round(sqrt(avg((p - v) * (p - v))), 6) AS rmse, round(avg(abs(p - v)), 6) AS mae, round(avg(p - v), 6) AS bias, round(1 - sum((p - v) * (p - v)) / sum((v - (SELECT avg(v) FROM k)) * (v - (SELECT avg(v) FROM k))), 6) AS r2,
 round(avg(200 * abs(p - v) / nullif(abs(v) + abs(p), 0)), 6) AS smape, round(regr_slope(p, v), 6) AS slope FROM k""")
def imputation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    df = table(spark, sf_dir, "events").select(F.when(i % 13 > 0, v + F.when(i % 997 == 0, 5000).otherwise(0)).alias("v"), F.when(i % 17 > 0, v * 0.5 + i % 211 + 40).alias("p"))
    return _rounded(quality.imputation_metrics(df, "v", "p"))


# --- events, anomalies, drought -------------------------------------------------------------------

_DAYS = "SELECT l_linenumber AS station, CAST(l_shipdate AS DATE) AS date, max(l_quantity + l_partkey % 97 / 97.0) AS tmax, min(l_quantity + l_partkey % 97 / 97.0) AS tmin, avg(l_quantity + l_partkey % 97 / 97.0) AS tmean FROM lineitem GROUP BY ALL"
_BASE = f"""days AS ({_DAYS}), spread AS (SELECT station, ((dayofyear(date) - 1 + k) % 366 + 366) % 366 + 1 AS doy, tmax, tmin FROM days, (SELECT unnest(range(-15, 16)) AS k)),
base AS (SELECT station, doy, CASE WHEN count(tmax) >= 10 THEN quantile_cont(tmax, 0.9) END AS tmax_p, CASE WHEN count(tmax) >= 10 THEN quantile_cont(tmin, 0.9) END AS tmin_p, avg(tmax) AS tmax_hist, avg(tmin) AS tmin_hist FROM spread GROUP BY ALL),
flags AS (SELECT d.station, d.date, d.tmax, coalesce(d.tmax > tmax_p, false) AS WHO, coalesce(d.tmax > tmax_p AND d.tmin > tmin_p, false) AS WMO, coalesce(d.tmax > tmax_hist + 5, false) AS INMET, d.tmax - tmax_hist AS anomaly FROM days d LEFT JOIN base b ON b.station = d.station AND b.doy = dayofyear(d.date))"""


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("station"), "l_shipdate", (F.col("l_quantity") + F.col("l_partkey") % 97 / 97.0).alias("t"))
    return events.daily_extremes(raw, "station", "l_shipdate", "t")


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir)
    return events.wave_flags(days, events.day_baseline(days, "station"), "station")


@register("heat_flags", f"WITH {_BASE} SELECT station, date, WHO, WMO, INMET, round(anomaly, 6) AS anomaly FROM flags")
def heat_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_flags(spark, sf_dir).select("station", "date", "WHO", "WMO", "INMET", "anomaly"))


_EVENTS = f"""WITH {_BASE}, g AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY date) - row_number() OVER (PARTITION BY station, INMET ORDER BY date) AS g FROM flags),
ev AS (SELECT station, min(date) AS start_date, max(date) AS end_date, count(*) AS n_days, avg(tmax) AS mean_value, max(tmax) AS peak_value, avg(anomaly) AS mean_anomaly, sum(anomaly) AS total_anomaly FROM g WHERE INMET GROUP BY station, g HAVING count(*) >= 2)"""


@register("heat_events", f"{_EVENTS} SELECT station, start_date, end_date, n_days, round(mean_value, 6) AS mean_value, round(peak_value, 6) AS peak_value, round(mean_anomaly, 6) AS mean_anomaly, round(total_anomaly, 6) AS total_anomaly, end_date - start_date + 1 AS duration, round((end_date - start_date + 1) * mean_anomaly, 6) AS severity, station || '_INMET_' || row_number() OVER (PARTITION BY station ORDER BY start_date) AS event_id FROM ev")
def heat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(events.wave_events(_flags(spark, sf_dir), "INMET", "station", "tmax", least=2))


@register("heat_summary", f"{_EVENTS} SELECT station, year(start_date) AS year, count(*) AS n_events, CAST(sum(end_date - start_date + 1) AS BIGINT) AS total_days, round(avg(end_date - start_date + 1), 6) AS mean_duration, round(max(peak_value), 6) AS peak_value, round(avg((end_date - start_date + 1) * mean_anomaly), 6) AS mean_severity FROM ev GROUP BY ALL")
def heat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(events.wave_summary(events.wave_events(_flags(spark, sf_dir), "INMET", "station", "tmax", least=2), "station"))


@register("heat_runs", f"WITH {_BASE}, g AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY date) - row_number() OVER (PARTITION BY station, WHO ORDER BY date) AS g FROM flags) SELECT station, date, WHO AND count(*) OVER (PARTITION BY station, WHO, g) >= 2 AS WHO FROM g")
def heat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.keep_runs(_flags(spark, sf_dir), "WHO", ["station"], "date", 2).select("station", "date", "WHO")


@register("heat_factor", f"""
WITH d AS ({_DAYS}), t AS (SELECT station, date, CASE WHEN count(tmean) OVER a = 3 THEN avg(tmean) OVER a END AS t3, avg(tmean) OVER b AS t30 FROM d WINDOW a AS (PARTITION BY station ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS (PARTITION BY station ORDER BY date ROWS BETWEEN 32 PRECEDING AND 3 PRECEDING)),
l AS (SELECT station, quantile_cont(tmean, 0.95) AS lim FROM d GROUP BY 1), f AS (SELECT t.station, date, CASE WHEN t3 IS NOT NULL THEN (t3 - lim) * greatest(1.0, t3 - t30) END AS factor FROM t JOIN l USING (station))
SELECT station, date, round(factor, 6) AS factor, coalesce(max(CASE WHEN factor > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 0) = 1 AS EHF FROM f""")
def heat_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(events.excess_heat(_days(spark, sf_dir), "station").select("station", "date", "factor", "EHF"))


@register("cold_flags", f"""WITH days AS ({_DAYS}), spread AS (SELECT station, ((dayofyear(date) - 1 + k) % 366 + 366) % 366 + 1 AS doy, tmax, tmin FROM days, (SELECT unnest(range(-15, 16)) AS k)),
base AS (SELECT station, doy, CASE WHEN count(tmax) >= 10 THEN quantile_cont(tmin, 0.1) END AS p, avg(tmin) AS h FROM spread GROUP BY ALL)
SELECT d.station, d.date, coalesce(tmin < p, false) AS WHO, coalesce(tmin < h - 5, false) AS INMET, round(h - tmin, 6) AS anomaly FROM days d LEFT JOIN base b ON b.station = d.station AND b.doy = dayofyear(d.date)""")
def cold_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir)
    return _rounded(events.wave_flags(days, events.day_baseline(days, "station", 0.1), "station", cold=True).select("station", "date", "WHO", "INMET", "anomaly"))


@register("climate_anomaly", """
WITH o AS (SELECT l_linenumber AS station, year(l_shipdate) AS year, month(l_shipdate) AS month, avg(l_quantity) AS observed FROM lineitem GROUP BY ALL), n AS (SELECT l_linenumber AS station, month(l_shipdate) AS month, avg(l_quantity) AS normal FROM lineitem WHERE l_shipdate < DATE '1999-01-01' GROUP BY ALL)
SELECT station, year, month, round(observed, 6) AS observed, round(normal, 6) AS normal, round(observed - normal, 6) AS anomaly, round(100 * (observed - normal) / normal, 6) AS anomaly_pct, round((observed - normal) / stddev_samp(observed) OVER (PARTITION BY station, month), 6) AS z FROM o LEFT JOIN n USING (station, month)""")
def climate_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("station"), F.to_date("l_shipdate").alias("date"), "l_quantity")  # noqa: E741
    normals = l.where("date < date '1999-01-01'").groupBy("station", F.month("date").alias("month")).agg(F.avg("l_quantity").alias("normal"))
    return _rounded(events.climate_anomaly(l, normals, "station", "l_quantity").select("station", "year", "month", "observed", "normal", "anomaly", "anomaly_pct", "z"))


_MONTHLY = "SELECT l_linenumber AS station, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_quantity) AS rain, avg(l_quantity) AS t FROM lineitem GROUP BY ALL"


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("station"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date")).agg(F.sum("l_quantity").alias("rain"), F.avg("l_quantity").alias("t"))


@register("thornthwaite", f"""WITH m AS ({_MONTHLY}), n AS (SELECT station, month(date) AS mm, avg(t) AS t FROM m GROUP BY ALL), i AS (SELECT station, sum(pow(greatest(t, 0) / 5, 1.514)) AS i FROM n GROUP BY 1)
SELECT station, date, round(CASE WHEN t > 0 THEN 16 * pow(10 * t / i, 0.000000675 * i * i * i - 0.0000771 * i * i + 0.01792 * i + 0.49239) * day(last_day(date)) / 30 ELSE 0 END, 4) AS pet FROM m JOIN i USING (station)""")
def thornthwaite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(events.thornthwaite(_monthly(spark, sf_dir), "station", "t").select("station", "date", "pet"), 4)


@register("drought_position", f"""WITH m AS (SELECT station, date, rain - 10 * t AS b FROM ({_MONTHLY})), r AS (SELECT station, date, CASE WHEN count(b) OVER w = 3 THEN sum(b) OVER w END AS rolling FROM m WINDOW w AS (PARTITION BY station ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT station, date, round(rolling, 4) AS rolling, CASE WHEN rolling IS NOT NULL THEN round((rank() OVER (PARTITION BY station, rolling IS NULL ORDER BY rolling) - 0.5) / count(rolling) OVER (PARTITION BY station), 6) END AS position FROM r""")
def drought_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events.hazen_position(_monthly(spark, sf_dir).withColumn("pet", 10 * F.col("t")), "station", "rain", "pet", 3)
    return df.select("station", "date", F.round("rolling", 4).alias("rolling"), F.round("position", 6).alias("position"))


# --- reports and indicators -----------------------------------------------------------------------


@register("report_overview", "SELECT CAST(sum(n) AS BIGINT) AS n_rows, 2 AS n_columns, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)")
def report_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.overview(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"))


@register("report_missing", """WITH t AS (SELECT CASE WHEN c_custkey % 30 = 0 THEN NULL ELSE 1 END AS a, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 1 END AS b, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 1 END AS c FROM customer),
u AS (SELECT 'a' AS "column", count(*) - count(a) AS n_missing, count(*) AS n FROM t UNION ALL SELECT 'b', count(*) - count(b), count(*) FROM t UNION ALL SELECT 'c', count(*) - count(c), count(*) FROM t)
SELECT "column", n_missing, round(100 * n_missing / n, 6) AS pct_missing, CASE WHEN 100 * n_missing / n < 5 THEN 'ok' WHEN 100 * n_missing / n < 20 THEN 'warning' ELSE 'critical' END AS flag FROM u""")
def report_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    hole = lambda n, c: F.when(F.col("c_custkey") % n != 0, 1).alias(c)
    return _rounded(quality.missingness(table(spark, sf_dir, "customer").select(hole(30, "a"), hole(7, "b"), hole(2, "c"))))


@register("report_frequencies", "SELECT c_mktsegment AS value, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM customer GROUP BY 1")
def report_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.frequencies(table(spark, sf_dir, "customer"), "c_mktsegment"))


@register("report_dates", "SELECT count(*) FILTER (WHERE o_orderkey % 9 = 0) AS n_missing, count(*) FILTER (WHERE o_orderkey % 9 <> 0 AND o_orderdate > DATE '2001-01-01') AS n_future, 0 AS n_before_1900, CAST(min(o_orderdate) FILTER (WHERE o_orderkey % 9 <> 0) AS DATE) AS first, CAST(max(o_orderdate) FILTER (WHERE o_orderkey % 9 <> 0) AS DATE) AS last FROM orders")
def report_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate"))
    return quality.date_report(table(spark, sf_dir, "orders").select(d.alias("d")), "d", F.lit("2001-01-01").cast("date"))


@register("report_diagnoses", f"SELECT substr(icd, 1, 1) AS chapter, count(*) AS n FROM (SELECT {_ICD} AS icd FROM part) WHERE regexp_matches(icd, '^[A-Za-z][0-9][0-9]') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def report_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.diagnosis_report(_diagnoses(spark, sf_dir), "icd")


@register("indicator_rates", """WITH p AS (SELECT n_nationkey, CAST(n_nationkey * 7 + 10 AS DOUBLE) AS pop_urban, CAST(n_nationkey * 11 + 40 AS DOUBLE) AS pop_total FROM nation),
w AS (SELECT *, pop_urban / pop_total AS p, 1.959963984540054 * 1.959963984540054 AS zz FROM p)
SELECT n_nationkey, round(100 * p, 6) AS urbanization_rate, round(100 * greatest((p + zz / (2 * pop_total) - 1.959963984540054 * sqrt(p * (1 - p) / pop_total + zz / (4 * pop_total * pop_total))) / (1 + zz / pop_total), 0), 6) AS urbanization_rate_lo, round(100 * least((p + zz / (2 * pop_total) + 1.959963984540054 * sqrt(p * (1 - p) / pop_total + zz / (4 * pop_total * pop_total))) / (1 + zz / pop_total), 1), 6) AS urbanization_rate_hi FROM w""")
def indicator_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 7 + 10).alias("pop_urban"), (F.col("n_nationkey") * 11 + 40).alias("pop_total"))
    return _rounded(indicators.compute_indicators(df).drop("pop_urban", "pop_total"))


@register("indicator_shares", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS pct_row, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS pct_col, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct_total FROM orders GROUP BY 1, 2")
def indicator_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(indicators.shares(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


@register("indicator_map_rates", """WITH c AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), p AS (SELECT c_nationkey AS k, count(*) AS pop FROM customer GROUP BY 1), r AS (SELECT c.k, n, pop, 100000.0 * n / pop AS rate FROM c LEFT JOIN p USING (k))
SELECT k, n, pop, round(rate, 6) AS rate, CASE WHEN rate IS NOT NULL THEN 1 + (rate > (SELECT quantile_cont(rate, 0.2) FROM r))::INT + (rate > (SELECT quantile_cont(rate, 0.4) FROM r))::INT + (rate > (SELECT quantile_cont(rate, 0.6) FROM r))::INT + (rate > (SELECT quantile_cont(rate, 0.8) FROM r))::INT END AS class FROM r""")
def indicator_map_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    pop = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("pop"))
    return _rounded(indicators.rates(n, pop, "k", "n", "pop"))


@register("indicator_trend", "SELECT year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS total, round(100 * (sum(o_totalprice) - lag(sum(o_totalprice)) OVER (ORDER BY year(o_orderdate))) / lag(sum(o_totalprice)) OVER (ORDER BY year(o_orderdate)), 6) AS pct_change FROM orders GROUP BY 1")
def indicator_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.annual_change(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice").select("year", F.round("total", 2).alias("total"), F.round("pct_change", 6).alias("pct_change"))


_DAILY = "SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS a, sum(o_totalprice) AS b FROM orders GROUP BY 1"


@register("indicator_ccf", f"WITH t AS ({_DAILY}) SELECT lag, round(corr(x.a, y.b), 6) AS r, count(*) AS n, round(2 / sqrt(count(*)), 6) AS band FROM t x, (SELECT unnest(range(-7, 8)) AS lag), t y WHERE y.d = x.d + CAST(lag AS INTEGER) GROUP BY lag")
def indicator_ccf(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("a"), F.sum("o_totalprice").alias("b"))
    return _rounded(indicators.cross_correlation(days, "d", "a", "b"))


@register("indicator_spearman", f"WITH t AS ({_DAILY}), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM t) SELECT round(corr(ra, rb), 6) AS rho FROM r")
def indicator_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("a"), F.sum("o_totalprice").alias("b"))
    return _rounded(indicators.spearman(days, "a", "b"))


@register("indicator_gini", "SELECT round(2 * sum(i * p_retailprice) / (count(*) * sum(p_retailprice)) - (count(*) + 1) / count(*), 6) AS gini FROM (SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice) AS i FROM part)")
def indicator_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(indicators.gini(table(spark, sf_dir, "part"), "p_retailprice"))


# --- models ---------------------------------------------------------------------------------------

_FIT = "SELECT l_linenumber AS city, year(l_shipdate) AS y, l_quantity AS t, CAST(l_partkey % 9 AS DOUBLE) AS cases, exp(pow(l_quantity - 25, 2) / 2000) AS rr FROM lineitem"


def _fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("city"), F.year("l_shipdate").alias("y"), F.col("l_quantity").alias("t"), (F.col("l_partkey") % 9).cast("double").alias("cases"), F.exp(F.pow(F.col("l_quantity") - 25, F.lit(2.0)) / 2000).alias("rr"))


@register("model_attributable", f"SELECT city, y, round(coalesce(sum(CASE WHEN t >= 25 THEN cases * (1 - 1 / rr) END), 0), 4) AS an, sum(cases) AS total, round(coalesce(sum(CASE WHEN t >= 25 THEN cases * (1 - 1 / rr) END), 0) / sum(cases), 8) AS af FROM ({_FIT}) GROUP BY ALL")
def model_attributable(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = models.attributable(_fit(spark, sf_dir), "cases", "rr", "t", low=25, by=["city", "y"])
    return df.select("city", "y", F.round("an", 4).alias("an"), "total", F.round("af", 8).alias("af"))


@register("model_burden", f"WITH a AS (SELECT city, sum(cases * (1 - 1 / rr)) AS an FROM ({_FIT}) GROUP BY 1) SELECT city, round(an, 4) AS an, rank() OVER (ORDER BY an DESC) AS rank, round(100 * an / sum(an) OVER (), 6) AS pct, round(100 * sum(an) OVER (ORDER BY an DESC, city ROWS UNBOUNDED PRECEDING) / sum(an) OVER (), 6) AS cum_pct FROM a")
def model_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = models.burden_ranking(models.attributable(_fit(spark, sf_dir), "cases", "rr", "t", by=["city"]), "city", "an")
    return df.select("city", F.round("an", 4).alias("an"), F.col("rank").cast("bigint").alias("rank"), F.round("pct", 6).alias("pct"), F.round("cum_pct", 6).alias("cum_pct"))


@register("model_excess", """WITH m AS (SELECT o_orderpriority AS g, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(count(*) AS DOUBLE) AS o FROM orders GROUP BY ALL), e AS (SELECT *, avg(o) OVER (PARTITION BY g) AS e FROM m)
SELECT g, date, round(o - e, 6) AS excess, round((o - e) / sqrt(e), 6) AS z, (o - e) / sqrt(e) > 1.96 AS flag, round(sum(o - e) OVER (PARTITION BY g ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS cum_excess FROM e""")
def model_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    m = aggregate.aggregate_series(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "g"), "o_orderdate", "month", "count", ["g"], name="o").withColumn("e", F.avg("o").over(Window.partitionBy("g")))
    return _rounded(models.excess(m, "o", "e", "date", ["g"]).select("g", "date", "excess", "z", "flag", "cum_excess"))


@register("model_its_design", """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1)
SELECT date, n, date - (SELECT min(date) FROM m) AS time, (date >= DATE '1998-01-01')::INT AS step, greatest(date - DATE '1998-01-01', 0) AS slope, round(sin(2 * pi() * 1 * dayofyear(date) / 365.25), 9) AS sin1, round(cos(2 * pi() * 1 * dayofyear(date) / 365.25), 9) AS cos1 FROM m""")
def model_its_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.interrupted_design(aggregate.aggregate_series(table(spark, sf_dir, "orders"), "o_orderdate", "month"), "date", "1998-01-01", 1)


@register("model_case_crossover", """WITH m AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, sum(o_totalprice) AS x FROM orders GROUP BY 1), s AS (SELECT date, n, strftime(date, '%Y-%m') AS stratum, lag(x, 2) OVER (ORDER BY date) AS exposure FROM m) SELECT date, n, stratum, round(exposure, 4) AS exposure FROM s QUALIFY sum(n) OVER (PARTITION BY stratum) > 0""")
def model_case_crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("x"))
    return models.case_crossover(days, "date", "n", "x", lag=2).select("date", "n", "stratum", F.round("exposure", 4).alias("exposure"))


@register("model_vulnerability", """WITH d AS (SELECT c_nationkey AS k, avg(c_acctbal) AS e, CAST(count(*) AS DOUBLE) AS s, max(c_acctbal) AS a FROM customer GROUP BY 1),
s AS (SELECT k, (e - min(e) OVER ()) / (max(e) OVER () - min(e) OVER ()) AS es, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS ss, 1 - (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS acs FROM d)
SELECT k, round(es, 6) AS e_score, round(ss, 6) AS s_score, round(acs, 6) AS a_score, round((es * 0.4 + ss * 0.3 + acs * 0.3) / 1.0, 6) AS index, rank() OVER (ORDER BY (es * 0.4 + ss * 0.3 + acs * 0.3) DESC) AS rank FROM s""")
def model_vulnerability(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("e"), F.count("*").cast("double").alias("s"), F.max("c_acctbal").alias("a"))
    return _rounded(models.vulnerability_index(d, "k", {"e": 0.4, "s": 0.3, "a": 0.3}, ("a",)).withColumn("rank", F.col("rank").cast("bigint")))


@register("model_quadrants", """WITH l AS (SELECT o_custkey % 20 AS k, CASE o_orderkey % 4 WHEN 0 THEN 'strengths' WHEN 1 THEN 'weaknesses' WHEN 2 THEN 'opportunities' ELSE 'threats' END AS q, o_totalprice % 100 AS v FROM orders), w AS (SELECT k, avg(v) FILTER (WHERE q = 'strengths') AS strengths, avg(v) FILTER (WHERE q = 'weaknesses') AS weaknesses, avg(v) FILTER (WHERE q = 'opportunities') AS opportunities, avg(v) FILTER (WHERE q = 'threats') AS threats FROM l GROUP BY 1)
SELECT k, round(strengths, 6) AS strengths, round(weaknesses, 6) AS weaknesses, round(opportunities, 6) AS opportunities, round(threats, 6) AS threats, """ + ", ".join(f"CASE WHEN {c} < 25 THEN 'low' WHEN {c} < 50 THEN 'moderate' WHEN {c} < 75 THEN 'high' WHEN {c} IS NOT NULL THEN 'very high' END AS {c}_class" for c in ("strengths", "weaknesses", "opportunities", "threats")) + " FROM w")
def model_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.element_at(F.array(*map(F.lit, ("strengths", "weaknesses", "opportunities", "threats"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    long = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("k"), q.alias("q"), (F.col("o_totalprice") % 100).alias("v"))
    return _rounded(models.quadrant_scores(long, "k", "q", "v"))


@register("model_metrics", "SELECT round(sqrt(avg((v - p) * (v - p))), 6) AS rmse, round(avg(abs(v - p)), 6) AS mae, round(1 - sum((v - p) * (v - p)) / (var_pop(v) * count(v)), 6) AS r2, round(corr(v, p), 6) AS pearson FROM (SELECT value AS v, value * 0.8 + event_id % 13 AS p FROM events)")
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(F.col("value").alias("v"), (F.col("value") * 0.8 + F.col("event_id") % 13).alias("p"))
    return _rounded(models.regression_metrics(df, "v", "p"))


# --- spatial --------------------------------------------------------------------------------------

_GRID = "SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey AND abs(a.n_nationkey // 5 - b.n_nationkey // 5) <= 1 AND abs(a.n_nationkey % 5 - b.n_nationkey % 5) <= 1"
_AREA = "SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM customer GROUP BY 1"


def _lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours on a 5 x 5 grid of nations, by shared corners."""
    corner = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x in (0, 1) for y in (0, 1)]))
    v = table(spark, sf_dir, "nation").select("n_nationkey", corner.alias("c"))
    return spatial.contiguity(v.select("n_nationkey", (F.floor(F.col("n_nationkey") / 5) + F.col("c.x")).alias("x"), (F.col("n_nationkey") % 5 + F.col("c.y")).alias("y")), "n_nationkey")


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("v"))


@register("spatial_weights", f"SELECT src, dst, round(1 / count(*) OVER (PARTITION BY src), 6) AS w FROM ({_GRID})")
def spatial_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spatial.row_weights(_lattice(spark, sf_dir)))


_MORAN = f"WITH w AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM ({_GRID})), z AS (SELECT k, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z FROM ({_AREA})), l AS (SELECT src AS k, sum(w * z) AS lag FROM w JOIN z ON z.k = dst GROUP BY 1)"


@register("spatial_moran", f"{_MORAN} SELECT round((SELECT count(*) FROM z) / (SELECT CAST(sum(w) AS DOUBLE) FROM w WHERE src IN (SELECT k FROM z) AND dst IN (SELECT k FROM z)) * sum(z * lag) / sum(z * z), 6) AS moran_i, round(-1 / (count(*) - 1), 6) AS expected FROM z JOIN l USING (k)")
def spatial_moran(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spatial.global_moran(_areas(spark, sf_dir), spatial.row_weights(_lattice(spark, sf_dir)), "k", "v"))


@register("spatial_lisa", f"{_MORAN} SELECT k, round(z, 6) AS z, round(coalesce(lag, 0), 6) AS lag, round(z * coalesce(lag, 0), 6) AS local_i, CASE WHEN z > 0 AND lag > 0 THEN 'HH' WHEN z < 0 AND lag < 0 THEN 'LL' WHEN z > 0 AND lag < 0 THEN 'HL' WHEN z < 0 AND lag > 0 THEN 'LH' ELSE 'NS' END AS quadrant FROM z LEFT JOIN l USING (k)")
def spatial_lisa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spatial.local_moran(_areas(spark, sf_dir), spatial.row_weights(_lattice(spark, sf_dir)), "k", "v"))


@register("spatial_adjust_p", "WITH p AS (SELECT s_suppkey, ((s_suppkey * 37) % 101 + 1) / 1000.0 AS p FROM supplier), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, s_suppkey) AS q FROM p) SELECT s_suppkey, round(p, 6) AS p, round(least(1.0, min(q) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_adjusted FROM r")
def spatial_adjust_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier").select("s_suppkey", (((F.col("s_suppkey") * 37) % 101 + 1) / 1000.0).alias("p"))
    return _rounded(spatial.adjust_p(df, "p"))


@register("spatial_scan", f"""WITH a AS (SELECT n_nationkey AS k, -10 + (n_nationkey // 5) * 0.9 AS lat, -50 + (n_nationkey % 5) * 0.9 AS lon, CAST((n_nationkey * 17) % 23 AS DOUBLE) AS c, CAST(n_nationkey % 7 * 10 + 50 AS DOUBLE) AS p FROM nation),
d AS (SELECT a.k AS k, b.k AS o, round({_KM}, 6) AS km, b.c, b.p FROM a, a b), g AS (SELECT k, km, sum(c) OVER w AS cases, sum(p) OVER w AS pop FROM d WHERE km <= 200 WINDOW w AS (PARTITION BY k ORDER BY km, o ROWS UNBOUNDED PRECEDING)), t AS (SELECT sum(c) AS C, sum(p) AS P FROM a),
e AS (SELECT g.k, km, cases, t.C * pop / t.P AS expected, t.C AS total FROM g, t WHERE pop <= 0.5 * t.P)
SELECT k, km AS radius_km, cases, round(expected, 6) AS expected, round(CASE WHEN cases > expected THEN cases * ln(cases / expected) + CASE WHEN total > cases THEN (total - cases) * ln((total - cases) / (total - expected)) ELSE 0 END ELSE 0 END, 6) AS llr FROM e ORDER BY llr DESC, k, km LIMIT 1""")
def spatial_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    df = table(spark, sf_dir, "nation").select(k.alias("k"), (-10 + F.floor(k / 5) * 0.9).alias("lat"), (-50 + (k % 5) * 0.9).alias("lon"), ((k * 17) % 23).alias("c"), (k % 7 * 10 + 50).alias("p"))
    return _rounded(spatial.scan_most_likely(df, "k", "c", "p"))


@register("spatial_points", "SELECT event_id, floor(x / 3) * 3 + floor(y / 3) AS polygon FROM (SELECT event_id, (event_id % 89) / 10.01 + 0.001 AS x, (event_id % 83) / 9.97 + 0.003 AS y FROM events)")
def spatial_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 89) / 10.01 + 0.001).alias("x"), ((F.col("event_id") % 83) / 9.97 + 0.003).alias("y"))
    squares = [(float(i * 3 + j), [(3.0 * i + a, 3.0 * j + b) for a, b in ((0, 0), (3, 0), (3, 3), (0, 3))]) for i in range(3) for j in range(3)]
    polygons = spark.createDataFrame(squares, "polygon double, ring array<struct<x:double,y:double>>")
    return spatial.points_in_polygons(points, polygons, "event_id", "polygon")


# --- grids ----------------------------------------------------------------------------------------


@register("grid_reanalysis", "SELECT event_id, round(value + 250 - 273.15, 6) AS tair_dry_bulb_c, round(value * 1000 * 0.01, 6) AS patm_hpa, round(value / 1000 * 1000, 6) AS rainfall_mm FROM events")
def grid_reanalysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return _rounded(grids.convert_reanalysis(table(spark, sf_dir, "events").select("event_id", (v + 250).alias("t2m"), (v * 1000).alias("sp"), (v / 1000).alias("tp"))))


@register("grid_pollutants", """WITH p AS (SELECT user_id AS code_muni, CAST(ts AS DATE) AS date, event_type, avg(value) AS v FROM events GROUP BY ALL)
SELECT code_muni, date, round(max(v) FILTER (WHERE event_type = 'click'), 6) AS pm25, round(max(v) FILTER (WHERE event_type = 'view'), 6) AS o3, round(max(v) FILTER (WHERE event_type = 'error'), 6) AS no2 FROM p WHERE event_type IN ('click', 'view', 'error') GROUP BY ALL""")
def grid_pollutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("code_muni"), F.to_date("ts").alias("date"), "event_type").agg(F.avg("value").alias("value"))
    return _rounded(grids.merge_pollutants({n: p.where(F.col("event_type") == e) for n, e in (("pm25", "click"), ("o3", "view"), ("no2", "error"))}, [2024]))


@register("grid_flash_droughts", "SELECT o_custkey % 50 AS code_muni, CAST(date_trunc('year', o_orderdate) AS DATE) AS date, count(*) AS n_fd_events, CAST(sum(o_orderkey % 30 + 1) AS BIGINT) AS fd_total_days, round(avg(o_totalprice), 4) AS fd_mean_severity, max(o_totalprice) AS fd_max_severity FROM orders GROUP BY ALL")
def grid_flash_droughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.to_date("o_orderdate")
    e = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("code_muni"), first.alias("fstdate"), F.date_add(first, (F.col("o_orderkey") % 30).cast("int")).alias("lstdate"), F.col("o_totalprice").alias("sv"))
    return _rounded(grids.flash_droughts(e), 4)


@register("grid_fires", "SELECT floor(x / 3) * 3 + floor(y / 3) AS code_muni, date, count(*) AS n_fires, round(avg(value), 9) AS frp_mean FROM (SELECT (event_id % 89) / 10.01 + 0.001 AS x, (event_id % 83) / 9.97 + 0.003 AS y, CAST(ts AS DATE) AS date, value FROM events) GROUP BY ALL")
def grid_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    fires = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), ((F.col("event_id") % 89) / 10.01 + 0.001).alias("x"), ((F.col("event_id") % 83) / 9.97 + 0.003).alias("y"), F.to_date("ts").alias("date"), F.col("value").alias("frp"))
    squares = [(float(i * 3 + j), [(3.0 * i + a, 3.0 * j + b) for a, b in ((0, 0), (3, 0), (3, 3), (0, 3))]) for i in range(3) for j in range(3)]
    return _rounded(grids.fires_by_municipality(fires, spark.createDataFrame(squares, "code_muni double, ring array<struct<x:double,y:double>>")), 9)


@register("grid_cleared_area", "SELECT o_custkey % 40 AS code_muni, year(o_orderdate) AS year, o_orderpriority AS biome, round(sum(o_totalprice), 2) AS area_km2, count(DISTINCT o_custkey) AS n_polygons FROM orders GROUP BY ALL")
def grid_cleared_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("code_muni"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("biome"), F.col("o_custkey").alias("uid"), F.col("o_totalprice").alias("km2"))
    return _rounded(grids.cleared_area(o), 2)


_ZONE = """WHEN state IN (22, 23, 24, 25, 26, 27) AND lat > -12 AND lon > -45 THEN 'BSh' WHEN state IN (41, 42, 43) AND lat < -23 THEN 'Cf' WHEN state = 33 AND lon > -44 THEN 'Cf'
WHEN state IN (31, 32, 35, 52, 53) AND lat < -15 THEN 'Cw' WHEN state IN (41, 42, 43) AND lat >= -23 THEN 'Cw' WHEN state IN (11, 12, 14, 17, 21, 50, 51, 52, 53) THEN 'Aw'
WHEN state IN (31, 35) AND lat >= -15 THEN 'Aw' WHEN state = 29 AND lat > -14 THEN 'Aw' WHEN state IN (21, 22, 26, 27, 28, 29) AND lon > -40 THEN 'As' WHEN state IN (13, 15, 16) THEN 'Am'
WHEN state IN (11, 12, 14, 16) AND lat > -5 THEN 'Af' WHEN lat > -23 THEN 'Aw' ELSE 'Cf'"""


@register("grid_climate_zone", f"SELECT c_custkey, CASE {_ZONE} END AS zone FROM (SELECT c_custkey, c_custkey % 43 + 11 AS state, -33 + c_custkey % 38 AS lat, -73.5 + c_custkey % 39 AS lon FROM customer)")
def grid_climate_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", grids.climate_zone(k % 43 + 11, -33 + k % 38, -73.5 + k % 39).alias("zone"))


#: Places whose series have holes, breaks, zeros and odd months.
_QUALITY_SERIES = """SELECT l_suppkey % 40 AS k, CAST(l_shipdate AS DATE) AS date, sum(CASE WHEN l_suppkey % 3 = 0 AND date_trunc('month', l_shipdate) IN (DATE '1996-03-01', DATE '1997-06-01', DATE '1998-01-01', DATE '1999-05-01') THEN 90 * l_quantity WHEN l_suppkey % 40 < 9 AND l_shipdate > DATE '1998-01-01' THEN 2 * l_quantity
 WHEN l_suppkey % 40 IN (11, 12) AND month(l_shipdate) = 2 THEN 0 WHEN l_partkey % 50 = 0 THEN NULL ELSE 0.001 + l_quantity END) AS v FROM lineitem GROUP BY ALL"""


@register("series_quality", f"""WITH d AS ({_QUALITY_SERIES}), c AS (SELECT k, count(*) AS n_obs, max(date) - min(date) + 1 AS n_expected FROM d GROUP BY 1), m AS (SELECT k, date_trunc('month', date) AS m, coalesce(sum(v), 0) AS s FROM d GROUP BY ALL), l AS (SELECT k, quantile_cont(s, 0.75) + 1.5 * (quantile_cont(s, 0.75) - quantile_cont(s, 0.25)) AS lim FROM m GROUP BY 1),
o AS (SELECT k, count(*) FILTER (WHERE s > lim) AS n_outlier_months FROM m JOIN l USING (k) GROUP BY 1), g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) - row_number() OVER (PARTITION BY k, coalesce(v, 0) = 0 ORDER BY date) AS g FROM d),
z AS (SELECT k, count(*) AS n_gaps FROM (SELECT k, count(*) AS n FROM g WHERE coalesce(v, 0) = 0 GROUP BY k, g) WHERE n > 2 GROUP BY 1), e AS (SELECT k, date, v - avg(v) OVER (PARTITION BY k) AS e, stddev_samp(v) OVER (PARTITION BY k) * sqrt(count(v) OVER (PARTITION BY k)) AS s FROM d WHERE v IS NOT NULL),
w AS (SELECT k, max(abs(p)) / nullif(first(s), 0) AS x FROM (SELECT k, s, sum(e) OVER (PARTITION BY k ORDER BY date) AS p FROM e) GROUP BY k), b AS (SELECT k, CASE WHEN x < 0.1 THEN 1.0 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * i * i * x * x))))) END AS p FROM w),
q AS (SELECT k, n_obs, n_expected, n_obs / n_expected AS share, CASE WHEN n_obs >= 30 THEN p END AS p, n_outlier_months, coalesce(n_gaps, 0) AS n_gaps FROM c LEFT JOIN o USING (k) LEFT JOIN z USING (k) LEFT JOIN b USING (k))
SELECT k, n_obs, CAST(n_expected AS BIGINT) AS n_expected, round(share, 4) AS completeness, p < 0.05 AS has_break, round(p, 6) AS break_pval, n_outlier_months, n_gaps,
 CAST(greatest(0, 100 - CASE WHEN share < 0.9 THEN round((1 - share) * 60) ELSE 0 END - CASE WHEN p < 0.05 THEN 25 ELSE 0 END - CASE WHEN n_outlier_months > 3 THEN 10 ELSE 0 END - 5 * least(n_gaps, 2)) AS BIGINT) AS score, share >= 0.9 AND NOT coalesce(p < 0.05, false) AND n_outlier_months <= 3 AND n_gaps = 0 AS include,
 concat_ws('; ', CASE WHEN share < 0.9 THEN 'completeness=' || CAST(round(100 * share) AS INTEGER) || '%' END, CASE WHEN p < 0.05 THEN 'break (p=' || printf('%.3f', p) || ')' END, CASE WHEN n_outlier_months > 3 THEN 'outlier_months=' || n_outlier_months END, CASE WHEN n_gaps > 0 THEN 'gaps>2d=' || n_gaps END) AS reasons FROM q""")
def series_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, k, date = F.col("l_quantity"), F.col("l_suppkey"), F.to_date("l_shipdate")
    odd = F.date_format("l_shipdate", "yyyy-MM").isin("1996-03", "1997-06", "1998-01", "1999-05")
    v = F.when((k % 3 == 0) & odd, 90 * q).when((k % 40 < 9) & (F.col("l_shipdate") > F.lit("1998-01-01").cast("timestamp")), 2 * q).when((k % 40).isin(11, 12) & (F.month("l_shipdate") == 2), 0.0).when(F.col("l_partkey") % 50 == 0, None).otherwise(0.001 + q)
    d = table(spark, sf_dir, "lineitem").groupBy((k % 40).alias("k"), date.alias("date")).agg(F.sum(v).alias("v"))
    return _rounded(quality.series_quality(d, "k", "date", "v", max_gap=2))


@register("station_missing", "SELECT user_id % 10 AS station, round(avg(CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE 0.0 END), 6) AS missing_v FROM events GROUP BY 1")
def station_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("station"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return _rounded(joins.station_missing_share(e, "station", ["v"]))


# --- fits: no SQL ---------------------------------------------------------------------------------


@register("fit_spi")
def fit_spi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.drought_spi(_monthly(spark, sf_dir), "station", "rain")


@register("fit_distributed_lag")
def fit_distributed_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    health, _ = _series(spark, sf_dir)
    raw = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("k"), F.col("l_shipdate").alias("date"), F.col("l_quantity").alias("x"))
    climate = exposure.daily(raw, "k", "date", ["x"])
    return fits.distributed_lag_model(health.groupBy("k", "date").agg(F.count("*").alias("n")), climate, "k", "n", "x", lags=5)


@register("fit_baseline")
def fit_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = aggregate.aggregate_series(table(spark, sf_dir, "orders"), "o_orderdate", "day", "count", ["o_orderstatus"])
    return fits.baseline(days, "o_orderstatus", "n", "1999-01-01")


@register("fit_interrupted_series")
def fit_interrupted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = aggregate.aggregate_series(table(spark, sf_dir, "orders"), "o_orderdate", "month", "count", ["o_orderpriority"])
    return fits.interrupted_series(models.interrupted_design(months, "date", "1998-01-01", 1), "o_orderpriority", "n", ["time", "step", "slope", "sin1", "cos1"])


@register("fit_pooled")
def fit_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = fit_interrupted_series(spark, sf_dir).where("term = 'slope'").withColumn("all", F.lit("all"))
    return fits.pooled(effects, "all", "estimate", "se")


@register("fit_poisson_bounds")
def fit_poisson_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.poisson_bounds(table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")), "n")
