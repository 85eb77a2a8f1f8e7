"""Registered queries of front ends, gap filling, matching, weights, models and catalogues, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codes, resolve, thermal
from .operators import aggregate, boosting, events, exposure, filters, fits, grids, indicators, inference, joins, models, quality, spatial, standardize
from .queries import _CLIMATE, _DAYS, _GRID, _HEALTH, _ICD, _KM, _MONTHLY, _days, _diagnoses, _lattice, _monthly, _rounded, _series, register, table

# --- records: from raw columns to a monthly series ------------------------------------------------

_ICD_OF = "chr(CAST(65 + o_custkey % 26 AS INTEGER)) || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0')"


def _raw_deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw death records: Latin-1 bytes, coded answers, dates as text."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    icd = F.concat(F.chr((65 + c % 26).cast("int")), F.lpad((k % 100).cast("string"), 2, "0"))
    place = F.when(c % 10 == 0, "000000").otherwise((c % 50 + 350000).cast("string"))
    return table(spark, sf_dir, "orders").select(
        k, F.encode(F.concat("o_orderpriority", F.lit(" São")), "ISO-8859-1").alias("BAIRRO"), F.date_format("o_orderdate", "ddMMyyyy").alias("DTOBITO"),
        (c % 4).cast("string").alias("SEXO"), (k % 7).cast("string").alias("RACACOR"), icd.alias("CAUSABAS"), place.alias("CODMUNOCOR"),
    )


@register("chain_clean_to_series", f"""WITH r AS (SELECT CAST(o_orderdate AS DATE) AS d, {_ICD_OF} AS icd, CASE o_custkey % 4 WHEN 1 THEN 'Masculino' WHEN 2 THEN 'Feminino' WHEN 0 THEN 'Ignorado' ELSE '3' END AS sexo, o_custkey % 50 + 350000 AS muni FROM orders WHERE o_custkey % 10 <> 0)
SELECT CAST(date_trunc('month', d) AS DATE) AS date, CAST(muni AS VARCHAR) AS codigo_municipio_ocorrencia, count(*) AS n FROM r WHERE regexp_matches(icd, '^I[0-9][0-9]') AND sexo IN ('Masculino', 'Feminino') GROUP BY ALL""")
def chain_clean_to_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = standardize.standardize(standardize.repair_columns(_raw_deaths(spark, sf_dir)), "SIM", language="pt")
    df = filters.filter_diagnosis(df, resolve.diagnosis_column(df.columns, "SIM"), group="cardiovascular")
    df = filters.filter_demographics(df, {"sexo": ["masculino", "feminino"]})
    place = resolve.place_column(df.columns, "SIM")
    return aggregate.aggregate_series(aggregate.drop_invalid_geo(df, place), resolve.date_column(df.dtypes, "SIM"), "month", "count", [place])


for _lang, _male, _female, _unknown, _races, _day, _race in (
    ("pt", "Masculino", "Feminino", "Ignorado", ("Branca", "Preta", "Amarela", "Parda", "Indígena"), "data_obito", "raca"),
    ("es", "Masculino", "Femenino", "Ignorado", ("Blanca", "Negra", "Amarilla", "Parda", "Indígena"), "fecha_muerte", "raza"),
):

    def _standard(spark: SparkSession, sf_dir: str, lang: str = _lang, day: str = _day, race: str = _race) -> DataFrame:
        return standardize.standardize(_raw_deaths(spark, sf_dir).drop("BAIRRO"), language=lang).select("o_orderkey", "sexo", race, day, "causa_basica")

    register(f"standardize_{_lang}", f"""SELECT o_orderkey, CASE o_custkey % 4 WHEN 1 THEN '{_male}' WHEN 2 THEN '{_female}' WHEN 0 THEN '{_unknown}' ELSE '3' END AS sexo, coalesce(['{"', '".join(_races)}'][(o_orderkey % 7)::INTEGER], CAST(o_orderkey % 7 AS VARCHAR)) AS {_race},
CAST(o_orderdate AS DATE) AS {_day}, {_ICD_OF} AS causa_basica FROM orders""")(_standard)


@register("standardize_dictionary", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'obras' WHEN 'MACHINERY' THEN 'maquinas' ELSE c_mktsegment END AS ramo FROM customer")
def standardize_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = spark.createDataFrame([("X", "pt", "c_mktsegment", None, "ramo"), ("X", "pt", "c_mktsegment", "BUILDING", "obras"), ("X", "pt", "c_mktsegment", "MACHINERY", "maquinas"), ("X", "en", "c_mktsegment", None, "segment"), ("Y", "pt", "c_name", None, "nome")], "system string, language string, column string, value string, standard string")
    return standardize.apply_dictionary(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), book, "X", "pt")


def _group_pattern(name: str) -> str:
    return f"^({'|'.join(codes.expand(codes.DISEASE_GROUPS[name]))})"


@register("cid_every_group", " UNION ALL ".join(f"SELECT '{g}' AS disease_group, {'false' if g in codes.NOT_CLIMATE else 'true'} AS climate, count(*) AS n FROM (SELECT {_ICD} AS icd FROM part) WHERE regexp_matches(icd, '{_group_pattern(g)}')" for g in codes.DISEASE_GROUPS))
def cid_every_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    icd = _diagnoses(spark, sf_dir)
    one = icd.agg(*[F.count_if(codes.matches(F.col("icd"), codes.group_codes(g))).alias(g) for g in codes.DISEASE_GROUPS])
    rows = F.array(*[F.struct(F.lit(g).alias("disease_group"), F.lit(climate).alias("climate"), F.col(g).alias("n")) for g, _, climate in codes.catalogue()])
    return one.select(F.explode(rows).alias("r")).select("r.*")


_SEASON_SQL = lambda wet, between, name: f"CASE WHEN month(o_orderdate) IN ({wet}) THEN 'rainy' WHEN month(o_orderdate) IN ({between}) THEN 'transition' ELSE 'dry' END AS {name}"


@register("calendar_regions", f"""SELECT o_orderkey, {_SEASON_SQL('12, 1, 2, 3, 4, 5', '6, 11', 'norte')}, {_SEASON_SQL('3, 4, 5, 6, 7', '2, 8', 'nordeste')}, {_SEASON_SQL('11, 12, 1, 2, 3', '4, 10', 'centro_oeste')}, {_SEASON_SQL('11, 12, 1, 2, 3', '4, 10', 'sudeste')},
CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) <= 5 THEN 'spring' WHEN month(o_orderdate) <= 8 THEN 'summer' ELSE 'autumn' END AS north FROM orders""")
def calendar_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import dates

    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", *[dates.climatic_season(d, r).alias(r.replace("-", "_")) for r in dates.CLIMATIC], dates.astronomical_season(d, "north").alias("north"))


@register("agg_by_window", "SELECT make_date(year(o_orderdate), (month(o_orderdate) - 1) // 4 * 4 + 1, 1) AS date, count(*) AS n FROM orders GROUP BY 1")
def agg_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.aggregate_series(table(spark, sf_dir, "orders"), "o_orderdate", "4 months")


# --- heat waves over all methods ------------------------------------------------------------------

_MORE_DAYS = f"days AS (SELECT *, tmax + 2 AS utci_max, (tmax + tmin) / 2 AS wbgt_max, tmean + 1 AS hi_max FROM ({_DAYS}))"
_SPREAD = "spread AS (SELECT station, ((dayofyear(date) - 1 + k) % 366 + 366) % 366 + 1 AS doy, tmax, tmin, utci_max, wbgt_max, hi_max FROM days, (SELECT unnest(range(-15, 16)) AS k))"
_P = lambda c: f"CASE WHEN count({c}) >= 10 THEN quantile_cont({c}, 0.9) END"
_RUN = lambda m, n: f"({m} AND count(*) OVER (PARTITION BY station, g_{m}) >= {n})"
_GROUPED = lambda m: f"sum(new_{m}) OVER (PARTITION BY station ORDER BY date) AS g_{m}"
_NEW = lambda m: f"CASE WHEN {m} IS DISTINCT FROM lag({m}) OVER w THEN 1 ELSE 0 END AS new_{m}"
_METHODS = {"WHO": 3, "WMO": 5, "INMET": 5, "EHF": 3, "UTCI": 3, "WBGT": 3, "HI": 3}
_waves_sql = lambda spread: f"""WITH {_MORE_DAYS}, {spread},
base AS (SELECT station, doy, {_P('tmax')} AS tmax_p, CASE WHEN count(tmax) >= 10 THEN quantile_cont(tmin, 0.9) END AS tmin_p, avg(tmax) AS tmax_hist, {_P('utci_max')} AS u, {_P('wbgt_max')} AS b, {_P('hi_max')} AS h FROM spread GROUP BY ALL),
lim AS (SELECT station, quantile_cont(tmean, 0.95) AS limit95 FROM days GROUP BY 1),
f AS (SELECT station, date, (t3 - limit95) * greatest(1, t3 - t30) AS factor FROM (SELECT station, date, CASE WHEN count(tmean) OVER a = 3 THEN avg(tmean) OVER a END AS t3, avg(tmean) OVER c AS t30 FROM days WINDOW a AS (PARTITION BY station ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), c AS (PARTITION BY station ORDER BY date ROWS BETWEEN 32 PRECEDING AND 3 PRECEDING)) JOIN lim USING (station)),
e AS (SELECT station, date, coalesce(max(CASE WHEN factor > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 0) = 1 AS EHF FROM f),
x AS (SELECT d.station, d.date, coalesce(d.tmax > tmax_p, false) AS WHO, coalesce(d.tmax > tmax_p AND d.tmin > tmin_p, false) AS WMO, coalesce(d.tmax > tmax_hist + 5, false) AS INMET, coalesce(EHF, false) AS EHF, coalesce(d.utci_max > u, false) AS UTCI, coalesce(d.wbgt_max > b, false) AS WBGT, coalesce(d.hi_max > h, false) AS HI
 FROM days d LEFT JOIN base ON base.station = d.station AND base.doy = dayofyear(d.date) LEFT JOIN e ON e.station = d.station AND e.date = d.date),
n AS (SELECT *, {', '.join(map(_NEW, _METHODS))} FROM x WINDOW w AS (PARTITION BY station ORDER BY date)), g AS (SELECT *, {', '.join(map(_GROUPED, _METHODS))} FROM n),
k AS (SELECT station, date, {', '.join(f'{_RUN(m, n)} AS {m}' for m, n in _METHODS.items())} FROM g), flags AS (SELECT *, {' OR '.join(_METHODS)} AS any_method FROM k)"""  # noqa: E731
_WAVES = _waves_sql(_SPREAD)


def _more_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).withColumns({"utci_max": F.col("tmax") + 2, "wbgt_max": (F.col("tmax") + F.col("tmin")) / 2, "hi_max": F.col("tmean") + 1})


def _waves(spark: SparkSession, sf_dir: str, **period) -> DataFrame:
    return events.waves(_more_days(spark, sf_dir), "station", list(_METHODS), **period).withColumnRenamed("any", "any_method")


@register("heat_methods", f"{_WAVES} SELECT station, date, {', '.join(_METHODS)}, any_method FROM flags")
def heat_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _waves(spark, sf_dir).select("station", "date", *_METHODS, "any_method")


_PERIOD = {"first": "1996-02-01", "last": "1998-06-30"}
_OF_PERIOD = _SPREAD.replace("FROM days,", f"FROM (SELECT * FROM days WHERE date BETWEEN DATE '{_PERIOD['first']}' AND DATE '{_PERIOD['last']}'),")


@register("heat_baseline_period", f"{_waves_sql(_OF_PERIOD)} SELECT station, date, {', '.join(_METHODS)}, any_method FROM flags")
def heat_baseline_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _waves(spark, sf_dir, **_PERIOD).select("station", "date", *_METHODS, "any_method")


_MEASURED = {"WHO": ("tmax", "tmax_p"), "WMO": ("tmax", "tmax_p"), "INMET": ("tmax", "tmax_hist"), "EHF": ("tmean", "tmean"), "UTCI": ("utci_max", "u"), "WBGT": ("wbgt_max", "b"), "HI": ("hi_max", "h")}
_EVENT_ROWS = " UNION ALL ".join(
    f"SELECT k.station, '{m}' AS method, g_{m} AS g, k.date, d.{v} AS value, d.{v} - {'d' if r in ('tmean',) else 'base'}.{r} AS anomaly, {'f.factor' if m == 'EHF' else 'NULL::DOUBLE'} AS factor FROM long k JOIN days d USING (station, date) LEFT JOIN base ON base.station = d.station AND base.doy = dayofyear(d.date) LEFT JOIN f ON f.station = d.station AND f.date = d.date WHERE k.{m}"
    for m, (v, r) in _MEASURED.items()
)


@register("heat_event_classes", f"""{_waves_sql(_SPREAD).replace('k AS (SELECT station, date,', 'long AS (SELECT station, date, ' + ', '.join(f'g_{m}' for m in _METHODS) + ', ' + ', '.join(f'{_RUN(m, 2)} AS {m}' for m in _METHODS) + ' FROM g), k AS (SELECT station, date,')},
rows AS ({_EVENT_ROWS}),
ev AS (SELECT station, method, min(date) AS start_date, max(date) AS end_date, max(date) - min(date) + 1 AS duration_days, avg(value) AS temp_mean, max(value) AS temp_peak, avg(anomaly) AS anomaly_mean, sum(anomaly) AS anomaly_cumulative, max(factor) AS ehf_peak, avg(factor) AS ehf_mean FROM rows GROUP BY station, method, g),
p AS (SELECT quantile_cont(factor, 0.85) AS p85 FROM f WHERE factor > 0 AND station IN (SELECT station FROM ev WHERE method = 'EHF'))
SELECT station, method, start_date, end_date, CAST(duration_days AS INTEGER) AS duration_days, round(temp_mean, 6) AS temp_mean, round(temp_peak, 6) AS temp_peak, round(anomaly_mean, 6) AS anomaly_mean, round(anomaly_cumulative, 6) AS anomaly_cumulative, round(ehf_peak, 6) AS ehf_peak, round(ehf_mean, 6) AS ehf_mean,
 round(duration_days * anomaly_mean, 6) AS severity_index, station || '_' || method || '_' || row_number() OVER (PARTITION BY method ORDER BY start_date, station) AS event_id,
 CASE WHEN ehf_peak >= 3 * p85 THEN 'Extreme (EHW)' WHEN ehf_peak >= p85 THEN 'Severe (SHW)' WHEN ehf_peak > 0 THEN 'Low Intensity (LIHW)' END AS intensity_class FROM ev, p""")
def heat_event_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = list(_METHODS)
    return _rounded(events.method_events(events.wave_days(_more_days(spark, sf_dir), "station", methods, least=2), "station", methods))


@register("heat_active_days", f"{_WAVES} SELECT station, year(date) AS year, count(*) AS n_days, min(date) AS first, max(date) AS last FROM flags WHERE any_method GROUP BY ALL")
def heat_active_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.active_days(_waves(spark, sf_dir), "any_method", "station")


# --- drought index, comfort intervals, daily range ------------------------------------------------


def _quantile_sql(p: str) -> str:
    a = "((((((-39.69683028665376) * r + 220.9460984245205) * r + -275.9285104469687) * r + 138.3577518672690) * r + -30.66479806614716) * r + 2.506628277459239)"
    b = "((((((-54.47609879822406) * r + 161.5858368580409) * r + -155.6989798598866) * r + 66.80131188771972) * r + -13.28068155288572) * r + 1.0)"
    c = "((((((-0.007784894002430293) * t + -0.3223964580411365) * t + -2.400758277161838) * t + -2.549732539343734) * t + 4.374664141464968) * t + 2.938163982698783)"
    d = "(((((0.007784695709041462) * t + 0.3224671290700398) * t + 2.445134137142996) * t + 3.754408661907416) * t + 1.0)"
    tail = lambda x: f"({c.replace(' t ', f' {x} ')} / {d.replace(' t ', f' {x} ')})"
    middle = f"(({p} - 0.5) * {a.replace(' r ', f' (({p} - 0.5) * ({p} - 0.5)) ')} / {b.replace(' r ', f' (({p} - 0.5) * ({p} - 0.5)) ')})"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} <= 0.97575 THEN {middle} ELSE -{tail(f'sqrt(-2 * ln(1 - {p}))')} END"


@register("drought_spei", f"""WITH m AS (SELECT station, date, rain - 10 * t AS b FROM ({_MONTHLY})), r AS (SELECT station, date, CASE WHEN count(b) OVER w = 3 THEN sum(b) OVER w END AS rolling FROM m WINDOW w AS (PARTITION BY station ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
c AS (SELECT station, date, rolling, (SELECT count(*) FROM r i WHERE i.station = r.station AND i.date <= DATE '1999-12-31' AND i.rolling <= r.rolling) AS rank, count(CASE WHEN date <= DATE '1999-12-31' THEN rolling END) OVER (PARTITION BY station) AS n FROM r),
p AS (SELECT *, greatest(1e-6, least(1 - 1e-6, (rank - 0.5) / n)) AS p FROM c) SELECT station, date, CASE WHEN rolling IS NOT NULL AND n >= 24 THEN round({_quantile_sql('p')}, 6) END AS spei FROM p""")
def drought_spei(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _monthly(spark, sf_dir).withColumn("pet", 10 * F.col("t"))
    return _rounded(events.drought_spei(m, "station", "rain", "pet", last="1999-12-31").select("station", "date", "spei"))


@register("index_interval", f"""WITH e AS (SELECT event_id, value AS t FROM events), d AS (SELECT event_id, t, list_sort(list_transform(range(1, 201), lambda i: round(greatest(t + 0.5 * ({_quantile_sql('((0.5 + i * 0.6180339887498949) % 1.0 * 0.999999 + 5e-7)')}) - 18, 0), 1))) AS s FROM e)
SELECT event_id, round(s[5] * 0.025 + s[6] * 0.975, 2) AS low, round(s[195] * 0.975 + s[196] * 0.025, 2) AS high FROM (SELECT event_id, list_transform(s, lambda x: x) AS s FROM d)""")
def index_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = thermal.interval(thermal.cooling_degrees, {"t": F.col("value")}, {"t": 0.5})
    # draws are work of the processor on a small file, which would be one task
    rows = table(spark, sf_dir, "events").select("event_id", "value").repartition(4 * spark.sparkContext.defaultParallelism)
    return rows.select("event_id", both.alias("both")).select("event_id", "both.low", "both.high")


@register("diurnal_range", """WITH d AS (SELECT user_id % 10 AS station, CAST(ts AS DATE) AS date, avg(event_id % 5 + 1.0) AS gap, max(value + event_id % 5) - min(value - 1) AS extremes, max(value) - min(value) AS plain FROM events GROUP BY ALL), s AS (SELECT station, stddev_samp(gap) AS sd FROM d GROUP BY 1)
SELECT station, date, round(CASE WHEN sd > 0.5 THEN extremes ELSE plain END, 2) AS diurnal_range FROM d JOIN s USING (station)""")
def diurnal_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, k = F.col("value"), F.col("event_id") % 5
    df = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("station"), "ts", (v + k).alias("tair_max_c"), (v - 1).alias("tair_min_c"), v.alias("tair_dry_bulb_c"))
    return quality.diurnal_range(df, "station", "ts")


# --- reports --------------------------------------------------------------------------------------


@register("report_places", """WITH c AS (SELECT CASE WHEN o_custkey % 10 > 0 THEN CAST(o_custkey % 50 + 350000 AS VARCHAR) END AS code, count(*) AS n FROM orders GROUP BY 1)
SELECT code, n, (SELECT count(code) FROM c) AS n_municipalities, (SELECT count(DISTINCT substr(code, 1, 2)) FROM c) AS n_states, CAST((SELECT coalesce(sum(n), 0) FROM c WHERE code IS NULL) AS BIGINT) AS n_missing FROM c WHERE code IS NOT NULL ORDER BY n DESC, code LIMIT 10""")
def report_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.place_report(_raw_deaths(spark, sf_dir).withColumn("place", F.when(F.col("CODMUNOCOR") != "000000", F.col("CODMUNOCOR"))), "place")


@register("report_derived", f"""SELECT unnest(['{"', '".join(quality.DERIVED)}']) AS variable, unnest([{', '.join('true' if v in ('year', 'month', 'age_years') else 'false' for v in quality.DERIVED)}]) AS present,
unnest([{', '.join({'year': 'n', 'month': 'n', 'age_years': 'k'}.get(v, '0') for v in quality.DERIVED)}]) AS n_known FROM (SELECT count(*) AS n, count(*) FILTER (WHERE o_custkey % 3 <> 0) AS k FROM orders)""")
def report_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.when(F.col("o_custkey") % 3 != 0, F.lit(30)).alias("age_years"))
    return quality.derived_presence(df)


@register("report_all", """WITH r AS (SELECT CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 4 END AS sex, CAST(o_orderdate AS DATE) AS date, chr(CAST(65 + o_custkey % 26 AS INTEGER)) || CASE WHEN o_custkey % 9 = 0 THEN 'x' ELSE '1' END || '2' AS icd, o_custkey % 50 + 350000 AS place FROM orders),
a AS (SELECT count(*) AS n, 100.0 * count(*) FILTER (WHERE sex IS NULL) / count(*) AS ms, 0.0 AS md, 0.0 AS mi, 0.0 AS mp, 100.0 * count(*) FILTER (WHERE sex IS NOT NULL) / count(*) AS ks, 100.0 AS kp, 100.0 AS dates, 100.0 * count(*) FILTER (WHERE regexp_matches(icd, '^[A-Z][0-9]{2}')) / count(*) AS dx FROM r),
p AS (SELECT *, 100 * ((CASE WHEN ms < 5 THEN 1.0 WHEN ms < 20 THEN 0.5 ELSE 0 END) + 3) / 4 AS comp FROM a)
SELECT unnest(['overview', 'missing', 'missing', 'missing', 'missing', 'demographics', 'places', 'parts', 'parts', 'parts', 'parts', 'score']) AS section, unnest(['rows', 'sex', 'date', 'icd', 'place', 'sex', 'place', 'completeness', 'dates', 'diagnosis', 'demographics', 'score']) AS item,
round(unnest([CAST(n AS DOUBLE), ms, md, mi, mp, ks, kp, comp, dates, dx, ks, 0.4 * comp + 0.2 * dates + 0.2 * dx + 0.2 * ks]), 6) AS value FROM p""")
def report_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    icd = F.concat(F.chr((65 + c % 26).cast("int")), F.when(c % 9 == 0, "x").otherwise("1"), F.lit("2"))
    df = table(spark, sf_dir, "orders").select(F.when(k % 11 > 0, (k % 4).cast("string")).alias("sex"), F.to_date("o_orderdate").alias("date"), icd.alias("icd"), (c % 50 + 350000).alias("place"))
    return _rounded(quality.quality_report(df, "icd", "date", ["sex"], "place"))


# --- gap filling ----------------------------------------------------------------------------------


@register("gap_transforms", "SELECT event_id, round(ln(1 + value), 6) AS rainfall_mm, round(sqrt(value), 6) AS ws_2_m_s, round(value, 6) AS rh_mean_porc, round(greatest(value - 60, 0) * greatest(value - 60, 0), 6) AS back FROM events")
def gap_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    columns = {c: quality.transformed(v, quality.transform_of(c)) for c in ("rainfall_mm", "ws_2_m_s", "rh_mean_porc")}
    return _rounded(table(spark, sf_dir, "events").select("event_id", *[x.alias(c) for c, x in columns.items()], quality.restored(v - 60, "sqrt").alias("back")))


@register("gap_smoothing", """WITH e AS (SELECT event_id, user_id % 10 AS s, value AS v, CASE WHEN event_id % 40 = 0 THEN value * 100 ELSE value END AS p FROM events), q AS (SELECT s, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, avg(v) AS m FROM e GROUP BY 1)
SELECT event_id, round(CASE WHEN p < a - 5 * (b - a) OR p > b + 5 * (b - a) THEN 0.3 * m + 0.7 * p ELSE p END, 6) AS p FROM e JOIN q USING (s)""")
def gap_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    df = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("s"), v.alias("v"), F.when(F.col("event_id") % 40 == 0, v * 100).otherwise(v).alias("p"))
    return _rounded(quality.smooth_extremes(df, "p", "v", ["s"]).select("event_id", "p"))


@register("gap_nights", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN hour(ts) >= 18 OR hour(ts) < 6 THEN 0.0 END ELSE value END AS sr_kj_m2 FROM events")
def gap_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("sr_kj_m2"))
    return quality.zero_nights(df, "ts").select("event_id", "sr_kj_m2")


def _injected(mechanism: str, depends: list[str] | None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Rows that lost their value and rows that kept it, with the means of the truth and of what gaps depend on."""
        df = table(spark, sf_dir, "events").select("event_id", "value", (F.col("value") + F.col("event_id") % 7).alias("other"))
        out = quality.inject_gaps(df, "value", ["event_id"], 0.2, mechanism, depends)
        return out.groupBy(F.col("value").isNull().alias("gap")).agg(F.count("*").alias("n"), F.avg("value_truth").alias("truth"), F.avg("other").alias("other"), F.stddev_samp("value_truth").alias("spread"))

    return run


for _mechanism, _depends in (("MCAR", None), ("MAR", ["other"]), ("MNAR", None)):
    register(f"gap_injection_{_mechanism.lower()}")(_injected(_mechanism, _depends))


@register("gap_filling")
def gap_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("station"), "ts", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("v"))
    return boosting.fill_gaps(df, "station", "ts", "v", rounds=10)


@register("gap_time_features", "SELECT event_id, hour(ts) AS hour, isodow(ts) AS day_of_week, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * dayofyear(ts) / 365.25), 6) AS day_cos, hour(ts) >= 18 OR hour(ts) < 6 AS is_night FROM events")
def gap_time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.time_features(table(spark, sf_dir, "events"), "ts").select("event_id", "hour", "day_of_week", "hour_sin", "day_cos", "is_night"))


# --- grids ----------------------------------------------------------------------------------------


@register("grid_zone_by_area", "WITH a AS (SELECT o_custkey % 50 AS code_muni, o_orderstatus AS zone, sum(o_orderkey % 100 + 1) AS km2 FROM orders GROUP BY ALL) SELECT code_muni, first(zone ORDER BY km2 DESC, zone) AS zone, CAST(sum(km2) AS DOUBLE) AS area_km2 FROM a GROUP BY 1")
def grid_zone_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("code_muni"), F.col("o_orderstatus").alias("zone"), (F.col("o_orderkey") % 100 + 1).cast("double").alias("km2"))
    return grids.zone_by_area(df)


@register("grid_pollutant_fallback", """WITH d AS (SELECT user_id AS code_muni, CAST(ts AS DATE) AS date, avg(value) AS value FROM events GROUP BY ALL), y AS (SELECT code_muni, CAST(date_trunc('year', date) AS DATE) AS date, avg(value) AS value FROM d GROUP BY ALL)
SELECT code_muni, date, 'pm25' AS pollutant, round(value, 6) AS value, 'daily' AS resolution FROM d UNION ALL SELECT code_muni, date, 'o3', round(value, 6), 'annual' FROM y UNION ALL SELECT code_muni, date, 'no2', round(value + 1, 6), 'annual' FROM y""")
def grid_pollutant_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("code_muni"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("value"))
    y = d.groupBy("code_muni", F.trunc("date", "year").alias("date")).agg(F.avg("value").alias("value"))
    panels = {("pm25", "daily"): d, ("o3", "annual"): y, ("no2", "annual"): y.withColumn("value", F.col("value") + 1)}
    return _rounded(grids.pollutant_panel(panels, ["pm25", "o3", "no2"], "daily"))


@register("grid_drought", """WITH c AS (SELECT user_id AS cell, CAST(ts AS DATE) AS date, avg(value) / 20 - 3 AS pdsi FROM events GROUP BY ALL), z AS (SELECT cell % 12 AS code_muni, date, sum((cell % 5 + 1) * pdsi) / sum(cell % 5 + 1) AS pdsi FROM c GROUP BY ALL)
SELECT code_muni, date, round(pdsi, 6) AS pdsi, CASE WHEN pdsi <= -4 THEN 'extreme drought' WHEN pdsi <= -3 THEN 'severe drought' WHEN pdsi <= -2 THEN 'moderate drought' WHEN pdsi <= -1 THEN 'mild drought' WHEN pdsi < 1 THEN 'normal' WHEN pdsi < 2 THEN 'slightly wet' WHEN pdsi < 3 THEN 'moderately wet' WHEN pdsi < 4 THEN 'very wet' ELSE 'extremely wet' END AS class FROM z""")
def grid_drought(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell"), F.to_date("ts").alias("date")).agg((F.avg("value") / 20 - 3).alias("pdsi"))
    weights = table(spark, sf_dir, "events").select(F.col("user_id").alias("cell")).distinct().select("cell", (F.col("cell") % 12).alias("code_muni"), (F.col("cell") % 5 + 1).alias("w"))
    return _rounded(grids.drought_severity(cells, weights))


@register("grid_daily_reanalysis", """SELECT user_id % 10 AS code_muni, CAST(ts AS DATE) AS date, round(avg(value + 250) - 273.15, 9) AS tair_dry_bulb_c, round(max(value + 255) - 273.15, 9) AS tair_max_c, round(min(value + 245) - 273.15, 9) AS tair_min_c, round(avg(value + 240) - 273.15, 9) AS dew_point_c,
round(avg(value), 9) AS ws_10m_u_m_s, round(avg(-value), 9) AS ws_10m_v_m_s, round(avg(value * 1000) * 0.01, 9) AS patm_hpa, round(sum(value / 1000) * 1000, 9) AS rainfall_mm FROM events GROUP BY ALL""")
def grid_daily_reanalysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    raw = {"t2m": v + 250, "t2m_max": v + 255, "t2m_min": v + 245, "td2m": v + 240, "u10": v, "v10": -v, "sp": v * 1000, "tp": v / 1000}
    return _rounded(grids.daily_reanalysis(table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("code_muni"), "ts", *[x.alias(c) for c, x in raw.items()])), 9)


# --- joins and matches ----------------------------------------------------------------------------


@register("join_level", "SELECT c_custkey, area FROM customer JOIN (SELECT n_nationkey, 'area ' || (n_nationkey % 4) AS area, CASE n_nationkey % 3 WHEN 0 THEN 'semiarid' END AS level FROM nation) ON n_nationkey = c_nationkey AND level = 'semiarid'")
def join_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lambda c: F.concat((F.col(c) + 300000).cast("string"), F.lit("7"))
    health = table(spark, sf_dir, "customer").select("c_custkey", code("c_nationkey").alias("muni"))
    n = F.col("n_nationkey")
    levels = table(spark, sf_dir, "nation").select((n + 300000).alias("code_muni"), F.when(n % 3 == 0, "Semiarid").otherwise("other").alias("level"), F.concat(F.lit("area "), (n % 4).cast("string")).alias("area"))
    return joins.level_join(health, None, levels, "muni", "semiarid").select("c_custkey", "area")


@register("join_facility", "SELECT o_orderkey, s_name, s_acctbal FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey % 150")
def join_facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("facility_code"), "s_name", "s_acctbal", F.lit("2024-01-01").alias("update_date"))
    old = s.withColumns({"s_name": F.lit("old"), "update_date": F.lit("2020-01-01")})
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 150).cast("string").alias("facility_code"))
    return joins.facility_join(orders, s.unionByName(old)).select("o_orderkey", "s_name", "s_acctbal")


@register("join_grid", "WITH g AS (SELECT l_linenumber AS code_muni, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT o_orderkey, o_totalprice AS v, round(g.v, 6) AS v_grid FROM orders LEFT JOIN g ON code_muni = o_custkey % 7 + 1 AND date = CAST(o_orderdate AS DATE)")
def join_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("code_muni"), F.to_date("l_shipdate").alias("date")).agg(F.avg("l_quantity").alias("v"))
    health = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"), (F.col("o_custkey") % 7 + 1).alias("code_muni"), F.to_date("o_orderdate").alias("date"))
    return health.transform(joins.grid_join, grid).select("o_orderkey", "v", F.round("v_grid", 6).alias("v_grid"))


_CENSUS = {"sum": "sum(c_acctbal)", "mean": "avg(c_acctbal)", "median": "median(c_acctbal)", "min": "min(c_acctbal)", "max": "max(c_acctbal)", "sd": "stddev_samp(c_acctbal)", "q25": "quantile_cont(c_acctbal, 0.25)", "q75": "quantile_cont(c_acctbal, 0.75)", "q95": "quantile_cont(c_acctbal, 0.95)", "q99": "quantile_cont(c_acctbal, 0.99)"}


@register("census_join_functions", f"SELECT s_suppkey, {', '.join(f'round({s}, 4) AS c_acctbal_{n}' for n, s in _CENSUS.items())} FROM supplier JOIN customer ON s_nationkey = c_nationkey GROUP BY s_suppkey")
def census_join_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    census = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("s_nationkey"), "c_acctbal")
    df = table(spark, sf_dir, "supplier").join(census.select("s_nationkey").distinct(), "s_nationkey")
    for fun in _CENSUS:
        df = joins.census_join(df, census, "s_nationkey", fun)
    return _rounded(df.select("s_suppkey", *[f"c_acctbal_{f}" for f in _CENSUS]), 4)


@register("station_match", f"""WITH a AS (SELECT n_nationkey, -30 + n_nationkey * 1.1 AS lat, -70 + (n_nationkey * 7 % 25) * 1.3 AS lon FROM nation), b AS (SELECT s_suppkey, -32 + (s_suppkey * 37 % 300) / 10.0 AS lat, -72 + (s_suppkey * 53 % 360) / 10.0 AS lon FROM supplier),
q AS (SELECT l_suppkey AS s_suppkey, avg(CASE WHEN l_partkey % 3 > 0 OR l_linenumber % 2 = 0 THEN 1.0 ELSE 0.0 END) AS quality FROM lineitem GROUP BY 1),
r AS (SELECT n_nationkey, b.s_suppkey, round({_KM}, 6) AS distance_km, quality FROM a CROSS JOIN b JOIN q ON q.s_suppkey = b.s_suppkey WHERE quality >= 0.8)
SELECT n_nationkey, s_suppkey, distance_km, round(quality, 6) AS quality, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY distance_km, s_suppkey) AS INTEGER) AS nth FROM r QUALIFY nth <= 3""")
def station_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").select("n_nationkey", (-30 + F.col("n_nationkey") * 1.1).alias("lat"), (-70 + (F.col("n_nationkey") * 7 % 25) * 1.3).alias("lon"))
    stations = table(spark, sf_dir, "supplier").select("s_suppkey", (-32 + (F.col("s_suppkey") * 37 % 300) / 10.0).alias("lat"), (-72 + (F.col("s_suppkey") * 53 % 360) / 10.0).alias("lon"))
    readings = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.when(F.col("l_partkey") % 3 > 0, 1).alias("t"), F.when(F.col("l_linenumber") % 2 == 0, 1).alias("rh"))
    return _rounded(joins.match_stations(places, stations, joins.station_quality(readings, "s_suppkey", ["t", "rh"], "any"), "n_nationkey", "s_suppkey", least=0.8))


@register("station_coordinates", "SELECT event_id, CAST(user_id % 10 AS DOUBLE) AS lat, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN user_id % 10 + 40.0 ELSE user_id % 10 + 40.0 END AS lon FROM events")
def station_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("event_id"), (F.col("user_id") % 10).cast("double")
    bad = F.when(k % 3 == 0, None).when(k % 5 == 0, 999.0)
    df = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("station"), F.when((k % 3 == 0) | (k % 5 == 0), bad).otherwise(s).alias("lat"), F.when((k % 3 == 0) | (k % 5 == 0), bad).otherwise(s + 40).alias("lon"))
    known = spark.range(10).select(F.col("id").alias("station"), F.col("id").cast("double").alias("lat"), (F.col("id") + 40.0).alias("lon")).unionByName(spark.createDataFrame([(1, 0.0, 0.0)], "station bigint, lat double, lon double"))
    return joins.recover_coordinates(df, known, "station").select("event_id", "lat", "lon")


@register("clim_front_end", f"""WITH c AS ({_CLIMATE}), h AS ({_HEALTH}) SELECT h.o_orderkey, h.k, h.date, CASE WHEN count(x) / 4.0 >= 0.7 THEN round(avg(x), 6) END AS x_mean_w3 FROM h LEFT JOIN c ON c.k = h.k AND c.date BETWEEN h.date - 3 AND h.date GROUP BY ALL""")
def clim_front_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    health, _ = _series(spark, sf_dir)
    raw = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("station"), F.col("l_shipdate").alias("time"), F.col("l_quantity").alias("x"))
    places = health.select("k").distinct().select("k", F.concat(F.lit("S"), F.col("k").cast("string")).alias("station"))
    return _rounded(exposure.join_climate(health, raw, "k", "time", ["x"], "moving_window", places, days=3))


# --- indicators -----------------------------------------------------------------------------------

_INPUTS = ["pop_young", "pop_elderly", "pop_working", "pop_urban", "pop_total", "pop_illiterate", "pop_15_plus", "hh_water", "total_hh", "hh_sewage", "gini_value", "deaths_infant", "live_births", "deaths_maternal", "deaths_dcn_30_69", "pop_30_69", "deaths_homicide", "deaths_traffic", "cases_arbovirus", "cases_tb_new", "hosp_icsap", "hosp_resp", "births_low_weight", "pop_women_15_49", "deliveries_cesarean", "total_deliveries", "prenatal_early", "cnes_beds", "cnes_doctors"]
_WHOLE = {"pop_total", "pop_15_plus", "total_hh", "live_births", "total_deliveries", "pop_working", "pop_young", "pop_30_69", "pop_women_15_49"}
_INPUT_SQL = ", ".join(f"{f'1000 + s_suppkey * {k + 3} % 997' if c in _WHOLE else f'1 + s_suppkey * {k + 3} % 89'} AS {c}" for k, c in enumerate(_INPUTS))


@register("indicator_catalogue", f"WITH d AS (SELECT s_suppkey, {_INPUT_SQL} FROM supplier) SELECT s_suppkey, {', '.join(f'round({m} * ({a}) / CAST({b} AS DOUBLE), 6) AS {n}' for n, (a, b, m, _) in indicators.CATALOGUE.items())} FROM d")
def indicator_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    df = table(spark, sf_dir, "supplier").select("s_suppkey", *[(1000 + s * (k + 3) % 997 if c in _WHOLE else 1 + s * (k + 3) % 89).alias(c) for k, c in enumerate(_INPUTS)])
    return _rounded(indicators.compute_indicators(df, intervals=False).select("s_suppkey", *indicators.CATALOGUE))


_NAMES = ["V01_Idade", "renda_mensal", "household_water", "anos_escola", "ocupacao", "municipio", "V9", "nasceu_aqui", "saude_geral"]


@register("census_subjects", f"SELECT p_partkey, name, CASE {' '.join(f"WHEN regexp_matches(lower(name), '{'|'.join(parts)}') THEN '{s}'" for s, parts in codes.SUBJECTS.items())} ELSE 'other' END AS subject FROM (SELECT p_partkey, [{', '.join(repr(n) for n in _NAMES)}][CAST(p_partkey % {len(_NAMES)} AS INTEGER) + 1] AS name FROM part)")
def census_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES)).cast("int") + 1)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("subject", codes.subject(F.col("name")))


@register("indicator_pyramid", """WITH c AS (SELECT CAST(o_custkey % 90 // 10 * 10 AS VARCHAR) || '-' || CAST(o_custkey % 90 // 10 * 10 + 9 AS VARCHAR) AS age_group, CASE o_orderkey % 4 WHEN 1 THEN 'male' WHEN 2 THEN 'female' END AS sex, count(*) AS n FROM orders GROUP BY ALL)
SELECT age_group, sex, n, round(100.0 * n / sum(n) OVER (PARTITION BY sex), 1) AS pct, CASE WHEN sex = 'male' THEN -n ELSE n END AS n_signed, CAST(regexp_extract(age_group, '^[0-9]+') AS INTEGER) AS position FROM c WHERE sex IS NOT NULL""")
def indicator_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = (F.floor(F.col("o_custkey") % 90 / 10) * 10).cast("int")
    df = table(spark, sf_dir, "orders").select(F.concat_ws("-", low.cast("string"), (low + 9).cast("string")).alias("g"), (F.col("o_orderkey") % 4).cast("string").alias("s"))
    return indicators.pyramid(df, "g", "s")


@register("heat_calendar", f"{_WAVES} SELECT flags.station, year(flags.date) AS year, month(flags.date) AS month, count(*) FILTER (WHERE any_method) AS n_days, round(avg(CASE WHEN any_method THEN tmax END), 6) AS mean_value, count(*) AS n_seen FROM flags JOIN days ON days.station = flags.station AND days.date = flags.date GROUP BY ALL")
def heat_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(indicators.event_calendar(_waves(spark, sf_dir), "any_method", "station", "tmax"))


@register("gap_calendar", "SELECT user_id % 10 AS station, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n_values, count(*) FILTER (WHERE event_id % 7 = 0) AS n_imputed, round(avg(CASE WHEN event_id % 7 = 0 THEN value END), 6) AS mean_imputed, round(avg(CASE WHEN event_id % 7 > 0 THEN value END), 6) AS mean_observed FROM events GROUP BY ALL")
def gap_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("station"), "ts", F.col("value").alias("v"), (F.col("event_id") % 7 == 0).alias("is_imputed_v"))
    return _rounded(indicators.gap_calendar(df, "station", "ts", "v"))


# --- models ---------------------------------------------------------------------------------------


@register("model_sensitivity", """WITH c AS (SELECT l_linenumber AS k, floor(l_quantity) AS x, avg(l_discount + l_quantity / 200) AS y FROM lineitem GROUP BY ALL), v AS (SELECT k, max(y) FILTER (WHERE x = 45) AS hot, max(y) FILTER (WHERE x = 5) AS cold FROM c GROUP BY 1)
SELECT k, round(exp(hot), 6) AS hot_rr, round(exp(cold), 6) AS cold_rr, round(hot + cold, 6) AS sensitivity_index, CAST(rank() OVER (ORDER BY hot DESC) AS INTEGER) AS hot_rank, CAST(rank() OVER (ORDER BY cold DESC) AS INTEGER) AS cold_rank FROM v""")
def model_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k"), F.floor("l_quantity").cast("double").alias("exposure")).agg(F.avg(F.col("l_discount") + F.col("l_quantity") / 200).alias("log_rr"))
    at = lambda x: curves.select("k").distinct().withColumn("point", F.lit(float(x)))
    return _rounded(models.sensitivity_ranking(curves, "k", at(45), at(5)))


@register("model_pillars", """WITH d AS (SELECT c_nationkey AS k, avg(c_acctbal) AS e, CAST(count(*) AS DOUBLE) AS s, max(c_acctbal) AS a FROM customer GROUP BY 1), z AS (SELECT k, (e - avg(e) OVER ()) / stddev_samp(e) OVER () AS e, (s - avg(s) OVER ()) / stddev_samp(s) OVER () AS s, -(a - avg(a) OVER ()) / stddev_samp(a) OVER () AS a FROM d)
SELECT k, round((2 * e + s) / 3, 6) AS exposure, round(a, 6) AS capacity FROM z""")
def model_pillars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("e"), F.count("*").cast("double").alias("s"), F.max("c_acctbal").alias("a"))
    return _rounded(models.weighted_pillars(d, "k", {"exposure": {"e": 2.0, "s": 1.0}, "capacity": {"a": 1.0}}, "zscore", ("a",)))


@register("model_pooled", """WITH e AS (SELECT o_orderpriority AS g, o_custkey % 20 AS place, avg(o_totalprice) / 1000 AS y, stddev_samp(o_totalprice) / sqrt(count(*)) / 1000 AS se FROM orders GROUP BY ALL), k AS (SELECT * FROM e WHERE se > 0),
a AS (SELECT g, count(*) AS n, sum(1 / (se * se)) AS w, sum(1 / (se * se * se * se)) AS ww, sum(y / (se * se)) AS wy, sum(y * y / (se * se)) AS wyy FROM k GROUP BY 1), q AS (SELECT g, n, greatest(wyy - wy * wy / w, 0) AS q, w, ww FROM a), t AS (SELECT g, n, q, greatest((q - (n - 1)) / (w - ww / w), 0) AS tau2 FROM q)
SELECT t.g, n, round(q, 4) AS q, round(tau2, 4) AS tau2, round(sum(y / (se * se + tau2)) / sum(1 / (se * se + tau2)), 5) AS effect, round(1 / sqrt(sum(1 / (se * se + tau2))), 5) AS se, round(CASE WHEN q > 0 THEN greatest((q - (n - 1)) / q, 0) ELSE 0 END, 5) AS i2 FROM t JOIN k ON k.g = t.g GROUP BY t.g, n, q, tau2""")
def model_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g"), (F.col("o_custkey") % 20).alias("place")).agg((F.avg("o_totalprice") / 1000).alias("y"), (F.stddev_samp("o_totalprice") / F.sqrt(F.count("*")) / 1000).alias("se"))
    out = fits.pooled_moments(e, ["g"], "y", "se")
    return out.select("g", "n", F.round("q", 4).alias("q"), F.round("tau2", 4).alias("tau2"), *[F.round(c, 5).alias(c) for c in ("effect", "se", "i2")])


_Z = "abs({0}) / sqrt(2)"
_CDF = "0.5 * (1 + sign({0}) * (1 - (1 / (1 + 0.3275911 * abs({0}) / sqrt(2))) * (0.254829592 + (1 / (1 + 0.3275911 * abs({0}) / sqrt(2))) * (-0.284496736 + (1 / (1 + 0.3275911 * abs({0}) / sqrt(2))) * (1.421413741 + (1 / (1 + 0.3275911 * abs({0}) / sqrt(2))) * (-1.453152027 + (1 / (1 + 0.3275911 * abs({0}) / sqrt(2))) * 1.061405429)))) * exp(-{0} * {0} / 2)))"


@register("model_exceedance", f"""WITH r AS (SELECT s_suppkey, 0.8 + s_suppkey % 50 / 60.0 AS rr, (0.8 + s_suppkey % 50 / 60.0) / 1.3 AS lo, (0.8 + s_suppkey % 50 / 60.0) * 1.3 AS hi FROM supplier), z AS (SELECT s_suppkey, (ln(1.0) - ln(rr)) / ((ln(hi) - ln(lo)) / 3.92) AS a, (ln(1.5) - ln(rr)) / ((ln(hi) - ln(lo)) / 3.92) AS b FROM r)
SELECT s_suppkey, round(1 - {_CDF.format('a')}, 6) AS p_gt_1_0, round(1 - {_CDF.format('b')}, 6) AS p_gt_1_5 FROM z""")
def model_exceedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rr = 0.8 + F.col("s_suppkey") % 50 / 60.0
    df = table(spark, sf_dir, "supplier").select("s_suppkey", rr.alias("rr"), (rr / 1.3).alias("lo"), (rr * 1.3).alias("hi"))
    return _rounded(inference.exceedance_probability(df, "rr", "lo", "hi", [1.0, 1.5]).select("s_suppkey", "p_gt_1_0", "p_gt_1_5"))


@register("model_projection", "SELECT s_suppkey, step, round(exp(m + d * step), 6) AS rr, round(exp(m + d * step - 1.96 * sqrt(v * step)), 6) AS rr_lo, round(exp(m + d * step + 1.96 * sqrt(v * step)), 6) AS rr_hi FROM (SELECT s_suppkey, s_suppkey % 10 / 20.0 AS m, s_suppkey % 7 / 100.0 AS d, 0.01 + s_suppkey % 3 / 50.0 AS v, unnest(range(1, 7)) AS step FROM supplier)")
def model_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    last = table(spark, sf_dir, "supplier").select("s_suppkey", (s % 10 / 20.0).alias("m"), (s % 7 / 100.0).alias("d"), (0.01 + s % 3 / 50.0).alias("v"))
    return _rounded(inference.project_risk(last, "s_suppkey", "m", "d", "v", 6))


@register("model_conditional_fit")
def model_conditional_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("x"))
    return fits.conditional_fit(models.case_crossover(days, "date", "n", "x", key=["o_orderstatus"]), "o_orderstatus", "n", ["exposure"])


@register("model_meta_regression")
def model_meta_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g"), (F.col("o_custkey") % 20).alias("place")).agg((F.avg("o_totalprice") / 1000).alias("y"), (F.stddev_samp("o_totalprice") / F.sqrt(F.count("*")) / 1000).alias("se"))
    return inference.meta_regression(e.withColumn("x", F.col("place").cast("double")), "g", "y", "se", ["x"])


@register("model_attributable_interval")
def model_attributable_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g"), F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"))
    df = days.withColumns({"log_rr": F.dayofyear("date") / 3650.0, "se": F.lit(0.02)})
    return inference.attributable_interval(df, "g", "n", "log_rr", "se", draws=200)


# --- spatial --------------------------------------------------------------------------------------

_DEGREE = f"WITH l AS ({_GRID}), d AS (SELECT src, count(*) AS d FROM l GROUP BY 1), t AS (SELECT count(*) AS n, sum(d) AS s, sum(sqrt(d)) AS q, max(d) AS r FROM d)"
_STYLES = {"W": "1.0 / d", "B": "1.0", "C": "n / CAST(s AS DOUBLE)", "U": "1.0 / s", "S": "n / q / sqrt(d)", "minmax": "1.0 / r"}


@register("spatial_weight_styles", f"{_DEGREE} " + " UNION ALL ".join(f"SELECT '{k}' AS style, src, dst, round({w}, 6) AS w FROM l JOIN d USING (src), t" for k, w in _STYLES.items()))
def spatial_weight_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _lattice(spark, sf_dir)
    return _rounded(grids.union_sources([spatial.weights(links, s).select(F.lit(s).alias("style"), "src", "dst", "w") for s in _STYLES]))


@register("spatial_rook", "SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a, nation b WHERE abs(a.n_nationkey // 5 - b.n_nationkey // 5) + abs(a.n_nationkey % 5 - b.n_nationkey % 5) = 1")
def spatial_rook(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for n, (x, y) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))])
    v = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(ring).alias("c"))
    return spatial.rook_contiguity(v.select("n_nationkey", F.col("c.n").alias("n"), (F.floor(F.col("n_nationkey") / 5) + F.col("c.x")).alias("x"), (F.col("n_nationkey") % 5 + F.col("c.y")).alias("y")), "n_nationkey")


@register("spatial_scan_centres", f"""WITH a AS (SELECT n_nationkey AS k, -10 + (n_nationkey // 5) * 0.9 AS lat, -50 + (n_nationkey % 5) * 0.9 AS lon, CAST((n_nationkey * 17) % 23 AS DOUBLE) AS c, CAST(n_nationkey % 7 * 10 + 50 AS DOUBLE) AS p FROM nation),
d AS (SELECT a.k AS k, b.k AS o, round({_KM}, 6) AS km, b.c, b.p FROM a, a b), g AS (SELECT k, km, sum(c) OVER w AS cases, sum(p) OVER w AS pop, row_number() OVER w AS n_areas FROM d WINDOW w AS (PARTITION BY k ORDER BY km, o ROWS UNBOUNDED PRECEDING)), t AS (SELECT sum(c) AS C, sum(p) AS P FROM a),
e AS (SELECT g.k, km, n_areas, cases, t.C * pop / t.P AS expected, t.C AS total FROM g, t WHERE pop <= 0.5 * t.P), r AS (SELECT *, CASE WHEN cases > expected THEN cases * ln(cases / expected) + CASE WHEN total > cases THEN (total - cases) * ln((total - cases) / (total - expected)) ELSE 0 END ELSE 0 END AS llr FROM e)
SELECT k, round(km, 4) AS radius_km, n_areas, cases, round(expected, 6) AS expected, round(llr, 6) AS llr FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY llr DESC, n_areas) = 1""")
def spatial_scan_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    df = table(spark, sf_dir, "nation").select(k.alias("k"), (-10 + F.floor(k / 5) * 0.9).alias("lat"), (-50 + (k % 5) * 0.9).alias("lon"), ((k * 17) % 23).alias("c"), (k % 7 * 10 + 50).alias("p"))
    out = spatial.scan_clusters(df, "k", "c", "p").drop("secondary")
    return _rounded(out.withColumn("radius_km", F.round("radius_km", 4)))


@register("spatial_scan_simulated")
def spatial_scan_simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    df = table(spark, sf_dir, "nation").select(k.alias("k"), (-10 + F.floor(k / 5) * 0.9).alias("lat"), (-50 + (k % 5) * 0.9).alias("lon"), ((k * 17) % 23).alias("c"), (k % 7 * 10 + 50).alias("p"))
    return spatial.scan_clusters(df, "k", "c", "p", simulations=99).where("secondary is not null")


_COUNTS = "SELECT c_nationkey AS k, CAST(count(*) FILTER (WHERE c_acctbal > 7000) AS DOUBLE) AS c, CAST(count(*) AS DOUBLE) AS p FROM customer GROUP BY 1"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count_if(F.col("c_acctbal") > 7000).alias("c"), F.count("*").alias("p"))


@register("spatial_smoothed_rates", f"""WITH a AS ({_COUNTS}), m AS (SELECT sum(c) / sum(p) AS m, avg(p) AS size, sum(p) AS tot FROM a), s AS (SELECT m, greatest(sum(p * pow(c / p - m, 2)) / any_value(tot) - m / any_value(size), 0) AS a FROM a, m GROUP BY m),
w AS (SELECT k, c / p AS r, m, CASE WHEN a + m / p > 0 THEN a / (a + m / p) ELSE 0 END AS w FROM a, s s(m, a)) SELECT k, round(r, 6) AS rate, round(w * r + (1 - w) * m, 6) AS smoothed, round(w, 6) AS weight FROM w""")
def spatial_smoothed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spatial.smoothed_rates(_counts(spark, sf_dir), "k", "c", "p"))


@register("spatial_local_rates", f"""WITH a AS ({_COUNTS}), n AS (SELECT src, dst FROM ({_GRID}) UNION SELECT k, k FROM a), j AS (SELECT src, c, p FROM n JOIN a ON a.k = dst), m AS (SELECT src, sum(c) / sum(p) AS m, avg(p) AS size, sum(p) AS tot FROM j GROUP BY 1),
s AS (SELECT src, any_value(m) AS m, greatest(sum(p * pow(c / p - m, 2)) / any_value(tot) - any_value(m) / any_value(size), 0) AS v FROM j JOIN m USING (src) GROUP BY 1), w AS (SELECT k, c / p AS r, m, CASE WHEN v + m / p > 0 THEN v / (v + m / p) ELSE 0 END AS w FROM a JOIN s ON s.src = k)
SELECT k, round(r, 6) AS rate, round(w * r + (1 - w) * m, 6) AS smoothed, round(w, 6) AS weight FROM w""")
def spatial_local_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spatial.smoothed_rates(_counts(spark, sf_dir), "k", "c", "p", _lattice(spark, sf_dir)))


@register("spatial_least_squares", f"""WITH a AS ({_COUNTS}), s AS (SELECT regr_slope(c, p) AS b, regr_intercept(c, p) AS i, regr_sxx(c, p) AS sxx, regr_syy(c, p) AS syy, count(*) AS n, avg(p) AS m FROM a), e AS (SELECT *, sqrt((syy - b * b * sxx) / (n - 2)) AS s FROM s)
SELECT 'intercept' AS term, round(i, 5) AS estimate, round(s * sqrt(1.0 / n + m * m / sxx), 5) AS se FROM e UNION ALL SELECT 'p', round(b, 5), round(s / sqrt(sxx), 5) FROM e""")
def spatial_least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spatial.spatial_regression(_counts(spark, sf_dir), spatial.weights(_lattice(spark, sf_dir)), "k", "c", ["p"], "ols").select("term", "estimate", "se"), 5)


@register("spatial_lag_model")
def spatial_lag_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.spatial_regression(_counts(spark, sf_dir), spatial.weights(_lattice(spark, sf_dir)), "k", "c", ["p"], "lag")


@register("spatial_holes", "SELECT event_id, CASE WHEN x < 3 THEN 'left' ELSE 'right' END AS polygon FROM (SELECT event_id, (event_id % 89) / 14.01 + 0.001 AS x, (event_id % 83) / 27.97 + 0.003 AS y FROM events) WHERE y < 3 AND (x < 3 OR (x > 4 AND x < 7)) AND NOT (x > 1 AND x < 2 AND y > 1 AND y < 2)")
def spatial_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 89) / 14.01 + 0.001).alias("x"), ((F.col("event_id") % 83) / 27.97 + 0.003).alias("y"))
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    polygons = spark.createDataFrame([("left", [box(0.0, 0.0, 3.0, 3.0), box(1.0, 1.0, 2.0, 2.0)]), ("right", [box(4.0, 0.0, 5.5, 3.0), box(5.5, 0.0, 7.0, 3.0)])], "polygon string, rings array<array<struct<x:double,y:double>>>")
    return spatial.points_in_polygons(points, polygons, "event_id", "polygon")
