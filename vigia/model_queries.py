"""Registered queries of geometry, permutation tests and fitted models, each with its SQL where SQL can express it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import thermal
from .operators import aggregate, bayes, boosting, econometrics, exposure, filters, fits, geometry, grids, inference, joins, lagmodels, models, quality, spatial
from .queries import _AREA, _CLIMATE, _GRID, _MORAN, _areas, _lattice, _rounded, _series, register, table
from .sources import tables
from .streaming import series

# --- polygons -------------------------------------------------------------------------------------

#: Parts as rectangles, nations as squares of side 4 on a grid: every third with a corner cut out, every third with a hole, the others whole.
_RECTANGLES = "SELECT p_partkey AS uid, (p_partkey * 7 % 1900) / 100.0 AS x, (p_partkey * 13 % 1850) / 100.0 AS y, 0.3 + p_size / 20.0 AS w, 0.2 + p_partkey % 17 / 10.0 AS h FROM part"
_SQUARES = "SELECT n_nationkey AS k, n_nationkey % 5 * 4 AS x, n_nationkey // 5 * 4 AS y, n_nationkey % 3 AS kind FROM nation"
_CUT = "CASE kind WHEN 0 THEN 2 ELSE 1 END"


def _common(x: str, y: str, w: str, h: str) -> str:
    return f"greatest(0, least(r.x + r.w, {x} + {w}) - greatest(r.x, {x})) * greatest(0, least(r.y + r.h, {y} + {h}) - greatest(r.y, {y}))"


#: Of rectangle r and square s: the square less its cut corner (upper right) or hole (in the middle).
_OVERLAP = f"{_common('s.x', 's.y', '4', '4')} - CASE kind WHEN 0 THEN {_common('s.x + 2', 's.y + 2', '2', '2')} WHEN 1 THEN {_common('s.x + 1', 's.y + 1.5', '2', '1')} ELSE 0 END"


def _ring(points: list[tuple]) -> F.Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def _rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    df = table(spark, sf_dir, "part").select(k.alias("uid"), (k * 7 % 1900 / 100).alias("x"), (k * 13 % 1850 / 100).alias("y"), (0.3 + F.col("p_size") / 20).alias("w"), (0.2 + k % 17 / 10).alias("h"), (1995 + k % 5).alias("year"), F.concat(F.lit("b"), k % 2).alias("biome"))
    x, y, w, h = (F.col(c) for c in "xywh")
    return df.select("uid", "year", "biome", _ring([(x, y), (x, y + h), (x + w, y + h), (x + w, y)]).alias("ring"))


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = k % 5 * 4, F.floor(k / 5) * 4
    corner = F.array(_ring([(x, y), (x + 4, y), (x + 4, y + 2), (x + 2, y + 2), (x + 2, y + 4), (x, y + 4), (x, y)]))
    whole = _ring([(x, y), (x + 4, y), (x + 4, y + 4), (x, y + 4)])
    hole = F.array(whole, _ring([(x + 1, y + 1.5), (x + 3, y + 1.5), (x + 3, y + 2.5), (x + 1, y + 2.5)]))
    return table(spark, sf_dir, "nation").select(k.alias("k"), F.when(k % 3 == 0, corner).when(k % 3 == 1, hole).otherwise(F.array(whole)).alias("rings"))


@register("geometry_areas", f"SELECT k, round(CASE kind WHEN 0 THEN 12 WHEN 1 THEN 14 ELSE 16 END, 6) AS area FROM ({_SQUARES})")
def geometry_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(geometry.polygon_areas(_squares(spark, sf_dir), "k"))


@register("geometry_overlaps", f"SELECT uid, k, round({_OVERLAP}, 6) AS area FROM ({_RECTANGLES}) r, ({_SQUARES}) s WHERE {_OVERLAP} > 1e-9")
def geometry_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(geometry.overlaps(_rectangles(spark, sf_dir), _squares(spark, sf_dir), "uid", "k", 2.0))


@register("grid_cleared_polygons", f"SELECT k AS code_muni, 1995 + uid % 5 AS year, 'b' || uid % 2 AS biome, round(sum({_OVERLAP}), 6) AS area_km2, count(DISTINCT uid) AS n_polygons FROM ({_RECTANGLES}) r, ({_SQUARES}) s WHERE {_OVERLAP} > 1e-9 GROUP BY ALL")
def grid_cleared_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _squares(spark, sf_dir).withColumnRenamed("k", "code_muni")
    return _rounded(grids.cleared_area(geometry.cleared_overlaps(_rectangles(spark, sf_dir), places, "code_muni", 2.0, degrees=False)))


_CELLS = "SELECT c AS col, d AS row, c * 0.75 - 1 AS x, d * 0.6 - 1 AS y, 0.75 AS w, 0.6 AS h FROM (SELECT unnest(range(0, 40)) AS c), (SELECT unnest(range(0, 50)) AS d)"


@register("geometry_cell_shares", f"SELECT k, col, row, round(({_OVERLAP}) / 0.45, 6) AS share FROM ({_CELLS}) r, ({_SQUARES}) s WHERE {_OVERLAP} > 1e-9")
def geometry_cell_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(geometry.cell_shares(_squares(spark, sf_dir), "k", -1.0, -1.0, 0.75, 0.6))


@register("grid_raster_means", f"""WITH v AS (SELECT o_orderkey % 40 AS col, o_custkey % 50 AS row, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS rain FROM orders WHERE o_orderkey % 11 > 0 GROUP BY ALL), c AS (SELECT k, col, row, ({_OVERLAP}) / 0.45 AS share FROM ({_CELLS}) r, ({_SQUARES}) s WHERE {_OVERLAP} > 1e-9)
SELECT k, date, round(sum(share * rain) / sum(share), 6) AS rain, round(sum(share) / (SELECT sum(share) FROM c b WHERE b.k = c.k), 6) AS covered FROM c JOIN v USING (col, row) GROUP BY k, date""")
def grid_raster_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("o_orderkey") % 11 > 0, F.col("o_totalprice"))
    cells = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 40).alias("col"), (F.col("o_custkey") % 50).alias("row"), F.to_date("o_orderdate").alias("date")).agg(F.avg(value).alias("rain"))
    return _rounded(geometry.raster_zonal_mean(cells, _squares(spark, sf_dir), "k", "rain", ["date"], -1.0, -1.0, 0.75, 0.6))


# --- permutation tests and spatial models ---------------------------------------------------------

_KEYED = lambda *parts: "('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 13))::BIGINT"
_AREA_Z = f"a AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z FROM ({_AREA})), e AS (SELECT p.i, q.i AS j, g.w FROM (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM ({_GRID})) g JOIN a p ON p.k = g.src JOIN a q ON q.k = g.dst)"


@register("spatial_permutation", f"""WITH {_AREA_Z}, t AS (SELECT a.*, draw FROM a, (SELECT unnest(range(0, 200)) AS draw)), d AS (SELECT draw, z, row_number() OVER (PARTITION BY draw ORDER BY CASE WHEN draw > 0 THEN {_KEYED('42', 'draw', 'i')} ELSE i END, i) - 1 AS i FROM t),
s AS (SELECT x.draw, sum(x.z * y.z * e.w) AS s FROM d x JOIN e ON e.i = x.i JOIN d y ON y.draw = x.draw AND y.i = e.j GROUP BY x.draw), m AS (SELECT draw, round((SELECT count(*) FROM a) / (SELECT sum(w) FROM e) * s / (SELECT sum(z * z) FROM a), 12) AS m FROM s)
SELECT round((SELECT m FROM m WHERE draw = 0), 6) AS moran_i, (count(*) FILTER (WHERE m >= (SELECT m FROM m WHERE draw = 0)) + 1) / 200 AS p_value FROM m WHERE draw > 0""")
def spatial_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = econometrics.permutation_test(_areas(spark, sf_dir), spatial.weights(_lattice(spark, sf_dir)), "k", "v", 199)
    return out.select(F.round("moran_i", 6).alias("moran_i"), "p_value")


@register("spatial_lisa_permuted", f"""{_MORAN}, {_AREA_Z}, n AS (SELECT i, list(w ORDER BY j) AS ws, (SELECT count(*) FROM a) AS n FROM e GROUP BY i), b AS (SELECT i, ws, n, draw, list_transform(range(1, len(ws) + 1), lambda t: n - 2 - len(ws) + t) AS tops FROM n, (SELECT unnest(range(1, 100)) AS draw)),
c AS (SELECT *, list_transform(range(1, len(ws) + 1), lambda t: {_KEYED('1', 'i', 'draw', 't')} % (tops[t] + 1)) AS xs FROM b),
f AS (SELECT i, draw, ws, list_reduce([[]::BIGINT[]] || list_transform(range(1, len(ws) + 1), lambda t: [tops[t], xs[t]]), lambda got, s: got || [CASE WHEN list_contains(got, s[2]) THEN s[1] ELSE s[2] END]) AS others FROM c),
u AS (SELECT i, draw, unnest(ws) AS w, unnest(others) AS o FROM f), q AS (SELECT u.i, draw, sum(w * y.z) AS lag FROM u JOIN a y ON y.i = o + CASE WHEN o >= u.i THEN 1 ELSE 0 END GROUP BY u.i, draw),
p AS (SELECT z.k, z.z, coalesce(l.lag, 0) AS lag, z.z * coalesce(l.lag, 0) AS local_i FROM z LEFT JOIN l USING (k)), r AS (SELECT p.k, avg(p.z * q.lag) AS mean_i, stddev_samp(p.z * q.lag) AS sd_i, count(*) FILTER (WHERE p.z * q.lag >= local_i) AS above, count(*) FILTER (WHERE p.z * q.lag <= local_i) AS below FROM p JOIN a USING (k) JOIN q USING (i) GROUP BY 1)
SELECT k, round(local_i, 6) AS local_i, round(mean_i, 6) AS mean_i, round(sd_i, 6) AS sd_i, round((local_i - mean_i) / sd_i, 6) AS z_i, CASE WHEN sd_i > 0 THEN (least(above, below) + 1) / 100 END AS p_sim FROM p LEFT JOIN r USING (k)""")
def spatial_lisa_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = econometrics.local_moran_permuted(_areas(spark, sf_dir), spatial.row_weights(_lattice(spark, sf_dir)), "k", "v", 99)
    return _rounded(out.select("k", "local_i", "mean_i", "sd_i", "z_i", "p_sim"))


def _tracts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as tracts of a grid 20 wide, with neighbours by shared sides."""
    k = F.col("c_custkey") % 400
    areas = table(spark, sf_dir, "customer").groupBy(k.alias("k")).agg(F.avg("c_acctbal").alias("y"), F.avg(F.col("c_nationkey").cast("double")).alias("x"), F.avg((F.col("c_custkey") * 37 % 101).cast("double")).alias("v"))
    x, y = F.col("k") % 20, F.floor(F.col("k") / 20)
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    near = areas.select("k", x.alias("x"), y.alias("y"), step.alias("s")).where("x + s.a between 0 and 19 and y + s.b between 0 and 19").select(F.col("k").alias("src"), (F.col("x") + F.col("s.a") + 20 * (F.col("y") + F.col("s.b"))).alias("dst"))
    return areas, spatial.row_weights(near.join(areas.select(F.col("k").alias("dst")), "dst", "left_semi"))


@register("spatial_likelihood_models")
def spatial_likelihood_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas, links = _tracts(spark, sf_dir)
    traces = econometrics.weight_traces(areas.select(F.col("k").alias("i")), links.select(F.col("src").alias("i"), F.col("dst").alias("j"), "w"), 12, 16)
    found = [econometrics.spatial_likelihood(areas, links, "k", "y", ["x", "v"], m, traces=traces)[0].withColumn("model", F.lit(m)) for m in econometrics.MODELS]
    return reduce(DataFrame.unionByName, found)


# --- lag models, matched sets, boosting -----------------------------------------------------------


@register("model_ljung_box", f"""WITH d AS ({_CLIMATE}), e AS (SELECT k, date, x - avg(x) OVER (PARTITION BY k) AS e FROM d), l AS (SELECT k, count(*) OVER (PARTITION BY k) AS n, e, {', '.join(f'e * lag(e, {i}) OVER (PARTITION BY k ORDER BY date) AS p{i}' for i in range(1, 11))} FROM e),
q AS (SELECT k, max(n) AS n, max(n) * (max(n) + 2.0) * ({' + '.join(f'pow(sum(p{i}) / sum(e * e), 2) / (max(n) - {i})' for i in range(1, 11))}) AS q FROM l GROUP BY k HAVING max(n) > 10)
SELECT k, n, round(q, 6) AS q, round(exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2 + pow(q / 2, 3) / 6 + pow(q / 2, 4) / 24), 6) AS p_value FROM q""")
def model_ljung_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k"), F.to_date("l_shipdate").alias("date")).agg(F.avg("l_quantity").alias("x"))
    return _rounded(lagmodels.ljung_box(days, ["k"], "date", "x", 10))


def _lag_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    health, _ = _series(spark, sf_dir)
    climate = exposure.daily(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("k"), F.col("l_shipdate").alias("date"), F.col("l_quantity").alias("x")), "k", "date", ["x"])
    return lagmodels.lag_fits(health.groupBy("k", "date").agg(F.count("*").alias("n")), climate, "k", "n", "x", lags=5, knots=[18.0, 25.0, 32.0], bounds=(0.0, 51.0), reference=25.0)


@register("fit_lag_surface")
def fit_lag_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lagmodels.lag_surface(_lag_fits(spark, sf_dir), "k", points=10))


@register("fit_lag_pooled")
def fit_lag_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = lagmodels.pool_vectors(_lag_fits(spark, sf_dir), "k")
    return _rounded(lagmodels.curve(spark, pooled.mean, pooled.cov, [18.0, 25.0, 32.0], (0.0, 51.0), 25.0, [float(x) for x in range(10, 41, 3)]))


@register("fit_conditional_logit")
def fit_conditional_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 7).alias("k"), F.to_date("o_orderdate").alias("date")).agg(F.count_if(F.col("o_totalprice") > 420_000).alias("n"), (F.avg("o_totalprice") / 100_000).alias("x"))
    design = days.withColumn("stratum", F.date_format("date", "yyyy-MM"))
    return _rounded(lagmodels.conditional_logit(design, "k", "stratum", "n", ["x"]))


@register("fit_boosted_folds")
def fit_boosted_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, off, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (price * (1 - off) * (1 + tax)).alias("y"), price.alias("price"), off.alias("off"), tax.alias("tax"), "l_quantity")
    _, metrics, _ = boosting.out_of_fold(rows, "y", ["price", "off", "tax", "l_quantity"], "l_suppkey", 4, rounds=8, rate=0.4)
    return _rounded(metrics, 3)


# --- sources and small operators ------------------------------------------------------------------


@register("source_rain_gauges", "SELECT 'g' || o_custkey % 30 AS gauge_code, 'c' || o_custkey % 30 AS city, 's' || o_custkey % 3 AS state, CAST(o_custkey % 30 AS DOUBLE) AS lat, CAST(-(o_custkey % 30) AS DOUBLE) AS long, date_trunc('month', o_orderdate) AS date, round(sum(o_totalprice / 1000), 6) AS rainfall_mm FROM orders WHERE year(o_orderdate) IN (1996, 1998) AND o_custkey % 3 IN (0, 2) GROUP BY ALL")
def source_rain_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_custkey") % 30
    orders = table(spark, sf_dir, "orders")
    code = F.concat(F.lit("g"), n)
    gauges = orders.select(code.alias("gauge_code"), F.concat(F.lit("c"), n).alias("city"), F.concat(F.lit("s"), F.col("o_custkey") % 3).alias("state"), n.cast("double").alias("lat"), (-n).cast("double").alias("long")).distinct()
    return _rounded(tables.rain_gauges(orders.select(code.alias("gauge_code"), F.col("o_orderdate").alias("datetime"), (F.col("o_totalprice") / 1000).alias("rain_mm")), gauges, [1996, 1998], ["s0", "s2"], "month"))


@register("source_climate_normals", """WITH w AS (SELECT c_nationkey AS codigo, avg(c_acctbal) AS janeiro_1, max(c_acctbal) AS "março_2", min(c_acctbal) AS dezembro_3 FROM customer GROUP BY 1)
SELECT codigo, mes, decada, round(valor, 6) AS valor, 'tmed' AS var_code FROM (SELECT codigo, 1 AS mes, 1 AS decada, janeiro_1 AS valor FROM w UNION ALL SELECT codigo, 3, 2, "março_2" FROM w UNION ALL SELECT codigo, 12, 3, dezembro_3 FROM w)""")
def source_climate_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("janeiro_1"), F.max("c_acctbal").alias("março_2"), F.min("c_acctbal").alias("dezembro_3"))
    return _rounded(tables.numbered_months(tables.normals_long(wide, "c_nationkey", "tmed")))


@register("source_particles", "SELECT event_id, round((value + value / 2 + event_id % 7 + 1.4 * (event_id % 5) + 1) * 1e-9 * 1e9, 6) AS pm25 FROM events")
def source_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: (c * 1e-9)
    e = table(spark, sf_dir, "events").select("event_id", part(F.col("value")).alias("dust"), part(F.col("value") / 2).alias("sea_salt"), part(F.col("event_id") % 7).alias("black_carbon"), part(F.col("event_id") % 5).alias("organic_carbon"), part(F.lit(1.0)).alias("sulfate"))
    return _rounded(tables.particulate_matter(e).select("event_id", "pm25"))


@register("grid_valid_rain", "SELECT o_custkey % 50 AS code_muni, count(CASE WHEN o_orderkey % 9 > 0 THEN 1 END) AS n_known, round(avg(CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice / 1000 END), 6) AS rain FROM orders GROUP BY 1")
def grid_valid_rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rain = grids.valid_rain(F.when(F.col("o_orderkey") % 9 == 0, -9999.0).otherwise(F.col("o_totalprice") / 1000))
    return _rounded(table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("code_muni")).agg(F.count(rain).alias("n_known"), F.avg(rain).alias("rain")))


@register("grid_coverage", "SELECT round(count(DISTINCT CASE WHEN d IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_suppkey % 7 = 3 AND l_linenumber > 3) THEN d END) / count(DISTINCT d), 6) AS coverage FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)")
def grid_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").where("l_suppkey % 7 = 3 and l_linenumber > 3").select(F.col("l_shipdate").alias("date"))  # noqa: E741
    return _rounded(grids.coverage_ratio(table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("date")), l))


@register("index_confidence", "SELECT event_id, CASE WHEN value >= 95 THEN 'extreme' WHEN value >= 70 THEN 'high' WHEN value <= 10 THEN 'low' ELSE 'normal' END AS flag FROM events")
def index_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", thermal.confidence_flag(F.col("value"), 10, 70, 95).alias("flag"))


@register("model_geometric", "SELECT c_nationkey, c_mktsegment, round(exp(avg(ln(1 + (c_custkey % 100) / 50.0))), 6) AS rr, count(*) AS n FROM customer GROUP BY ALL")
def model_geometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(inference.geometric_aggregate(table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", (1 + F.col("c_custkey") % 100 / 50).alias("rr")), ["c_nationkey", "c_mktsegment"], "rr"))


@register("quality_stuck_runs", """WITH h AS (SELECT user_id, event_id, floor(value / 20) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, floor(value / 20) ORDER BY event_id) AS g FROM events)
SELECT user_id, event_id, CASE WHEN count(*) OVER (PARTITION BY user_id, v, g) <= 2 THEN v END AS v FROM h""")
def quality_stuck_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") / 20).cast("double").alias("v"))
    return quality.stuck_runs(e, "v", ["user_id"], "event_id", 2)


_CURVES = "SELECT l_linenumber AS k, CAST(floor(l_quantity / 10) AS DOUBLE) AS exposure, avg(l_discount) AS log_rr, 0.01 + stddev_samp(l_discount) / sqrt(count(*)) AS se FROM lineitem GROUP BY ALL"


@register("model_pooled_curves", f"""WITH c AS ({_CURVES}), a AS (SELECT exposure, count(*) AS n, sum(1 / (se * se)) AS w, sum(1 / pow(se, 4)) AS ww, sum(log_rr / (se * se)) AS wy, sum(log_rr * log_rr / (se * se)) AS wyy FROM c GROUP BY 1),
t AS (SELECT exposure, n, greatest(wyy - wy * wy / w, 0) AS q, coalesce(greatest((greatest(wyy - wy * wy / w, 0) - (n - 1)) / nullif(w - ww / w, 0), 0), 0) AS tau2 FROM a), e AS (SELECT c.exposure, sum(log_rr / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS effect, 1 / sqrt(sum(1 / (se * se + tau2))) AS se FROM c JOIN t USING (exposure) GROUP BY 1)
SELECT exposure, n, round(q, 6) AS q, round(tau2, 6) AS tau2, round(effect, 6) AS effect, round(se, 6) AS se, round(CASE WHEN q > 0 THEN greatest((q - (n - 1)) / q, 0) ELSE 0 END, 6) AS i2, round(exp(effect), 6) AS rr, round(exp(effect - 1.96 * se), 6) AS rr_lo, round(exp(effect + 1.96 * se), 6) AS rr_hi FROM t JOIN e USING (exposure)""")
def model_pooled_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount")
    curves = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k"), F.floor(F.col("l_quantity") / 10).cast("double").alias("exposure")).agg(F.avg(d).alias("log_rr"), (0.01 + F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se"))
    return _rounded(fits.pooled_curves(curves))


@register("stream_daily_series", "SELECT date_trunc('day', ts) AS date, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregation over the whole table at once: a static frame takes the same plan."""
    e = table(spark, sf_dir, "events").withColumn("one", F.lit(1))
    out = series.stream_series(e, "ts", ["event_type"], {"n": ("sum", "one"), "total": ("sum", "value")})
    return _rounded(out.withColumn("n", F.col("n").cast("bigint")), 4)


@register("stream_spells", """WITH o AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, event_type, count(*) AS n FROM g GROUP BY user_id, event_type, g""")
def stream_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.stream_spells(table(spark, sf_dir, "events"), "ts", ["user_id", "event_type"], "6 hours")


# --- places by name -------------------------------------------------------------------------------

_MUNICIPALITIES = "SELECT 350000 + n_nationkey AS code_muni, 'São ' || n_name AS name, 's' || n_regionkey AS state FROM nation UNION ALL SELECT 360000 + n_nationkey, 'São ' || n_name || CASE WHEN n_nationkey % 3 > 0 THEN ' do Sul' ELSE '' END, 's' || (n_regionkey + 1) % 5 FROM nation"
_WANTED = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' sao nation_' WHEN 1 THEN 'SÃO NATION_' ELSE 'São Nation_' END || c_custkey % 28 AS name, CASE WHEN c_custkey % 5 > 0 THEN 'S' || c_custkey % 28 % 5 END AS state FROM customer"


def _municipalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    nation = table(spark, sf_dir, "nation")
    row = lambda base, state, more: [(base + n).alias("code_muni"), F.concat(F.lit("São "), "n_name", more).alias("name"), F.concat(F.lit("s"), state).alias("state")]
    return nation.select(*row(350000, r, F.lit(""))).unionByName(nation.select(*row(360000, (r + 1) % 5, F.when(n % 3 > 0, " do Sul").otherwise(""))))


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    start = F.when(k % 4 == 0, " sao nation_").when(k % 4 == 1, "SÃO NATION_").otherwise("São Nation_")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(start, k % 28).alias("name"), F.when(k % 5 > 0, F.concat(F.lit("S"), k % 28 % 5)).alias("state"))


@register("demo_resolve_cities", f"""WITH m AS (SELECT code_muni, lower(strip_accents(trim(name))) AS n, upper(state) AS s FROM ({_MUNICIPALITIES})), w AS (SELECT name, state, lower(strip_accents(trim(name))) AS n, upper(state) AS s FROM ({_WANTED})),
c AS (SELECT name, state, (SELECT count(*) FROM m WHERE m.n = w.n AND (w.s IS NULL OR m.s = w.s)) AS fits, (SELECT count(*) FROM m WHERE m.n = w.n) AS every, (SELECT min(code_muni) FROM m WHERE m.n = w.n AND (w.s IS NULL OR m.s = w.s)) AS code FROM w)
SELECT name, state, CASE WHEN fits = 1 THEN code END AS code_muni, CASE WHEN fits > 0 THEN fits ELSE every END AS n_matches, CASE WHEN fits = 1 THEN 'ok' WHEN fits > 1 THEN 'ambiguous' WHEN every > 0 THEN 'other_state' ELSE 'unknown' END AS status FROM c""")
def demo_resolve_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.resolve_cities(_wanted(spark, sf_dir), _municipalities(spark, sf_dir))


@register("level_by_name", f"SELECT c_custkey, w.name, w.state, code_muni FROM ({_WANTED}) w JOIN ({_MUNICIPALITIES}) m ON lower(strip_accents(trim(w.name))) = lower(strip_accents(trim(m.name))) AND upper(w.state) = upper(m.state)")
def level_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = _municipalities(spark, sf_dir).withColumnsRenamed({"name": "area", "state": "uf"})
    return joins.level_join_by_name(_wanted(spark, sf_dir), areas, "name", "state", "area", "uf")


# --- points inside, interruptions, Bayesian maps --------------------------------------------------


@register("geometry_point_on_surface", f"SELECT -1 - k AS k, CAST(x + CASE kind WHEN 0 THEN 1 WHEN 1 THEN 0.5 ELSE 2 END AS DOUBLE) AS x, CAST(y + CASE kind WHEN 0 THEN 3 ELSE 2 END AS DOUBLE) AS y FROM ({_SQUARES}) UNION ALL SELECT uid, round(x + w / 2, 6), round(y + h / 2, 6) FROM ({_RECTANGLES})")
def geometry_point_on_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = _rectangles(spark, sf_dir).select(F.col("uid").cast("bigint").alias("k"), F.array("ring").alias("rings"))
    return _rounded(geometry.point_on_surface(shapes.unionByName(_squares(spark, sf_dir).select((-1 - F.col("k")).cast("bigint").alias("k"), "rings")), "k"))


_MONTHS = """m AS (SELECT o_orderpriority AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n FROM orders GROUP BY ALL), d AS (SELECT *, date - (SELECT min(date) FROM m) AS time, (date >= DATE '1995-01-01')::INT AS step1, greatest(date - DATE '1995-01-01', 0) AS slope1, (date >= DATE '1997-07-01')::INT AS step2, greatest(date - DATE '1997-07-01', 0) AS slope2 FROM m),
b AS (SELECT o_orderpriority AS k, ln(avg(o_totalprice) / 10000) AS b0, avg(o_custkey % 3 + 1) / 10000 AS b1, count(*) / (SELECT count(*) FROM orders) AS b2 FROM orders GROUP BY 1),
f AS (SELECT d.*, step1 + step2 AS segment, exp(b0 + b1 * time) AS c, b2 * step1 - b2 / 2 * step2 + b1 / 3 * slope2 AS g FROM d JOIN b USING (k))"""


def _counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months a priority with two interruptions, under coefficients made of the orders' means."""
    orders = table(spark, sf_dir, "orders")
    months = aggregate.aggregate_series(orders, "o_orderdate", "month", "count", ["o_orderpriority"]).withColumnRenamed("o_orderpriority", "k")
    design = models.interrupted_design(months, "date", ["1995-01-01", "1997-07-01"], 0)
    means = orders.groupBy(F.col("o_orderpriority").alias("k")).agg(F.log(F.avg("o_totalprice") / 10000).alias("b0"), (F.avg(F.col("o_custkey") % 3 + 1) / 10000).alias("b1"), F.count("*").alias("b2"))
    means = means.crossJoin(F.broadcast(orders.agg(F.count("*").alias("all")))).withColumn("b2", F.col("b2") / F.col("all"))
    terms = {"intercept": F.col("b0"), "time": F.col("b1"), "step1": F.col("b2"), "step2": -F.col("b2") / 2, "slope2": F.col("b1") / 3}
    coefs = means.select("k", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), v.cast("double").alias("estimate")) for t, v in terms.items()])).alias("c")).select("k", "c.term", "c.estimate")
    return models.interruption_counterfactual(design, coefs, "n", "k")


@register("model_its_counterfactual", f"WITH {_MONTHS} SELECT k, date, n, segment, round(c * exp(g), 4) AS fitted, round(c, 4) AS counterfactual, round(c - n, 4) AS avoided, round(exp(g), 4) AS ratio FROM f")
def model_its_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_counterfactual(spark, sf_dir).select("k", "date", "n", "segment", "fitted", "counterfactual", "avoided", "ratio"), 4)


@register("model_its_segments", f"WITH {_MONTHS} SELECT k, segment, count(*) AS n, round(avg(n), 4) AS mean_observed, round(avg(c * exp(g)), 4) AS mean_fitted, round(avg(c), 4) AS mean_counterfactual, round(100 * (sum(n) / sum(c) - 1), 4) AS change_percent FROM f GROUP BY ALL")
def model_its_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(models.segment_means(_counterfactual(spark, sf_dir), "n", "k"), 4)


@register("fit_spatial_bayes")
def fit_spatial_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count_if(F.col("c_acctbal") > 5000).alias("y"), (F.count("*") * 0.45).alias("e"), F.avg((F.col("c_custkey") * 37 % 101) / 100).alias("x"))
    return _rounded(bayes.car_model(areas, _lattice(spark, sf_dir).withColumn("w", F.lit(1.0)), "k", "y", ["x"], "e", rho=0.9, tau2=0.1).areas, 4)


@register("fit_space_time_bayes")
def fit_space_time_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    panel = orders.groupBy(F.col("c_nationkey").alias("k"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("e"), F.count_if(F.col("o_totalprice") > 150000).alias("y"))
    fit = bayes.space_time_model(panel, _lattice(spark, sf_dir).withColumn("w", F.lit(1.0)), "k", "year", "y", expected="e", rho=0.9, tau2=0.1)
    return _rounded(inference.exceedance_probability(fit.areas, "rr", "rr_lo", "rr_hi", [0.5]), 4)
