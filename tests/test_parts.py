import datetime
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vigia.functions import codes, dates, kernels, stats
from vigia.operators import aggregate, events, exposure, fits, joins, models, quality, spatial, standardize
from vigia.plans import meta, recipe
from vigia.sources import tables
from vigia.streaming import series

DAY = datetime.date


def test_kernels_against_known_values():
    assert kernels.gamma_p(2.0, 2.0) == pytest.approx(1 - 3 * math.exp(-2), abs=1e-12)
    assert kernels.normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-9)
    assert kernels.poisson_interval(0)[1] == pytest.approx(3.688879, abs=1e-5)
    assert kernels.poisson_interval(10) == pytest.approx((4.795389, 18.390356), abs=1e-5)


def test_poisson_regression_recovers_coefficients():
    rng = np.random.default_rng(42)
    x = np.column_stack((np.ones(4000), rng.normal(size=4000)))
    fit = kernels.poisson_regression(x, rng.poisson(np.exp(x @ [1.0, 0.3])).astype(float))
    assert fit.coef == pytest.approx([1.0, 0.3], abs=0.05)
    assert fit.dispersion == pytest.approx(1.0, abs=0.1)


def test_pooling_of_equal_effects():
    out = kernels.pool_effects(np.full(5, 0.2), np.full(5, 0.01))
    assert out["effect"] == pytest.approx(0.2) and out["tau2"] == 0 and out["i2"] == 0
    assert kernels.pool_effects(np.array([0.0, 1.0, 2.0]), np.full(3, 0.01))["tau2"] > 0.5


def test_spline_is_linear_outside():
    b = kernels.natural_spline(np.array([11.0, 12.0, 13.0]), np.array([3.0, 6.0]), 0.0, 10.0)
    assert np.allclose(np.diff(b, 2, axis=0), 0)


def test_distributed_lag_model_finds_the_risk(spark):
    rng = np.random.default_rng(42)
    rows, climate = [], []
    for place in (1, 2):
        t = 20 + 8 * np.sin(np.arange(700) / 58) + rng.normal(0, 3, 700)
        for k in range(700):
            day = DAY(2020, 1, 1) + datetime.timedelta(k)
            climate.append((place, day, float(t[k])))
            rows.append((place, day, int(rng.poisson(20 * math.exp(0.04 * max(0, t[k] - 22))))))
    health, weather = spark.createDataFrame(rows, "city int, date date, n int"), spark.createDataFrame(climate, "city int, date date, t double")
    curve = fits.distributed_lag_model(health, weather, "city", "n", "t", lags=5).collect()
    assert len(curve) == 50
    for place in (1, 2):
        mine = sorted((r["exposure"], r["rr"]) for r in curve if r["city"] == place)
        assert mine[-1][1] > 1.1 and mine[-1][1] > mine[len(mine) // 2][1]


def test_spi_is_standard(spark):
    rng = np.random.default_rng(1)
    rows = [(1, DAY(2000 + k // 12, k % 12 + 1, 1), float(rng.gamma(3, 30))) for k in range(240)] + [(2, DAY(2000, k + 1, 1), 5.0) for k in range(6)]
    out = fits.drought_spi(spark.createDataFrame(rows, "k int, date date, rain double"), "k", "rain").collect()
    values = [r["spi"] for r in out if r["k"] == 1 and r["spi"] is not None]
    assert len(values) == 238 and abs(np.mean(values)) < 0.1 and abs(np.std(values) - 1) < 0.15
    assert all(r["spi"] is None for r in out if r["k"] == 2)


def test_baseline_poisson_bounds_and_pooled(spark):
    rows = [(1, DAY(2019, 1, 1) + datetime.timedelta(k), 10 + (k > 800) * 10) for k in range(900)]
    out = fits.baseline(spark.createDataFrame(rows, "k int, date date, n int"), "k", "n", "2021-01-01").collect()
    assert max(abs(r["expected"] - 10) for r in out) < 0.5
    b = fits.poisson_bounds(spark.createDataFrame([(10,), (None,)], "n int"), "n").collect()
    assert b[0]["n_lo"] == pytest.approx(4.795, abs=1e-2) and b[1]["n_lo"] is None
    p = fits.pooled(spark.createDataFrame([("a", 0.1, 0.1), ("a", 0.3, 0.1), ("a", 0.2, None)], "g string, e double, se double"), "g", "e", "se").first()
    assert p["effect"] == pytest.approx(0.2) and p["n"] == 2


def test_codes():
    assert codes.expand(["J00-J02", "V98-Y99", "a90"]) == ["J00", "J01", "J02", "V98", "V99", "A90"]
    assert len(codes.DISEASE_GROUPS) == 58
    with pytest.raises(ValueError, match="dengue"):
        codes.group_codes("dengu")
    with pytest.raises(ValueError, match="unknown region"):
        codes.states_of("atlantis")
    assert codes.states_of("South") == ["PR", "RS", "SC"]


def test_dotted_code_is_a_wildcard(spark):
    df = spark.createDataFrame([("A920",), ("A92.0",), ("A92x0",), (None,)], "icd string")
    assert [r[0] for r in df.where(codes.matches(F.col("icd"), ["A92.0"])).collect()] == ["A92.0", "A92x0"]


def test_dates(spark):
    df = spark.createDataFrame([(DAY(2023, 1, 1),), (DAY(2021, 1, 2),), (DAY(2024, 2, 29),), (None,)], "d date")
    got = df.select(dates.epi_week(F.col("d")), dates.epi_year(F.col("d")), dates.bucket(F.col("d"), "season"), dates.astronomical_season(F.col("d"), "north")).collect()
    assert [tuple(r) for r in got] == [(1, 2023, DAY(2022, 12, 1), "winter"), (53, 2020, DAY(2020, 12, 1), "winter"), (9, 2024, DAY(2023, 12, 1), "winter"), (None, None, None, None)]
    ages = spark.createDataFrame([("405",), ("512",), ("311",), ("236",), ("x",), (None,), ("4",)], "c string").select(dates.decode_age(F.col("c"))).collect()
    assert [r[0] for r in ages] == [5, 112, 0, 0, None, None, None]


def test_calendar_is_filled_with_null_and_zero(spark):
    df = spark.createDataFrame([(DAY(2020, 1, 1), "a", 2.0), (DAY(2020, 1, 4), "b", None), (None, "a", 1.0)], "d date, g string, v double")
    out = aggregate.aggregate_series(df, "d", "day", {"n": ("count", "v"), "m": ("mean", "v"), "s": ("sum", "v")}, ["g"], complete=True)
    rows = {(r["date"], r["g"]): (r["n"], r["m"], r["s"]) for r in out.collect()}
    assert len(rows) == 8 and rows[DAY(2020, 1, 2), "a"] == (0, None, None) and rows[DAY(2020, 1, 4), "b"] == (1, None, 0.0)


def test_window_needs_enough_days(spark):
    health = spark.createDataFrame([(1, DAY(2020, 1, 10), 7), (1, DAY(2020, 1, 10), 8), (2, DAY(2020, 1, 10), 9)], "k int, date date, id int")
    climate = spark.createDataFrame([(1, DAY(2020, 1, d), float(d)) for d in (7, 8, 10)], "k int, date date, x double")
    got = {r["id"]: r["x_mean_w3"] for r in exposure.moving_window(health, climate, "k", "x", 3).collect()}
    assert got == {7: pytest.approx(25 / 3), 8: pytest.approx(25 / 3), 9: None}


def test_standardize_keeps_taken_names_and_unknown_values(spark):
    raw = spark.createDataFrame([("1", "x", "01022020", "7")], "SEXO string, sex string, DTOBITO string, RACACOR string")
    row = standardize.standardize(raw, "SIM").first()
    assert row["SEXO"] == "1" and row["death_date"] == DAY(2020, 2, 1) and row["race"] == "7"
    assert standardize.detect_system(["DT_INTER", "N_AIH"]) == "SIH" and standardize.detect_system(["a"]) is None


def test_nearest_station_far_away(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 60.0, 100.0)], "p int, lat double, lon double")
    stations = spark.createDataFrame([(10, 40.0, 0.0), (11, 0.0, 44.0), (12, 1.0, 1.0)], "s int, lat double, lon double")
    assert {r["p"]: r["s"] for r in joins.nearest_station(places, stations, "p", "s").collect()} == {1: 12, 2: 10}


def test_interpolation_of_a_curve(spark):
    grid = spark.createDataFrame([(1, 0.0, 1.0), (1, 10.0, 2.0)], "k int, x double, y double")
    at = spark.createDataFrame([(1, 5.0), (1, -3.0), (1, 99.0), (1, 10.0)], "k int, p double")
    assert {r["p"]: r["value"] for r in models.interpolate_at(grid, "k", "x", "y", at, "p").collect()} == {5.0: 1.5, -3.0: 1.0, 99.0: 2.0, 10.0: 2.0}


def test_stuck_sensor_and_score(spark):
    df = spark.createDataFrame([(1, i, 5.0 if i < 4 else float(i)) for i in range(6)], "k int, t int, v double")
    assert [r["v"] for r in quality.stuck_runs(df, "v", ["k"], "t", 3).orderBy("t").collect()] == [None] * 4 + [4.0, 5.0]
    assert quality.weighted_score({"completeness": 100.0, "dates": 50.0, "diagnosis": None}) == pytest.approx(250 / 3)


def test_daily_mean_does_not_depend_on_row_order(spark):
    # a day whose mean is its station's level must not pass it by a last bit when the rows come in another order
    values = [(i * 7919 % 4850 + 97) / 97.0 for i in range(1000)]
    means = []
    for some in (values, values[::-1], sorted(values)):
        hourly = spark.createDataFrame([(1, datetime.datetime(2020, 1, 1), v) for v in some], "s int, ts timestamp, t double").coalesce(1)
        means.append(events.daily_extremes(hourly, "s", "ts", "t").first()["tmean"])
    assert means[0] == means[1] == means[2] == pytest.approx(math.fsum(values) / 1000, rel=1e-15)


def test_exact_mean(spark):
    groups = {"plain": [0.1, 0.2, -0.3, 21.7], "negative": [-3e-9, -1e-9], "some": [None, 2.0, 0.5], "wide": [1e12, 2.5], "none": [None], "infinite": [float("inf"), 1.0]}
    df = spark.createDataFrame([(k, v) for k, some in groups.items() for v in some], "k string, v double")
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(stats.exact_mean(F.col("v")).alias("m")).collect()}
    for k, some in groups.items():
        known = [v for v in some if v is not None]
        assert got[k] == (pytest.approx(math.fsum(known) / len(known), rel=1e-12) if known else None)
    assert math.isnan(spark.createDataFrame([(float("nan"),), (1.0,)], "v double").agg(stats.exact_mean(F.col("v"))).first()[0])


def test_levels_equal_the_quantiles_of_sql(spark):
    # sums of 97ths that should be equal differ in their last bit; a level between two of them falls on one side or the other
    con = duckdb.connect()
    con.sql("create table d as select s, date '1997-01-01' + i::int as date, 50 + (s * 7 + i * 31) % 3 / 97.0 + (1 + (96 - (s * 7 + i * 31) % 3) / 97.0) as tmax, (s * 13 + i * 17) % 89 / 97.0 - 2 as tmin from range(40) a(s), range(400) b(i)")
    want = con.sql("select s, doy, quantile_cont(tmax, 0.9), quantile_cont(tmin, 0.9) from (select s, ((dayofyear(date) - 1 + k) % 366 + 366) % 366 + 1 as doy, tmax, tmin from d, (select unnest(range(-15, 16)) as k)) group by all").fetchall()
    days = spark.createDataFrame(con.sql("select * from d").fetchall(), "s long, date date, tmax double, tmin double")
    got = {(r["s"], r["doy"]): (r["tmax_p"], r["tmin_p"]) for r in events.day_baseline(days, "s").collect()}
    assert got == {(s, doy): (a, b) for s, doy, a, b in want}
    assert events.day_baseline(days, "s", least=1000).where("tmax_p is not null").count() == 0


def test_fused_rounds_once(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(map(float, r)) for r in np.column_stack([rng.uniform(-60, 60, 3000), rng.uniform(0, 1, 3000), rng.uniform(-60, 60, 3000)])]
    got = spark.createDataFrame(rows, "a double, b double, c double").select("a", "b", "c", stats.fused(F.col("a"), F.col("b"), F.col("c")).alias("f")).collect()
    assert [r["f"] for r in got] == [float(Fraction(r["a"]) * Fraction(r["b"]) + Fraction(r["c"])) for r in got]


def test_zonal_mean(spark):
    cells = spark.createDataFrame([(1, 0, 2.0), (2, 0, 4.0), (3, 0, None)], "cell int, t int, v double")
    weights = spark.createDataFrame([(1, "z", 0.25), (2, "z", 0.75), (3, "z", 1.0)], "cell int, zone string, w double")
    assert spatial.zonal_mean(cells, weights, "cell", "zone", "v", ["t"]).first()["v"] == 3.5


def test_meta_survives_parquet(spark, tmp_path):
    frame = meta.HealthFrame(spark.range(3), meta.Meta(system="SIM")).step("clean", lambda d: d.where("id > 0"), meta.Stage.CLEAN)
    frame.write(f"file://{tmp_path}/t")
    again = meta.read(spark, f"file://{tmp_path}/t")
    assert again.meta == frame.meta and again.df.count() == 2
    with pytest.raises(ValueError, match="belongs to stage"):
        frame.step("import", lambda d: d, meta.Stage.IMPORT)
    with pytest.raises(ValueError, match="unknown system"):
        meta.Meta(system="X")


def test_recipe(spark):
    plan = {"steps": [{"name": "filter_diagnosis", "parameters": {"column": "icd", "codes": ["J10"]}}, {"name": "aggregate_series", "parameters": {"date": "d", "unit": "month"}}]}
    df = spark.createDataFrame([("J101", DAY(2020, 1, 5)), ("J108", DAY(2020, 1, 9)), ("A00", DAY(2020, 1, 9))], "icd string, d date")
    out = recipe.run(recipe.loads(recipe.dumps(plan)), meta.HealthFrame(df))
    assert out.df.first()["n"] == 2 and out.meta.stage is meta.Stage.AGGREGATE and out.meta.history == ("filter_diagnosis", "aggregate_series")
    other = recipe.loads(recipe.dumps(plan), unit="year")
    assert recipe.compare(plan, other) and len(recipe.branches(plan, unit=["day", "month"])) == 2
    assert recipe.check({"steps": [{"name": "aggregate_series"}, {"name": "standardize"}, {"name": "rm"}]}) == ["step 1: standardize comes too late", "step 2: unknown name rm"]


def test_read_and_write_formats(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    for kind in ("parquet", "csv", "json"):
        tables.write_records(a, f"file://{tmp_path}/t.{kind}", kind)
    got = tables.read_records(spark, [f"file://{tmp_path}/t.parquet", f"file://{tmp_path}/t.json"])
    assert got.count() == 2 and tables.read_records(spark, f"file://{tmp_path}/t.csv").first()["b"] == "x"
    a.withColumns({"system": F.lit("SIM"), "uf": F.lit("SP"), "year": F.lit(2020), "month": F.lit(1)}).write.partitionBy("system", "uf", "year", "month").parquet(f"file://{tmp_path}/n")
    assert tables.read_national(spark, f"file://{tmp_path}/n", "SIM", ["SP"], [2020], [1]).count() == 1
    assert tables.read_national(spark, f"file://{tmp_path}/n", "SIM", ["RJ"]).count() == 0


def test_station_file(spark, tmp_path):
    head = ["REGIAO:;SE", "UF:;SP", "ESTACAO:;São Tomé", "CODIGO (WMO):;A701", "LATITUDE:;-23,5", "LONGITUDE:;-46,6", "ALTITUDE:;785,6", "DATA DE FUNDACAO:;2006-07-25", "Data;Hora;..."]
    (tmp_path / "s.csv").write_bytes("\n".join([*head, "2019/01/01;0000 UTC;,2;920,1" + ";-9999" * 15 + ";", "2019/01/01;0100 UTC;0;920" + ";1,5" * 15 + ";"]).encode("latin-1"))
    rows = tables.read_station_files(spark, f"file://{tmp_path}/s.csv").orderBy("date").collect()
    assert rows[0]["rainfall_mm"] == 0.2 and rows[0]["sr_kj_m2"] is None and rows[1]["ws_2_m_s"] == 1.5
    assert rows[0]["station_name"] == "São Tomé" and rows[1]["date"].hour == 1 and rows[0]["latitude"] == -23.5


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = series.stream_series(stream, "ts", ["event_type"], {"n": ("count", "value"), "s": ("sum", "value")}, late="60 days").writeStream.outputMode("complete").format("memory").queryName("series").start()
    query.processAllAvailable()
    query.stop()
    batch = series.stream_series(events, "ts", ["event_type"], {"n": ("count", "value"), "s": ("sum", "value")})
    key = lambda df: sorted((r["date"], r["event_type"], r["n"], round(r["s"], 6)) for r in df.collect())
    assert key(spark.table("series")) == key(batch)
    assert series.stream_spells(events, "ts", ["user_id"]).agg(F.sum("n")).first()[0] == events.count()


def test_nearest_stations_equal_all_pairs(spark):
    """Over the whole globe: across the date line, at the poles, in empty oceans."""
    import random

    from vigia.operators import joins

    rng = random.Random(3)
    spots = lambda n, ocean: [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(n)] + ocean
    places = spots(150, [(900, 0.0, 179.99), (901, 90.0, 0.0), (902, -89.9, 10.0), (903, 10.0, -180.0), (904, None, 1.0)])
    stations = [(i, lat, lon) for i, lat, lon in spots(60, [(800, 0.1, -179.98), (801, 0.0, 178.0), (802, 10.0, 180.0)]) if not (0 < lon < 120 and i < 800)]

    def km(a, b):
        (x1, y1), (x2, y2) = (map(math.radians, v) for v in (a, b))
        return 2 * 6371.0 * math.asin(min(1, math.sqrt(math.sin((x2 - x1) / 2) ** 2 + math.cos(x1) * math.cos(x2) * math.sin((y2 - y1) / 2) ** 2)))

    shape = "lat double, lon double"
    p, s = spark.createDataFrame(places, f"p int, {shape}"), spark.createDataFrame(stations, f"s int, {shape}")
    got = {(r["p"], r["nth"]): r["s"] for r in joins._nearest(p, s, "p", "s", 3).collect()}
    for i, lat, lon in places:
        want = [x[1] for x in sorted((round(km((lat, lon), (a, b)), 4), j) for j, a, b in stations)[:3]] if lat is not None else []
        assert [got.get((i, n)) for n in (1, 2, 3)] == (want or [None] * 3)
    assert {r["p"]: r["s"] for r in joins.nearest_station(p, s, "p", "s").collect()} == {i: got[i, 1] for i, lat, _ in places if lat is not None}
    near = joins._nearest(p, s, "p", "s", 2, within_km=600.0).collect()
    assert {(r["p"], r["s"]) for r in near} == {(i, j) for i, lat, lon in places if lat is not None for n, (d, j) in enumerate(sorted((km((lat, lon), (a, b)), j) for j, a, b in stations)[:2]) if d <= 600}


def test_cities_by_name(spark):
    from vigia.operators import filters, joins

    places = spark.createDataFrame([(3550308, "São Paulo", "SP"), (1, "Bom Jesus", "PI"), (2, "Bom Jesus", "SC"), (3, None, "SC")], "code_muni long, name string, state string")
    wanted = spark.createDataFrame([("sao paulo ", None), ("Bom Jesus", None), ("BOM JESUS", "sc"), ("São Paulo", "RJ"), ("Nowhere", None), (None, "SP")], "name string, state string")
    got = {(r["name"], r["state"]): (r["code_muni"], r["n_matches"], r["status"]) for r in filters.resolve_cities(wanted, places).collect()}
    assert got == {("sao paulo ", None): (3550308, 1, "ok"), ("Bom Jesus", None): (None, 2, "ambiguous"), ("BOM JESUS", "sc"): (2, 1, "ok"), ("São Paulo", "RJ"): (None, 1, "other_state"), ("Nowhere", None): (None, 0, "unknown"), (None, "SP"): (None, 0, "unknown")}
    rows = spark.createDataFrame([(355030, "a"), (3550308, "b"), (9, "c")], "code_muni long, v string")
    assert {r["v"] for r in filters.filter_cities(rows, filters.resolve_cities(wanted, places)).collect()} == {"a", "b"}
    areas = spark.createDataFrame([("SAO PAULO", "sp", "school", 7), ("Rio", "RJ", "school", 8)], "name string, state string, kind string, v int")
    out = joins.level_join_by_name(spark.createDataFrame([("São Paulo", "SP", "x"), ("Rio", "SP", "y")], "city string, uf string, v string"), areas, "city", "uf").collect()
    assert [(r["city"], r["v"], r["kind"], r["area_v"]) for r in out] == [("São Paulo", "x", "school", 7)]
