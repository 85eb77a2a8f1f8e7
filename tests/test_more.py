"""Parts without SQL: resolvers, code books, gap injection, conditional fit, spatial lag model, scan, weights, quantiles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigia.functions import codes, kernels, resolve
from vigia.operators import boosting, events, exposure, fits, grids, joins, models, quality, spatial, standardize


def test_resolvers():
    assert resolve.date_column([("x", "int"), ("DTOBITO", "string"), ("d", "date")], "SIM-DO") == "DTOBITO"
    assert resolve.date_column([("x", "int"), ("d", "date")], "SIA") == "d"
    assert resolve.place_column(["codigo_municipio_residencia", "codigo_municipio_ocorrencia"], "SIM") == "codigo_municipio_ocorrencia"
    assert resolve.place_column(["codigo_municipio_residencia", "codigo_municipio_ocorrencia"], "SIH") == "codigo_municipio_residencia"
    assert resolve.place_column(["zip_code"]) == "zip_code"
    assert resolve.diagnosis_column(["secondary_icd", "primary_icd"], "SIA") == "primary_icd"
    assert resolve.age_column(["IDADE", "age_years"]) == "age_years"
    for call in (lambda: resolve.date_column([("x", "int")]), lambda: resolve.place_column(["x"]), lambda: resolve.diagnosis_column(["underlying_cause"], "SINAN"), lambda: resolve.age_column([])):
        with pytest.raises(ValueError):
            call()


def test_diagnosis_ranges_equal_prefixes(spark):
    words = ["I00", "I09", "I10", "I1A", "I20", "I2", "I25", "I26", "I99", "I9", "J00", "I:0", "", None, "A920", "A92.0", "A9200", "i10"]
    df = spark.createDataFrame([(w,) for w in words], "c string")
    for wanted in (["I00-I99"], ["I09-I21"], ["I20-I25", "J00"], ["A92.0"], ["I10", "I11", "I13"]):
        full = codes.expand(wanted)
        got = [r["c"] for r in df.where(codes.matches(F.col("c"), full)).collect()]
        assert got == [w for w in words if w is not None and any(w.startswith(c) if "." not in c else (w[:3] == c[:3] and w[4:5] == c[4:5] and len(w) > 4) for c in full)]
    assert "dengue" in codes.groups_of("A90") and codes.groups_of("ZZZ") == []


def test_languages_and_code_book(spark):
    raw = spark.createDataFrame([("01022020", "1", "4", "I219"), (None, "9", None, None)], "DTOBITO string, SEXO string, RACACOR string, CAUSABAS string")
    got = standardize.standardize(raw, "SIM", language="es")
    assert got.columns == ["fecha_muerte", "sexo", "raza", "causa_basica"] and [str(r["fecha_muerte"]) for r in got.collect()] == ["2020-02-01", "None"]
    assert [r["sexo"] for r in got.collect()] == ["Masculino", "9"]
    with pytest.raises(ValueError):
        standardize.standardize(raw, "SIM", language="xx")


def test_gap_injection(spark):
    df = spark.range(2000).select("id", (F.col("id") % 100).cast("double").alias("v"), (F.col("id") % 50).cast("double").alias("w"))
    for mechanism, depends in (("MCAR", None), ("MAR", ["w"]), ("MNAR", None)):
        out = quality.inject_gaps(df, "v", ["id"], 0.25, mechanism, depends)
        rows = out.collect()
        gone = [r for r in rows if r["v"] is None]
        assert abs(len(gone) - 500) <= 2 and all(r["v_truth"] == float(r["id"] % 100) for r in rows)
        mean = lambda f, some: sum(f(r) for r in some) / len(some)
        if mechanism == "MAR":
            assert mean(lambda r: r["w"], gone) > mean(lambda r: r["w"], rows) + 3
        if mechanism == "MNAR":
            assert mean(lambda r: abs(r["v_truth"] - 49.5), gone) > mean(lambda r: abs(r["v_truth"] - 49.5), rows) + 3
        if mechanism == "MCAR":
            assert abs(mean(lambda r: r["v_truth"], gone) - 49.5) < 4
    assert out.columns == [*df.columns, "v_truth"]
    with pytest.raises(ValueError):
        quality.inject_gaps(df, "v", ["id"], 0.2, "OTHER")


def test_filled_values_see_only_others(spark):
    truth = [10 + 5 * math.sin(2 * math.pi * i / 24) for i in range(240)]
    rows = [(1, i, truth[i] if i % 10 else None) for i in range(240)]
    df = spark.createDataFrame(rows, "s int, h int, v double").select("s", F.timestamp_seconds(F.col("h") * 3600).alias("t"), "v")
    got = {int(r["t"].timestamp()) // 3600: r["v"] for r in boosting.fill_gaps(df, "s", "t", "v").where("is_imputed_v").collect()}
    assert len(got) == 24 and all(abs(v - truth[i]) < 0.5 for i, v in got.items() if i)  # the first row has one neighbour only


def test_conditional_fit_equals_stratum_levels(spark):
    rng = np.random.default_rng(3)
    rows = [("p", f"s{s}", float(x), int(rng.poisson(math.exp(0.3 * x + s % 3)))) for s in range(20) for x in rng.normal(size=8)]
    design = spark.createDataFrame(rows, "p string, stratum string, x double, n int")
    got = fits.conditional_fit(design, "p", "n", ["x"]).first()
    names = sorted({r[1] for r in rows})
    full = np.column_stack([[r[2] for r in rows], *[[float(r[1] == s) for r in rows] for s in names]])
    model = kernels.poisson_regression(full, np.array([float(r[3]) for r in rows]))
    assert abs(got["estimate"] - model.coef[0]) < 1e-5


def test_spatial_lag_model_against_numpy(spark):
    side, rng = 12, np.random.default_rng(1)
    n = side * side
    links = [(i, j) for i in range(n) for j in range(n) if abs(i // side - j // side) + abs(i % side - j % side) == 1]
    w = np.zeros((n, n))
    for i, j in links:
        w[i, j] = 1
    w /= w.sum(axis=1, keepdims=True)
    x = rng.normal(size=n)
    y = np.linalg.solve(np.eye(n) - 0.5 * w, 1 + 2 * x + 0.1 * rng.normal(size=n))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k int, x double, y double")
    got = {r["term"]: r["estimate"] for r in spatial.spatial_regression(df, spatial.weights(spark.createDataFrame(links, "src int, dst int")), "k", "y", ["x"]).collect()}
    z, d = np.column_stack([np.ones(n), x, w @ x, w @ w @ x]), np.column_stack([np.ones(n), x, w @ y])
    p = d.T @ z @ np.linalg.pinv(z.T @ z)
    want = np.linalg.solve(p @ z.T @ d, p @ z.T @ y)
    assert np.allclose([got["intercept"], got["x"], got["rho"]], want, atol=1e-6) and abs(got["rho"] - 0.5) < 0.1


def test_scan_finds_two_clusters(spark):
    rows = [(f"a{i}{j}", -10 + i * 0.5, -50 + j * 0.5, 100 if (i < 2 and j < 2) else 60 if (i > 7 and j > 7) else 10, 1000) for i in range(10) for j in range(10)]
    df = spark.createDataFrame(rows, "k string, lat double, lon double, c int, p int")
    got = spatial.scan_clusters(df, "k", "c", "p", simulations=19)
    first, second = got.where("secondary = false").collect(), got.where("secondary and p_value <= 0.05").collect()
    assert len(first) == 1 and first[0]["n_areas"] == 4 and first[0]["cases"] == 400.0 and len(second) == 1 and second[0]["cases"] == 240.0
    assert got.count() == 100


def test_levels_facilities_and_stations(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0)], "place int, lat double, lon double")
    stations = spark.createDataFrame([("a", 0.1, 0.1), ("b", 0.2, 0.2), ("c", 9.0, 9.0)], "station string, lat double, lon double")
    good = spark.createDataFrame([("a", 0.2), ("b", 0.9), ("c", 0.8)], "station string, quality double")
    got = [(r["place"], r["station"], r["nth"]) for r in joins.match_stations(places, stations, good, "place", "station", k=2).orderBy("place", "nth").collect()]
    assert got == [(1, "b", 1), (1, "c", 2), (2, "c", 1), (2, "b", 2)]
    assert joins.match_stations(places, stations, good, "place", "station", k=2, within_km=300.0).count() == 2
    readings = spark.createDataFrame([("a", 1.0, None), ("a", None, None), ("b", 1.0, 2.0)], "station string, t double, rh double")
    for how, want in (("any", {"a": 0.5, "b": 1.0}), ("all", {"a": 0.0, "b": 1.0}), ("mean", {"a": 0.25, "b": 1.0})):
        assert {r["station"]: r["quality"] for r in joins.station_quality(readings, "station", ["t", "rh"], how).collect()} == want
    with pytest.raises(ValueError):
        joins.station_quality(readings, "station", ["t"], "none")


def test_front_end_names_what_is_missing(spark):
    health = spark.createDataFrame([(1, "2020-01-02")], "k int, date string").select("k", F.to_date("date").alias("date"))
    climate = spark.createDataFrame([(1, "2020-01-01", 2.0), (1, "2020-01-02", 4.0)], "k int, day string, t double")
    assert exposure.join_climate(health, climate, "k", "day", ["t"], "exact").first()["t"] == 4.0
    assert exposure.join_climate(health, climate, "k", "day", ["t"], "discrete_lag", lag=1).first()["lag1_t"] == 2.0
    for strategy in ("offset_window", "nothing"):
        with pytest.raises(ValueError):
            exposure.join_climate(health, climate, "k", "day", ["t"], strategy)


def test_waves_without_index_columns(spark):
    days = spark.range(800).select(F.lit("s").alias("station"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.col("id") % 37).cast("double").alias("tmax"), (F.col("id") % 37 - 5).cast("double").alias("tmin"), (F.col("id") % 37 - 2).cast("double").alias("tmean"))
    got = events.waves(days, "station", ["WHO", "UTCI", "EHF"], least=1)
    assert got.where("UTCI is not null").count() == 0 and got.where("any").count() > 0 and "WMO" not in got.columns
    with pytest.raises(ValueError):
        events.waves(days, "station", ["XYZ"])


def test_normal_quantile_and_drought_classes(spark):
    p = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.99, 1 - 1e-6]
    got = [r["q"] for r in spark.createDataFrame([(x,) for x in p], "p double").select(events.normal_quantile(F.col("p")).alias("q")).collect()]
    assert np.allclose(got, [kernels.normal_quantile(x) for x in p], atol=1e-7)
    grades = spark.createDataFrame([(x,) for x in (-2.5, -1.2, 0.0, 2.5, None)], "x double").select(events.drought_class(F.col("x")).alias("c")).collect()
    assert [r["c"] for r in grades] == ["extremely dry", "moderately dry", "near normal", "extremely wet", None]


def test_pollutants_and_zones(spark):
    assert [grids.available_resolution(p, r) for p, r in (("o3", "daily"), ("pm25", "daily"), ("no2", "daily"), ("no2", "monthly"), ("co", "annual"))] == ["annual", "daily", "annual", "monthly", "annual"]
    bounds = spark.createDataFrame([(41, -23.0, -50.0, "Cw"), (41, -23.1, -50.0, "Cf"), (31, -15.0, -45.0, "Aw"), (31, -15.1, -45.0, "Cw"), (16, -1.0, -51.0, "Am"), (12, -9.0, -70.0, "Aw")], "s int, lat double, lon double, want string")
    assert all(r["zone"] == r["want"] for r in bounds.select("want", grids.climate_zone(F.col("s"), F.col("lat"), F.col("lon")).alias("zone")).collect())


def test_rank_pillars(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 5.0), ("c", 2.0, 7.0)], "k string, x double, y double")
    got = {r["k"]: r["p"] for r in models.weighted_pillars(df, "k", {"p": {"x": 1.0, "y": 1.0}}, "rank").collect()}
    assert abs(got["a"] - 1 / 6) < 1e-9 and abs(got["b"] - (2 / 3 + 0.25) / 2) < 1e-9 and abs(got["c"] - (2 / 3 + 0.75) / 2) < 1e-9


def test_export_keeps_metadata_and_types_block_stages(spark, tmp_path):
    from vigia.plans import meta
    from vigia.sources import tables

    frame = meta.HealthFrame(spark.createDataFrame([(1, "São"), (2, None)], "a int, b string"), meta.Meta(system="SIM"))
    meta.export(frame, f"file://{tmp_path}/t.json", "json")
    again = meta.read_export(spark, f"file://{tmp_path}/t.json")
    assert again.meta == frame.meta and again.df.count() == 2
    (tmp_path / "l.csv").write_bytes("a;b\n1;São\n".encode("latin-1"))
    got = meta.read_export(spark, f"file://{tmp_path}/l.csv", sep=";", encoding="ISO-8859-1")
    assert got.df.first()["b"] == "São" and got.meta == meta.Meta()
    with pytest.raises(ValueError, match="SIH-SP"):
        meta.HealthFrame(frame.df, meta.Meta(type="SIH-SP")).step("derive", lambda d: d, meta.Stage.DERIVE)
    normals = spark.createDataFrame([("s", "Março", 1, 2.0), ("s", "ano", None, 9.0), ("s", "12", 3, 1.0)], "codigo string, mes string, decada int, valor double")
    assert sorted(r["mes"] for r in tables.numbered_months(normals).collect()) == [3, 12]


def test_parallel_ranks(spark):
    from vigia.functions.stats import with_rank

    rng = np.random.default_rng(4)
    values = [None if x > 2.2 else round(float(x), 2) for x in rng.normal(size=3000)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = {r["i"]: r["r"] for r in with_rank(df, "x", "r", cells=16).collect()}
    known = sorted(v for v in values if v is not None)
    for i, v in enumerate(values):
        assert got[i] == (None if v is None else np.searchsorted(known, v, "left") + (np.searchsorted(known, v, "right") - np.searchsorted(known, v, "left") + 1) / 2)


def test_interval_draws_once_a_row_and_matches_plain_percentiles(spark, sf_dir):
    from statistics import NormalDist

    import __spark_entry__
    from vigia.functions import thermal

    plan = __spark_entry__.queries()["index_interval"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") == 1 and "array_sort" not in plan
    df = spark.createDataFrame([(20.0,), (35.25,), (None,)], "t double")
    got = df.select("t", thermal.interval(thermal.cooling_degrees, {"t": F.col("t")}, {"t": 0.5}).alias("i")).select("t", "i.low", "i.high").collect()
    for t, low, high in got:
        if t is None:
            assert low == high == 0.0  # greatest() passes over nulls, in SQL too
            continue
        s = sorted(max(t + 0.5 * NormalDist().inv_cdf((0.5 + i * 0.6180339887498949) % 1.0 * 0.999999 + 5e-7) - 18, 0) for i in range(1, 201))
        assert abs(low - (s[4] * 0.025 + s[5] * 0.975)) < 0.06 and abs(high - (s[194] * 0.975 + s[195] * 0.025)) < 0.06
