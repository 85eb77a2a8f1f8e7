"""Spatial statistics on neighbour tables: weights, autocorrelation, cluster scan, points in polygons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import haversine_km


def row_weights(links: DataFrame) -> DataFrame:
    """``src, dst`` neighbours to ``src, dst, w`` with weights that add to 1 a row."""
    return links.withColumn("w", 1 / F.count("*").over(Window.partitionBy("src")))


def weights(links: DataFrame, style: str = "W") -> DataFrame:
    """``src, dst`` neighbours to ``src, dst, w``; areas without neighbours have no rows.

    B: 1.  W: the row adds to 1.  C: all weights add to the number of areas with neighbours.  U: all add to 1.
    S: variance-stabilising (Tiefelsdorf), all add to that number.  minmax: 1 over the smaller of the largest row and column sums.
    """
    degree = links.groupBy("src").agg(F.count("*").alias("__d"))
    df = links.select("src", "dst").join(degree, "src")
    if style == "W":
        return df.select("src", "dst", (1 / F.col("__d")).alias("w"))
    if style == "B":
        return df.select("src", "dst", F.lit(1.0).alias("w"))
    total = degree.agg(F.count("*").cast("double").alias("__n"), F.sum("__d").cast("double").alias("__s"), F.sum(F.sqrt("__d")).alias("__q"))
    if style == "minmax":
        total = total.crossJoin(links.groupBy("dst").agg(F.count("*").alias("c")).agg(F.max("c").alias("__c"))).crossJoin(degree.agg(F.max("__d").alias("__r")))
    w = {"C": lambda: F.col("__n") / F.col("__s"), "U": lambda: 1 / F.col("__s"), "S": lambda: F.col("__n") / F.col("__q") / F.sqrt("__d"), "minmax": lambda: 1 / F.least("__r", "__c")}
    if style not in w:
        raise ValueError(f"unknown style: {style}; one of W, B, C, U, S, minmax")
    return df.crossJoin(total).select("src", "dst", w[style]().cast("double").alias("w"))


def rook_contiguity(vertices: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """Neighbours that share an edge: ``vertices`` has key, x, y and ``n``, the vertex's number in its ring (the ring is closed)."""
    p = vertices.select(F.col(key).alias("src"), "n", F.struct(F.round("x", digits).alias("x"), F.round("y", digits).alias("y")).alias("p"))
    after = F.lead("p").over(Window.partitionBy("src").orderBy("n"))
    e = p.withColumn("q", after).where("q is not null").select("src", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    return e.join(e.withColumnRenamed("src", "dst"), ["a", "b"]).where("src <> dst").select("src", "dst").distinct()


def contiguity(vertices: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """Neighbours that share a rounded vertex (queen): ``vertices`` has key, x, y."""
    v = vertices.select(F.col(key).alias("src"), F.round("x", digits).alias("x"), F.round("y", digits).alias("y")).distinct()
    return v.join(v.withColumnRenamed("src", "dst"), ["x", "y"]).where("src <> dst").select("src", "dst").distinct()


def _scores(df: DataFrame, key: str, value: str) -> DataFrame:
    stats = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return df.select(F.col(key).alias("src"), F.col(value).alias("v")).crossJoin(stats).select("src", ((F.coalesce("v", "m") - F.col("m")) / F.nullif("s", F.lit(0.0))).alias("z"))


def local_moran(df: DataFrame, weights: DataFrame, key: str, value: str) -> DataFrame:
    """z-score, spatial lag, local I and quadrant of each area; areas without neighbours have lag 0, and values without spread null scores."""
    z = _scores(df, key, value)
    lag = weights.join(z.withColumnsRenamed({"src": "dst", "z": "zd"}), "dst").groupBy("src").agg(F.sum(F.col("w") * F.col("zd")).alias("lag"))
    out = z.join(lag, "src", "left").withColumn("lag", F.coalesce("lag", F.lit(0.0)))
    quadrant = F.when((F.col("z") > 0) & (F.col("lag") > 0), "HH").when((F.col("z") < 0) & (F.col("lag") < 0), "LL").when((F.col("z") > 0) & (F.col("lag") < 0), "HL").when((F.col("z") < 0) & (F.col("lag") > 0), "LH").otherwise("NS")
    return out.select(F.col("src").alias(key), "z", "lag", (F.col("z") * F.col("lag")).alias("local_i"), quadrant.alias("quadrant"))


def global_moran(df: DataFrame, weights: DataFrame, key: str, value: str) -> DataFrame:
    z = _scores(df, key, value)
    cross = weights.join(z, "src").join(z.withColumnsRenamed({"src": "dst", "z": "zd"}), "dst").agg(F.sum(F.col("w") * F.col("z") * F.col("zd")).alias("c"), F.sum("w").alias("w"))
    return cross.crossJoin(z.agg(F.sum(F.col("z") * F.col("z")).alias("q"), F.count("*").alias("n"))).select((F.col("n") / F.col("w") * F.col("c") / F.col("q")).alias("moran_i"), (-1 / (F.col("n") - 1)).alias("expected"))


def adjust_p(df: DataFrame, p: str, method: str = "fdr") -> DataFrame:
    """Bonferroni or step-up (false discovery rate) adjusted p-values, of one row an area; equal p-values are ranked as one."""
    total = df.agg(F.count(p).alias("__n"))
    if method == "bonferroni":
        return df.crossJoin(total).withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * F.col("__n"))).drop("__n")
    levels = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("__m")).crossJoin(total)
    rank = F.sum("__m").over(Window.orderBy(p))  # one row a distinct p-value of areas
    levels = levels.withColumn("__q", F.col(p) * F.col("__n") / rank)
    least = F.min("__q").over(Window.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(levels.select(p, F.least(F.lit(1.0), least).alias("p_adjusted")), p, "left").select(*df.columns, "p_adjusted")


def scan_most_likely(df: DataFrame, key: str, cases: str, population: str, radius_km: float = 200.0, most: float = 0.5) -> DataFrame:
    """Most likely circular cluster (Kulldorff): centre, radius, cases, expected cases, log-likelihood ratio.

    Circles grow around each area up to ``radius_km``, so that pairs come from neighbouring cells of a grid, and up to a share ``most`` of
    the population.  ``df``: one row an area with lat and lon.
    """
    cell = radius_km / 111.0
    area = df.select(F.col(key).alias("k"), "lat", "lon", F.col(cases).cast("double").alias("c"), F.col(population).cast("double").alias("p"), F.floor(F.col("lat") / cell).alias("gy"))
    centre = area.select(F.col("k").alias("centre"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), F.explode(F.array(F.col("gy") - 1, F.col("gy"), F.col("gy") + 1)).alias("gy"))
    near = centre.join(area, "gy").withColumn("km", F.round(haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")), 6)).where(F.col("km") <= radius_km)
    w = Window.partitionBy("centre").orderBy("km", "k").rowsBetween(Window.unboundedPreceding, 0)
    totals = area.agg(F.sum("c").alias("C"), F.sum("p").alias("P"))
    grown = near.select("centre", "km", "k", F.sum("c").over(w).alias("cases"), F.sum("p").over(w).alias("pop")).crossJoin(totals).where(F.col("pop") <= most * F.col("P"))
    expected = F.col("C") * F.col("pop") / F.col("P")
    rest, rest_expected = F.col("C") - F.col("cases"), F.col("C") - expected
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    out = grown.withColumn("expected", expected).withColumn("llr", F.when(F.col("cases") > F.col("expected"), part(F.col("cases"), expected) + part(rest, rest_expected)).otherwise(0.0))
    return out.orderBy(F.desc("llr"), "centre", "km").limit(1).select(F.col("centre").alias(key), F.col("km").alias("radius_km"), "cases", "expected", "llr")


#: Areas that a scan holds in each task at most: some times the municipalities of a country.
MOST_AREAS = 50_000


def scan_clusters(df: DataFrame, key: str, cases: str, population: str, most: float = 0.5, simulations: int = 0, seed: int = 42) -> DataFrame:
    """Best circle around each area by the Poisson likelihood ratio, of any radius up to a share ``most`` of the population.

    ``key, radius_km, n_areas, cases, expected, llr``, and with ``simulations`` a p-value: the share of random tables (cases dealt by population)
    whose best circle is as likely.  ``secondary``: false for the most likely circle, true for those that no more likely circle overlaps,
    null for the others.  The areas (one row each, MOST_AREAS at most, else an error) go to every task; centres and
    simulations are dealt over tasks, and no table of pairs is made.
    """
    areas = df.select(F.col(key).alias("k"), F.radians("lat").alias("lat"), F.radians("lon").alias("lon"), F.col(cases).cast("double").alias("c"), F.col(population).cast("double").alias("p")).orderBy("k").limit(MOST_AREAS + 1).toArrow()
    if areas.num_rows > MOST_AREAS:
        raise ValueError(f"a scan takes {MOST_AREAS} areas at most")
    names, (lat, lon, c, p) = areas.column("k").to_pylist(), (areas.column(x).to_numpy() for x in ("lat", "lon", "c", "p"))
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    shared = spark.sparkContext.broadcast((lat, lon, c, p))

    def circles(i: int, lat: np.ndarray, lon: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.sin((lat - lat[i]) / 2) ** 2 + np.cos(lat) * np.cos(lat[i]) * np.sin((lon - lon[i]) / 2) ** 2
        km = np.round(2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(a, 1.0))), 6)
        order = np.lexsort((np.arange(len(km)), km))
        grown = np.cumsum(p[order])
        return order[grown <= most * p.sum()], km, grown

    def ratio(seen: np.ndarray, people: np.ndarray, total: float, whole: float) -> np.ndarray:
        want = total * people / whole
        with np.errstate(divide="ignore", invalid="ignore"):
            inside = np.where(seen > 0, seen * np.log(seen / want), 0.0)
            outside = np.where(total - seen > 0, (total - seen) * np.log((total - seen) / (total - want)), 0.0)
        return np.where(seen > want, inside + outside, 0.0)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lat, lon, c, p = shared.value
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                order, km, grown = circles(i, lat, lon, p)
                if len(order):
                    seen = np.cumsum(c[order])
                    llr = ratio(seen, grown[: len(order)], c.sum(), p.sum())
                    n = int(np.argmax(llr))
                    out.append((i, km[order[n]], n + 1, seen[n], c.sum() * grown[n] / p.sum(), llr[n]))
            yield pd.DataFrame(out, columns=["id", "radius_km", "n_areas", "cases", "expected", "llr"])

    def random_best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lat, lon, c, p = shared.value
        for pdf in batches:
            draws = np.array([np.random.default_rng((seed, int(k))).multinomial(int(c.sum()), p / p.sum()) for k in pdf["id"]], dtype=float)
            top = np.zeros(len(draws))
            for i in range(len(lat)):
                order, _, grown = circles(i, lat, lon, p)
                if len(order) and len(draws):
                    top = np.maximum(top, ratio(np.cumsum(draws[:, order], axis=1), grown[: len(order)][None, :], c.sum(), p.sum()).max(axis=1))
            yield pd.DataFrame({"llr": top})

    found = spark.range(len(names)).mapInPandas(best, "id bigint, radius_km double, n_areas bigint, cases double, expected double, llr double")
    table = found.toArrow().to_pandas().sort_values(["llr", "id"], ascending=[False, True])  # a row an area
    taken: set[int] = set()
    second = []
    for rank, row in enumerate(table.itertuples(index=False)):
        order, _, _ = circles(row.id, lat, lon, p)
        members = set(order[: row.n_areas].tolist())
        free = row.llr > 0 and not members & taken
        second.append(None if not free else rank > 0)
        taken |= members if free else set()
    rows = [(names[r.id], float(r.radius_km), int(r.n_areas), float(r.cases), float(r.expected), float(r.llr), flag) for r, flag in zip(table.itertuples(index=False), second, strict=True)]
    out = spark.createDataFrame(rows, f"{key} {kind}, radius_km double, n_areas bigint, cases double, expected double, llr double, secondary boolean")
    if not simulations:
        return out
    drawn = spark.range(simulations).mapInPandas(random_best, "llr double").agg(F.array_sort(F.collect_list("llr")).alias("__draws"))
    return out.crossJoin(drawn).withColumn("p_value", (F.size(F.filter("__draws", lambda x: x >= F.col("llr"))) + 1) / (simulations + 1)).drop("__draws")


def smoothed_rates(df: DataFrame, key: str, cases: str, population: str, links: DataFrame | None = None) -> DataFrame:
    """Empirical-Bayes rates (Marshall): each area's rate drawn to the mean of all areas, or of its neighbours and itself, by its variance.

    ``rate``, ``smoothed``, ``weight``: how much of its own rate an area keeps.
    """
    area = df.select(F.col(key).alias("src"), F.col(cases).cast("double").alias("c"), F.col(population).cast("double").alias("p")).where("p > 0")
    member = (links.select("src", "dst").unionByName(area.select("src", F.col("src").alias("dst"))) if links is not None else area.select(F.lit(0).alias("src"), F.col("src").alias("dst"))).distinct()
    inside = member.join(area.select(F.col("src").alias("dst"), "c", "p"), "dst")
    mean = inside.groupBy("src").agg((F.sum("c") / F.sum("p")).alias("m"), F.avg("p").alias("size"), F.sum("p").alias("all"))
    spread = inside.join(mean, "src").groupBy("src").agg(F.first("m").alias("m"), F.first("size").alias("size"), (F.sum(F.col("p") * F.pow(F.col("c") / F.col("p") - F.col("m"), 2)) / F.first("all")).alias("s2"))
    prior = spread.select("src", "m", F.greatest(F.col("s2") - F.col("m") / F.col("size"), F.lit(0.0)).alias("a"))
    joined = area.join(prior, "src") if links is not None else area.crossJoin(prior.drop("src"))
    weight = F.when(F.col("a") + F.col("m") / F.col("p") > 0, F.col("a") / (F.col("a") + F.col("m") / F.col("p"))).otherwise(0.0)
    rate = F.col("c") / F.col("p")
    return joined.select(F.col("src").alias(key), rate.alias("rate"), (weight * rate + (1 - weight) * F.col("m")).alias("smoothed"), weight.alias("weight"))


def spatial_lag(df: DataFrame, links: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with ``lag_<column>``, the weighted mean of the neighbours; 0 without any."""
    near = links.join(df.select(F.col(key).alias("dst"), *columns), "dst").groupBy(F.col("src").alias(key)).agg(*[F.sum(F.col("w") * F.col(c)).alias(f"lag_{c}") for c in columns])
    return df.join(near, key, "left").na.fill(0.0, [f"lag_{c}" for c in columns])


def spatial_regression(df: DataFrame, links: DataFrame, key: str, outcome: str, covariates: list[str], model: str = "lag") -> DataFrame:
    """``term, estimate, se, z``: spatial-lag model by two-stage least squares, lagged covariates, or plain least squares.

    lag: the neighbours' outcome is a term (``rho``), with once and twice lagged covariates as its instruments.  slx: the lagged covariates
    are terms.  ols: neither.  Spark adds up the cross products; the driver solves a system of a few terms.
    """
    data = df.select(key, F.col(outcome).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(covariates)]).dropna()
    xs = [f"x{k}" for k in range(len(covariates))]
    data = spatial_lag(data, links, key, ["y", *xs])
    terms, extra = ["one", *xs], []
    if model == "lag":
        data = spatial_lag(data, links, key, [f"lag_{x}" for x in xs])
        extra = [f"lag_{x}" for x in xs] + [f"lag_lag_{x}" for x in xs]
    elif model == "slx":
        terms += [f"lag_{x}" for x in xs]
    elif model != "ols":
        raise ValueError(f"unknown model: {model}; one of lag, slx, ols")
    data = data.withColumn("one", F.lit(1.0))
    z, x = [*terms, *extra], [*terms, *(["lag_y"] if model == "lag" else [])]
    names = list(dict.fromkeys([*z, *x, "y"]))
    at = {n: i for i, n in enumerate(names)}
    cells = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = data.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{k}") for k, (a, b) in enumerate(cells)], F.count("*").alias("n")).first()
    m = np.zeros((len(names), len(names)))
    for k, (a, b) in enumerate(cells):
        m[at[a], at[b]] = m[at[b], at[a]] = sums[k] or 0.0
    pick = lambda rows, cols: m[np.ix_([at[r] for r in rows], [at[c] for c in cols])]
    inner = pick(x, z) @ np.linalg.pinv(pick(z, z))
    inverse = np.linalg.pinv(inner @ pick(z, x))
    coef = inverse @ inner @ pick(z, ["y"])[:, 0]
    rest = pick(["y"], ["y"])[0, 0] - 2 * coef @ pick(x, ["y"])[:, 0] + coef @ pick(x, x) @ coef
    se = np.sqrt(np.maximum(0.0, np.diag(inverse)) * rest / max(1, sums["n"] - len(x)))
    shown = {"one": "intercept", "lag_y": "rho", **{f"x{k}": c for k, c in enumerate(covariates)}, **{f"lag_x{k}": f"lag_{c}" for k, c in enumerate(covariates)}}
    rows = [(shown[n], float(b), float(s), float(b / s) if s > 0 else None) for n, b, s in zip(x, coef, se, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, z double")


def points_in_polygons(points: DataFrame, polygons: DataFrame, point: str, polygon: str) -> DataFrame:
    """``point, polygon`` of the points inside (ray casting): ``points`` has x, y; ``polygons`` has a ring array<struct<x,y>>.

    A polygon of several parts, or with holes, has ``rings`` (an array of such arrays) in place of ``ring``: a point is inside if a ray from
    it crosses all rings an odd number of times.

    Polygons are dealt to the one-degree cells of their boxes and meet the points by an equi-join; the exact
    test runs on these candidates only.
    """
    p = points.select(point, "x", "y").withColumns({"cx": F.floor("x"), "cy": F.floor("y")})
    if "rings" in polygons.columns:
        polygons = polygons.withColumn("ring", F.flatten("rings"))
    else:
        polygons = polygons.withColumn("rings", F.array("ring"))
    box = polygons.select(polygon, "rings", *[f(F.col(f"ring.{c}")).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.array_min), ("hi", F.array_max))])
    cells = box.withColumn("cx", F.explode(F.sequence(F.floor("lox"), F.floor("hix")))).withColumn("cy", F.explode(F.sequence(F.floor("loy"), F.floor("hiy"))))

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y, rings in zip(pdf["x"], pdf["y"], pdf["rings"], strict=True):
                xs, ys = (np.concatenate([[v[c] for v in ring] for ring in rings]) for c in "xy")
                x2, y2 = (np.concatenate([[v[c] for v in [*ring[1:], ring[0]]] for ring in rings]) for c in "xy")
                crosses = (ys > y) != (y2 > y)
                with np.errstate(divide="ignore", invalid="ignore"):
                    left = x < (x2 - xs) * (y - ys) / (y2 - ys) + xs
                keep.append(bool((crosses & left).sum() % 2))
            yield pdf.loc[keep, [point, polygon]]

    near = p.join(cells, ["cx", "cy"]).where(F.col("x").between(F.col("lox"), F.col("hix")) & F.col("y").between(F.col("loy"), F.col("hiy")))
    types = dict(points.dtypes) | dict(polygons.dtypes)
    return near.select(point, "x", "y", polygon, "rings").mapInPandas(inside, f"{point} {types[point]}, {polygon} {types[polygon]}").distinct()


def zonal_mean(cells: DataFrame, weights: DataFrame, cell: str, zone: str, value: str, by: list[str]) -> DataFrame:
    """Weighted mean of cell values per zone: ``weights`` has cell, zone, w (the covered share)."""
    j = cells.where(F.col(value).isNotNull()).join(weights, cell)
    return j.groupBy(zone, *by).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))
