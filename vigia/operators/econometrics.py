"""Permutation tests on neighbour tables, and spatial models by maximum likelihood."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut
from .inference import normal_cdf
from .spatial import local_moran, spatial_lag

# --- permutations ---------------------------------------------------------------------------------


def _draw(seed: int, *parts: Column) -> Column:
    """A number of 52 bits keyed by the seed and the parts: the same in every task, run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("bigint")


def _numbered(df: DataFrame, key: str, value: str) -> DataFrame:
    """``k, i, z``: areas with a value, numbered from 0 by key, with their z-scores.  One row an area."""
    known = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    stats = known.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return known.join(F.broadcast(stats)).select("k", (F.row_number().over(Window.orderBy("k")) - 1).cast("bigint").alias("i"), ((F.col("v") - F.col("m")) / F.nullif("s", F.lit(0.0))).alias("z"))


def _links(weights: DataFrame, areas: DataFrame) -> DataFrame:
    """``i, j, w`` among the numbered areas."""
    ends = lambda side, n: areas.select(F.col("k").alias(side), F.col("i").alias(n))
    return weights.join(ends("src", "i"), "src").join(ends("dst", "j"), "dst").select("i", "j", "w")


def local_moran_permuted(df: DataFrame, weights: DataFrame, key: str, value: str, permutations: int = 999, seed: int = 1) -> DataFrame:
    """``local_moran`` with conditional permutations: ``mean_i, sd_i, z_i, p_value, p_sim`` besides.

    An area keeps its value while its neighbours draw theirs from all other areas, without replacement, ``permutations`` times.  p_value is two-sided for the normal score of
    local_i among the draws, p_sim the smaller tail's share (draws at least as extreme, plus one).  A draw is keyed by (seed, area, permutation, step), so every task
    makes its own: the table of draws is dealt by (area, permutation) and meets the values in a join; no task or driver holds all areas.  Areas
    without neighbours, or without spread among their draws, have null p-values.
    """
    areas = _numbered(df, key, value)
    n = areas.count()
    links = _links(weights, areas)
    near = links.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "w"))), lambda x: x["w"]).alias("ws"))
    draws = near.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    # Floyd: step t of d takes a number up to n - 2 - d + t, or that bound itself where the number is taken
    d = F.size("ws")
    bound = lambda t: F.lit(n - 2) - d + t
    pick = lambda t: F.pmod(_draw(seed, F.col("i"), F.col("draw"), t), bound(t) + 1)
    steps = F.transform(F.sequence(F.lit(1), d), lambda t: F.struct(bound(t).cast("bigint").alias("top"), pick(t).alias("x")))
    taken = F.aggregate(steps, F.array().cast("array<bigint>"), lambda got, s: F.concat(got, F.array(F.when(F.array_contains(got, s["x"]), s["top"]).otherwise(s["x"]))))
    drawn = draws.select("i", "draw", "ws", taken.alias("others")).select("i", "draw", F.explode(F.arrays_zip(F.col("ws").alias("w"), F.col("others").alias("j"))).alias("e"))
    drawn = drawn.select("i", "draw", "e.w", (F.col("e.j") + (F.col("e.j") >= F.col("i")).cast("int")).alias("j"))
    lags = drawn.join(areas.select(F.col("i").alias("j"), F.col("z").alias("zj")), "j").groupBy("i", "draw").agg(F.sum(F.col("w") * F.col("zj")).alias("lag"))
    own = local_moran(df.where(F.col(value).isNotNull()), weights, key, value)
    placed = own.withColumnRenamed(key, "k").join(areas.select("k", "i"), "k")
    sims = lags.join(placed.select("i", F.col("z").alias("zi"), F.col("local_i").alias("obs")), "i").withColumn("sim", F.col("zi") * F.col("lag"))
    sums = sims.groupBy("i").agg(F.avg("sim").alias("mean_i"), F.stddev_samp("sim").alias("sd_i"), F.count_if(F.col("sim") >= F.col("obs")).alias("above"), F.count_if(F.col("sim") <= F.col("obs")).alias("below"))
    score = (F.col("local_i") - F.col("mean_i")) / F.nullif("sd_i", F.lit(0.0))
    out = placed.join(sums, "i", "left").withColumn("z_i", score)
    tail = (F.least("above", "below") + 1) / (permutations + 1)
    return out.select(F.col("k").alias(key), "z", "lag", "local_i", "quadrant", "mean_i", "sd_i", "z_i", (2 * (1 - normal_cdf(F.abs("z_i")))).alias("p_value"), F.when(F.col("sd_i") > 0, tail).alias("p_sim"))


def permutation_test(df: DataFrame, weights: DataFrame, key: str, value: str, permutations: int = 999, seed: int = 42) -> DataFrame:
    """Moran's I and the share of permutations with one at least as large (plus one): ``moran_i, p_value``.

    Each permutation deals the values anew by a keyed draw's order within the permutation; neighbours meet by (permutation, area) and
    their products are summed by permutation, so that nothing but the sums reaches the driver or one task.
    """
    areas = _numbered(df, key, value)
    links = _links(weights, areas)
    tries = areas.select("i", "z", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("draw"))
    order = Window.partitionBy("draw").orderBy(F.when(F.col("draw") > 0, _draw(seed, F.col("draw"), F.col("i"))).otherwise(F.col("i")), "i")
    dealt = tries.select("draw", "z", (F.row_number().over(order) - 1).cast("bigint").alias("i"))
    lag = dealt.select("draw", F.col("i").alias("j"), "z").join(links, "j").groupBy("draw", "i").agg(F.sum(F.col("w") * F.col("z")).alias("lag"))
    sums = dealt.join(lag, ["draw", "i"]).groupBy("draw").agg(F.sum(F.col("z") * F.col("lag")).alias("s"))
    scale = areas.agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("q")).join(F.broadcast(links.agg(F.sum("w").alias("w"))))
    stats = sums.join(F.broadcast(scale)).withColumn("moran", F.round(F.col("n") / F.col("w") * F.col("s") / F.col("q"), 12))
    own = stats.where("draw = 0").select(F.col("moran").alias("moran_i"))
    return stats.where("draw > 0").join(F.broadcast(own)).groupBy("moran_i").agg(((F.count_if(F.col("moran") >= F.col("moran_i")) + 1) / (permutations + 1)).alias("p_value"))


# --- maximum likelihood ---------------------------------------------------------------------------


def weight_traces(areas: DataFrame, links: DataFrame, powers: int = 30, probes: int = 32, seed: int = 7) -> list[float]:
    """Traces of the weight matrix's powers 1 to ``powers``; ``areas`` has ``i``, ``links`` has ``i, j, w``.

    With no more areas than probes each area is a probe of its own and the traces are exact.  Else the first two are exact (sums over links), and the others are means of
    v'W^k v over probes of keyed signs: one join of links and probes a power, whatever the number of probes.
    """
    ids = areas.select("i").distinct()
    n = ids.count()
    exact = n <= probes
    number = ids.select("i", (F.row_number().over(Window.orderBy("i")) - 1).alias("at")) if exact else ids
    many = n if exact else probes
    sign = lambda k: F.when(F.col("at") == k, 1.0).otherwise(0.0) if exact else F.when(_draw(seed, F.lit(k), F.col("i")) % 2 == 0, 1.0).otherwise(-1.0)
    columns = [f"v{k}" for k in range(many)]
    start = cut(number.select("i", *[sign(k).alias(c) for k, c in enumerate(columns)]))
    links = cut(links.select("i", "j", "w"))
    held = [start]
    for _ in range(powers):
        moved = links.join(held[-1].withColumnRenamed("i", "j"), "j").groupBy("i").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])
        held.append(cut(moved))  # areas without a row are 0
    product = reduce(lambda a, b: a + b, [F.col(f"s.{c}") * F.col(f"t.{c}") for c in columns])
    every = reduce(DataFrame.unionByName, [v.withColumn("k", F.lit(k)) for k, v in enumerate(held) if k])
    sums = {r["k"]: r["t"] for r in every.alias("t").join(start.alias("s"), "i").groupBy("k").agg(F.sum(product).alias("t")).collect()}  # a number a power
    out = [float(sums.get(k) or 0.0) / (1 if exact else probes) for k in range(1, powers + 1)]
    if not exact:
        back = links.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("b"))
        out[0] = float(links.where("i = j").agg(F.sum("w")).first()[0] or 0.0)
        if powers > 1:
            out[1] = float(links.join(back, ["i", "j"]).agg(F.sum(F.col("w") * F.col("b"))).first()[0] or 0.0)
    return out


class _Traces:
    """log det(I - rho W) and tr((I - rho W)^-1 W^m) as series of the traces; powers beyond the last are taken to have the mean of the last two."""

    def __init__(self, n: int, traces: list[float]) -> None:
        self.n, self.t = n, np.array(traces)
        self.k = np.arange(1, len(traces) + 1)
        self.rest = float(self.t[-2:].mean())

    def log_det(self, rho: float) -> float:
        own = rho**self.k / self.k
        return float(-(own * self.t).sum() - self.rest * (-math.log(1 - rho) - own.sum()))

    def inverse(self, rho: float, m: int = 0) -> float:
        t = np.concatenate(([self.n], self.t))[m:]
        j = np.arange(len(t))
        return float((rho**j * t).sum() + self.rest * rho ** len(t) / (1 - rho))


def _highest(f: Callable[[float], float], low: float = -0.98, high: float = 0.98) -> float:
    """The place of a function's maximum: a grid, then golden sections around the best point."""
    grid = np.linspace(low, high, 41)
    at = grid[int(np.argmax([f(x) for x in grid]))]
    a, b, g = max(low, at - 0.06), min(high, at + 0.06), (math.sqrt(5) - 1) / 2
    while b - a > 1e-10:
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if f(c) > f(d) else (c, b)
    return (a + b) / 2


MODELS = ("lag", "error", "durbin", "sac")


def spatial_likelihood(df: DataFrame, links: DataFrame, key: str, outcome: str, covariates: list[str], model: str = "lag", powers: int = 30, probes: int = 32, traces: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """A spatial model by maximum likelihood: ``term, estimate, se, z`` and, but for the error model, ``covariate, direct, indirect, total``.

    lag: y = rho W y + X b + e.  durbin: with W X as further terms.  error: y = X b + u, u = lambda W u + e.  sac: both.  ``links`` (``src, dst, w``) have rows
    that add to 1 or, for areas without neighbours, no row.  Spark makes the lags by edge joins, adds up the cross products of all columns and their lags in one aggregation, and the
    traces of the weights' powers; these sums are all that the likelihood needs at any rho and lambda, so that the driver searches on matrices of a few
    columns.  ``traces`` of the same links from ``weight_traces`` serve several models.  Standard errors come from the likelihood's curvature.  Rows without a value in any column are left out, so are links to them.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model: {model}; one of {', '.join(MODELS)}")
    xs = [f"x{k}" for k in range(len(covariates))]
    data = df.select(F.col(key).alias("i"), F.col(outcome).cast("double").alias("y"), *[F.col(c).cast("double").alias(x) for c, x in zip(covariates, xs, strict=True)], F.lit(1.0).alias("one")).dropna()
    data = cut(data)
    inner = links.join(data.select(F.col("i").alias("src")), "src", "left_semi").join(data.select(F.col("i").alias("dst")), "dst", "left_semi").select("src", "dst", "w")
    inner = cut(inner)
    data = spatial_lag(data, inner, "i", ["y", "one", *xs])
    if model == "sac":
        data = spatial_lag(data, inner, "i", ["lag_y"])
    names = [c for c in data.columns if c != "i"]
    cells = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    sums = data.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{k}") for k, (a, b) in enumerate(cells)], F.count("*").alias("n")).first()
    at, n = {c: k for k, c in enumerate(names)}, sums["n"]
    cross = np.zeros((len(names), len(names)))
    for k, (a, b) in enumerate(cells):
        cross[at[a], at[b]] = cross[at[b], at[a]] = sums[k] or 0.0
    traces = _Traces(n, traces or weight_traces(data.select("i"), inner.select(F.col("src").alias("i"), F.col("dst").alias("j"), "w"), powers, probes))
    terms = ["one", *xs, *([f"lag_{x}" for x in xs] if model == "durbin" else [])]
    p = len(terms)

    def filtered(rho: float, lam: float) -> np.ndarray:
        """Columns of (I - lambda W)(y - rho W y) and (I - lambda W) X as combinations of the named ones."""
        out = np.zeros((len(names), p + 1))
        out[at["y"], 0] = 1
        out[at["lag_y"], 0] = -rho - lam
        if model == "sac":
            out[at["lag_lag_y"], 0] = rho * lam
        for k, t in enumerate(terms):
            out[at[t], k + 1] = 1
            if lam:
                out[at[f"lag_{t}"], k + 1] -= lam
        return out

    def pieces(rho: float, lam: float) -> tuple[np.ndarray, float]:
        c = filtered(rho, lam)
        m = c.T @ cross @ c
        beta = np.linalg.pinv(m[1:, 1:]) @ m[1:, 0]
        return beta, float(m[0, 0] - beta @ m[1:, 0])

    both = lambda rho, lam: traces.log_det(rho) + traces.log_det(lam)
    short = lambda rho, lam: both(rho, lam) - n / 2 * math.log(max(1e-300, pieces(rho, lam)[1] / n))
    rho = lam = 0.0
    if model in ("lag", "durbin"):
        rho = _highest(lambda x: short(x, 0.0))
    elif model == "error":
        lam = _highest(lambda x: short(0.0, x))
    else:
        best = max((_ridge(short, start) for start in ((0.0, 0.0), (0.5, -0.3), (-0.3, 0.5))), key=lambda x: short(*x))
        rho, lam = best
    beta, rest = pieces(rho, lam)
    free = {"lag": ("rho",), "durbin": ("rho",), "error": ("lambda",), "sac": ("rho", "lambda")}[model]

    def full(x: np.ndarray) -> float:
        r, q = (x[p] if "rho" in free else 0.0), (x[p + len(free) - 1] if "lambda" in free else 0.0)
        c = filtered(r, q)
        m = c.T @ cross @ c
        b, s2 = np.concatenate(([1.0], -x[:p])), x[-1]
        return both(r, q) - n / 2 * math.log(2 * math.pi * s2) - float(b @ m @ b) / (2 * s2)

    where = np.concatenate((beta, [{"rho": rho, "lambda": lam}[f] for f in free], [rest / n]))
    se = _errors(full, where)
    shown = {"one": "intercept", **dict(zip(xs, covariates, strict=True)), **{f"lag_{x}": f"lag_{c}" for x, c in zip(xs, covariates, strict=True)}}
    rows = [(t, float(v), float(s), float(v / s) if s > 0 else None) for t, v, s in zip([*(shown[t] for t in terms), *free, "sigma2"], where, se, strict=True)]
    rows.append(("log_likelihood", float(full(where)), None, None))
    spark = df.sparkSession
    effects = []
    if model != "error":
        ones = _row_sums(inner, n)
        for k, c in enumerate(covariates):
            own, near = beta[1 + k], beta[1 + len(xs) + k] if model == "durbin" else 0.0
            direct = (own * traces.inverse(rho) + near * traces.inverse(rho, 1)) / n
            total = (own * ones(rho, 0) + near * ones(rho, 1)) / n
            effects.append((c, float(direct), float(total - direct), float(total)))
    return spark.createDataFrame(rows, "term string, estimate double, se double, z double"), spark.createDataFrame(effects, "covariate string, direct double, indirect double, total double")


def _ridge(f: Callable[[float, float], float], start: tuple[float, float]) -> tuple[float, float]:
    """A maximum over two parameters: each in turn, then along the move of the round, until both stay."""
    rho, lam = start
    for _ in range(60):
        before = (rho, lam)
        rho = _highest(lambda x: f(x, lam))  # noqa: B023
        lam = _highest(lambda x: f(rho, x))  # noqa: B023
        move = (rho - before[0], lam - before[1])
        if max(map(abs, move)) < 1e-9:
            break
        most = min((0.98 - abs(v)) / abs(m) if m else 50.0 for v, m in zip((rho, lam), move, strict=True))
        step = _highest(lambda x: f(rho + x * move[0], lam + x * move[1]), 0.0, max(1e-6, min(50.0, most)))  # noqa: B023
        rho, lam = rho + step * move[0], lam + step * move[1]
    return rho, lam


def _errors(f: Callable[[np.ndarray], float], at: np.ndarray) -> np.ndarray:
    """Standard errors from the curvature of a log-likelihood by central differences."""
    h = 1e-4 * np.maximum(1e-2, np.abs(at))
    size = len(at)
    curve = np.zeros((size, size))
    shift = lambda i, a, j, b: f(at + a * h[i] * (np.arange(size) == i) + b * h[j] * (np.arange(size) == j))
    for i in range(size):
        for j in range(i, size):
            curve[i, j] = curve[j, i] = (shift(i, 1, j, 1) - shift(i, 1, j, -1) - shift(i, -1, j, 1) + shift(i, -1, j, -1)) / (4 * h[i] * h[j])
    return np.sqrt(np.maximum(0.0, np.diag(np.linalg.pinv(-curve))))


def _row_sums(links: DataFrame, n: int, powers: int = 40) -> Callable[[float, int], float]:
    """1'(I - rho W)^-1 W^m 1 where rows add to 1 or are empty: areas whose paths never end in an empty row count in all powers."""
    ids = links.select(F.col("src").alias("i")).distinct()
    now, sums = ids.withColumn("s", F.lit(1.0)), [float(n), float(ids.count())]
    if sums[1] < n:  # some areas are islands; what leads to them loses weight a power
        for k in range(2, 6):
            now = links.join(now.withColumnRenamed("i", "dst"), "dst").groupBy(F.col("src").alias("i")).agg(F.sum(F.col("w") * F.col("s")).alias("s"))
            sums.append(float(now.agg(F.sum("s")).first()[0] or 0.0))
            if k % 2 == 0:
                now = cut(now)
    sums += [sums[-1]] * (powers - len(sums))

    def total(rho: float, m: int) -> float:
        t = np.array(sums[m:])
        j = np.arange(len(t))
        return float((rho**j * t).sum() + t[-1] * rho ** len(t) / (1 - rho))

    return total
