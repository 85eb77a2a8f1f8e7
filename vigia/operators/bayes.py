"""Disease mapping with a spatially structured random effect, fitted on edge tables: Laplace approximation, draws by perturbed solves, hyperparameters by expectation-maximisation."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut
from .econometrics import _highest, _Traces, weight_traces

FAMILIES = ("poisson", "binomial")
#: Sweeps between two cuts of the lineage.
SWEEPS = 4
#: Links up to this many (some 12 MB) go to every task; more are joined by shuffles.
SENT_LINKS = 500_000


@dataclass
class Mapped:
    """``areas``: a row an area; ``fixed``: a row a term; ``model``: one row of hyperparameters and fit; ``draws``: ``i, k, eta``, the areas' linear predictors (without offset) by draw."""

    areas: DataFrame
    fixed: DataFrame
    model: DataFrame
    draws: DataFrame


def _normal(seed: int, *parts: Column) -> Column:
    """A standard normal number keyed by the seed and the parts, the same in every task and run."""
    u1, u2 = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(n), *parts), 11) / float(2**53) for n in (1, 2))
    return F.sqrt(-2 * F.log(1 - u1)) * F.cos(2 * math.pi * u2)


def _add(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _solve(rows: DataFrame, links: DataFrame, bind: float, radius: float, shrink: float) -> DataFrame:
    """Solve ``d_i x_i - bind * sum_j w_ij x_j = g_i`` for every k of ``rows`` (``i, k, d, g, x``, x the start): Chebyshev's semi-iteration of Jacobi sweeps.

    ``radius`` bounds the spectrum of the sweep (the largest share of a row that lies off the diagonal), so that no inner products are needed and the number of sweeps follows from it: as
    many as shrink the start's error by ``shrink``.  A sweep is one join of links and rows and one sum by (i, k), with partial sums before the shuffle.
    """
    if radius == 0:
        return cut(rows.select("i", "k", (F.col("g") / F.col("d")).alias("x")))
    rate = radius / (1 + math.sqrt(max(0.0, 1 - radius**2)))
    blocks = math.ceil(math.log(2 / shrink) / -math.log(rate) / SWEEPS)
    none = F.lit(None).cast("double")
    used = F.when(F.col("omega") >= 2, 1.0).otherwise(F.col("omega"))  # the first sweep is a plain one
    # The numbers of a solve stand in columns, not in the plan, so that every block of sweeps runs the same compiled code
    numbers = rows.sparkSession.createDataFrame([(float(bind), float(radius**2))], "bind double, r2 double")
    now = rows.crossJoin(F.broadcast(numbers)).select("i", "k", (F.col("d") / F.col("bind")).alias("d"), (F.col("g") / F.col("bind")).alias("g"), "x", F.col("x").alias("last"), F.lit(2.0).alias("omega"), "r2")
    kept = ("d", "g", "x", "last", "omega", "r2")
    for _ in range(blocks):
        for _ in range(SWEEPS):
            near = links.join(now.select(F.col("i").alias("j"), "k", "x"), "j").select("i", "k", *[none.alias(c) for c in kept], (F.col("w") * F.col("x")).alias("near"))
            every = now.withColumn("near", none).unionByName(near).groupBy("i", "k").agg(*[F.sum(c).alias(c) for c in (*kept, "near")])
            moved = (F.col("g") + F.coalesce("near", F.lit(0.0))) / F.col("d")
            now = every.select("i", "k", "d", "g", (used * (moved - F.col("last")) + F.col("last")).alias("x"), F.col("x").alias("last"), (1 / (1 - F.col("r2") * F.col("omega") / 4)).alias("omega"), "r2")
        now = cut(now)
    return now.select("i", "k", "x")


def car_model(
    df: DataFrame,
    links: DataFrame,
    key: str,
    outcome: str,
    covariates: list[str] | tuple[str, ...] = (),
    expected: str | None = None,
    trials: str | None = None,
    family: str = "poisson",
    rho: float | None = None,
    tau2: float | None = None,
    prior: tuple[float, float] = (1.0, 0.01),
    draws: int = 100,
    rounds: int = 15,
    tolerance: float = 1e-2,
    powers: int = 40,
    seed: int = 1,
) -> Mapped:
    """Bayesian regression with Leroux's spatial effect u: precision (rho (D - W) + (1 - rho) I) / tau2 over the areas.

    Poisson counts with ``expected`` as offset, or binomial counts of ``trials``.  rho 0 is the model of independent effects, rho near 1 the intrinsic one; ``rho`` and ``tau2`` are estimated
    where not given (tau2 under an inverse gamma ``prior`` of shape and rate, rho uniform on 0 to 0.99).  Fixed effects have flat priors.

    Given hyperparameters, the posterior is taken as normal around its mode with the curvature there.  A Newton step and each draw are solutions of one sparse system over the links
    (a draw's right side is noise of the system's own covariance, keyed by seed, draw, area and link), so a round solves mode and all draws together by joins.  The draws then give the
    expected squares by which the hyperparameters move; the prior's determinant comes from traces of the weights' powers.  The driver holds numbers a draw and term only.

    ``links`` (``src, dst, w``) must be symmetric; one without a row at both ends is left out.  Rows with a null in any column are left out; repeated keys are refused; an area without links has an independent effect.
    Result ``areas``: ``key, fitted, effect, effect_sd, rr, rr_lo, rr_hi, p_gt_1``: posterior mean of the fitted count, mean and deviation of u, and the mean and 95 % interval of exp(linear predictor), which is
    the relative risk (odds for binomial).  ``model``: ``rho, tau2, deviance, p_d, dic, rounds``, the deviance against the saturated model.
    """
    if family not in FAMILIES:
        raise ValueError(f"unknown family: {family}; one of {', '.join(FAMILIES)}")
    if family == "binomial" and trials is None:
        raise ValueError("a binomial model needs the column of trials")
    if rho is not None and not 0 <= rho <= 0.99:
        raise ValueError("rho must lie between 0 and 0.99")
    xs = [f"x{m}" for m in range(len(covariates) + 1)]
    p = len(xs)
    size = F.col(expected).cast("double") if expected else F.lit(1.0)
    many = F.col(trials).cast("double") if trials else F.lit(1.0)
    data = df.select(F.col(key).alias("i"), F.col(outcome).cast("double").alias("y"), F.log(size).alias("off"), many.alias("n"), F.lit(1.0).alias("x0"), *[F.col(c).cast("double").alias(x) for c, x in zip(covariates, xs[1:], strict=True)]).dropna()
    data = cut(data)
    inner = links.where("src <> dst").join(data.select(F.col("i").alias("src")), "src", "left_semi").join(data.select(F.col("i").alias("dst")), "dst", "left_semi")
    inner = cut(inner.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").cast("double").alias("w")))
    if inner.count() <= SENT_LINKS:
        inner = F.broadcast(inner)
    degree = inner.groupBy("i").agg(F.sum("w").alias("deg"))
    size = data.agg(F.count("*").alias("n"), F.count_distinct("i").alias("keys"), F.sum("y").alias("y"), F.sum(F.exp("off") * F.col("n")).alias("e")).first()
    areas_n = size["n"]
    if not areas_n:
        raise ValueError("no area has a value in every column")
    if size["keys"] != areas_n:
        raise ValueError("each area may have one row only")
    start = (size["y"] + 0.5) / (size["e"] + 1)
    start = math.log(start) if family == "poisson" else math.log(start / max(1e-9, 1 - start))
    areas = cut(data.join(degree, "i", "left").withColumns({"deg": F.coalesce("deg", F.lit(0.0)), "lin": F.lit(start)}))
    ks = F.explode(F.sequence(F.lit(p + 1), F.lit(p + draws)))
    # Noise of the links: one normal number a link and draw, with opposite signs at its ends
    ends = (F.least("i", "j"), F.greatest("i", "j"))
    bound = inner.select("i", "j", "w", ks.alias("k")).select("i", "k", (F.sqrt("w") * F.when(F.col("i") < F.col("j"), 1.0).otherwise(-1.0) * _normal(seed, F.col("k"), F.lit("link"), *ends)).alias("e")).groupBy("i", "k").agg(F.sum("e").alias("z_link"))
    single = areas.select("i", ks.alias("k")).select("i", "k", _normal(seed, F.col("k"), F.lit("data"), F.col("i")).alias("z_data"), _normal(seed, F.col("k"), F.lit("own"), F.col("i")).alias("z_own"))
    rest = areas.select("i", F.explode(F.sequence(F.lit(0), F.lit(p))).alias("k")).select("i", "k", *[F.lit(0.0).alias(c) for c in ("z_data", "z_own", "z_link")])
    noise = cut(single.join(bound, ["i", "k"], "left").withColumn("z_link", F.coalesce("z_link", F.lit(0.0))).unionByName(rest))
    r, t = (0.5 if rho is None else rho), (0.1 if tau2 is None else tau2)
    prior_det = None
    if rho is None:
        most = float(areas.agg(F.max("deg")).first()[0]) or 1.0
        walk = inner.select("i", "j", (F.col("w") / most).alias("w")).unionByName(areas.select("i", F.col("i").alias("j"), (1 - F.col("deg") / most).alias("w")))
        traces = _Traces(areas_n, weight_traces(areas.select("i"), walk, powers))
        prior_det = lambda v: areas_n * math.log(v * most + 1 - v) + traces.log_det(v * most / (v * most + 1 - v))
    held = noise.select("i", "k", F.lit(0.0).alias("x"))
    fixed_hyper = rho is not None and tau2 is not None
    done = 0
    while True:
        eta = F.col("lin") + F.col("off")
        mu = F.exp(eta) if family == "poisson" else F.col("n") / (1 + F.exp(-eta))
        weight = mu if family == "poisson" else mu * (1 - mu / F.col("n"))
        hyper = areas.sparkSession.createDataFrame([(float(r), float(t))], "r double, t double")
        now = areas.crossJoin(F.broadcast(hyper)).withColumns({"mu": mu, "v": weight}).withColumn("d", F.col("v") + (F.col("r") * F.col("deg") + 1 - F.col("r")) / F.col("t"))
        side = F.when(F.col("k") == p, F.col("v") * F.col("lin") + F.col("y") - F.col("mu")).when(F.col("k") > p, F.sqrt("v") * F.col("z_data")).otherwise(0.0)
        cross = now.agg(F.max(F.col("r") * F.col("deg") / F.col("t") / F.col("d")).alias("radius"), *[F.sum(F.col("v") * F.col(a) * F.col(b)).alias(f"c{m}_{q}") for m, a in enumerate(xs) for q, b in enumerate(xs)]).first()
        held_to = noise.join(now, "i").withColumn("s", side)
        prior_noise = F.sqrt((1 - F.col("r")) / F.col("t")) * F.col("z_own") + F.sqrt(F.col("r") / F.col("t")) * F.col("z_link")
        column = _add([F.when(F.col("k") == m, F.col("v") * F.col(x)).otherwise(0.0) for m, x in enumerate(xs)])
        rows = held_to.withColumn("g", F.col("s") + prior_noise + column).join(held, ["i", "k"])
        solved = _solve(rows, inner, r / t, float(cross["radius"]), 1e-3 if done == 0 else 1e-2)
        held = solved
        # Fixed effects by elimination: p numbers a draw
        both = solved.join(held_to.select("i", "k", "s", "v", *xs), ["i", "k"])
        sums = both.groupBy("k").agg(*[F.sum(F.col("v") * F.col(x) * F.col("x")).alias(f"a{m}") for m, x in enumerate(xs)], *[F.sum(F.col("s") * F.col(x)).alias(f"b{m}") for m, x in enumerate(xs)]).collect()  # 2p numbers a draw
        got = {row["k"]: (np.array([row[f"a{m}"] for m in range(p)]), np.array([row[f"b{m}"] for m in range(p)])) for row in sums}
        schur = np.array([[cross[f"c{m}_{q}"] for q in range(p)] for m in range(p)]) - np.array([got[m][0] for m in range(p)])
        back = np.linalg.pinv(schur)
        betas = {k: back @ (b - a) for k, (a, b) in got.items() if k >= p}
        coefs = areas.sparkSession.createDataFrame([(int(k), *map(float, b)) for k, b in betas.items()], "k int, " + ", ".join(f"b{m} double" for m in range(p)))
        design = solved.where(F.col("k") < p).groupBy("i").agg(*[F.max(F.when(F.col("k") == m, F.col("x"))).alias(f"q{m}") for m in range(p)])
        u = solved.where(F.col("k") >= p).join(F.broadcast(coefs), "k").join(design, "i")
        u = cut(u.select("i", "k", (F.col("x") - _add([F.col(f"b{m}") * F.col(f"q{m}") for m in range(p)])).alias("u"), *[f"b{m}" for m in range(p)]))
        lin = _add([F.col(x) * F.col(f"b{m}") for m, x in enumerate(xs)]) + F.col("u")
        areas = cut(areas.withColumnRenamed("lin", "old").join(u.where(F.col("k") == p).drop("k"), "i").select(*[c for c in areas.columns if c != "lin"], F.abs(lin - F.col("old")).alias("change"), lin.alias("lin")))
        change = areas.agg(F.max("change")).first()[0]
        areas = areas.drop("change")
        done += 1
        gap = 0.0
        if not fixed_hyper:
            every = u.select("i", "k", F.col("u").alias("e"))
            pairs = inner.join(every.withColumnRenamed("e", "f").withColumnRenamed("i", "j"), "j").join(every, ["i", "k"]).groupBy((F.col("k") == p).alias("mode")).agg(F.sum(F.col("w") * F.col("e") * F.col("f")).alias("near"))
            squares = every.join(areas.select("i", "deg"), "i").groupBy((F.col("k") == p).alias("mode")).agg(F.sum(F.col("e") * F.col("e")).alias("one"), F.sum(F.col("deg") * F.col("e") * F.col("e")).alias("all"))
            near = {row["mode"]: row["near"] for row in pairs.collect()}
            one, rough = 0.0, 0.0
            for row in squares.collect():
                share = 1 if row["mode"] else draws
                one += row["one"] / share
                rough += (row["all"] - near.get(row["mode"], 0.0)) / share
            before = (r, t)
            best_t = lambda v: (2 * prior[1] + v * rough + (1 - v) * one) / (areas_n + 2 * prior[0] + 2)  # noqa: E731, B023
            if rho is None:
                spread = best_t if tau2 is None else (lambda v: tau2)
                value = lambda v: prior_det(v) / 2 - (areas_n / 2 + prior[0] + 1) * math.log(spread(v)) - (2 * prior[1] + v * rough + (1 - v) * one) / (2 * spread(v))  # noqa: E731, B023
                r = min(0.99, max(0.0, _highest(value, 0.0, 0.99)))
            if tau2 is None:
                t = best_t(r)
            gap = max(abs(r - before[0]), abs(math.log(t / before[1])))
        if (gap < tolerance and change < tolerance) or done >= rounds:
            break
    drawn = u.where(F.col("k") > p)
    mode = u.where(F.col("k") == p).select("i", F.col("u").alias("mode"), *[F.col(f"b{m}").alias(f"m{m}") for m in range(p)])
    every = drawn.join(mode, "i").join(areas.select("i", "y", "off", "n", *xs), "i")
    every = every.withColumn("lin", F.col("mode") + F.col("u") + _add([F.col(x) * (F.col(f"b{m}") + F.col(f"m{m}")) for m, x in enumerate(xs)]))
    fitted = F.exp(F.col("lin") + F.col("off")) if family == "poisson" else F.col("n") / (1 + F.exp(-F.col("lin") - F.col("off")))
    every = cut(every.select("i", "k", "y", "n", "off", "lin", (F.col("mode") + F.col("u")).alias("effect"), fitted.alias("mu")))
    interval = lambda q: F.exp(F.percentile("lin", q))
    out = every.groupBy("i").agg(F.avg("mu").alias("fitted"), F.avg("effect").alias("effect"), F.stddev_samp("effect").alias("effect_sd"), F.avg(F.exp("lin")).alias("rr"), interval(0.025).alias("rr_lo"), interval(0.975).alias("rr_hi"), F.avg((F.col("lin") > 0).cast("double")).alias("p_gt_1"))
    logs = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    y, n, m = F.col("y"), F.col("n"), F.col("mu")
    deviance = 2 * (logs(y, m) - y + m) if family == "poisson" else 2 * (logs(y, m) + logs(n - y, n - m))
    mean = every.groupBy("i").agg(F.max("y").alias("y"), F.max("n").alias("n"), F.max("off").alias("off"), F.avg("lin").alias("lin")).withColumn("mu", fitted)
    fit = every.agg((F.sum(deviance) / draws).alias("deviance")).crossJoin(mean.agg(F.sum(deviance).alias("at_mean")))  # one row each
    model = fit.select(F.lit(float(r)).alias("rho"), F.lit(float(t)).alias("tau2"), "deviance", (F.col("deviance") - F.col("at_mean")).alias("p_d"), (2 * F.col("deviance") - F.col("at_mean")).alias("dic"), F.lit(done).alias("rounds"))
    spread = np.array([b for k, b in betas.items() if k > p])
    at = betas[p] + spread
    terms = ["intercept", *covariates]
    fixed = [(terms[m], float(at[:, m].mean()), float(at[:, m].std(ddof=1)), float(np.quantile(at[:, m], 0.025)), float(np.quantile(at[:, m], 0.975))) for m in range(p)]
    fixed = areas.sparkSession.createDataFrame(fixed, "term string, mean double, sd double, lo double, hi double")
    return Mapped(out.withColumnRenamed("i", key), fixed, model, every.select("i", "k", F.col("lin").alias("eta")))


def space_time_links(links: DataFrame, panel: DataFrame, key: str, time: str, over_time: float = 1.0) -> DataFrame:
    """Links of (area, step) nodes: neighbours within a step, and one area's consecutive rows with weight ``over_time`` (a random walk of first order).

    ``panel`` has a row an area and step with whole-numbered ``time``; a node is ``struct(key, time)``.  Gaps in an area's steps are bridged with the weight over the number of steps.
    """
    nodes = panel.select(F.col(key).alias("a"), F.col(time).cast("bigint").alias("t")).dropna().distinct()
    node = lambda a, t: F.struct(F.col(a).alias("key"), F.col(t).alias("time"))
    beside = nodes.withColumnRenamed("a", "src").join(links.where("src <> dst"), "src").join(nodes.withColumnRenamed("a", "dst"), ["dst", "t"])
    space = beside.select(node("src", "t").alias("src"), node("dst", "t").alias("dst"), F.col("w").cast("double").alias("w"))
    steps = nodes.withColumn("before", F.lag("t").over(Window.partitionBy("a").orderBy("t"))).where("before is not null")
    weight = (over_time / (F.col("t") - F.col("before"))).alias("w")
    ahead = steps.select(node("a", "before").alias("src"), node("a", "t").alias("dst"), weight)
    behind = steps.select(node("a", "t").alias("src"), node("a", "before").alias("dst"), weight)
    return space.unionByName(ahead).unionByName(behind)


def space_time_model(panel: DataFrame, links: DataFrame, key: str, time: str, outcome: str, over_time: float = 1.0, **options) -> Mapped:
    """``car_model`` over the product of the areas' links and time: an effect for every area and step that is near its neighbours' and its own a step before.

    Result ``areas`` has ``key, time`` in place of the node, and ``rr_lo, rr_hi`` for ``inference.exceedance_probability``; ``draws`` keep the node as ``i``.
    """
    node = F.struct(F.col(key).alias("key"), F.col(time).cast("bigint").alias("time"))
    known = panel.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    fit = car_model(known.withColumn("__node", node), space_time_links(links, known, key, time, over_time), "__node", outcome, **options)
    rest = [c for c in fit.areas.columns if c != "__node"]
    return Mapped(fit.areas.select(F.col("__node.key").alias(key), F.col("__node.time").alias(time), *rest), fit.fixed, fit.model, fit.draws)
