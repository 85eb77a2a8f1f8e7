"""Aggregate columns with one rule for missing values: null (and NaN, made null at ingest) is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut


def safe_sum(x: Column) -> Column:
    """Sum; 0 where every value is missing."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def exact_mean(x: Column) -> Column:
    """Mean that doesn't depend on the order of the rows, as its sums are of whole numbers: exact for magnitudes from 2^-31 to 2^30, the plain mean for groups beyond.

    A plain mean of the same rows may differ in its last bit each time it is computed, and a value that is held against a level taken from itself with it.
    """
    x = x.cast("double")
    parts, rest = [], x * 2.0**20
    for _ in range(3):
        whole = rest.try_cast("bigint")
        parts.append(F.try_sum(whole))
        rest = (rest - whole) * 2.0**32
    total = (parts[0] + (parts[1] + parts[2] / 2.0**32) / 2.0**32) / 2.0**20
    return F.coalesce(F.when(F.max(F.abs(x)) < 2.0**30, total / F.count(x)), F.avg(x))


def fused(a: Column, b: Column, c: Column) -> Column:
    """``a * b + c`` rounded once: the product's own rounding error is found from halves of the factors (Dekker) and added to the sum's."""
    half = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    p, a1, b1 = a * b, half(a), half(b)
    a2, b2 = a - a1, b - b1
    lost = a2 * b2 - (((p - a1 * b1) - a2 * b1) - a1 * b2)
    s = p + c
    return s + (((p - (s - (s - p))) + (c - (s - p))) + lost)


def circular_mean(degrees: Column) -> Column:
    """Mean direction in (-180, 180]."""
    return F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))))


#: Named aggregates of one value column.
AGGREGATES = {
    "count": lambda x: F.count(F.lit(1)),
    "sum": safe_sum,
    "mean": F.avg,
    "median": F.median,
    "min": F.min,
    "max": F.max,
    "sd": F.stddev_samp,
    "q25": lambda x: F.percentile(x, 0.25),
    "q75": lambda x: F.percentile(x, 0.75),
    "q95": lambda x: F.percentile(x, 0.95),
    "q99": lambda x: F.percentile(x, 0.99),
}


def aggregate(name: str, x: Column) -> Column:
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {name}; one of {', '.join(AGGREGATES)}")
    return AGGREGATES[name](x)


def wilson(successes: Column, trials: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share."""
    p, zz = successes / trials, z * z
    centre, half = p + zz / (2 * trials), z * F.sqrt(p * (1 - p) / trials + zz / (4 * trials * trials))
    return F.greatest((centre - half) / (1 + zz / trials), F.lit(0.0)), F.least((centre + half) / (1 + zz / trials), F.lit(1.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


#: Shares of the named aggregates that are quantiles.
QUANTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75, "q95": 0.95, "q99": 0.99}


def aggregates(wanted: dict[str, tuple[str, str]]) -> tuple[list[Column], dict[str, Column]]:
    """Aggregates for {output: (name, column)}, all quantiles of a column in one; and each output as a column of the result."""
    plain, shares = {}, {}
    for output, (name, column) in wanted.items():
        if name in QUANTILES:
            shares.setdefault(column, []).append(output)
        else:
            plain[output] = aggregate(name, F.col(column)).alias(output)
    made, out = list(plain.values()), {k: F.col(k) for k in plain}
    for n, (column, outputs) in enumerate(shares.items()):
        made.append(F.percentile(column, F.array(*[F.lit(QUANTILES[wanted[o][0]]) for o in outputs])).alias(f"__quantiles{n}"))
        out |= {o: F.get(f"__quantiles{n}", F.lit(k)) for k, o in enumerate(outputs)}
    return made, out


def with_rank(df: DataFrame, value: str, name: str, cells: int = 256) -> DataFrame:
    """Average rank (from 1) of each row's ``value``, in parallel: rows are counted by cells between approximate quantiles, and ranked within
    their cell, so that no task sees the whole table.  Rows without a value get null."""
    known = cut(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__m")))  # read three times below
    edges = known.agg(F.percentile_approx(value, [k / cells for k in range(1, cells)], 10_000).alias("__edges"))
    known = known.crossJoin(edges).withColumn("__cell", F.size(F.filter("__edges", lambda x: x < F.col(value)))).drop("__edges")
    before = known.groupBy("__cell").agg(F.sum("__m").alias("__n"))
    before = before.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a cell
    inside = F.sum("__m").over(Window.partitionBy("__cell").orderBy(value))
    ranked = known.withColumn("__inside", inside).join(before.select("__cell", "__before"), "__cell")
    ranked = ranked.select(value, (F.col("__before") + F.col("__inside") - (F.col("__m") - 1) / 2).alias(name))
    return df.join(ranked, value, "left").select(*df.columns, name)
