"""Window recipes: runs, neighbours' values, interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_ids(df: DataFrame, flag: Column, keys: list[str], order: str, name: str = "run") -> DataFrame:
    """Number of the run of equal flags that a row is in; runs follow row order within ``keys``."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = (flag != F.lag(flag).over(w)) | F.lag(flag).over(w).isNull()
    return df.withColumn("__new", F.coalesce(changed, F.lit(True)).cast("int")).withColumn(name, F.sum("__new").over(w)).drop("__new")


def runs(df: DataFrame, flag: Column, keys: list[str], order: str, least: int = 1) -> DataFrame:
    """Runs of true flags of at least ``least`` rows: keys, run, start, end, n_rows."""
    marked = run_ids(df.withColumn("__flag", F.coalesce(flag, F.lit(False))), F.col("__flag"), keys, order)
    found = marked.where("__flag").groupBy(*keys, "run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n_rows"))
    return found.where(F.col("n_rows") >= least)


def interpolate(df: DataFrame, value: str, keys: list[str], order: str, name: str | None = None) -> DataFrame:
    """Linear in row order between known values; at the ends the nearest known value."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.row_number().over(w)
    before, behind = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("__n", n).withColumn("__at", F.when(F.col(value).isNotNull(), F.col("__n")))
    a, b = F.last(value, True).over(before), F.first(value, True).over(behind)
    i, j = F.last("__at", True).over(before), F.first("__at", True).over(behind)
    line = a + (b - a) * (F.col("__n") - i) / (j - i)
    return df.withColumn(name or f"{value}_filled", F.coalesce(F.col(value), line, a, b)).drop("__n", "__at")


def complete_rolling_sum(value: str, keys: list[str], order: str, size: int) -> Column:
    """Sum of the last ``size`` rows; null unless all of them have a value."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(size - 1), 0)
    return F.when(F.count(value).over(w) == size, F.sum(value).over(w))
