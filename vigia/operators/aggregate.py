"""Time series from records: buckets, aggregates, completed calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import bucket, step_sql
from ..functions.stats import aggregate as named_aggregate
from ..functions.stats import aggregates as named_aggregates

INVALID_GEO = ("0", "000000", "")


def drop_invalid_geo(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.coalesce(~F.trim(F.col(column).cast("string")).isin(*INVALID_GEO), F.lit(False)))


def aggregate_series(df: DataFrame, date: str, unit: str = "day", funs: str | dict[str, tuple[str, str]] = "count", by: list[str] | None = None, value: str | None = None, complete: bool = False, name: str | None = None) -> DataFrame:
    """One row a bucket and group: ``date``, the groups, the aggregates.

    ``funs``: the name of one aggregate (of ``value``; output ``name`` or ``<fun>_<value>``), or {output: (aggregate, column)}.
    Rows without a date are dropped.  With ``complete`` every group has every bucket from the first to the last of the
    table: 0 for counts, null for the rest; seasons are completed too.  Missing values are left out of aggregates.
    """
    by = by or []
    wanted = funs if isinstance(funs, dict) else {name or ("n" if funs == "count" else f"{funs}_{value}"): (funs, value or date)}
    rows = df.where(F.col(date).isNotNull()).withColumn("__bucket", bucket(F.col(date), unit))
    made, outputs = named_aggregates(wanted)
    out = rows.groupBy("__bucket", *by).agg(*made).select(F.col("__bucket").alias("date"), *by, *[x.alias(name) for name, x in outputs.items()])
    if complete:
        out = complete_calendar(out, "date", unit, by, [a for a, (fun, _) in wanted.items() if fun == "count"])
    return out.select("date", *by, *wanted)


def complete_calendar(series: DataFrame, date: str, unit: str, by: list[str], zero: list[str]) -> DataFrame:
    """Each group on each bucket between the table's first and last; columns of ``zero`` get 0 where there was no row.

    The calendar is two scalars and its length a span of time, so its product with the groups is as large as the result.
    """
    span = series.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr(step_sql(unit)))).alias(date))
    grid = days.crossJoin(series.select(*by).distinct()) if by else days
    out = grid.join(series, [date, *by], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})


def roll_up_hours(df: DataFrame, keys: list[str], timestamp: str, rules: dict[str, str]) -> DataFrame:
    """Hourly rows to daily ones by a rule a column: sum, mean, max, min or circular."""
    from ..functions.stats import circular_mean

    pick: dict[str, Column] = {c: circular_mean(F.col(c)) if rule == "circular" else named_aggregate(rule, F.col(c)) for c, rule in rules.items()}
    return df.groupBy(*keys, F.to_date(timestamp).alias("date")).agg(*[x.alias(c) for c, x in pick.items()])
