"""The batch aggregation as a stream: late records up to a watermark, one row a bucket and group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import aggregate as named_aggregate


def stream_series(records: DataFrame, timestamp: str, by: list[str], funs: dict[str, tuple[str, str]], window: str = "1 day", late: str = "30 days") -> DataFrame:
    """``date``, groups and aggregates of a streaming (or static) frame; state is kept for ``late`` at most."""
    parts = records.withWatermark(timestamp, late).groupBy(F.window(timestamp, window), *by)
    out = parts.agg(*[named_aggregate(fun, F.col(c)).alias(name) for name, (fun, c) in funs.items()])
    return out.select(F.col("window.start").alias("date"), *by, *funs)


def stream_spells(records: DataFrame, timestamp: str, by: list[str], gap: str = "2 days", late: str = "30 days") -> DataFrame:
    """Spells of records that lie closer than ``gap``: start, end, count."""
    parts = records.withWatermark(timestamp, late).groupBy(F.session_window(timestamp, gap), *by)
    return parts.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")
