"""Derived variables of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates


def calendar_variables(df: DataFrame, date: str, language: str = "en", hemisphere: str = "south", region: str | None = None) -> DataFrame:
    """Year to season of ``date`` as columns."""
    d = F.col(date).cast("date")
    out = {
        "year": F.year(d), "month": F.month(d), "quarter": F.quarter(d), "semester": F.when(F.month(d) <= 6, 1).when(d.isNotNull(), 2),
        "day_of_year": F.dayofyear(d), "day_of_week": F.weekday(d) + 1, "is_weekend": F.weekday(d) >= 5, "epi_week": dates.epi_week(d), "epi_year": dates.epi_year(d),
        "month_name": dates.named(F.month(d), dates.MONTHS[language]), "day_name": dates.named(F.weekday(d) + 1, dates.DAYS[language]), "season": dates.astronomical_season(d, hemisphere),
    }
    if region:
        name = region.strip().lower().replace("_", "-").replace(" ", "-")
        out |= {"climatic_season": dates.climatic_season(d, name), "dry_rainy": dates.dry_or_rainy(d, name)}
    return df.withColumns(out)


def age_variables(df: DataFrame, event: str | None = None, birth: str | None = None, code: str | None = None) -> DataFrame:
    """``age_years`` from two dates or from a coded age, and its groups."""
    age = dates.age_in_years(F.col(event), F.col(birth)) if event and birth else dates.decode_age(F.col(code))
    df = df.withColumn("age_years", age)
    a = F.col("age_years")
    return df.withColumns({"age_group": dates.age_group(a), "five_year_group": dates.five_year_group(a), "risk_group": dates.risk_group(a)})
