"""Calendar columns: buckets, epidemiological week, seasons, ages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months and days (Monday first) in the three languages.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "pt": "Janeiro Fevereiro Março Abril Maio Junho Julho Agosto Setembro Outubro Novembro Dezembro".split(),
    "es": "Enero Febrero Marzo Abril Mayo Junio Julio Agosto Septiembre Octubre Noviembre Diciembre".split(),
}
DAYS = {
    "en": "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split(),
    "pt": "Segunda Terça Quarta Quinta Sexta Sábado Domingo".split(),
    "es": "Lunes Martes Miércoles Jueves Viernes Sábado Domingo".split(),
}
SEASONS = ("summer", "autumn", "winter", "spring")
#: Rainy, transition and dry months of each climatic region; other regions have none.
CLIMATIC = {
    "norte": ({12, 1, 2, 3, 4, 5}, {6, 11}, {7, 8, 9, 10}),
    "nordeste": ({3, 4, 5, 6, 7}, {2, 8}, {9, 10, 11, 12, 1}),
    "centro-oeste": ({11, 12, 1, 2, 3}, {4, 10}, {5, 6, 7, 8, 9}),
    "sudeste": ({11, 12, 1, 2, 3}, {4, 10}, {5, 6, 7, 8, 9}),
}


def bucket(day: Column, unit: str) -> Column:
    """First day of the bucket that ``day`` lies in.

    Weeks start on Sunday; "n days" restarts on the first of each month; "season" is the quarter that
    begins in December, March, June or September, so January belongs to the December before.
    """
    day = day.cast("date")
    match = re.fullmatch(r"(\d+) (day|month|year)s?", unit)
    if match:
        n, what = int(match[1]), match[2]
        if what == "day":
            return F.make_date(F.year(day), F.month(day), (F.floor((F.dayofmonth(day) - 1) / n) * n + 1).cast("int"))
        if what == "month":
            return F.make_date(F.year(day), (F.floor((F.month(day) - 1) / n) * n + 1).cast("int"), F.lit(1))
        return F.make_date((F.floor(F.year(day) / n) * n).cast("int"), F.lit(1), F.lit(1))
    if unit == "day":
        return day
    if unit == "week":
        return F.date_sub(day, F.dayofweek(day) - 1)
    if unit == "season":
        return F.add_months(F.trunc(F.add_months(day, 1), "quarter"), -1)
    if unit in ("month", "quarter", "year"):
        return F.trunc(day, unit)
    raise ValueError(f"unknown time unit: {unit}")


def step_sql(unit: str) -> str:
    """The interval from one bucket to the next, for ``sequence``."""
    return {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year", "season": "interval 3 months"}[unit]


def epi_week(day: Column) -> Column:
    """Week of the year that holds the week's Wednesday; weeks run from Sunday to Saturday."""
    wednesday = F.date_add(F.date_sub(day, F.dayofweek(day) - 1), 3)
    return F.ceil(F.dayofyear(wednesday) / 7).cast("int")


def epi_year(day: Column) -> Column:
    return F.year(F.date_add(F.date_sub(day, F.dayofweek(day) - 1), 3))


def astronomical_season(day: Column, hemisphere: str = "south") -> Column:
    """summer, autumn, winter or spring by month; the hemispheres are half a year apart."""
    shift = 0 if hemisphere == "south" else 2
    names = F.array(*[F.lit(SEASONS[(k + shift) % 4]) for k in range(4)])
    return F.when(day.isNotNull(), F.element_at(names, (F.floor((F.month(day) % 12) / 3) + 1).cast("int")))


def climatic_season(day: Column, region: str) -> Column:
    """rainy, transition or dry by the region's months; null for a region without them."""
    if region not in CLIMATIC:
        return F.lit(None).cast("string")
    wet, between, dry = (sorted(x) for x in CLIMATIC[region])
    return F.when(F.month(day).isin(wet), "rainy").when(F.month(day).isin(between), "transition").when(F.month(day).isin(dry), "dry")


def dry_or_rainy(day: Column, region: str) -> Column:
    wet = sorted(CLIMATIC.get(region, (set(), set(), set()))[0])
    return F.when(F.month(day).isin(wet), "rainy").when(day.isNotNull(), "dry") if wet else F.lit(None).cast("string")


def named(number: Column, names: list[str]) -> Column:
    """The name with that number, from 1; null for null."""
    return F.when(number.isNotNull(), F.element_at(F.array(*map(F.lit, names)), number))


def age_in_years(event: Column, birth: Column) -> Column:
    return F.floor(F.datediff(event, birth) / 365.25).cast("int")


def decode_age(code: Column, centenarians: bool = True) -> Column:
    """Age in years of a code whose first digit is its unit: 1, 2 (hours, days): 0; 3 months; 4 years; 5 years over 100."""
    unit, value = F.substring(code, 1, 1), F.expr("0") + code.substr(F.lit(2), F.lit(10)).try_cast("int")
    return F.when(unit.isin("1", "2"), F.when(value.isNotNull(), 0)).when(unit == "3", F.floor(value / 12).cast("int")).when(unit == "4", value).when(unit == "5", value + (100 if centenarians else 0))


def age_group(age: Column, breaks: tuple[float, ...] = (0, 5, 15, 60, float("inf"))) -> Column:
    """Left-closed bins, called "lo-(hi-1)", the last one "lo+"."""
    bins = [(lo, hi, f"{lo:g}+" if hi == float("inf") else f"{lo:g}-{hi - 1:g}") for lo, hi in zip(breaks, breaks[1:], strict=False)]
    return reduce(lambda c, b: c.when((age >= b[0]) & (age < b[1] if b[1] != float("inf") else F.lit(True)), b[2]), bins[1:], F.when((age >= bins[0][0]) & (age < bins[0][1]), bins[0][2]))


def five_year_group(age: Column) -> Column:
    low = (F.floor(age / 5) * 5).cast("int")
    return F.when(age >= 80, "80+").when(age >= 0, F.concat_ws("-", low.cast("string"), (low + 4).cast("string")))


def risk_group(age: Column) -> Column:
    """Climate risk groups, closed on the right: children to 4, adults to 64, elderly."""
    return F.when(age <= 4, "0-4").when(age <= 64, "5-64").when(age > 64, "65+")


def parse_date(text: Column) -> Column:
    """The first of yyyy-MM-dd, yyyyMMdd, ddMMyyyy that reads the text; null otherwise."""
    return F.coalesce(*[F.try_to_date(text, f) for f in ("yyyy-MM-dd", "yyyyMMdd", "ddMMyyyy")])
