"""Socio-demographic indicators from a catalogue of formulas, with interval bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import wilson, with_rank
from .fits import poisson_bounds

#: Name: (numerator, denominator, multiplier, interval).
CATALOGUE = {
    "dependency_ratio": ("pop_young + pop_elderly", "pop_working", 100, None),
    "aging_index": ("pop_elderly", "pop_young", 100, None),
    "urbanization_rate": ("pop_urban", "pop_total", 100, "binomial"),
    "illiteracy_rate": ("pop_illiterate", "pop_15_plus", 100, "binomial"),
    "water_connection_rate": ("hh_water", "total_hh", 100, "binomial"),
    "sewage_connection_rate": ("hh_sewage", "total_hh", 100, "binomial"),
    "gini_index": ("gini_value", "1", 1, None),
    "infant_mortality_rate": ("deaths_infant", "live_births", 1000, "poisson"),
    "maternal_mortality_ratio": ("deaths_maternal", "live_births", 100000, "poisson"),
    "premature_dcn_mortality": ("deaths_dcn_30_69", "pop_30_69", 100000, "poisson"),
    "homicide_rate": ("deaths_homicide", "pop_total", 100000, "poisson"),
    "traffic_mortality_rate": ("deaths_traffic", "pop_total", 100000, "poisson"),
    "arbovirus_incidence_rate": ("cases_arbovirus", "pop_total", 100000, "poisson"),
    "tb_incidence_rate": ("cases_tb_new", "pop_total", 100000, "poisson"),
    "icsap_hospitalization_rate": ("hosp_icsap", "pop_total", 10000, "poisson"),
    "respiratory_hospitalization_rate": ("hosp_resp", "pop_total", 10000, "poisson"),
    "low_birth_weight_proportion": ("births_low_weight", "live_births", 100, "binomial"),
    "general_fertility_rate": ("live_births", "pop_women_15_49", 1000, "poisson"),
    "cesarean_proportion": ("deliveries_cesarean", "total_deliveries", 100, "binomial"),
    "prenatal_early_coverage": ("prenatal_early", "live_births", 100, "binomial"),
    "beds_per_capita": ("cnes_beds", "pop_total", 1000, None),
    "doctors_per_capita": ("cnes_doctors", "pop_total", 1000, None),
}


def available(columns: list[str]) -> list[str]:
    """Indicators whose columns are all there."""
    import re

    return [k for k, (a, b, _, _) in CATALOGUE.items() if set(re.findall(r"[a-z_0-9]*[a-z_][a-z_0-9]*", f"{a} {b}")) <= set(columns)]


def compute_indicators(df: DataFrame, names: list[str] | None = None, intervals: bool = True) -> DataFrame:
    """One column an indicator; ``intervals`` adds ``_lo`` and ``_hi``: Wilson's for shares, the exact one for Poisson counts.

    A denominator of 0 gives null.
    """
    for name in names or available(df.columns):
        top, bottom, times, kind = CATALOGUE[name]
        x, n = F.expr(top), F.nullif(F.expr(bottom).cast("double"), F.lit(0.0))
        df = df.withColumn(name, times * x / n)
        if intervals and kind == "binomial":
            lo, hi = wilson(x, n)
            df = df.withColumns({f"{name}_lo": times * lo, f"{name}_hi": times * hi})
        elif intervals and kind == "poisson":
            df = poisson_bounds(df.withColumn("__count", x), "__count")
            df = df.withColumns({f"{name}_lo": times * F.col("__count_lo") / n, f"{name}_hi": times * F.col("__count_hi") / n}).drop("__count", "__count_lo", "__count_hi")
    return df


def shares(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts by two variables with percentages of the row, of the column and of all."""
    counts = df.groupBy(rows, columns).agg(F.count("*").alias("n"))
    of = lambda *keys: 100 * F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.withColumns({"pct_row": of(rows), "pct_col": of(columns)}).crossJoin(total).withColumn("pct_total", 100 * F.col("n") / F.col("total")).drop("total")


def rates(counts: DataFrame, population: DataFrame, key: str, n: str, pop: str, per: float = 100_000, classes: int = 5) -> DataFrame:
    """Rate per ``per`` people and its quantile class (by quantile breaks, from 1)."""
    df = counts.join(population, key, "left").withColumn("rate", per * F.col(n) / F.nullif(F.col(pop).cast("double"), F.lit(0.0)))
    breaks = df.agg(F.percentile("rate", [k / classes for k in range(1, classes)]).alias("b"))
    return df.crossJoin(breaks).withColumn("class", F.when(F.col("rate").isNotNull(), F.size(F.filter("b", lambda x: x < F.col("rate"))) + 1)).drop("b")


def annual_change(df: DataFrame, date: str, value: str) -> DataFrame:
    years = df.groupBy(F.year(date).alias("year")).agg(F.sum(value).alias("total"))
    before = F.lag("total").over(Window.orderBy("year"))  # one row a year
    return years.withColumn("pct_change", F.when(before != 0, 100 * (F.col("total") - before) / before))


def cross_correlation(df: DataFrame, date: str, x: str, y: str, most: int = 7) -> DataFrame:
    """Correlation of x at day t - lag with y at day t, for lags -most..most, and the band 2 / sqrt(n); one value a day."""
    left = df.select(F.col(date).cast("date").alias("d"), F.col(x).alias("x")).withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("d", F.expr("date_add(d, lag)"))
    both = left.join(df.select(F.col(date).cast("date").alias("d"), F.col(y).alias("y")), "d")
    return both.groupBy("lag").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n")).withColumn("band", 2 / F.sqrt("n"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    return with_rank(with_rank(rows, x, "__rx"), y, "__ry").agg(F.corr("__rx", "__ry").alias("rho"))


def gini(df: DataFrame, value: str) -> DataFrame:
    """Lorenz curve's Gini index of a non-negative value, from ranks."""
    ranked = with_rank(df.where(F.col(value).isNotNull()).select(value), value, "i").groupBy(value, "i").agg(F.count("*").alias("m"))
    return ranked.agg((2 * F.sum(F.col("i") * F.col("m") * F.col(value)) / (F.sum("m") * F.sum(F.col("m") * F.col(value))) - (F.sum("m") + 1) / F.sum("m")).alias("gini"))


#: Answers that mean a sex.
MALE, FEMALE = ("Male", "Masculino", "M", "1", "male", "masculino"), ("Female", "Feminino", "Femenino", "F", "2", "female", "feminino")


def pyramid(df: DataFrame, age_group: str, sex: str) -> DataFrame:
    """Rows of an age-sex pyramid: count, percentage of the sex, and the signed count (men to the left), by the group's first number."""
    side = F.when(F.col(sex).isin(*MALE), "male").when(F.col(sex).isin(*FEMALE), "female")
    counts = df.where(F.col(age_group).isNotNull()).groupBy(F.col(age_group).alias("age_group"), side.alias("sex")).agg(F.count("*").alias("n")).where("sex is not null")
    total = F.sum("n").over(Window.partitionBy("sex"))  # a row a group and sex
    return counts.select("age_group", "sex", "n", F.round(100 * F.col("n") / total, 1).alias("pct"), F.when(F.col("sex") == "male", -F.col("n")).otherwise(F.col("n")).alias("n_signed"), F.regexp_extract("age_group", "^([0-9]+)", 1).try_cast("int").alias("position"))


def event_calendar(flags: DataFrame, method: str, station: str, value: str) -> DataFrame:
    """Days with the flag, and the mean of ``value`` on them, per station, year and month: what a heat or cold wave calendar shows."""
    hit = F.coalesce(F.col(method), F.lit(False))
    return flags.groupBy(station, F.year("date").alias("year"), F.month("date").alias("month")).agg(F.count_if(hit).alias("n_days"), F.avg(F.when(hit, F.col(value))).alias("mean_value"), F.count("*").alias("n_seen"))


def gap_calendar(filled: DataFrame, station: str, timestamp: str, value: str) -> DataFrame:
    """Values, and how many of them were imputed, per station and month: what a gap filling figure shows."""
    flag = F.col(f"is_imputed_{value}")
    return filled.groupBy(station, F.trunc(timestamp, "month").alias("month")).agg(F.count(value).alias("n_values"), F.count_if(flag).alias("n_imputed"), F.avg(F.when(flag, F.col(value))).alias("mean_imputed"), F.avg(F.when(~flag, F.col(value))).alias("mean_observed"))
