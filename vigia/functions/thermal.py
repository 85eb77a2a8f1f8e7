"""Thermal comfort and climate indices, one column each.

T is air temperature in °C, rh relative humidity in %, ws wind in m/s, sr solar radiation in kJ/m².  The numbers are
the published coefficients of each index.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def solar(sr: Column) -> Column:
    """Negative and missing radiation count as 0."""
    return F.greatest(F.coalesce(sr, F.lit(0.0)), F.lit(0.0))


def saturation_pressure(t: Column) -> Column:
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def vapour_pressure(t: Column, rh: Column) -> Column:
    return F.round(saturation_pressure(t) * (rh / 100), 3)


def dew_point(t: Column, rh: Column) -> Column:
    g = F.log(rh / 100) + 17.27 * t / (237.7 + t)
    return 237.7 * g / (17.27 - g)


def wbgt(t: Column, rh: Column, sr: Column, ws: Column) -> Column:
    vapour = rh / 100 * saturation_pressure(t)
    wet = (t * F.atan(0.16 * F.sqrt(F.greatest(vapour, F.lit(0.01)) + 0.1)) + 3.0 + t + 0.33 * (rh / 100) * F.exp(0.0514 * t) - 4.0) / 2
    globe = t + 0.0144 * F.pow(F.greatest(sr / 3.6, F.lit(0.0)), 0.6) / F.pow(F.greatest(ws, F.lit(0.1)), 0.2) - 2.0
    return F.round(0.7 * wet + 0.2 * globe + 0.1 * t, 2)


def heat_index(t: Column, rh: Column, mask: bool = True, min_temp: float = 26.7, min_rh: float = 40) -> Column:
    f = t * 9 / 5 + 32
    terms = ((-42.379, 0, 0), (2.04901523, 1, 0), (10.14333127, 0, 1), (-0.22475541, 1, 1), (-6.83783e-3, 2, 0), (-5.481717e-2, 0, 2), (1.22874e-3, 2, 1), (8.5282e-4, 1, 2), (-1.99e-6, 2, 2))
    hi = sum((c * F.pow(f, F.lit(float(a))) * F.pow(rh, F.lit(float(b))) for c, a, b in terms[1:]), F.lit(terms[0][0]))
    dry = (13 - rh) / 4 * F.sqrt(F.greatest(17 - F.abs(f - 95), F.lit(0.0)) / 17)
    damp = (rh - 85) / 10 * ((87 - f) / 5)
    hi = F.when((rh < 13) & f.between(80, 112), hi - dry).when((rh > 85) & f.between(80, 87), hi + damp).otherwise(hi)
    out = F.round(F.least((hi - 32) * 5 / 9, F.lit(60.0)), 2)
    return F.when((t >= min_temp) & (rh >= min_rh), out) if mask else out


def temperature_humidity(t: Column, rh: Column) -> Column:
    return F.round(t - (1 - rh / 100) * (t - 14.4) / 2, 2)


def wind_chill_metric(t: Column, ws: Column, mask: bool = True) -> Column:
    v = F.pow(F.greatest(ws * 3.6, F.lit(0.01)), 0.16)
    out = F.round(13.12 + 0.6215 * t - 11.37 * v + 0.3965 * t * v, 2)
    return F.when((t <= 10) & (ws > 1.3), out) if mask else out


def wind_chill_imperial(t: Column, ws: Column, mask: bool = True) -> Column:
    f, v = t * 9 / 5 + 32, F.pow(F.greatest(ws * 0.621371, F.lit(0.01)), 0.16)
    out = F.round((35.74 + 0.6215 * f - 35.75 * v + 0.4275 * f * v - 32) * 5 / 9, 2)
    return F.when((t <= 10) & (ws > 1.3), out) if mask else out


def effective_temperature(t: Column, rh: Column, ws: Column) -> Column:
    """Missing where the wind is under 0.2 m/s, for which the formula has no value."""
    out = t - 0.4 * (t - 10) * (1 - rh / 100) - 1.1 * F.sqrt(F.greatest(ws - 0.2, F.lit(0.0)))
    return F.when(ws >= 0.2, F.round(F.greatest(out, F.lit(-273.15)), 2))


def utci(t: Column, rh: Column, ws: Column, sr: Column, correction: float = 0.0) -> Column:
    radiant = 0.07 * (sr / 3.6) - 1.5
    wind = F.greatest(ws * 1.5, F.lit(0.5))
    vapour = rh / 100 * saturation_pressure(t) * 1000 - 1000
    out = t + 0.048 * vapour / 100 - 0.29 * F.log(wind + 0.1) + 0.016 * radiant + 0.010 * radiant * radiant / 10 - 6e-5 * radiant * radiant * wind + correction
    return F.round(F.least(F.greatest(out, F.lit(-60.0)), F.lit(50.0)), 2)


def pet(t: Column, rh: Column, ws: Column, sr: Column, month: Column, correction: float = 0.0, clothing: float = 0.6) -> Column:
    clo = clothing * F.when(month.isin(12, 1, 2), 0.5).when(month.isin(3, 4, 5, 9, 10, 11), 0.7).otherwise(0.9)
    out = t + 0.10 * (rh - 50) / 10 - 0.30 * F.greatest(ws, F.lit(0.1)) + 0.05 * (0.06 * (sr / 3.6) - 2.0) + 0.50 * (1 - clo) + correction
    return F.round(out, 2)


def cooling_degrees(t: Column, base: float = 18) -> Column:
    return F.round(F.greatest(t - base, F.lit(0.0)), 1)


def heating_degrees(t: Column, base: float = 18) -> Column:
    return F.round(F.greatest(base - t, F.lit(0.0)), 1)


def growing_degrees(t: Column, base: float = 10, upper: float = 30) -> Column:
    return F.round(F.least(F.greatest(t, F.lit(float(base))), F.lit(float(upper))) - base, 1)


def heat_stress_class(index: Column) -> Column:
    return F.when(index > 33, "Extreme").when(index > 30, "Very High").when(index > 28, "High").when(index > 25, "Moderate").when(index > 20, "Low").otherwise("None")


def humidity_class(rh: Column) -> Column:
    return F.when(rh < 30, "Arid").when(rh < 50, "Semi-arid").when(rh < 70, "Humid").otherwise("Perhumid")


def confidence_flag(x: Column, low: float, high: float, extreme: float) -> Column:
    return F.when(x >= extreme, "extreme").when(x >= high, "high").when(x <= low, "low").otherwise("normal")


def interval(index, values: dict[str, Column], spread: dict[str, float], draws: int = 200) -> Column:
    """A struct of ``low`` and ``high``, the 2.5 and 97.5 percentiles of ``index(**values)`` under normal errors of the inputs.

    ``spread``: standard deviation of each uncertain input; draws of the inputs follow the golden-ratio sequence (a fixed
    set that covers the normal distribution evenly), so that the interval is the same in every run.  All draws of a row stay in that row; their errors are constants of the
    plan, and a row draws and sorts once.
    """
    from ..operators.events import normal_quantile_of

    names = [n for n in values if spread.get(n)]
    step = {n: (0.6180339887498949, 0.7548776662466927, 0.5698402909980532, 0.8191725133961645)[k] for k, n in enumerate(names)}
    errors = [F.lit([spread[n] * normal_quantile_of((0.5 + i * step[n]) % 1.0 * 0.999999 + 5e-7) for i in range(1, draws + 1)]).alias(n) for n in names]
    if names:
        drawn = F.transform(F.arrays_zip(*errors), lambda e: index(**{n: v + e[n] if n in step else v for n, v in values.items()}))
    else:
        drawn = F.array_repeat(index(**values), draws)

    def at(ordered: Column, p: float) -> Column:
        place = p * (draws - 1)
        k, part = int(place), place - int(place)
        return F.round(F.get(ordered, F.lit(k)) * (1 - part) + F.get(ordered, F.lit(min(k + 1, draws - 1))) * part, 2)

    once = F.array(F.sort_array(F.array_compact(drawn)))  # nulls count as last
    return F.get(F.transform(once, lambda s: F.struct(at(s, 0.025).alias("low"), at(s, 0.975).alias("high"))), F.lit(0))


def uncertainty(index, values: dict[str, Column], spread: dict[str, float], draws: int = 200) -> tuple[Column, Column]:
    """The two ends of ``interval`` as columns; each draws anew, so select the struct first where both are needed."""
    both = interval(index, values, spread, draws)
    return both["low"], both["high"]
