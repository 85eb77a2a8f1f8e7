"""Row filters: diagnoses, demographics, places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import expand, fold, group_codes, matches, states_of

#: Fixed values that stand for an unknown answer.
IGNORED = ("ignorado", "ignored", "ignorada", "não informado", "nao informado", "not informed", "no informado", "unknown", "desconhecido", "9", "99", "")


def filter_diagnosis(df: DataFrame, column: str, codes: list[str] | None = None, group: str | None = None, how: str = "starts_with") -> DataFrame:
    """Rows whose diagnosis is one of ``codes`` or of the named group, which goes first."""
    wanted = group_codes(group) if group else expand(codes or [])
    if not wanted:
        raise ValueError("give codes or a group")
    return df.where(matches(F.col(column), wanted, how))


def filter_demographics(df: DataFrame, values: dict[str, list] | None = None, age: tuple[float, float] | None = None, age_column: str = "age_years", region: str | None = None, state_column: str = "uf", municipalities: list[str] | None = None, municipality_column: str = "code_muni") -> DataFrame:
    """All given conditions together; text values are compared in title case, ages with both ends, municipalities by 6 digits."""
    for column, wanted in (values or {}).items():
        df = df.where(F.initcap(F.trim(F.col(column))).isin([str(v).strip().title() for v in wanted]))
    if age:
        df = df.where(F.col(age_column).between(*age))
    if region:
        df = df.where(F.upper(F.col(state_column)).isin(states_of(region)))
    if municipalities:
        df = df.where(F.substring(F.col(municipality_column).cast("string"), 1, 6).isin([m[:6] for m in municipalities]))
    return df


def drop_ignored(df: DataFrame, columns: list[str], ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """Without rows whose value in any of ``columns`` is missing or says that it is unknown."""
    for c in columns:
        df = df.where(F.coalesce(~F.lower(F.trim(F.col(c))).isin(*ignored), F.lit(False)))
    return df


def suggest_names(df: DataFrame, column: str, wanted: str, top: int = 5) -> DataFrame:
    """Names that begin like ``wanted`` or are a few edits away, nearest first: a top-k report."""
    key = fold(F.lit(wanted))
    most = max(1, min(3, len(wanted) // 4))
    distance = F.levenshtein(fold(F.col(column)), key)
    near = df.select(column).distinct().withColumn("distance", distance).where((F.col("distance") <= most) | fold(F.col(column)).startswith(key))
    return near.orderBy("distance", column).limit(top)


def resolve_cities(wanted: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Codes of cities given by name: ``name, state, code_muni, n_matches, status`` for each row of ``wanted`` (``name, state``; a null state is any).

    Names are compared without accents, case and outer blanks, states in upper case; ``municipalities`` has ``code_muni, name, state``.  status: ok (one municipality fits), ambiguous (several
    do, a state is needed), other_state (the name is known, but not in that state), unknown.  Only ok rows have a code; n_matches counts what fits, in other states for other_state.
    """
    clean = lambda c: F.upper(F.trim(c))
    known = municipalities.select(fold(F.col("name")).alias("__n"), clean("state").alias("__s"), "code_muni")
    per_state = known.groupBy("__n", "__s").agg(F.count("*").alias("__here"), F.min("code_muni").alias("__code"))
    per_name = known.groupBy("__n").agg(F.count("*").alias("__all"), F.min("code_muni").alias("__only"))
    rows = wanted.select("name", "state", fold(F.col("name")).alias("__n"), clean("state").alias("__s"))
    out = rows.join(per_state, ["__n", "__s"], "left").join(per_name, "__n", "left")
    fits = F.when(F.col("__s").isNull(), F.col("__all")).otherwise(F.col("__here"))
    status = F.when(fits == 1, "ok").when(fits > 1, "ambiguous").when(F.col("__all") > 0, "other_state").otherwise("unknown")
    code = F.when(fits == 1, F.when(F.col("__s").isNull(), F.col("__only")).otherwise(F.col("__code")))
    return out.select("name", "state", code.alias("code_muni"), F.coalesce(fits, "__all", F.lit(0)).alias("n_matches"), status.alias("status"))


def filter_cities(df: DataFrame, resolved: DataFrame, column: str = "code_muni") -> DataFrame:
    """Rows of the municipalities that ``resolve_cities`` has found, by six digits."""
    six = lambda c: F.substring(F.col(c).cast("string"), 1, 6)
    codes = resolved.where("status = 'ok'").select(six("code_muni").alias("__k")).distinct()
    return df.join(codes, six(column) == codes["__k"], "left_semi")
