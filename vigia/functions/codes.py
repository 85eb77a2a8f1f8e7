"""Code tables (diagnosis groups, regions) and the predicates made from them."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Diagnosis groups and the ICD-10 codes or ranges that they hold.
DISEASE_GROUPS = {
    "diarrheal": ["A00-A09"],
    "tuberculosis": ["A15-A19"],
    "zoonotic_bacterial": ["A20-A28"],
    "leptospirosis": ["A27"],
    "hansen": ["A30"],
    "vector_borne": ["A75-A79", "A90-A99"],
    "dengue": ["A90", "A91"],
    "chikungunya": ["A92.0"],
    "zika": ["A92.5", "P35.4", "Q02"],
    "yellow_fever": ["A95"],
    "malaria": ["B50-B54"],
    "leishmaniasis": ["B55"],
    "chagas": ["B57"],
    "schistosomiasis": ["B65"],
    "helminthiasis": ["B65-B83"],
    "skin_cancer": ["C43-C44"],
    "respiratory_cancer": ["C30-C39"],
    "diabetes": ["E10-E14"],
    "malnutrition": ["E40-E46"],
    "mental_disorders": ["F00-F99"],
    "climate_sensitive_mental_disorders": ["F30-F33", "F41", "F43", "F50"],
    "cardiovascular": ["I00-I99"],
    "ischemic_heart": ["I20-I25"],
    "acute_myocardial_infarction": ["I21-I22"],
    "cerebrovascular": ["I60-I69"],
    "stroke": ["I63-I64"],
    "hypertension": ["I10-I15"],
    "respiratory": ["J00-J99"],
    "acute_respiratory": ["J00-J06", "J20-J22"],
    "influenza_pneumonia": ["J09-J18"],
    "pneumonia": ["J12-J18"],
    "asthma": ["J45-J46"],
    "copd": ["J40-J44"],
    "digestive": ["K00-K93"],
    "skin_infections": ["L00-L08"],
    "renal": ["N00-N29"],
    "pregnancy_complications": ["O00-O99"],
    "perinatal": ["P00-P96"],
    "congenital": ["Q00-Q99"],
    "microcephaly": ["Q02"],
    "ill_defined": ["R00-R99"],
    "injuries": ["S00-T98"],
    "transport_accidents": ["V01-V99"],
    "drowning": ["W65-W74"],
    "heat_exposure": ["X30"],
    "cold_exposure": ["X31"],
    "natural_disasters": ["X36-X39"],
    "suicide_self_harm": ["X60-X84", "Y87.0"],
    "heat_related": ["E86", "T67", "X30"],
    "waterborne": ["A00-A09", "A27"],
    "air_pollution_related": ["J20-J22", "J40-J46", "I20-I25", "I60-I69"],
    "climate_sensitive_all": ["A00-A09", "A15-A19", "A20-A28", "A75-A79", "A90-A99", "B50-B57", "B65-B83", "C43-C44", "E10-E14", "E40-E46", "I00-I99", "J00-J99", "L00-L08", "N00-N29", "O00-O99", "P00-P96", "S00-T98", "V01-Y98"],
    "pediatric_respiratory": ["J00-J06", "J09-J18", "J20-J22"],
    "elderly_cardiovascular": ["I20-I25", "I60-I69"],
    "fever_syndrome": ["A90-A99", "B50-B54"],
    "respiratory_syndrome": ["J00-J22", "J40-J46"],
    "diarrheal_syndrome": ["A00-A09"],
    "neurological_disorders": ["G00-G99"],
}
#: Groups that are not flagged as sensitive to climate.
NOT_CLIMATE = frozenset({"hansen", "digestive", "congenital", "ill_defined"})

#: States of macro-regions, biomes, basins and policy areas.
REGIONS = {
    "norte": ["AC", "AP", "AM", "PA", "RO", "RR", "TO"],
    "nordeste": ["AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"],
    "centro_oeste": ["DF", "GO", "MT", "MS"],
    "sudeste": ["ES", "MG", "RJ", "SP"],
    "sul": ["PR", "RS", "SC"],
    "amazonia_legal": ["AC", "AP", "AM", "PA", "RO", "RR", "MT", "MA", "TO"],
    "mata_atlantica": ["AL", "BA", "CE", "ES", "GO", "MA", "MG", "MS", "PB", "PE", "PI", "PR", "RJ", "RN", "RS", "SC", "SE", "SP"],
    "caatinga": ["AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE", "MG"],
    "cerrado": ["BA", "DF", "GO", "MA", "MG", "MS", "MT", "PA", "PI", "PR", "RO", "SP", "TO"],
    "pantanal": ["MT", "MS"],
    "pampa": ["RS"],
    "bacia_amazonica": ["AC", "AM", "AP", "MT", "PA", "RO", "RR"],
    "bacia_sao_francisco": ["AL", "BA", "DF", "GO", "MG", "PE", "SE"],
    "bacia_parana": ["GO", "MG", "MS", "PR", "SP"],
    "bacia_tocantins": ["GO", "MA", "PA", "TO"],
    "semi_arido": ["AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE", "MG"],
    "matopiba": ["MA", "TO", "PI", "BA"],
    "arco_desmatamento": ["RO", "AC", "AM", "PA", "MT", "MA"],
    "dengue_hyperendemic": ["GO", "MS", "MT", "PR", "RJ", "SP"],
    "sudene": ["AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE", "MG", "ES"],
    "fronteira_brasil": ["AC", "AM", "AP", "MT", "MS", "PA", "PR", "RO", "RR", "RS", "SC"],
}
REGION_ALIASES = {
    "north": "norte", "northeast": "nordeste", "central_west": "centro_oeste", "southeast": "sudeste", "south": "sul", "amazon": "amazonia_legal", "legal_amazon": "amazonia_legal",
    "atlantic_forest": "mata_atlantica", "semi_arid": "semi_arido", "border": "fronteira_brasil", "noreste": "nordeste", "sur": "sul", "amazonia": "amazonia_legal",
    "bosque_atlantico": "mata_atlantica", "semiarido": "semi_arido", "frontera": "fronteira_brasil",
}

#: Characters with an accent and without, for accent-insensitive comparison.
ACCENTED, PLAIN = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.lower(F.translate(F.trim(text), ACCENTED, PLAIN))


def states_of(region: str) -> list[str]:
    key = region.strip().lower().replace(" ", "_").replace("-", "_")
    key = REGION_ALIASES.get(key, key)
    if key not in REGIONS:
        raise ValueError(f"unknown region: {region}; one of {', '.join(REGIONS)}")
    return REGIONS[key]


def expand(codes: list[str]) -> list[str]:
    """``J00-J06`` becomes J00 ... J06; a range over several letters keeps its first letter."""
    out: list[str] = []
    for code in codes:
        if m := re.fullmatch(r"([A-Z])(\d{2})-([A-Z])(\d{2})", code.strip().upper()):
            out += [f"{m[1]}{n:02d}" for n in range(int(m[2]), int(m[4]) + 1)]
        else:
            out.append(code.strip().upper())
    return list(dict.fromkeys(out))


def group_codes(group: str) -> list[str]:
    if group not in DISEASE_GROUPS:
        near = sorted((levenshtein(group, g), g) for g in DISEASE_GROUPS)
        hint = ", ".join(g for d, g in near[:3] if d <= 3)
        raise ValueError(f"unknown disease group: {group}" + (f"; did you mean {hint}?" if hint else ""))
    return expand(DISEASE_GROUPS[group])


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def merged(codes: list[str]) -> tuple[list[tuple[str, str]], list[str]]:
    """Three-character codes as runs (first, last) of neighbours under one letter, and the other codes."""
    short = sorted({c for c in codes if re.fullmatch(r"[A-Z]\d{2}", c)})
    runs: list[tuple[str, str]] = []
    for c in short:
        if runs and runs[-1][1][0] == c[0] and int(runs[-1][1][1:]) + 1 == int(c[1:]):
            runs[-1] = (runs[-1][0], c)
        else:
            runs.append((c, c))
    return runs, [c for c in codes if c not in set(short)]


def matches(column: Column, codes: list[str], how: str = "starts_with") -> Column:
    """Predicate on a diagnosis column.

    exact: one of the codes.  starts_with: begins with one; a run of three-character codes becomes a range of strings and a single code a
    ``startswith``, both of which reach the Parquet scan; the dot of a dotted code stands for any character.
    range: contains one anywhere.
    """
    if how == "exact":
        return column.isin(codes)
    if how == "range":
        return column.rlike("|".join(codes))
    if how != "starts_with":
        raise ValueError(f"unknown match type: {how}")
    runs, rest = merged(codes)
    plain, dotted = [c for c in rest if "." not in c], [c for c in rest if "." in c]
    # what begins with I09 lies before "I0:" (the character after 9), what begins with I19 before "I1:"
    parts = [column.startswith(a) if a == b else (column >= a) & (column < b[:2] + chr(ord(b[2]) + 1)) & column.substr(3, 1).between("0", "9") for a, b in runs]
    parts += [column.startswith(c) for c in plain] + ([column.rlike(f"^({'|'.join(dotted)})")] if dotted else [])
    return reduce(or_, parts)


def catalogue(language_labels: dict[str, str] | None = None) -> list[tuple[str, str, bool]]:
    """(group, its codes, sensitive to climate) of all disease groups; ``language_labels`` rename them."""
    label = language_labels or {}
    return [(label.get(g, g), ", ".join(c), g not in NOT_CLIMATE) for g, c in DISEASE_GROUPS.items()]


def groups_of(code: str) -> list[str]:
    """Disease groups that hold a diagnosis code."""
    return [g for g, c in DISEASE_GROUPS.items() if any(code.upper().startswith(x.replace(".", "")) or code.upper().startswith(x) for x in expand(c))]


#: Parts of census variables' names that tell their subject; the first subject with a part in the name counts.
SUBJECTS = {
    "demographics": ["idade", "age", "edad", "sexo", "sex", "raca", "race", "cor", "color", "nascimento", "birth", "nacimiento", "parentesco", "kinship"],
    "education": ["escola", "educ", "alfabetiz", "literacy", "instrucao", "instruction", "instruccion", "curso", "course", "serie", "grade", "grado"],
    "income": ["renda", "income", "ingreso", "salario", "wage", "beneficio", "benefit", "aposentadoria", "pension"],
    "housing": ["domicilio", "household", "vivienda", "agua", "water", "esgoto", "sewer", "alcantarillado", "energia", "energy", "lixo", "garbage", "basura", "banheiro", "bathroom"],
    "health": ["saude", "health", "salud", "deficiencia", "disability", "discapacidad", "enxergar", "see", "ver", "ouvir", "hear", "oir", "caminhar", "walk", "caminar", "morte", "death", "muerte", "filho", "child", "hijo"],
    "migration": ["migracao", "migration", "migracion", "nasceu", "born", "nacio", "residencia", "residence", "moradia", "dwelling", "fixou", "settled"],
    "geography": ["municipio", "municipality", "uf", "state", "estado", "regiao", "region", "area"],
    "work": ["trabalho", "work", "trabajo", "ocupacao", "occupation", "ocupacion", "emprego", "employment", "empleo", "profissao", "profession", "profesion"],
}


def subject(name: Column) -> Column:
    """Subject of a census variable by its name; other, if none fits."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.rlike("|".join(parts)), s) for s, parts in SUBJECTS.items()], F.lit("other"))
