"""Which column of a table holds the date, the place, the diagnosis or the age, by candidate names in order."""

from __future__ import annotations

from collections.abc import Iterable

#: Candidates per system, first found first.
DATES = {
    "SIM": ["data_obito", "death_date", "fecha_muerte", "DTOBITO"],
    "SINASC": ["data_nascimento", "birth_date", "fecha_nacimiento", "DTNASC"],
    "SIH": ["data_internacao", "admission_date", "fecha_ingreso", "data_internacao_sp", "sp_fecha_ingreso", "sp_admission_date", "DT_INTER"],
    "SINAN": ["data_notificacao", "notification_date", "fecha_notificacion", "DT_NOTIFIC"],
    "CNES": ["data_atualizacao", "update_date", "fecha_actualizacion", "DT_COMPET"],
}
PLACES = {
    "residence": ["codigo_municipio_residencia", "residence_municipality_code", "municipio_residencia_paciente_sp", "CODMUNRES", "MUNI_RES"],
    "occurrence": ["codigo_municipio_ocorrencia", "codigo_municipio_ocurrencia", "occurrence_municipality_code", "codigo_municipio_notificacao", "codigo_municipio_notificacion", "notification_municipality_code"],
    "facility": ["municipio_estabelecimento_sp", "uf_municipio_estabelecimento", "facility_uf_municipality", "uf_municipio_establecimiento"],
    "birth": ["codigo_municipio_nascimento", "codigo_municipio_nacimiento", "birth_municipality_code"],
    "generic": ["codigo_municipio", "municipality_code", "codigo_municipio_paciente", "patient_municipality_code", "codigo_gestor_sp", "sp_manager_code", "sp_codigo_gestor"],
    "zip": ["cep_paciente", "codigo_postal_paciente", "codigo_postal", "patient_zip_code", "zip_code"],
}
PLACE_ORDER = {
    "SIM": ["occurrence", "residence", "facility", "generic"],
    "SIH": ["residence", "facility", "occurrence", "generic"],
    "SINAN": ["residence", "occurrence", "facility", "generic"],
    "SIA": ["residence", "facility", "generic"],
    "CNES": ["facility", "generic"],
    "SINASC": ["residence", "birth", "facility", "generic"],
}
DIAGNOSES = {
    "SIM": ["underlying_cause", "causa_basica", "underlying_cause_original", "causa_basica_original", "cause_line_a", "cause_line_b", "cause_line_c", "cause_line_d"],
    "SIH": ["primary_diagnosis", "diagnostico_principal", "secondary_diagnosis", "diagnostico_secundario", "death_cause", "notified_cause", "sp_primary_icd", "sp_secondary_icd"],
    "SIA": ["primary_icd", "cid_principal", "cie_principal", "secondary_icd", "associated_icd"],
    "SINASC": ["underlying_cause", "causa_basica", "maternal_cause", "fetal_cause", "congenital_anomaly_code", "anomaly_code"],
}
AGES = ["age_years", "age", "idade_anos", "idade", "edad_anos", "edad", "age_code", "codigo_idade", "codigo_edad", "IDADE", "NU_IDADE_N"]


def first_present(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    there = set(columns)
    return next((c for c in candidates if c in there), None)


def _needed(found: str | None, what: str) -> str:
    if found is None:
        raise ValueError(f"no {what} column found; name it")
    return found


def _base(system: str | None) -> str:
    return (system or "").upper().split("-")[0]


def date_column(dtypes: list[tuple[str, str]], system: str | None = None) -> str:
    """The system's event date, else the first column of a date type."""
    names = [c for c, _ in dtypes]
    known = DATES.get(_base(system), [c for group in DATES.values() for c in group])
    return _needed(first_present(names, known) or next((c for c, t in dtypes if t in ("date", "timestamp", "timestamp_ntz")), None), "date")


def place_column(columns: list[str], system: str | None = None) -> str:
    """The municipality in the system's order of preference, else a zip code."""
    groups = PLACE_ORDER.get(_base(system), ["residence", "occurrence", "facility", "generic"])
    return _needed(first_present(columns, [c for g in [*groups, "zip"] for c in PLACES[g]]), "place")


def diagnosis_column(columns: list[str], system: str | None = None) -> str:
    """The system's main diagnosis, else the first column named like one of any system."""
    if _base(system) in ("CNES", "SINAN"):
        raise ValueError("this system holds no ICD-10 codes")
    known = [c for group in DIAGNOSES.values() for c in group]
    return _needed(first_present(columns, DIAGNOSES.get(_base(system), [])) or first_present(columns, known), "diagnosis")


def age_column(columns: list[str]) -> str:
    return _needed(first_present(columns, AGES), "age")
