"""Standardising raw records: encoding, names, value codes, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date

#: Recodes of coded answers, per system where they differ.
SEX = {"SIM": {"1": "Male", "2": "Female", "0": "Ignored"}, "SIH": {"1": "Male", "3": "Female", "0": "Ignored"}, "SINAN": {"M": "Male", "F": "Female", "I": "Ignored"}, "SINASC": {"1": "Male", "2": "Female", "0": "Ignored"}}
RACE = {"1": "White", "2": "Black", "3": "Yellow", "4": "Brown", "5": "Indigenous", "9": "Ignored"}
#: Columns of the raw systems under their standard names.
NAMES = {
    "SIM": {"DTOBITO": "death_date", "DTNASC": "birth_date", "IDADE": "age_code", "SEXO": "sex", "RACACOR": "race", "CODMUNRES": "residence_municipality_code", "CODMUNOCOR": "occurrence_municipality_code", "CAUSABAS": "underlying_cause", "TIPOBITO": "death_type", "ESTCIV": "marital_status", "ESC": "education"},
    "SIH": {"DT_INTER": "admission_date", "DT_SAIDA": "discharge_date", "DIAG_PRINC": "primary_diagnosis", "MUNIC_RES": "residence_municipality_code", "SEXO": "sex", "IDADE": "age", "COD_IDADE": "age_unit", "NASC": "birth_date", "CEP": "zip_code", "N_AIH": "admission_number"},
    "SINAN": {"DT_NOTIFIC": "notification_date", "ID_AGRAVO": "disease_code", "DT_SIN_PRI": "symptom_date", "NU_IDADE_N": "age_code", "CS_SEXO": "sex", "CS_RACA": "race", "ID_MN_RESI": "residence_municipality_code"},
    "SIA": {"PA_PROC_ID": "procedure_code", "PA_CIDPRI": "primary_diagnosis", "PA_CBOCOD": "occupation_code", "PA_AUTORIZ": "authorization_number"},
    "CNES": {"CNES": "facility_code", "TP_UNID": "facility_type", "NATUREZA": "organization_type", "ESFERA_A": "administrative_sphere"},
    "SINASC": {"LOCNASC": "birth_place", "DTNASC": "birth_date", "IDADEMAE": "mother_age", "APGAR1": "apgar_1min", "APGAR5": "apgar_5min", "SEXO": "sex", "PESO": "birth_weight"},
}
#: Standard names of these columns in the two other languages.
TRANSLATED = {
    "pt": {
        "death_date": "data_obito", "birth_date": "data_nascimento", "age_code": "codigo_idade", "sex": "sexo", "race": "raca", "residence_municipality_code": "codigo_municipio_residencia",
        "occurrence_municipality_code": "codigo_municipio_ocorrencia", "underlying_cause": "causa_basica", "death_type": "tipo_obito", "marital_status": "estado_civil", "education": "escolaridade",
        "admission_date": "data_internacao", "discharge_date": "data_saida", "primary_diagnosis": "diagnostico_principal", "age": "idade", "age_unit": "codigo_unidade_idade", "zip_code": "cep_paciente", "admission_number": "numero_aih",
        "notification_date": "data_notificacao", "disease_code": "agravo", "symptom_date": "data_primeiros_sintomas", "procedure_code": "procedimento_id", "occupation_code": "cbo_profissional", "authorization_number": "numero_autorizacao",
        "facility_code": "codigo_cnes", "facility_type": "tipo_unidade", "organization_type": "natureza_organizacao", "administrative_sphere": "esfera_administrativa", "birth_place": "local_nascimento", "mother_age": "idade_mae",
        "apgar_1min": "apgar_1_minuto", "apgar_5min": "apgar_5_minutos", "birth_weight": "peso_nascimento",
    },
    "es": {
        "death_date": "fecha_muerte", "birth_date": "fecha_nacimiento", "age_code": "codigo_edad", "sex": "sexo", "race": "raza", "residence_municipality_code": "codigo_municipio_residencia",
        "occurrence_municipality_code": "codigo_municipio_ocurrencia", "underlying_cause": "causa_basica", "death_type": "tipo_muerte", "marital_status": "estado_civil", "education": "escolaridad",
        "admission_date": "fecha_ingreso", "discharge_date": "fecha_alta", "primary_diagnosis": "diagnostico_principal", "age": "edad", "age_unit": "codigo_unidad_edad", "zip_code": "codigo_postal_paciente", "admission_number": "numero_aih",
        "notification_date": "fecha_notificacion", "disease_code": "enfermedad", "symptom_date": "fecha_primeros_sintomas", "procedure_code": "procedimiento_id", "occupation_code": "cbo_profesional", "authorization_number": "numero_autorizacion",
        "facility_code": "codigo_cnes", "facility_type": "tipo_unidad", "organization_type": "naturaleza_organizacion", "administrative_sphere": "esfera_administrativa", "birth_place": "lugar_nacimiento", "mother_age": "edad_madre",
        "apgar_1min": "apgar_1_minuto", "apgar_5min": "apgar_5_minutos", "birth_weight": "peso_nacimiento",
    },
}
#: Answers in the two other languages.
ANSWERS = {
    "pt": {"Male": "Masculino", "Female": "Feminino", "Ignored": "Ignorado", "White": "Branca", "Black": "Preta", "Yellow": "Amarela", "Brown": "Parda", "Indigenous": "Indígena"},
    "es": {"Male": "Masculino", "Female": "Femenino", "Ignored": "Ignorado", "White": "Blanca", "Black": "Negra", "Yellow": "Amarilla", "Brown": "Parda", "Indigenous": "Indígena"},
}
#: A system is the first with at least two of its columns in the table.
ORDER = ("SIM", "SINASC", "SINAN", "SIH", "SIA", "CNES")


def detect_system(columns: list[str]) -> str | None:
    return next((s for s in ORDER if len(set(NAMES[s]) & set(columns)) >= 2), None)


def repair_text(raw: Column) -> Column:
    """Text of bytes: as UTF-8 where that is valid, else as Latin-1."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))


def recode(column: Column, mapping: dict[str, str]) -> Column:
    """Values by a map; those without an entry stay."""
    text = column.cast("string")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), text), text) if mapping else text


def repair_columns(df: DataFrame) -> DataFrame:
    """Every binary column that holds text becomes text; other columns stay."""
    return df.withColumns({c: repair_text(F.col(c)) for c, t in df.dtypes if t == "binary"})


def standardize(df: DataFrame, system: str | None = None, keep_original: bool = False, language: str = "en") -> DataFrame:
    """Rename the system's columns (but those whose new name is taken), recode sex and race, read dates; names and answers in ``language``."""
    system = system or detect_system(df.columns)
    if system is None:
        raise ValueError("the columns fit no known system")
    if language != "en" and language not in TRANSLATED:
        raise ValueError(f"unknown language: {language}; one of en, {', '.join(TRANSLATED)}")
    local = lambda name: TRANSLATED.get(language, {}).get(name, name)
    answer = lambda text: ANSWERS.get(language, {}).get(text, text)
    names = {a: local(b) for a, b in NAMES[system].items() if a in df.columns and local(b) not in df.columns}
    dates = {local(b) for b in NAMES[system].values() if b.endswith("_date")}
    df = df.withColumnsRenamed(names)
    for column, mapping in ((local("sex"), SEX.get(system)), (local("race"), RACE)):
        if mapping and column in df.columns:
            df = df.withColumn(f"{column}_translated" if keep_original else column, recode(F.col(column), {k: answer(v) for k, v in mapping.items()}))
    return df.withColumns({c: parse_date(F.col(c)) for c in df.columns if (c in dates or c.endswith("_date")) and dict(df.dtypes)[c] == "string"})


def apply_dictionary(df: DataFrame, dictionary: DataFrame, system: str, language: str) -> DataFrame:
    """Rename columns and recode values by a dictionary table: ``system, language, column, value, standard``.

    Rows with a null value name a column, the others an answer of a (raw) column.  The rows of one system and language, some hundreds by
    the nature of a code book, are read by the driver to make the expressions; a code book of over 100,000 rows is refused.
    """
    rows = dictionary.where((F.col("system") == system) & (F.col("language") == language)).select("column", F.col("value").cast("string"), "standard").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the dictionary is no code book: over 100,000 rows for one system and language")
    answers: dict[str, dict[str, str]] = {}
    for column, value, standard in rows:
        if value is not None:
            answers.setdefault(column, {})[value] = standard
    df = df.withColumns({c: recode(F.col(c), m) for c, m in answers.items() if c in df.columns})
    return df.withColumnsRenamed({c: s for c, v, s in rows if v is None and c in df.columns and s not in df.columns})
