"""Queries of the normalisers, each over all texts derived from part."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import text as T
from quadrille.plans.registry import query


def sp(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def ti(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '\p{{L}}+|[^\p{{L}}]+'), lambda w : concat(upper(w[1]), lower(w[2:]))), '')"


def case(rules, default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in rules) + f" ELSE {default} END"


def has(x: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def q(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v)


UP = "upper(t)"
PERIOD = case([(has(UP, k), q(v)) for k, v in T.PERIODS.items()])
ROOM = case([(f"t = '{T.UNKNOWN_ROOM}'", "'teorica'")] + [(has(UP, *words), q(k)) for k, words in T.ROOM_WORDS.items()], "'teorica'")
GROUP = r"trim(replace(regexp_replace(trim(t), '^(GRUPO|GR\.|G\.)\s*', '', 'i'), ' ', ''))"
LAB = has("upper(trim(t))", *T.ROOM_WORDS["laboratorio"], *T.ROOM_WORDS["informatica"])
G = f"upper({GROUP})"
FOLD = f"translate(lower(t), '{T._PLAIN_FROM}', '{T._PLAIN_TO}')"
ROMAN = ti(sp("t"))
for _r in T.ROMANS:
    ROMAN = rf"regexp_replace({ROMAN}, '\b{_r.capitalize()}\b', '{_r}', 'g')"
OCR = "t"
for _p, _w in T.OCR_FIXES:
    OCR = f"regexp_replace({OCR}, '{_p}', '{_w}', 'gi')"
REPAIR = "t"
for _p, _w in T.REPAIRS:
    REPAIR = f"regexp_replace({REPAIR}, '{_p}', '{_w}', 'gi')"
CAMEL = sp(rf"regexp_replace({REPAIR}, '([a-zñáéíóú])([A-ZÑÁÉÍÓÚ])', '\1 \2', 'g')")
R = r"^(\d{1,2}:\d{2})\s*-\s*(\d{1,2}:\d{2})$"


def mins(x: str) -> str:
    return f"CASE WHEN TRY_CAST(split_part({x}, ':', 1) AS INT) < 24 AND TRY_CAST(split_part({x}, ':', 2) AS INT) < 60 THEN TRY_CAST(split_part({x}, ':', 1) AS INT) * 60 + TRY_CAST(split_part({x}, ':', 2) AS INT) END"


A, B = mins(f"regexp_extract(trim(t), '{R}', 1)"), mins(f"regexp_extract(trim(t), '{R}', 2)")
TIME = r"replace(regexp_extract(t, '\b([01]?\d|2[0-3])[:.]?[0-5]\d\b'), '.', ':')"
TITLE = "replace(upper(t), chr(10), ' ')"

#: Query name, column function, the same in DuckDB.
PLAIN = {
    "n1_subject_key": (T.subject_key, f"replace(translate({sp(UP)}, 'ÁÉÍÓÚÜÑ.,', 'AEIOUUN'), '-', ' ')"),
    "n2_room_key": (T.room_key, sp(r"regexp_replace(translate(trim(upper(t)), 'ÁÉÍÓÚ', 'AEIOU'), '([A-Z])(\d)', '\1 \2', 'g')")),
    "n3_room_alnum": (T.room_alnum, r"upper(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g'))"),
    "n4_norm_name": (T.norm_name, ti(sp("t"))),
    "n5_norm_name_roman": (T.norm_name_roman, ROMAN),
    "n6_norm_room": (T.norm_room, f"CASE WHEN t = '{T.UNKNOWN_ROOM}' THEN t ELSE upper({sp('t')}) END"),
    "n7_map_day": (T.map_day, case([(f"translate({UP}, 'ÁÉÍÓ', 'AEIO') = '{k}'", q(v)) for k, v in T.DAYS.items()])),
    "n8_map_day_code": (lambda c: T.map_day_code(F.substring(c, 1, 1)), case([(f"upper(trim(t[1])) = '{k}'", q(v)) for k, v in T.DAY_CODES.items()])),
    "n9_infer_period": (lambda c: T.infer_period(c, F.lit("")), f"coalesce({PERIOD}, 'primer_cuatrimestre')"),
    "n10_parse_course": (T.parse_course, case([(rf"(regexp_matches({UP}, '\b{k}\b') OR {UP} = '{k}')", v) for k, v in T.COURSES.items() if "º" not in k] )),
    "n11_parse_course_sheet": (T.parse_course_sheet, case([(has("lower(trim(t))", k), v) for k, v in T.SHEET_COURSES.items()])),
    "n12_course_digits": (T.course_digits, r"coalesce(TRY_CAST(regexp_replace(t, '\D', '', 'g') AS INT), 0)"),
    "n13_room_type": (T.room_type, ROOM),
    "n14_manual_type": (T.manual_type, case([(has(UP, "LABORATORIO"), "'laboratorio'"), (has(UP, "AULA", "PRACTICA", "PRÁCTICA"), "'practica'"), (has(UP, "TEOR"), "'teoria'")])),
    "n15_clean_group": (T.clean_group, GROUP),
    "n17_infer_group_type": (lambda c: T.infer_group_type(c, c), case([(f"{G} = ''", "'teoria'"), (has(G, "PA"), "'practica'"), (LAB, "'laboratorio'"), (has(G, "PL"), "'laboratorio'")], "'teoria'")),
    "n20_norm_code": (T.norm_code, "upper(trim(t))"),
    "n20_valid_code": (lambda c: T.valid_code(T.norm_code(c)), r"regexp_matches(upper(trim(t)), '^[A-Z]{1,2}\d{1,4}[A-Z]?$')"),
    "n22_norm_time": (T.norm_time, rf"CASE WHEN contains({TIME}, ':') THEN concat(lpad(split_part({TIME}, ':', 1), 2, '0'), ':', lpad(split_part({TIME}, ':', 2), 2, '0')) END"),
    "n24_ocr_fix": (T.ocr_fix, OCR),
    "n25_repair_words": (T.repair_words, CAMEL),
    "n26_clean_subject": (T.clean_subject, sp(r"regexp_replace(t, '\b(TE|PL|PA|y)\b|[/\.,:–\-\?\*\(\)]+', ' ', 'gi')")),
    "n29_fold_key": (T.fold_key, FOLD),
    "n32_enum_label": (T.enum_label, ti("replace(t, '_', ' ')")),
    "n35_program_type": (T.program_type, case([(has("lower(t)", "doble"), "'doble_grado'"), (has("lower(t)", "máster", "master"), "'master'")], "'grado'")),
    "n36_clean_mention": (T.clean_mention, "trim(replace(replace(t, 'Mención en ', ''), 'MENCION EN ', ''))"),
    "n38_classify_title": (T.classify_title, "concat(" + case([(f"{has(TITLE, 'DOBLE GRADO')} AND {has(TITLE, 'FÍSICA', 'FISICA')} AND {has(TITLE, 'MATEMÁTICAS', 'MATEMATICAS')}", "'Doble Grado en Física y Matemáticas'"), (has(TITLE, "GRADO EN INGENIERÍA INFORMÁTICA", "GRADO EN INGENIERIA INFORMATICA"), "'Grado en Ingeniería Informática'"), (f"{has(TITLE, 'GRADO')} AND {has(TITLE, 'MATEMÁTICAS', 'MATEMATICAS')}", "'Grado en Matemáticas'"), (f"{has(TITLE, 'GRADO')} AND {has(TITLE, 'FÍSICA', 'FISICA')}", "'Grado en Física'")], "'-'") + f", '|', CASE WHEN {has(TITLE, 'SEGUNDO CUATRIMESTRE', '2º CUATRIMESTRE')} THEN 'Segundo Cuatrimestre' ELSE 'Primer Cuatrimestre' END)"),
    "n42_semantic_key": (lambda c: T.semantic_key(c, F.lit("PL"), F.lit(None).cast("string"), F.lit("Lunes"), F.lit("09:00")), rf"concat(regexp_replace(upper(trim({FOLD})), '\s+', '_', 'g'), '|PL|U|LUNES|09:00')"),
}
for _name, (_fn, _sql) in PLAIN.items():

    def _run(t, fn=_fn):
        return t.textos.select("id", fn(F.col("t")).alias("v"))

    query(_name, f"SELECT id, {_sql} AS v FROM textos", ("textos",))(_run)


MARKED = "SELECT p_partkey AS id, concat(p_name, ' ', CASE p_size % 9 WHEN 0 THEN 'Dvořák Šimić' WHEN 1 THEN 'ŐSZ ő' WHEN 2 THEN 'ǍLT ǖ ǟ' WHEN 3 THEN 'ṩ Ḝ ệ' WHEN 4 THEN 'Łódź Żółć' WHEN 5 THEN 'Ångström Ñandú' WHEN 6 THEN 'Ελλάδα Ώρα' WHEN 7 THEN 'Йод Ёлка' ELSE 'Çığ İzmir' END) AS t FROM part"


@query("n29_fold_marks", f"SELECT id, strip_accents(lower(t)) AS clave FROM ({MARKED})")
def n29b(t):
    """Letters with marks of any alphabet, not only those of Spanish."""
    return t.spark.sql(MARKED.replace("FROM part", "FROM {part}"), part=t.part).select("id", T.fold_key(F.col("t")).alias("clave"))


@query("n16_split_groups", r"SELECT id, trim(unnest(string_split_regex(trim(t), '(?i)\s*[,/&+]\s*|\s+(?:y|e)\s+'))) AS grupo FROM textos", ("textos",))
def n16(t):
    """All texts, as the SQL has them but for a bare 'y' before a group; tests hold the whole table against a plain version."""
    return t.textos.select("id", F.explode(T.split_groups(F.col("t"))).alias("grupo"))


SESSION = "SELECT id, t AS asignatura, concat('AULA ', CAST(id % 30 AS VARCHAR)) AS aula, CASE id % 3 WHEN 0 THEN 'Lunes' WHEN 1 THEN 'JUE' ELSE 'nunca' END AS dia, CASE WHEN id % 5 = 0 THEN 'teoría' END AS tipo, concat('Grupo P', CASE WHEN id % 2 = 0 THEN 'A' ELSE 'L' END, CAST(id % 4 AS VARCHAR)) AS grupo FROM textos"


@query(
    "n18_normalize_sessions",
    f"""WITH s AS ({SESSION}) SELECT id, {ti(sp("asignatura"))} AS asignatura, upper(aula) AS aula, CASE id % 3 WHEN 0 THEN 'lunes' ELSE 'jueves' END AS dia,
        CASE WHEN tipo IS NOT NULL THEN 'teoria' WHEN id % 2 = 0 THEN 'practica' ELSE 'laboratorio' END AS tipo, grupo[7:] AS grupo, 'teorica' AS aula_tipo, 'presencial' AS modalidad, 'semanal' AS tipo_recurrencia
        FROM s WHERE id % 3 < 2 AND NOT contains(asignatura, '(*)')""",
    ("textos",),
)
def n18(t):
    rows = t.spark.sql("".join(SESSION).replace("VARCHAR", "STRING").replace("FROM textos", "FROM {textos}"), textos=t.textos)
    return T.normalize_sessions(rows)


@query(
    "n19_map_sheet_enums",
    """SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'anual' WHEN p_size % 3 = 1 AND p_partkey % 3 = 1 THEN 'primer_cuatrimestre' WHEN p_size % 3 = 1 AND p_partkey % 3 = 2 THEN 'segundo_cuatrimestre' END AS periodo_enum,
       CASE p_partkey % 4 WHEN 0 THEN 'basica' WHEN 1 THEN 'obligatoria' WHEN 2 THEN 'optativa' END AS tipo_enum,
       CASE p_size % 4 WHEN 0 THEN 'online' WHEN 1 THEN 'semipresencial' ELSE 'presencial' END AS modalidad_enum,
       CASE WHEN p_size % 2 = 0 THEN 'ingles' ELSE 'español' END AS idioma_enum,
       CAST((CASE WHEN p_size % 3 = 2 OR (p_size % 3 = 1 AND p_partkey % 3 = 0) THEN 1 ELSE 0 END) + (CASE WHEN p_partkey % 4 = 3 THEN 1 ELSE 0 END) AS INT) AS n_errores FROM part""",
)
def n19(t):
    rows = t.part.selectExpr(
        "p_partkey AS id", "CASE p_size % 3 WHEN 0 THEN 'Anual' WHEN 1 THEN ' Cuatrimestral' ELSE 'otro' END AS periodo", "CAST(p_partkey % 3 AS INT) AS num_periodo",
        "CASE p_partkey % 4 WHEN 0 THEN 'Formación BÁSICA' WHEN 1 THEN 'obligatoria' WHEN 2 THEN 'Optativa' ELSE 'x' END AS tipo",
        "CASE p_size % 4 WHEN 0 THEN 'Virtual' WHEN 1 THEN 'Semipresencial' WHEN 2 THEN 'presencial' END AS modalidad", "CASE WHEN p_size % 2 = 0 THEN 'English' ELSE 'Castellano' END AS idioma",
    )
    out = T.map_sheet_enums(rows)
    return out.select("id", "periodo_enum", "tipo_enum", "modalidad_enum", "idioma_enum", F.size("errores").alias("n_errores"))


@query("n21_parse_range", f"SELECT id, CASE WHEN {A} < {B} THEN {A} END AS ini, CASE WHEN {A} < {B} THEN {B} END AS fin, CASE WHEN NOT regexp_matches(trim(t), '{R}') OR {A} IS NULL OR {B} IS NULL THEN 'formato' WHEN {A} >= {B} THEN 'orden' END AS error FROM textos", ("textos",))
def n21(t):
    return t.textos.select("id", T.parse_range(F.col("t")).alias("r")).select("id", "r.*")


@query("n27_preprocess_text", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\r\n?', chr(10), 'g'), '\n{2,}', chr(10), 'g'))) AS v FROM documents")
def n27(t):
    return t.documents.select("doc_id", F.sha2(T.preprocess_text(F.col("text")).cast("binary"), 256).alias("v"))


@query("n28_clean_text")
def n28(t):
    """The e-mail rule looks ahead, which DuckDB's patterns can't."""
    return t.documents.select("doc_id", F.length(T.clean_text(F.col("text"))).alias("n_chars"), F.sha2(T.clean_text(F.col("text")).cast("binary"), 256).alias("v"))


@query("n30_period_matches", "SELECT id, CASE WHEN periodo LIKE 'primer%' THEN id % 3 <> 1 ELSE id % 3 <> 0 END AS v FROM asignaturas", ("asignaturas",))
def n30(t):
    chosen = F.when(F.col("id") % 3 == 0, "Primer Cuatrimestre").when(F.col("id") % 3 == 1, "SEGUNDO SEMESTRE").otherwise("")
    return t.asignaturas.select("id", T.period_matches(F.col("periodo"), chosen).alias("v"))


@query("n31_time_arithmetic", "SELECT id, concat(lpad(CAST(ini // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(ini % 60 AS VARCHAR), 2, '0')) AS hora, ini AS minutos, CAST(greatest(0, (ini - 540) // 45) AS INT) AS hueco FROM (SELECT * FROM sesiones WHERE ini >= 540) UNION ALL SELECT id, concat(lpad(CAST(ini // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(ini % 60 AS VARCHAR), 2, '0')), ini, 0 FROM sesiones WHERE ini < 540", ("sesiones",))
def n31(t):
    hour = T.to_hhmm(F.col("ini"))
    return t.sesiones.select("id", hour.alias("hora"), T.minutes(hour).alias("minutos"), T.slot_index(F.col("ini"), 540, 45).alias("hueco"))


@query("n34_norm_contact", f"SELECT s_suppkey AS id, {sp('s_name')} AS nombre, lower(concat(s_name, '@UNI.ES')) AS email, upper(s_name) AS codigo FROM supplier")
def n34(t):
    return T.norm_contact(t.supplier.selectExpr("s_suppkey AS id", "concat('  ', replace(s_name, '#', '  #'), ' ') AS nombre", "concat(s_name, '@UNI.ES ') AS email", "concat(' ', lower(s_name)) AS codigo")).withColumn("nombre", F.replace("nombre", F.lit(" #"), F.lit("#")))


@query("n37_split_title", "SELECT id, trim(split_part(t, '|', 1)) AS titulo, CASE WHEN contains(t, '|') THEN trim(split_part(t, '|', 2)) ELSE 'Primer Cuatrimestre' END AS periodo FROM textos", ("textos",))
def n37(t):
    return t.textos.select("id", T.split_title(F.col("t")).alias("s")).select("id", "s.*")
