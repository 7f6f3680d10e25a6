"""Queries of field extraction, text quality and timetable cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.operators import extraction as X
from quadrille.plans.matching import ALIASES, own
from quadrille.plans.registry import query
from quadrille.plans.text import case, has
from quadrille.sources.storage import cut

NAME = r"regexp_extract(text, '(?i)CODI?GO\s+Y\s+DENOMINACI[ÓO]N\s*:\s*([A-Z]{1,2}\d{1,4})\s+([^\n\r]+)', #)"


@query("src3_w12_read_sheet_pages", """
  WITH n AS (SELECT *, row_number() OVER w AS k, length(trim(text)) > 50 AS u FROM paginas WINDOW w AS (PARTITION BY doc ORDER BY page)),
  g AS (SELECT *, k - coalesce(max(CASE WHEN u THEN k END) OVER (PARTITION BY doc ORDER BY k), 0) AS gap FROM n WHERE k <= 20),
  s AS (SELECT *, coalesce(bool_or(gap >= 3) OVER (PARTITION BY doc ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM g)
  SELECT doc, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY k) FILTER (WHERE u), '') AS text, count(*) AS page_count, CAST(count(*) FILTER (WHERE u) AS INT) AS pages_with_text FROM s WHERE NOT stopped GROUP BY doc""", ("paginas",))  # fmt: skip
def src3(t):
    return X.read_sheet_pages(t.paginas)


@query("src4_read_timetable_cells", "SELECT doc, page, CAST(fila - min(fila) OVER (PARTITION BY doc) AS INT) AS row, col, text FROM celdas", ("celdas",))
def src4(t):
    cells = t.celdas.groupBy("doc", "page", "fila").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]).alias("c"))
    tables = cells.groupBy("doc", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("fila", "c"))), lambda r: r["c"]).alias("celdas"))
    out = X.read_timetable_cells(tables)
    # documents whose first and last rows lack columns start at the first column they have
    first = t.celdas.groupBy("doc", "fila").agg(F.min("col").alias("_c")).join(t.celdas.groupBy("doc").agg(F.min("fila").alias("_f")), "doc").select("doc", (F.col("fila") - F.col("_f")).cast("int").alias("row"), "_c")
    return out.join(first, ["doc", "row"]).select("doc", "page", "row", (F.col("col") + F.col("_c")).cast("int").alias("col"), "text")


@query("x1_extract_code_name", f"SELECT doc_id, {NAME.replace('#', '1')} AS codigo_plan, trim({NAME.replace('#', '2')}) AS nombre FROM fichas", ("fichas",))
def x1(t):
    return X.extract_code_name(t.fichas).drop("text")


#: What fichas_varias says, sheet by sheet: degrees, teachers, and the code.
DEGREES = """SELECT doc_id, concat('Grado en Plan ', CAST(doc_id % 20 AS VARCHAR)) AS programa_nombre, CASE doc_id % 4 WHEN 0 THEN 'Obligatoria' ELSE 'Optativa' END AS tipo_asignatura, CASE doc_id % 4 WHEN 0 THEN '2' ELSE '3' END AS curso FROM fichas_varias WHERE doc_id % 4 < 2
  UNION ALL SELECT doc_id, concat('Grado en Otra Cosa ', CAST(doc_id % 7 AS VARCHAR)), 'Básica', '1' FROM fichas_varias WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id, 'Grado en Artes', 'Troncal', '4' FROM fichas_varias WHERE doc_id % 4 = 3"""
WHO = """SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN 'Jose Luis' WHEN 2 THEN 'Maria Isabel' WHEN 3 THEN 'Eva' WHEN 5 THEN 'Óscar' ELSE 'Ana' END AS nombre, CASE doc_id % 8 WHEN 1 THEN 'Perez Ruiz' WHEN 2 THEN 'Martin Diaz' WHEN 3 THEN 'Sanz Gil' WHEN 5 THEN 'Nuñez' ELSE 'Garcia Lopez' END AS apellidos FROM fichas_varias WHERE doc_id % 8 < 6
  UNION ALL SELECT doc_id, CAST(4500 + doc_id % 11 AS VARCHAR), 'Profesor Externo' FROM fichas_varias WHERE doc_id % 8 = 1"""
CODE = "concat(substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(doc_id // 10000 % 26 + 1 AS INT), 1), lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0'))"
#: Valid sheets, and of those the ones whose period is known.
VALID, TIMED = "doc_id % 6 <> 5", "doc_id % 6 <> 5 AND doc_id % 7 NOT IN (1, 2)"


@query("x2_extract_degrees", DEGREES, ("fichas_varias",))
def x2(t):
    return X.extract_degrees(t.fichas_varias)


@query("x3_extract_credits", r"SELECT doc_id, CAST(floor(CAST(replace(regexp_extract(text, '(?i)ECTS\s*:\s*([0-9]{1,2}(?:[.,][0-9]+)?)', 1), ',', '.') AS DOUBLE)) AS INT) AS ects FROM fichas", ("fichas",))
def x3(t):
    return t.fichas.select("doc_id", X.extract_credits(F.col("text")).alias("ects"))


@query("x4_extract_sheet_fields", """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'ANUAL' WHEN 1 THEN 'N.A.' WHEN 2 THEN 'TRIMESTRAL' ELSE 'CUATRIMESTRAL' END AS periodo, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 3 ELSE CAST(doc_id % 2 + 1 AS INT) END AS num_periodo,
  CASE doc_id % 4 WHEN 0 THEN 'OBLIGATORIA' WHEN 1 THEN 'OPTATIVA' WHEN 2 THEN 'N.A.' ELSE 'TRONCAL' END AS modalidad, CASE doc_id % 5 WHEN 0 THEN 'INGLES' WHEN 1 THEN 'FRENCH' ELSE 'ESPAÑOL' END AS idioma, doc_id % 3 = 0 AS english_friendly,
  CASE WHEN doc_id % 2 = 0 THEN 'Facultad de Ciencias' END AS centro, CASE WHEN doc_id % 2 = 0 THEN concat('Física ', CAST(doc_id % 4 AS VARCHAR)) END AS departamento FROM fichas_varias""", ("fichas_varias",))  # fmt: skip
def x4(t):
    return X.extract_sheet_fields(t.fichas_varias).drop("text")


@query("x5_extract_teachers", WHO, ("fichas_varias",))
def x5(t):
    return X.extract_teachers(t.fichas_varias).drop("n")


@query("x6_parse_sheets", f"SELECT doc_id, {NAME.replace('#', '1')} AS codigo_plan, CAST(floor(CAST(replace(regexp_extract(text, 'ECTS: ([0-9,]+)', 1), ',', '.') AS DOUBLE)) AS INT) AS ects, CAST(0 AS INT) AS n_avisos FROM fichas WHERE doc_id % 10 <> 3 UNION ALL SELECT doc_id, NULL, NULL, CAST(-1 AS INT) FROM fichas WHERE doc_id % 10 = 3", ("fichas",))
def x6(t):
    broken = t.fichas.withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.replace("text", F.lit("CODIGO"), F.lit("CIFRA"))).otherwise(F.col("text")))
    good, bad = X.parse_sheets(broken)
    return good.select("doc_id", "codigo_plan", "ects", F.size("avisos").alias("n_avisos")).unionByName(bad.select("doc_id", F.lit(None).cast("string").alias("codigo_plan"), F.lit(None).cast("int").alias("ects"), F.lit(-1).alias("n_avisos")))


@query("x6_rejected_sheets", f"SELECT doc_id, 'Faltan los ECTS' AS error FROM fichas_varias WHERE NOT ({VALID})", ("fichas_varias",))
def x6b(t):
    return X.parse_sheets(t.fichas_varias)[1].select("doc_id", F.explode("errores").alias("error"))


@query("x7_normalize_sheets", f"""SELECT doc_id, 'asignatura' AS que, {CODE} AS nombre, CASE WHEN doc_id % 7 = 0 THEN 'anual' WHEN doc_id % 2 = 0 THEN 'primer_cuatrimestre' ELSE 'segundo_cuatrimestre' END AS dato, CASE doc_id % 6 WHEN 0 THEN 7 WHEN 1 THEN (SELECT p_size % 9 + 1 FROM part WHERE p_partkey = doc_id) ELSE 4 END AS n FROM fichas_varias WHERE {TIMED}
  UNION ALL SELECT doc_id, 'titulacion', replace(programa_nombre, ' en ', ' En '), replace(lower(tipo_asignatura), 'á', 'a'), CAST(curso AS INT) FROM ({DEGREES}) WHERE {VALID} AND tipo_asignatura <> 'Troncal' UNION ALL SELECT doc_id, 'profesor', nombre, apellidos, 0 FROM ({WHO}) WHERE {VALID}""", ("fichas_varias",))  # fmt: skip
def x7(t):
    subject, degrees, teachers = X.normalize_sheets(cut(X.parse_sheets(t.fichas_varias)[0]))
    rows = subject.select("doc_id", F.lit("asignatura").alias("que"), F.col("codigo_plan").alias("nombre"), F.col("periodo").alias("dato"), F.col("ects").alias("n"))
    rows = rows.union(degrees.select("doc_id", F.lit("titulacion"), "programa_nombre", "tipo_asignatura", "curso"))
    return rows.union(teachers.select("doc_id", F.lit("profesor"), "nombre", "apellidos", F.lit(0)))


W = r"[\p{L}\p{N}_]"
S = r"[\s\x0b]"


def n(p: str, t: str = "text", flags: str = "") -> str:
    return f"len(regexp_extract_all({t}, '{p}', 0{', ' + chr(39) + flags + chr(39) if flags else ''}))"


def left(p: str) -> str:
    return f"length(regexp_replace(text, '{p}', '', 'g'))"


CODES = " + ".join(n(p) for p in X.SUBJECT_CODES)
TERMS = " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in X.TERMS)
ART = " + ".join(n(p.replace("'", "''"), "lower(text)") for p in (r"[^\p{L}\p{N}_\s\x0b\.\,\;\:\!\?\(\)\[\]\-\"\']+", *X.ARTIFACTS[1:]))
QUALITY = f"""
q1 AS (SELECT doc_id, text, length(text) AS cc, regexp_extract_all(text, '[^\\s\\x0b]+') AS w, len(string_split(text, chr(10))) AS lc,
  len(list_filter(string_split(text, chr(10) || chr(10)), lambda p : regexp_replace(p, '{S}+', '', 'g') <> '')) AS pc FROM documents),
q2 AS (SELECT doc_id, text, cc, lc, pc, len(w) AS wc, {left('[^\\p{L}]')} / greatest(cc, 1) AS ar, (cc - {left(S)}) / greatest(cc, 1) AS sr, {left('[^.,;:!?()\\-\\[\\]{}]')} / greatest(cc, 1) AS pr,
  CASE WHEN len(w) > 0 THEN {left(S)} / len(w) ELSE 0 END AS al, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x : length(x) <= 2)) / len(w) ELSE 0 END AS sh,
  pc > 1 AND lc > 1 AND lc < cc / 10 AS hs, {CODES} AS sc, {TERMS} AS tm, {n(X.TITLES)} AS pm, {ART} AS art FROM q1),
q3 AS (SELECT *, tm / greatest(wc, 1) * 100 AS ad, tm > 2 AND sc > 0 AS has, CAST(pc > 1 AS INT) + CAST(sc > 0 AS INT) + CAST(tm > 0 AS INT) + CAST(hs AS INT) AS si,
  (CAST(ar >= 0.7 AS INT) + CAST(al BETWEEN 2 AND 12 AS INT) + CAST(sh < 0.3 AS INT) + CAST(wc >= 10 AS INT)) / 4 AS co, least(art / greatest(cc, 1), 1) AS cr FROM q2),
q4 AS (SELECT *, (cr + least(abs(sr - 0.15) * 3, 1)) / 2 AS noise,
  0.3 * (least(pc / 3, 1) * 0.4 + (ar * 0.5 + (1 - sh) * 0.3 + least(pr * 10, 1) * 0.2) * 0.35 + CASE WHEN al BETWEEN 4 AND 8 THEN 1.0 WHEN al BETWEEN 2 AND 12 THEN 0.7 ELSE 0.3 END * 0.25)
  + 0.4 * (least(sc / 3, 1) * 0.4 + (least(ad / 100, 1) * 0.7 + CAST(tm > 0 AS INT) * 0.3) * 0.35) + 0.3 * (co * 0.5 + (1 - cr) * 0.5)
  + CASE WHEN has AND sc > 2 THEN 0.1 ELSE 0 END + CASE WHEN si / 5 > 0.7 THEN 0.05 ELSE 0 END AS s0 FROM q3),
q5 AS (SELECT *, greatest(least(s0 - CASE WHEN noise > 0.5 THEN 0.2 ELSE 0 END - CASE WHEN cr > 0.1 THEN 0.15 ELSE 0 END, 1), 0.2) AS s, length(regexp_replace(text, '^{S}+|{S}+$', '', 'g')) < 50 AS blank FROM q4),
q6 AS (SELECT *, CASE WHEN blank THEN 'unusable' WHEN s >= 0.85 THEN 'excellent' WHEN s >= 0.7 THEN 'good' WHEN s >= 0.5 THEN 'acceptable' WHEN s >= 0.3 THEN 'poor' ELSE 'unusable' END AS quality,
  CASE WHEN blank THEN 0.0 WHEN s >= 0.85 THEN least(1, 0.85 + (s - 0.85) / 0.15 * 0.15 + CASE WHEN has THEN 0.05 ELSE 0 END) WHEN s >= 0.7 THEN least(0.89, 0.7 + (s - 0.7) / 0.15 * 0.15 + co * 0.05)
   WHEN s >= 0.5 THEN greatest(0.5, 0.5 + (s - 0.5) / 0.2 * 0.2 - noise * 0.1) WHEN s >= 0.3 THEN greatest(0.3, 0.3 + (s - 0.3) / 0.2 * 0.2 - cr * 0.15) ELSE greatest(0.05, s / 0.3 * 0.25) END AS confidence FROM q5)"""


@query("g11_g12_g13_g14_assess_quality", f"WITH {QUALITY} SELECT doc_id, cc AS char_count, CAST(wc AS INT) AS word_count, CAST(pc AS INT) AS paragraph_count, round(ar, 6) AS alpha_ratio, round(al, 6) AS avg_word_length, CAST(sc AS INT) AS subject_code_count, CAST(tm AS INT) AS academic_term_matches, CAST(pm AS INT) AS professor_mention_count, round(co, 6) AS coherence_score, round(cr, 6) AS char_corruption_ratio, round(noise, 6) AS noise_level, quality, round(confidence, 6) AS confidence FROM q6")
def g14(t):
    q = X.assess_quality(t.documents)
    r = lambda c: F.round(c, 6).alias(c)
    return q.select("doc_id", "char_count", "word_count", "paragraph_count", r("alpha_ratio"), r("avg_word_length"), "subject_code_count", "academic_term_matches", "professor_mention_count", r("coherence_score"), r("char_corruption_ratio"), r("noise_level"), "quality", r("confidence"))


@query("g15_quality_stats", f"WITH {QUALITY} SELECT quality, count(*) AS n, round(avg(confidence), 6) AS confidence, CAST(sum(CAST(quality = 'unusable' AS INT)) AS BIGINT) AS failed FROM q6 GROUP BY quality")
def g15(t):
    return X.quality_stats(X.assess_quality(t.documents))


@query("g16_grid_coverage", "SELECT doc, page, round(avg(CAST(trim(text) <> '' AS INT)), 6) AS coverage FROM celdas GROUP BY 1, 2", ("celdas",))
def g16(t):
    return X.grid_coverage(t.celdas, ["doc", "page"])


@query("w2_fill_times", "SELECT doc, col, fila, last_value(hora IGNORE NULLS) OVER (PARTITION BY doc, col ORDER BY fila) AS hora FROM celdas WHERE coalesce(hora, '') <> '' OR coalesce(text, '') <> ''", ("celdas",))
def w2(t):
    return X.fill_times(t.celdas, ["doc", "col"]).select("doc", "col", "fila", "hora")


MIN = "CAST(split_part(hora, ':', 1) AS INT) * 60 + CAST(split_part(hora, ':', 2) AS INT)"


@query("w4_n23_end_times", f"WITH m AS (SELECT doc, col, fila, coalesce({MIN}, 0) AS ini, lead({MIN}) OVER (PARTITION BY doc, col ORDER BY fila) AS nx FROM celdas) SELECT doc, col, fila, ini, coalesce(nx, (ini + 60) % 1440) AS fin FROM m", ("celdas",))
def w4(t):
    return X.cell_times(t.celdas, ["doc", "col"]).select("doc", "col", "fila", "ini", "fin")


def sub(p: str) -> str:
    return p.replace("'", "''")


CELL = f"""c0 AS (SELECT doc, fila, col, text, text = '' OR starts_with(trim(text), '(*)') AS sk, trim(text) AS t0 FROM celdas),
 c1 AS (SELECT *, nullif(CASE WHEN NOT sk THEN trim(regexp_extract(t0, '(?i){X.ROOM_IN_CELL}')) END, '') AS aula, regexp_replace(t0, '(?i){X.ROOM_IN_CELL}', ' ') AS t1 FROM c0),
 c2 AS (SELECT *, nullif(CASE WHEN NOT sk THEN trim(regexp_extract(t1, '(?i){X.GROUP_IN_CELL}')) END, '') AS grupo, trim(regexp_replace(regexp_replace(regexp_replace(t1, '(?i){X.GROUP_IN_CELL}', ' '), '(?i)\\b(TE|PL|PA|y)\\b|[/\\.,:–\\-\\?\\*\\(\\)]+', ' ', 'g'), '\\s+', ' ', 'g')) AS nm FROM c1)"""


@query("x8_parse_cells", f"WITH {CELL} SELECT doc, fila, col, aula, grupo, CASE WHEN grupo IS NULL THEN 'CLASE' WHEN {has('upper(grupo)', 'PL', 'PA')} OR {has('upper(coalesce(aula, ' + chr(39) * 2 + '))', 'LAB', 'LSC', 'LATC')} THEN 'PRÁCTICA' ELSE 'TEORÍA' END AS tipo, CASE WHEN NOT sk AND length(nm) >= 3 THEN nm END AS asignatura FROM c2", ("celdas",))
def x8(t):
    return X.parse_cells(t.celdas).select("doc", "fila", "col", "aula", "grupo", "tipo", "asignatura")


@query("w5_merge_cells")
def w5(t):
    """Names grow as cells join, which SQL windows can't follow; tests hold it against golden columns."""
    return X.merge_cells(X.parse_cells(X.cell_times(t.celdas, ["doc", "page", "col"])))


CATALOGUE = """SELECT id, CASE WHEN id div 4 % 2 = 0 THEN element_at(array('Cálculo I', 'Estructuras de datos', 'Física', 'Álgebra lineal'), j) ELSE element_at(array('Cálculo integral', 'Estructura de los datos', 'Seminarios de introducción', 'Álgebra lineal y geometría'), j) END AS nombre, true AS activo
  FROM (SELECT CAST(id AS BIGINT) AS id, CAST(id % 4 + 1 AS INT) AS j FROM range(20))"""


def draft_inputs(t):
    """Pages, what is known of their documents and tables, and a catalogue whose programs call their subjects differently."""
    docs = t.rejilla.select("doc", "page").distinct()
    documents = docs.select("doc", F.when(F.col("doc") % 3 < 2, F.concat(F.lit("Grado en Plan "), (F.col("doc") % 5).cast("string"))).alias("plan"), F.when(F.col("doc") % 3 == 2, F.concat(F.lit("GRADO EN PLAN "), (F.col("doc") % 7).cast("string"))).alias("titulo")).distinct()
    tables = docs.select("doc", "page", F.when(F.col("doc") % 3 == 0, "1º").when(F.col("doc") % 3 == 1, "N.A.").otherwise("2º CURSO").alias("curso"))
    subjects = t.spark.sql(CATALOGUE)
    links = subjects.select(F.col("id").alias("asignatura_id"), F.floor(F.col("id") / 4).alias("programa_id"), (F.col("id") % 2 + 1).cast("int").alias("curso"))
    programs = t.spark.sql("SELECT CAST(id AS BIGINT) AS id, concat('Grado en Plan ', id) AS nombre, true AS activo FROM range(5)")
    return documents, tables, subjects, links, programs


@query("x9_build_draft")
def x9(t):
    documents, tables, subjects, links, programs = draft_inputs(t)
    return X.build_draft(X.day_matrix(t.rejilla), documents, tables, subjects, None, links, programs, t.aulas)


@query("x10_draft_to_normalizer", "SELECT id, CASE WHEN id % 3 = 0 THEN periodo ELSE 'documento' END AS periodo FROM sesiones", ("sesiones",))
def x10(t):
    draft = t.sesiones.select("id", F.when(F.col("id") % 3 == 0, F.col("periodo")).when(F.col("id") % 3 == 1, "").alias("periodo_tabla"), F.lit("documento").alias("periodo_documento"))
    return X.draft_to_normalizer(draft).select("id", "periodo")


LINES = "SELECT p_partkey // 8 AS doc, CAST(1 AS INT) AS page, p_partkey % 8 AS linea, CASE p_size % 11 WHEN 0 THEN 'TERCER CURSO' WHEN 1 THEN 'segundo' WHEN 2 THEN concat('Mención en ', p_name) WHEN 3 THEN '4' WHEN 4 THEN ' IV curso ' WHEN 5 THEN concat('ESPECIALIDAD DE ', p_name, '    y más') WHEN 6 THEN 'AULA tercer curso' WHEN 7 THEN 'séptimo curso' WHEN 8 THEN '1er' WHEN 9 THEN concat('itinerario ', p_name) ELSE p_name END AS text FROM part"


_TABLE = "LUNES|MARTES|MI[ÉE]RCOLES|JUEVES|VIERNES|AULA|LAB|SEMANAS|P[ÁA]GINA|PAGE|HOJA"


@query("g9_page_metadata", f"""WITH l AS ({LINES}), s AS (SELECT *, CASE trim(text) WHEN 'TERCER CURSO' THEN '3º' WHEN 'IV curso' THEN '4º' WHEN 'segundo' THEN '2º' WHEN '1er' THEN '1º' END AS c, CASE WHEN text ILIKE '% curso%' THEN 100 ELSE 50 END AS sc,
   CASE WHEN starts_with(text, 'Mención en ') OR starts_with(text, 'ESPECIALIDAD DE ') OR starts_with(text, 'itinerario ') THEN trim(regexp_extract(regexp_replace(text, '^(Mención en|ESPECIALIDAD DE|itinerario) ', ''), '^[A-Za-zÁÉÍÓÚÑáéíóúñ. ]+')) END AS m0 FROM l WHERE NOT regexp_matches(upper(text), '{_TABLE}')),
  r AS (SELECT *, trim(string_split(m0, '    ')[1]) AS m FROM s)
  SELECT doc, page, coalesce((SELECT c FROM r x WHERE x.doc = l.doc AND c IS NOT NULL ORDER BY sc DESC, linea LIMIT 1), 'N.A.') AS curso, (SELECT m FROM r x WHERE x.doc = l.doc AND m IS NOT NULL ORDER BY length(m) DESC, linea LIMIT 1) AS mencion FROM l GROUP BY doc, page""")  # fmt: skip
def g9(t):
    return X.page_metadata(t.spark.sql(LINES.replace("FROM part", "FROM {part}").replace("//", "div"), part=t.part))


#: The days of the pages of rejilla, said by how they are made: all named (one twice), one named, none but hours, neither.
DAYS = """r AS (SELECT DISTINCT doc, page, col, (col - doc % 3) // 10 AS p, doc // 4 % 2 AS s FROM rejilla),
 dm AS (SELECT doc, page, col, CASE WHEN doc % 8 = 0 AND p = 6 THEN 1 WHEN doc % 8 = 0 AND p = 1 THEN 0 WHEN doc % 4 = 0 THEN p WHEN doc % 4 < 3 THEN p - s END AS n FROM r),
 dc AS (SELECT doc, page, col, ['LUNES', 'MARTES', 'MIÉRCOLES', 'JUEVES', 'VIERNES'][n] AS dia FROM dm WHERE n BETWEEN 1 AND 5)"""


@query("g10_day_columns", f"WITH {DAYS} SELECT * FROM dc", ("rejilla",))
def g10(t):
    return X.day_columns(t.rejilla)


@query("src4_w2_day_matrix", f"""WITH {DAYS} SELECT g.doc, g.page, g.fila, g.col, dc.dia, CASE g.fila WHEN 0 THEN NULL WHEN 1 THEN '08:30' WHEN 2 THEN '09:30' WHEN 3 THEN '09:30' WHEN 6 THEN '12:30' WHEN 7 THEN '13:30' ELSE '10:30' END AS hora, g.text
  FROM rejilla g JOIN dc ON dc.doc = g.doc AND dc.col = g.col WHERE NOT (g.fila = 0 AND g.doc % 4 = 2) AND NOT (g.fila = 3 AND g.doc % 2 = 0)""", ("rejilla",))  # fmt: skip
def src4_w2(t):
    return X.day_matrix(t.rejilla)


GRID = "SELECT DISTINCT doc, page, axis, pos FROM (SELECT l_orderkey AS doc, CAST(1 AS INT) AS page, 'v' AS axis, CAST(60 * (l_linenumber % 4) AS DOUBLE) AS pos FROM lineitem UNION ALL SELECT l_orderkey, CAST(1 AS INT), 'h', CAST(30 * (l_linenumber // 3) + 9 * (l_linenumber % 2) AS DOUBLE) FROM lineitem)"
CELLS = "sp AS (SELECT doc, page, axis, pos, lead(pos) OVER (PARTITION BY doc, page, axis ORDER BY pos) AS nx FROM ln), gc AS (SELECT v.doc, v.page, CAST(row_number() OVER (PARTITION BY v.doc, v.page ORDER BY h.pos, v.pos) AS INT) AS cell, v.pos AS cx0, h.pos AS ctop, v.nx AS cx1, h.nx AS cbottom FROM sp v JOIN sp h ON v.doc = h.doc AND v.page = h.page AND v.axis = 'v' AND h.axis = 'h' AND v.nx - v.pos >= 25 AND h.nx - h.pos >= 10)"


def grid(t):
    """Lines that come twice are left to grid_cells, which counts them once where it has a page's lines together: a DISTINCT before it is one more shuffle, of few bytes a row, whose tasks hold millions of rows each."""
    every = GRID.replace("SELECT DISTINCT", "SELECT")
    return X.grid_cells(t.spark.sql(every.replace("FROM lineitem", "FROM {lineitem}").replace("//", "div"), lineitem=t.lineitem))


@query("w10_grid_cells", f"WITH ln AS ({GRID}), {CELLS} SELECT * FROM gc")
def w10(t):
    return grid(t)


@query("j23_atoms_to_cells", f"WITH ln AS ({GRID}), {CELLS} SELECT a.doc, a.n, CAST(min(cell) AS INT) AS cell FROM atomos a JOIN gc ON a.doc = gc.doc AND (x0 + x1) / 2 BETWEEN cx0 - 1 AND cx1 + 1 AND (top + bottom) / 2 BETWEEN ctop - 1 AND cbottom + 1 GROUP BY 1, 2", ("atomos",))
def j23(t):
    return X.atoms_to_cells(t.atomos, grid(t)).select("doc", "n", "cell")


@query("w11_stitch_cells", "WITH g AS (SELECT doc, text, n, floor(top / 5) AS y, x0, row_number() OVER o AS k, CASE WHEN lag(n) OVER o IS NULL THEN '' WHEN abs(top - lag(top) OVER o) > 5 THEN chr(10) WHEN x0 - lag(x1) OVER o < 1 THEN '' ELSE ' ' END AS g FROM atomos WINDOW o AS (PARTITION BY doc ORDER BY floor(top / 5), x0, n)) SELECT doc, string_agg(g || text, '' ORDER BY k) AS text FROM g GROUP BY doc", ("atomos",))
def w11(t):
    return X.stitch_cells(t.atomos.withColumn("cell", F.lit(1))).select("doc", "text")


@query("w8_footer_cutoff")
def w8(t):
    return X.footer_cutoff(t.atomos.withColumn("text", F.when(F.col("n") == 5, "(*) aviso").otherwise(F.col("text"))))


@query("w9_dedup_lines")
def w9(t):
    return X.dedup_lines(t.spark.sql(GRID.replace("FROM lineitem", "FROM {lineitem}").replace("//", "div"), lineitem=t.lineitem))
