"""Schedule-like tables derived from the driver's tables, by SQL that Spark and DuckDB read alike.

{name} stands for a table, // for integer division and VARCHAR for text; spark() and duck() put in each engine's own words.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("events", "part", "orders", "supplier", "documents", "lineitem", "customer")

TABLES = {
    "sesiones": """
      WITH b AS (SELECT event_id AS id, (event_id * 2654435761) % 4294967296 AS h, event_id // 1000 AS plan_id FROM {events}),
      k AS (SELECT id, plan_id, h % 5 AS dia_semana, 480 + 30 * ((h // 5) % 22) AS ini, 30 * (1 + (h // 110) % 4) AS dur,
        plan_id * 40 + (h // 440) % 40 AS aula_id, plan_id * 60 + (h // 17600) % 60 AS profesor_id, plan_id * 60 + (h // 700001) % 60 AS profesor_2_id,
        plan_id * 32 + (h // 31) % 32 AS asignatura_id, (h // 97) % 3 AS tk, (h // 293) % 4 AS gk, (h // 1171) % 10 AS mk FROM b)
      SELECT CAST(id AS BIGINT) AS id, CAST(plan_id AS BIGINT) AS plan_id, CAST(aula_id AS BIGINT) AS aula_id, CAST(profesor_id AS BIGINT) AS profesor_id,
        CAST(CASE WHEN mk = 0 AND profesor_2_id <> profesor_id THEN profesor_2_id END AS BIGINT) AS profesor_2_id,
        CAST(asignatura_id AS BIGINT) AS asignatura_id, CAST(plan_id * 10 + asignatura_id % 4 + 1 AS BIGINT) AS curso,
        CASE WHEN (asignatura_id // 4) % 2 = 0 THEN 'primer_cuatrimestre' ELSE 'segundo_cuatrimestre' END AS periodo,
        CASE tk WHEN 0 THEN 'TEORIA' WHEN 1 THEN 'PRACTICA' ELSE 'LABORATORIO' END AS tipo_grupo,
        concat('G', CAST(gk AS VARCHAR)) AS grupo_codigo,
        CAST(CASE WHEN (asignatura_id // 8) % 4 = 3 THEN asignatura_id % 2 + 1 END AS BIGINT) AS mencion_id,
        CAST(dia_semana AS INT) AS dia_semana, CAST(ini AS INT) AS ini, CAST(ini + dur AS INT) AS fin FROM k""",
    "restricciones": """
      WITH b AS (SELECT event_id AS id, (event_id * 2654435761) % 4294967296 AS h, event_id // 1000 AS plan_id FROM {events} WHERE event_id % 25 = 0)
      SELECT CAST(id AS BIGINT) AS id, CAST(plan_id * 60 + (h // 17600) % 60 AS BIGINT) AS profesor_id, CAST((h // 13) % 5 AS INT) AS dia_semana,
        CAST(480 + 60 * ((h // 77) % 12) AS INT) AS ini, CAST(600 + 60 * ((h // 77) % 12) AS INT) AS fin FROM b""",
    "fichas": """
      SELECT p_partkey AS doc_id, concat('DATOS DEL TITULO',
        chr(10), 'Grado en Plan ', CAST(p_partkey % 20 AS VARCHAR), ' ', CASE p_partkey % 3 WHEN 0 THEN 'OBLIGATORIA' WHEN 1 THEN 'OPTATIVA' ELSE 'BÁSICA' END, ' ', CAST(p_partkey % 4 + 1 AS VARCHAR),
        chr(10), 'CODIGO Y DENOMINACION : G', CAST(p_partkey % 9000 + 100 AS VARCHAR), ' ', upper(p_name),
        chr(10), 'Nº CRÉDITOS ECTS: ', CAST(p_size % 12 + 1 AS VARCHAR), ',00SECUENCIA: Cuatrimestral Nº: ', CAST(p_partkey % 2 + 1 AS VARCHAR),
        chr(10), 'DATOS DEL PROFESORADO',
        chr(10), 'CU GARCIA LOPEZ, ANA Universidad N',
        chr(10), 'TOTAL 1') AS text
      FROM {part}""",
    "fichas_varias": """
      WITH b AS (SELECT p_partkey AS k, p_name, p_size FROM {part})
      SELECT k AS doc_id, concat('DATOS DEL TITULO',
        CASE k % 4 WHEN 0 THEN concat(chr(10), 'Grado en Plan ', CAST(k % 20 AS VARCHAR), ' OBLIGATORIA 2') WHEN 1 THEN concat(chr(10), 'Grado en Plan ', CAST(k % 20 AS VARCHAR), ' OPTATIVA 3', chr(10), 'Grado en Otra Cosa ', CAST(k % 7 AS VARCHAR), ' BÁSICA 1') WHEN 2 THEN '' ELSE concat(chr(10), 'Doble Grado en Artes TRONCAL 4') END,
        chr(10), 'CODIGO Y DENOMINACION : ', substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(k // 10000 % 26 + 1 AS INT), 1), lpad(CAST(k % 10000 AS VARCHAR), 4, '0'), ' ', upper(p_name),
        CASE k % 6 WHEN 0 THEN concat(chr(10), 'Nº CRÉDITOS ECTS: 7,50') WHEN 1 THEN concat(chr(10), 'CRÉDITO ECTS : ', CAST(p_size % 9 + 1 AS VARCHAR)) WHEN 5 THEN '' ELSE concat(chr(10), 'ECTS: 4.5') END,
        CASE k % 7 WHEN 0 THEN concat(chr(10), 'PERIODO: Anual') WHEN 1 THEN '' WHEN 2 THEN concat(chr(10), 'SECUENCIA: Trimestral Nº: 3') ELSE concat(chr(10), 'SECUENCIA: Cuatrimestral Nº: ', CAST(k % 2 + 1 AS VARCHAR)) END,
        CASE k % 5 WHEN 0 THEN concat(chr(10), 'Idioma: Inglés') WHEN 1 THEN concat(chr(10), 'Language: French') WHEN 2 THEN concat(chr(10), 'Idioma : Castellano') ELSE '' END,
        CASE k % 3 WHEN 0 THEN concat(chr(10), 'Docencia en inglés: sí') WHEN 1 THEN concat(chr(10), 'English friendly: no') ELSE '' END,
        CASE WHEN k % 2 = 0 THEN concat(chr(10), 'CENTRO RESPONSABLE : 12 Facultad de Ciencias', chr(10), 'DEPARTAMENTO RESPONSABLE: Física ', CAST(k % 4 AS VARCHAR)) ELSE '' END,
        CASE k % 8 WHEN 7 THEN '' ELSE concat(chr(10), 'DATOS DEL PROFESORADO') END,
        CASE k % 8 WHEN 0 THEN concat(chr(10), 'CU GARCIA LOPEZ, ANA Universidad N') WHEN 1 THEN concat(chr(10), 'TUPEREZ RUIZ, JOSE LUIS Dpto 3', chr(10), 'EXT PROFESOR EXTERNO ID ', CAST(4500 + k % 11 AS VARCHAR))
          WHEN 2 THEN concat(chr(10), 'CD MARTIN DIAZ, MARIA', chr(10), 'ISABEL Universidad N') WHEN 3 THEN concat(chr(10), 'Apellidos y nombre del PROFESOR', chr(10), 'TIPO', chr(10), 'AS SANZ GIL, EVA 12,5 30') WHEN 4 THEN concat(chr(10), 'línea sin nombre', chr(10), 'GARCIA LOPEZ, ANA') WHEN 5 THEN concat(chr(10), 'PP NUÑEZ, ÓSCARHospital S') ELSE '' END,
        chr(10), 'DESGLOSE', chr(10), 'OTRA, PERSONA') AS text FROM b""",
    "aulas": """
      SELECT DISTINCT aula_id AS id, concat('Aula ', CAST(aula_id AS VARCHAR)) AS nombre, concat('ED-', lpad(CAST(aula_id AS VARCHAR), 5, '0')) AS codigo,
        CASE aula_id % 4 WHEN 0 THEN 'teorica' WHEN 1 THEN 'laboratorio' WHEN 2 THEN 'informatica' ELSE 'seminario' END AS tipo,
        CAST(20 + aula_id % 100 AS INT) AS capacidad, aula_id % 11 <> 0 AS activo FROM {sesiones}""",
    "profesores": """
      SELECT DISTINCT profesor_id AS id, concat('Nombre ', CAST(profesor_id % 60 AS VARCHAR)) AS nombre, concat('Apellido ', CAST(profesor_id AS VARCHAR)) AS apellidos,
        concat('Dpto ', CAST(profesor_id % 7 AS VARCHAR)) AS departamento, profesor_id % 13 <> 0 AS activo FROM {sesiones}""",
    "asignaturas": """
      SELECT DISTINCT asignatura_id AS id, concat('G', CAST(asignatura_id AS VARCHAR)) AS codigo_plan, concat('Materia ', CAST(asignatura_id AS VARCHAR), CASE WHEN asignatura_id % 3 = 0 THEN ' Física' ELSE ' Cálculo' END) AS nombre,
        periodo, CAST(1 + asignatura_id % 12 AS INT) AS ects, CASE asignatura_id % 3 WHEN 0 THEN 'presencial' WHEN 1 THEN 'online' ELSE 'hibrida' END AS modalidad,
        CASE WHEN asignatura_id % 5 = 0 THEN 'ingles' ELSE 'español' END AS idioma, asignatura_id % 17 <> 0 AS activo FROM {sesiones}""",
    "enlaces": """
      SELECT id * 2 + 1 AS id, id AS asignatura_id, id // 32 AS programa_id, CAST(id % 4 + 1 AS INT) AS curso, CAST(CASE WHEN (id // 8) % 4 = 3 THEN id % 2 + 1 END AS BIGINT) AS mencion_id FROM {asignaturas}
      UNION ALL SELECT id * 2 + 2, id, id // 32 + 100000, CAST(id % 3 + 1 AS INT), CAST(NULL AS BIGINT) FROM {asignaturas} WHERE id % 7 = 0""",
    "programas": """
      SELECT DISTINCT programa_id AS id, concat('Grado en Plan ', CAST(programa_id AS VARCHAR)) AS nombre FROM {enlaces}""",
    "menciones": """
      SELECT DISTINCT mencion_id AS id, CASE mencion_id WHEN 1 THEN 'Cómputo' ELSE 'Sistemas' END AS nombre FROM {enlaces} WHERE mencion_id IS NOT NULL""",
    "profesores_asignaturas": """
      SELECT DISTINCT profesor_id, asignatura_id FROM {sesiones} WHERE id % 3 = 0""",
    "fechadas": """
      SELECT o_orderkey AS id, o_custkey % 50 + 50 * (o_orderkey // 4000) AS aula_id, CAST(o_orderdate AS DATE) AS dia, CAST(480 + (o_orderkey * 37) % 600 AS INT) AS ini, CAST(540 + (o_orderkey * 37) % 600 AS INT) AS fin FROM {orders}""",
    "examenes": """
      WITH k AS (SELECT o_orderkey AS id, o_orderkey // 4000 AS plan_id, o_custkey AS c, CAST(o_orderdate AS DATE) AS dia, CAST(480 + (o_orderkey * 37) % 600 AS INT) AS ini, CAST(30 * (1 + o_custkey % 5) AS INT) AS dur FROM {orders})
      SELECT CAST(1000000000 + id AS BIGINT) AS id, CAST(plan_id * 40 + c % 12 AS BIGINT) AS aula_id, CAST(plan_id * 60 + c % 17 AS BIGINT) AS profesor_id, CAST(plan_id * 32 + c % 32 AS BIGINT) AS asignatura_id,
        CAST(plan_id * 10 + c % 4 + 1 AS BIGINT) AS curso, CASE WHEN (c % 32) // 4 % 2 = 0 THEN 'primer_cuatrimestre' ELSE 'segundo_cuatrimestre' END AS periodo, 'EXAMEN' AS tipo_grupo, concat('E', CAST(id % 3 AS VARCHAR)) AS grupo_codigo, dia, ini, ini + dur AS fin FROM k""",
    "celdas": """
      SELECT p_partkey // 60 AS doc, CAST(1 AS INT) AS page, CAST((p_partkey % 60) // 5 AS INT) AS fila, CAST(p_partkey % 5 AS INT) AS col,
        CASE WHEN (p_partkey % 60) // 5 % 4 = 2 AND p_partkey // 60 % 3 = 1 THEN NULL ELSE concat(lpad(CAST(8 + (p_partkey % 60) // 5 AS VARCHAR), 2, '0'), ':30') END AS hora,
        CASE (p_partkey // 5 // 2 + p_partkey % 5) % 6 WHEN 0 THEN '' WHEN 1 THEN concat('Cálculo I AULA ', CAST(p_partkey % 5 + 1 AS VARCHAR), ' PL', CAST(p_partkey % 5 AS VARCHAR))
          WHEN 2 THEN CASE WHEN p_partkey // 5 % 2 = 0 THEN 'Estructuras de' ELSE 'Datos LSC 2' END WHEN 3 THEN CASE WHEN p_partkey // 5 % 2 = 0 THEN 'Física' ELSE 'LATC Grupo 1' END
          WHEN 4 THEN '(*) aviso' ELSE concat('Álgebra lineal Grupo ', CAST(p_partkey % 5 AS VARCHAR)) END AS text
      FROM {part}""",
    "rejilla": """
      WITH b AS (SELECT p_partkey // 56 AS doc, CAST(p_partkey % 56 // 7 AS INT) AS fila, CAST(p_partkey % 7 AS INT) AS p, count(*) OVER (PARTITION BY p_partkey // 56) AS n FROM {part}),
      c AS (SELECT *, doc // 4 % 2 AS s FROM b WHERE n = 56)
      SELECT doc, CAST(1 AS INT) AS page, fila, CAST(10 * p + doc % 3 AS INT) AS col, CASE
        WHEN fila = 0 AND doc % 4 = 0 THEN CASE p WHEN 0 THEN 'Hora' WHEN 1 THEN 'L U N E S' WHEN 2 THEN 'Martes 1' WHEN 3 THEN 'miercoles' WHEN 4 THEN 'JUEVES' WHEN 5 THEN 'Horario de viernes' ELSE CASE WHEN doc % 8 = 0 THEN 'lunes' ELSE 'Notas' END END
        WHEN fila = 0 THEN CASE WHEN doc % 4 = 1 AND p = 2 + s THEN 'MARTES' END
        WHEN p = CASE WHEN doc % 4 = 2 THEN s ELSE 0 END AND doc % 4 < 3 THEN CASE fila WHEN 1 THEN '8:30' WHEN 2 THEN '09.30' WHEN 4 THEN 'de 10:30 a' WHEN 5 THEN '1130' WHEN 6 THEN '12:30' WHEN 7 THEN '13:30' END
        WHEN fila = 3 AND doc % 2 = 0 THEN NULL WHEN p = 6 AND doc % 8 = 0 THEN 'Seminario de introducción a la investigación'
        ELSE CASE (fila + p) % 5 WHEN 0 THEN '' WHEN 1 THEN 'Cálculo I AULA 3 PL1 y PL2' WHEN 2 THEN 'Estructuras de' WHEN 3 THEN 'Datos LSC 2' ELSE concat('Álgebra lineal Grupo ', CAST(p AS VARCHAR)) END END AS text FROM c""",
    "paginas": """
      SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS page, CASE WHEN l_partkey % 3 = 0 THEN '  corto ' ELSE concat('Texto de la página con más de cincuenta caracteres útiles, número ', CAST(l_partkey AS VARCHAR)) END AS text FROM {lineitem}""",
    "atomos": """
      SELECT l_orderkey AS doc, CAST(1 AS INT) AS page, concat('t', CAST(l_linenumber AS VARCHAR)) AS text, CAST(10 + 60 * (l_linenumber % 3) + l_partkey % 7 AS DOUBLE) AS x0, CAST(10 + 30 * (l_linenumber // 3) AS DOUBLE) AS top,
        CAST(40 + 60 * (l_linenumber % 3) AS DOUBLE) AS x1, CAST(20 + 30 * (l_linenumber // 3) AS DOUBLE) AS bottom, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS n FROM {lineitem}""",
    "textos": """
      SELECT p_partkey AS id, CASE p_partkey % 16
        WHEN 0 THEN concat('  Física   básica  I-', p_name) WHEN 1 THEN concat('AULA', CAST(p_size AS VARCHAR), '  ') WHEN 2 THEN concat('lab. química ', CAST(p_size AS VARCHAR))
        WHEN 3 THEN concat('Grupo ', CAST(p_size % 5 AS VARCHAR), ' y PL2') WHEN 4 THEN concat('gr. PA', CAST(p_size % 9 AS VARCHAR), ', PL1/ g. 3') WHEN 5 THEN 'POR DETERMINAR'
        WHEN 6 THEN CASE p_size % 5 WHEN 0 THEN 'Miércoles' WHEN 1 THEN 'lun' WHEN 2 THEN 'X' WHEN 3 THEN 'Sábado' ELSE 'festivo' END
        WHEN 7 THEN CASE p_size % 4 WHEN 0 THEN 'Primer Cuatrimestre' WHEN 1 THEN 'asignaturas 2C' WHEN 2 THEN 'anual' ELSE 'segundo semestre' END
        WHEN 8 THEN CASE p_size % 6 WHEN 0 THEN 'TERCER CURSO' WHEN 1 THEN 'Curso 2º' WHEN 2 THEN 'IV' WHEN 3 THEN 'sexto' WHEN 4 THEN 'curso 12' ELSE 'ninguno' END
        WHEN 9 THEN CASE p_size % 4 WHEN 0 THEN 'PRÁCTICAS DE LABORATORIO' WHEN 1 THEN 'Prácticas de aula' WHEN 2 THEN 'teoría' ELSE 'otra' END
        WHEN 10 THEN concat('Sala ordenadores LSC I informacio n ', p_name) WHEN 11 THEN concat(CAST(p_size % 24 AS VARCHAR), ':30-', CAST(p_size % 26 AS VARCHAR), ':15')
        WHEN 12 THEN concat(CAST(p_size % 24 AS VARCHAR), '.45 h') WHEN 13 THEN concat('g', CAST(p_size * 20 AS VARCHAR), 'a ')
        WHEN 14 THEN concat('Doble Grado en Física y Matemáticas|Segundo Cuatrimestre ', p_name) ELSE concat('Mención en cálculoNumérico II, ', p_name, ' (*) PL y TE') END AS t
      FROM {part}""",
}


def _needs(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", TABLES[name])))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table as read, or a derived one."""
    if name in BASE or name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = TABLES[name].replace("VARCHAR", "STRING")
    return spark.sql(sql.replace("//", "div"), **{n: table(spark, sf_dir, n) for n in _needs(name)})


def duck(sql: str, *names: str) -> str:
    """SQL for DuckDB that has the derived tables as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in TABLES and name not in order:
            for n in _needs(name):
                add(n)
            order.append(name)

    for n in names:
        add(n)
    parts = ", ".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', TABLES[n])})" for n in order)
    head = "WITH "
    body = sql.lstrip()
    if body.upper().startswith("WITH "):
        return f"{head}{parts}, {body[5:]}" if parts else body
    return f"{head}{parts} {body}" if parts else body
