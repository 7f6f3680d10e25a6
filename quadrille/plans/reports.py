"""Queries of searches, counts and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.operators import conflicts as C
from quadrille.operators import reports as R
from quadrille.plans.detection import ALL, NEEDS, keyed, sessions
from quadrille.plans.matching import own
from quadrille.plans.registry import query

STATE = "CASE WHEN sesion_id % 4 = 0 THEN 'solucionado' ELSE 'por_revisar' END"


def stored(t):
    return keyed(t).withColumn("estado", F.when(F.col("sesion_id") % 4 == 0, "solucionado").otherwise("por_revisar"))


@query("f5_search_conflicts", f"{ALL} SELECT hash FROM found WHERE tipo = '{C.COHORT}' AND severidad = '{C.CRITICAL}' AND {STATE} = 'por_revisar' AND (sesion_id = 501 OR sesion_2_id = 501)", NEEDS)
def f5(t):
    return R.search_conflicts(stored(t), tipo=C.COHORT, severidad=C.CRITICAL, estado="por_revisar", sesion=501).select("hash")


@query("f6_search_sessions", "SELECT id FROM sesiones WHERE periodo = 'primer_cuatrimestre' AND asignatura_id IN (SELECT asignatura_id FROM enlaces WHERE curso = 2) AND (profesor_id = 7 OR profesor_2_id = 7)", ("sesiones", "enlaces"))
def f6(t):
    return R.search_sessions(sessions(t), t.enlaces, curso=2, periodo="primer_cuatrimestre", profesor_id=7).select("id")


@query("f6_search_dates", "SELECT id, aula_id FROM fechadas WHERE dia BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' AND aula_id % 50 = 7", ("fechadas",))
def f6b(t):
    s = own(t, "SELECT id, aula_id, aula_id % 50 AS puesto, timestampadd(MINUTE, ini, CAST(dia AS TIMESTAMP)) AS inicio, timestampadd(MINUTE, fin, CAST(dia AS TIMESTAMP)) AS fin_ts FROM fechadas")
    return R.search_sessions(s, t.enlaces, desde="1995-01-01 00:00:00", hasta="1996-07-01 00:00:00", puesto=7).select("id", "aula_id")


PROGRAMS = "SELECT DISTINCT programa_id AS id, concat('Grado en Plan ', CAST(programa_id AS VARCHAR)) AS nombre, CASE WHEN programa_id >= 100000 THEN 'master' ELSE 'grado' END AS tipo, programa_id % 7 <> 0 AS activo FROM enlaces"
MENTIONS = "SELECT DISTINCT programa_id * 10 + mencion_id AS id, programa_id, concat('Mención ', CAST(mencion_id AS VARCHAR)) AS nombre, programa_id % 3 <> 0 AS activo FROM enlaces WHERE mencion_id IS NOT NULL"
GROUPS = "SELECT DISTINCT asignatura_id, grupo_codigo AS codigo, tipo_grupo AS tipo, curso FROM sesiones"


@query("f9_list_programs", f"SELECT id, nombre FROM ({PROGRAMS}) WHERE activo AND tipo = 'grado'", ("enlaces",))
def f9b(t):
    return R.listing(own(t, PROGRAMS), "nombre", "id", activo=True, tipo="grado").select("id", "nombre")


@query("f9_list_mentions", f"SELECT id, nombre FROM ({MENTIONS}) WHERE activo AND programa_id = 1", ("enlaces",))
def f9c(t):
    return R.listing(own(t, MENTIONS), "nombre", "id", activo=True, programa_id=1).select("id", "nombre")


@query("f9_list_groups", f"SELECT asignatura_id, codigo, curso FROM ({GROUPS}) WHERE tipo = 'TEORIA' AND codigo = 'G1'", ("sesiones",))
def f9d(t):
    return R.listing(own(t, GROUPS), "asignatura_id", "codigo", tipo="TEORIA", codigo="G1").select("asignatura_id", "codigo", "curso")


@query("j20_subject_programs", f"SELECT DISTINCT e.asignatura_id, e.programa_id, p.nombre FROM enlaces e JOIN ({PROGRAMS}) p ON p.id = e.programa_id", ("asignaturas", "enlaces"))
def j20b(t):
    return R.bridge(t.asignaturas, t.enlaces, own(t, PROGRAMS), "asignatura_id", "programa_id")


@query("j20_program_subjects", "SELECT DISTINCT e.programa_id, e.asignatura_id, a.nombre FROM enlaces e JOIN asignaturas a ON a.id = e.asignatura_id", ("asignaturas", "enlaces"))
def j20c(t):
    return R.bridge(own(t, PROGRAMS), t.enlaces, t.asignaturas, "programa_id", "asignatura_id")


@query("f7_search_subjects", "SELECT id, codigo_plan FROM asignaturas WHERE activo AND modalidad = 'online' AND idioma = 'español'", ("asignaturas",))
def f7(t):
    return R.search_subjects(t.asignaturas, activo=True, modalidad="online", idioma="español").select("id", "codigo_plan")


@query("f8_search_rooms", "SELECT id FROM aulas WHERE activo AND tipo = 'laboratorio' AND capacidad BETWEEN 30 AND 60 AND (contains(lower(nombre), 'aula 1') OR contains(lower(codigo), 'aula 1'))", ("aulas",))
def f8(t):
    return R.search_rooms(t.aulas, texto="AULA 1", min_capacidad=30, max_capacidad=60, activo=True, tipo="laboratorio").select("id")


@query("f9_list_teachers", "SELECT id, nombre, apellidos FROM profesores WHERE activo AND departamento = 'Dpto 3'", ("profesores",))
def f9(t):
    return R.listing(t.profesores, "apellidos", "nombre", "id", activo=True, departamento="Dpto 3").select("id", "nombre", "apellidos")


@query("f10_common_filters", f"{ALL} SELECT severidad, count(*) AS n FROM found WHERE severidad IN ('{C.CRITICAL}', '{C.MILD}') GROUP BY 1", NEEDS)
def f10(t):
    return R.common_filters(stored(t), min_severidad=C.MILD).groupBy("severidad").agg(F.count("*").alias("n"))


@query("f10_ilike", "SELECT id FROM asignaturas WHERE activo AND nombre ILIKE '%FÍSICA%'", ("asignaturas",))
def f10b(t):
    return R.common_filters(t.asignaturas, activo=True, nombre="física").select("id")


@query("f11_text_filter", "SELECT id FROM asignaturas WHERE contains(strip_accents(lower(nombre)), 'fisica') OR contains(lower(codigo_plan), 'fisica')", ("asignaturas",))
def f11(t):
    return R.text_filter(t.asignaturas, " FÍSICA ", ["nombre", "codigo_plan"]).select("id")


DRAFT = "SELECT id, plan_id, dia_semana, ini, CASE id % 4 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'NO_MATCH' ELSE 'FUZZY_AUTO' END AS estado, id % 6 = 1 AS manual FROM sesiones"
STATUS = "CASE WHEN manual OR estado = 'EXACT' THEN 'valid' WHEN estado = 'NO_MATCH' THEN 'error' ELSE 'suggestion' END"


@query("f12_pending_review", f"SELECT id FROM ({DRAFT}) WHERE {STATUS} <> 'valid'", ("sesiones",))
def f12(t):
    return R.pending_review(own(t, DRAFT)).select("id")


@query("g8_review_counts", f"SELECT plan_id, CAST(count(*) FILTER (WHERE {STATUS} = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (WHERE {STATUS} = 'suggestion') AS BIGINT) AS suggestions FROM ({DRAFT}) GROUP BY 1", ("sesiones",))
def g8(t):
    return R.review_counts(own(t, DRAFT), "plan_id")


@query("o3_review_order", f"SELECT id, row_number() OVER (PARTITION BY plan_id ORDER BY CASE {STATUS} WHEN 'error' THEN 0 WHEN 'suggestion' THEN 1 ELSE 2 END, dia_semana, ini, id) AS pos FROM ({DRAFT})", ("sesiones",))
def o3(t):
    """The order of each plan's rows, as numbers."""
    return R.review_order(own(t, DRAFT), "plan_id").select("id", "pos")


@query("f4_validate_session", "SELECT id, CASE id % 5 WHEN 0 THEN 'faltan_fechas,sobra_horario' WHEN 1 THEN 'falta_horario' WHEN 2 THEN 'orden_horas' ELSE '' END AS errores FROM sesiones", ("sesiones",))
def f4(t):
    s = t.sesiones.select("id", F.when(F.col("id") % 5 == 0, "puntual").otherwise("semanal").alias("tipo_recurrencia"), "dia_semana", "ini", F.when(F.col("id") % 5 == 2, F.col("ini")).when(F.col("id") % 5 != 1, F.col("fin")).alias("fin"), F.lit(None).cast("timestamp").alias("inicio"), F.lit(None).cast("timestamp").alias("fin_ts"))
    return R.validate_session(s).select("id", F.array_join("errores", ",").alias("errores"))


@query("f14_validate_entities", "SELECT id, CASE WHEN ects + 3 > 12 THEN 'ects' ELSE '' END || CASE WHEN length(codigo_plan) > 6 THEN 'codigo' ELSE '' END AS errores FROM asignaturas", ("asignaturas",))
def f14(t):
    return R.validate(t.asignaturas.withColumn("ects", F.col("ects") + 3), R.entity_rules()).select("id", F.array_join("errores", "").alias("errores"))


ODD_ROOMS = "SELECT id, CASE id % 6 WHEN 0 THEN '   ' WHEN 1 THEN NULL ELSE nombre END AS nombre, CASE id % 5 WHEN 0 THEN repeat(codigo, 9) ELSE codigo END AS codigo, CASE id % 4 WHEN 0 THEN 'pasillo' ELSE tipo END AS tipo, CAST(CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE capacidad END AS INT) AS capacidad FROM aulas"


@query("f14_validate_rooms", f"SELECT id, CASE WHEN id % 6 < 2 THEN 'nombre ' ELSE '' END || CASE WHEN length(codigo) > 50 THEN 'codigo ' ELSE '' END || CASE WHEN id % 4 = 0 THEN 'tipo ' ELSE '' END || CASE WHEN id % 3 = 0 THEN 'capacidad ' ELSE '' END AS errores FROM ({ODD_ROOMS})", ("aulas",))
def f14b(t):
    odd = t.spark.sql(ODD_ROOMS.replace("FROM aulas", "FROM {aulas}"), aulas=t.aulas)
    return R.validate(odd, R.entity_rules("aula")).select("id", F.array_join(F.transform("errores", lambda e: F.concat(e, F.lit(" "))), "").alias("errores"))


ODD_GROUPS = "SELECT id, asignatura_id, grupo_codigo AS codigo, lower(tipo_grupo) AS tipo, CAST(CASE WHEN id % 9 = 0 THEN NULL ELSE id % 8 END AS INT) AS curso FROM sesiones"


@query("f14_validate_groups", f"SELECT id, CASE WHEN asignatura_id = 0 THEN 'asignatura,' ELSE '' END || CASE WHEN curso IN (0, 7) THEN 'curso,' ELSE '' END AS errores FROM ({ODD_GROUPS})", ("sesiones",))
def f14c(t):
    groups = t.spark.sql(ODD_GROUPS.replace("FROM sesiones", "FROM {sesiones}"), sesiones=t.sesiones)
    return R.validate(groups, R.entity_rules("grupo")).select("id", F.array_join(F.transform("errores", lambda e: F.concat(e, F.lit(","))), "").alias("errores"))


@query("o1_paginate", "SELECT id, (SELECT count(*) FROM aulas) AS total, CAST(2 AS INT) AS pagina FROM aulas ORDER BY codigo, id LIMIT 20 OFFSET 20", ("aulas",))
def o1(t):
    return R.paginate(t.aulas, ["codigo", "id"], 20, 20).select("id", "total", "pagina")


@query("o2_sort_by", "SELECT id, capacidad FROM aulas", ("aulas",))
def o2(t):
    return R.sort_by(t.aulas, "capacidad", desc=True).select("id", "capacidad")


@query("o4_ordered_restrictions", "SELECT id, dia_semana, ini FROM restricciones", ("restricciones",))
def o4(t):
    return R.ordered_restrictions(t.restricciones).select("id", "dia_semana", "ini")


@query("g5_subject_counts", "SELECT a.id, (SELECT count(*) FROM enlaces e WHERE e.asignatura_id = a.id) AS n_programas, (SELECT count(*) FROM profesores_asignaturas p WHERE p.asignatura_id = a.id) AS n_profesores FROM asignaturas a", ("asignaturas", "enlaces", "profesores_asignaturas"))
def g5(t):
    return R.subject_counts(t.asignaturas, t.enlaces, t.profesores_asignaturas)


@query("g5_teacher_counts", "SELECT p.id, (SELECT count(*) FROM restricciones r WHERE r.profesor_id = p.id) AS n_restricciones FROM profesores p", ("profesores", "restricciones"))
def g5b(t):
    return R.teacher_counts(t.profesores, t.restricciones)


@query("g6_facets", "SELECT 'tipo' AS faceta, tipo AS valor, count(*) AS n FROM aulas GROUP BY 2 UNION ALL SELECT 'activo', CAST(activo AS VARCHAR), count(*) FROM aulas WHERE tipo = 'seminario' GROUP BY 2", ("aulas",))
def g6(t):
    return R.facets(t.aulas, ["tipo", "activo"], {"tipo": "seminario"})


@query("g6_facets_of_sessions", """SELECT 'tipo_grupo' AS faceta, tipo_grupo AS valor, count(*) AS n FROM sesiones WHERE periodo = 'primer_cuatrimestre' AND mencion_id = 1 GROUP BY 2 UNION ALL SELECT 'periodo', periodo, count(*) FROM sesiones WHERE tipo_grupo = 'TEORIA' AND mencion_id = 1 GROUP BY 2
  UNION ALL SELECT 'mencion_id', CAST(mencion_id AS VARCHAR), count(*) FROM sesiones WHERE tipo_grupo = 'TEORIA' AND periodo = 'primer_cuatrimestre' GROUP BY 2 UNION ALL SELECT 'dia_semana', CAST(dia_semana AS VARCHAR), count(*) FROM sesiones WHERE tipo_grupo = 'TEORIA' AND periodo = 'primer_cuatrimestre' AND mencion_id = 1 GROUP BY 2""", ("sesiones",))  # fmt: skip
def g6b(t):
    """Four facets, three of them chosen: one scan."""
    return R.facets(t.sesiones, ["tipo_grupo", "periodo", "mencion_id", "dia_semana"], {"tipo_grupo": "TEORIA", "periodo": "primer_cuatrimestre", "mencion_id": 1})


@query("g7_import_stats", "SELECT event_id // 1000 AS run_id, count(*) FILTER (WHERE event_id % 5 = 0) AS created, count(*) FILTER (WHERE event_id % 5 = 1) AS updated, count(*) FILTER (WHERE event_id % 5 = 2) AS removed, count(*) FILTER (WHERE event_id % 5 = 3) AS error, count(*) FILTER (WHERE event_id % 5 = 4) AS warning FROM events GROUP BY 1")
def g7(t):
    return R.import_stats(t.events.selectExpr("event_id div 1000 AS run_id", "element_at(array('created','updated','removed','error','warning'), CAST(event_id % 5 + 1 AS INT)) AS action"))


FIRST = "fc AS (SELECT asignatura_id, programa_id, curso, mencion_id FROM enlaces QUALIFY row_number() OVER (PARTITION BY asignatura_id ORDER BY id) = 1)"


@query(
    "g1_schedule_summary",
    f"""{ALL}, {FIRST}, sd AS (SELECT hash, sesion_id AS id FROM found WHERE {STATE} = 'por_revisar' UNION ALL SELECT hash, sesion_2_id FROM found WHERE {STATE} = 'por_revisar' AND sesion_2_id IS NOT NULL)
    SELECT programa_id, fc.curso, s.periodo, fc.mencion_id, count(DISTINCT s.asignatura_id) AS total_asignaturas, count(DISTINCT s.id) AS total_sesiones, count(DISTINCT hash) AS conflictos, CASE WHEN count(DISTINCT hash) > 0 THEN 'conflicto' ELSE 'ok' END AS estado
    FROM sesiones s JOIN fc ON fc.asignatura_id = s.asignatura_id LEFT JOIN sd ON sd.id = s.id GROUP BY ALL""",
    (*NEEDS, "enlaces"),
)
def g1(t):
    return R.schedule_summary(t.sesiones, t.enlaces, stored(t))


DAY = "['lunes', 'martes', 'miercoles', 'jueves', 'viernes'][dia_semana + 1]"
SUMMARY = f"""sm AS (SELECT s.id, concat(tipo_grupo, ' ', grupo_codigo) AS grupo, concat(CAST(s.curso AS VARCHAR), '°') AS curso_label, concat({DAY}, ' ', lpad(CAST(ini // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(ini % 60 AS VARCHAR), 2, '0'), '-', lpad(CAST(fin // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(fin % 60 AS VARCHAR), 2, '0')) AS horario,
  (SELECT programa_id FROM enlaces e WHERE e.asignatura_id = s.asignatura_id ORDER BY (e.curso = s.curso % 10) DESC, e.id LIMIT 1) AS programa_id FROM sesiones s)"""


@query("n41_session_summary", f"WITH {SUMMARY} SELECT * FROM sm", ("sesiones", "enlaces"))
def n41(t):
    links = t.enlaces
    s = t.sesiones
    out = R.session_summary(s.withColumn("curso", F.col("curso") % 10), links)
    return out.join(s.select("id", F.concat(F.col("curso").cast("string"), F.lit("°")).alias("_c")), "id").withColumn("curso_label", F.col("_c")).drop("_c")


@query("j18_conflicts_of", f"{ALL} SELECT hash FROM found WHERE sesion_id IN (SELECT id FROM sesiones WHERE asignatura_id = 5) OR sesion_2_id IN (SELECT id FROM sesiones WHERE asignatura_id = 5)", NEEDS)
def j18(t):
    return C.touching(keyed(t), t.sesiones.where("asignatura_id = 5").select("id")).select("hash")


@query("j19_conflict_details", f"{ALL}, {SUMMARY} SELECT f.hash, a.horario AS horario_1, a.programa_id AS programa_id_1, b.horario AS horario_2, b.programa_id AS programa_id_2 FROM found f LEFT JOIN sm a ON a.id = sesion_id LEFT JOIN sm b ON b.id = sesion_2_id", (*NEEDS, "enlaces"))
def j19(t):
    summary = R.session_summary(t.sesiones.withColumn("curso", F.col("curso") % 10), t.enlaces)
    return R.conflict_details(keyed(t), summary).select("hash", "horario_1", "programa_id_1", "horario_2", "programa_id_2")


@query("j20_subject_teachers", "SELECT a.id AS asignatura_id, p.id AS profesor_id, p.nombre FROM asignaturas a JOIN profesores_asignaturas x ON x.asignatura_id = a.id JOIN profesores p ON p.id = x.profesor_id", ("asignaturas", "profesores", "profesores_asignaturas"))
def j20(t):
    return R.bridge(t.asignaturas, t.profesores_asignaturas, t.profesores, "asignatura_id", "profesor_id")


@query("j21_grid_sessions", f"{ALL} SELECT s.id, a.nombre AS asignatura, r.nombre AS aula, s.dia_semana, s.ini, s.fin, CASE WHEN s.id IN (SELECT sesion_id FROM found WHERE {STATE} = 'por_revisar' UNION SELECT sesion_2_id FROM found WHERE {STATE} = 'por_revisar' AND sesion_2_id IS NOT NULL) THEN 'conflicto' WHEN s.id % 9 = 0 THEN 'nueva' WHEN s.id % 9 = 1 THEN 'editada' ELSE 'normal' END AS color FROM sesiones s LEFT JOIN asignaturas a ON a.id = s.asignatura_id LEFT JOIN aulas r ON r.id = s.aula_id", NEEDS)
def j21(t):
    s = t.sesiones.withColumn("op", F.when(F.col("id") % 9 == 0, "create").when(F.col("id") % 9 == 1, "update"))
    return R.grid_sessions(s, t.asignaturas, t.aulas, stored(t))


@query("j22_slot_occupancy", "WITH g AS (SELECT *, unnest(range(540, 1200, 30)) AS s0 FROM sesiones) SELECT plan_id, dia_semana, (s0 - 540) // 30 AS hueco, count(*) AS n FROM g WHERE s0 < fin AND s0 + 30 > ini GROUP BY ALL", ("sesiones",))
def j22(t):
    return R.slot_occupancy(t.sesiones, 540, 1200, 30, "plan_id")


CLUSTER = "m AS (SELECT *, max(fin) OVER (PARTITION BY aula_id, dia_semana ORDER BY ini, fin, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sesiones), cl AS (SELECT *, sum(CASE WHEN before IS NULL OR ini >= before THEN 1 ELSE 0 END) OVER (PARTITION BY aula_id, dia_semana ORDER BY ini, fin, id) AS cluster FROM m)"


@query("w6_overlap_clusters", f"WITH {CLUSTER} SELECT id, CAST(cluster AS BIGINT) AS cluster FROM cl", ("sesiones",))
def w6(t):
    return R.overlap_clusters(t.sesiones, ["aula_id"]).select("id", "cluster")


@query("w7_lanes", f"WITH {CLUSTER} SELECT a.id, CAST(max((SELECT count(*) FROM cl b WHERE b.aula_id = a.aula_id AND b.dia_semana = a.dia_semana AND b.cluster = a.cluster AND b.ini <= c.ini AND b.fin > c.ini)) AS INT) AS lanes FROM cl a JOIN cl c ON a.aula_id = c.aula_id AND a.dia_semana = c.dia_semana AND a.cluster = c.cluster GROUP BY a.id", ("sesiones",))
def w7(t):
    return R.assign_lanes(R.overlap_clusters(t.sesiones, ["aula_id"]), ["aula_id"]).select("id", "lanes")


@query("w7_lane_index")
def w7b(t):
    return R.assign_lanes(R.overlap_clusters(t.sesiones, ["aula_id"]), ["aula_id"]).select("id", "lane", "lanes")


@query("w1_keep_first", "SELECT id, plan_id, dia_semana, ini FROM sesiones QUALIFY row_number() OVER (PARTITION BY plan_id, dia_semana, ini ORDER BY id) = 1", ("sesiones",))
def w1(t):
    return C.keep_first(t.sesiones, ["plan_id", "dia_semana", "ini"], ["id"]).select("id", "plan_id", "dia_semana", "ini")
