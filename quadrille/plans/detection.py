"""Queries of the detector."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators import conflicts as C
from quadrille.operators.intervals import interval_pairs, overlaps_weekly, recurrence
from quadrille.plans.registry import Tables, query


def sessions(t: Tables) -> DataFrame:
    return t.sesiones.withColumns({"profesor_ids": F.array_compact(F.array("profesor_id", "profesor_2_id")), "mencion_ids": F.array_compact(F.array("mencion_id"))})


PAIR = "a.dia_semana = b.dia_semana AND a.periodo = b.periodo AND a.ini < b.fin AND b.ini < a.fin AND a.id < b.id"
J1 = f"SELECT a.id AS s1, b.id AS s2, a.aula_id FROM sesiones a JOIN sesiones b ON a.aula_id = b.aula_id AND {PAIR}"
TEACHERS = "sp AS (SELECT *, profesor_id AS pid, profesor_2_id IS NULL AS one FROM sesiones UNION ALL SELECT *, profesor_2_id, false FROM sesiones WHERE profesor_2_id IS NOT NULL)"
J2 = f"SELECT a.id AS s1, b.id AS s2, a.pid AS profesor_id, a.one AND b.one AS alone FROM sp a JOIN sp b ON a.pid = b.pid AND {PAIR}"
J3 = f"""SELECT a.id AS s1, b.id AS s2, CASE WHEN a.asignatura_id = b.asignatura_id THEN a.asignatura_id ELSE 0 END AS asignatura_comun,
  CASE WHEN a.asignatura_id <> b.asignatura_id THEN '{C.LEVEL}' WHEN a.tipo_grupo = 'TEORIA' OR b.tipo_grupo = 'TEORIA' THEN '{C.INNER}'
    ELSE concat('Solapamiento de subgrupo idéntico (', a.grupo_codigo, ').') END AS motivo, a.asignatura_id
  FROM sesiones a JOIN sesiones b ON a.curso = b.curso AND {PAIR}
  WHERE NOT coalesce(a.mencion_id <> b.mencion_id, false) AND (a.asignatura_id <> b.asignatura_id OR a.tipo_grupo = 'TEORIA' OR b.tipo_grupo = 'TEORIA' OR a.grupo_codigo = b.grupo_codigo)"""
J4 = "SELECT s.id AS s1, r.id AS restriccion_id, s.pid AS profesor_id, r.ini AS r_ini, r.fin AS r_fin FROM sp s JOIN restricciones r ON s.pid = r.profesor_id AND s.dia_semana = r.dia_semana AND s.ini < r.fin AND r.ini < s.fin"


def hm(c: str) -> str:
    return f"concat(lpad(CAST({c} // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST({c} % 60 AS VARCHAR), 2, '0'))"


CONTEXT = "cx AS (SELECT e.asignatura_id, p.nombre AS grado, m.nombre AS mencion FROM (SELECT * FROM enlaces QUALIFY row_number() OVER (PARTITION BY asignatura_id ORDER BY id) = 1) e LEFT JOIN programas p ON p.id = e.programa_id LEFT JOIN menciones m ON m.id = e.mencion_id)"
ALL = f"""WITH {TEACHERS}, {CONTEXT}, j1 AS ({J1}), j2 AS ({J2}), j3 AS ({J3}), j4 AS ({J4}),
u AS (
 SELECT '{C.ROOM}' AS tipo, '{C.CRITICAL}' AS severidad, s1 AS sesion_id, s2 AS sesion_2_id, aula_id, CAST(NULL AS BIGINT) AS profesor_id, CAST(NULL AS BIGINT) AS asignatura_id, CAST(NULL AS BIGINT) AS restriccion_id,
  concat('El aula ''', coalesce(n.nombre, concat('Aula ', CAST(aula_id AS VARCHAR))), ''' está ocupada simultáneamente.') AS descripcion, aula_id AS res FROM j1 LEFT JOIN aulas n ON n.id = aula_id
 UNION ALL SELECT '{C.TEACHER}', CASE WHEN alone THEN '{C.CRITICAL}' ELSE '{C.MILD}' END, s1, s2, NULL, profesor_id, NULL, NULL,
  concat(coalesce(n.nombre || ' ' || n.apellidos, concat('Docente ', CAST(profesor_id AS VARCHAR))), CASE WHEN alone THEN ' tiene dos clases a la vez (único docente).' ELSE ' tiene solapamiento (con apoyo).' END), profesor_id FROM j2 LEFT JOIN profesores n ON n.id = profesor_id
 UNION ALL SELECT '{C.COHORT}', '{C.CRITICAL}', s1, s2, NULL, NULL, j3.asignatura_id, NULL,
  CASE WHEN asignatura_comun <> 0 THEN concat('Asignatura ''', n.nombre, ''': ', motivo)
   ELSE concat('Solape en ', coalesce(cx.grado, 'Grado'), ': Curso ', CAST(s.curso AS VARCHAR), 'º, ', CASE s.periodo WHEN 'primer_cuatrimestre' THEN 'Primer Cuatrimestre' ELSE 'Segundo Cuatrimestre' END, coalesce(' (' || cx.mencion || ')', '')) END, j3.asignatura_id
  FROM j3 JOIN sesiones s ON s.id = s1 LEFT JOIN asignaturas n ON n.id = asignatura_comun LEFT JOIN cx ON cx.asignatura_id = j3.asignatura_id
 UNION ALL SELECT '{C.RESTRICTION}', '{C.MILD}', s1, NULL, NULL, profesor_id, NULL, restriccion_id,
  concat('Restricción de ', coalesce(n.nombre || ' ' || n.apellidos, concat('Docente ', CAST(profesor_id AS VARCHAR))), ': No disponible de ', {hm("r_ini")}, ' a ', {hm("r_fin")}, '.'), restriccion_id FROM j4 LEFT JOIN profesores n ON n.id = profesor_id),
h AS (SELECT *, sha256(CASE WHEN tipo = '{C.RESTRICTION}' THEN concat(tipo, ':', CAST(sesion_id AS VARCHAR), ':', CAST(res AS VARCHAR))
  ELSE concat(tipo, ':', CAST(sesion_id AS VARCHAR), '-', CAST(sesion_2_id AS VARCHAR), ':', CAST(res AS VARCHAR)) END) AS hash FROM u),
found AS (SELECT tipo, severidad, sesion_id, sesion_2_id, aula_id, profesor_id, asignatura_id, restriccion_id, descripcion, hash FROM h
 QUALIFY row_number() OVER (PARTITION BY hash ORDER BY sesion_id, sesion_2_id NULLS FIRST, profesor_id NULLS FIRST) = 1)"""
NEEDS = ("sesiones", "restricciones", "aulas", "profesores", "asignaturas", "enlaces", "programas", "menciones")


def names(t: Tables) -> dict[str, DataFrame]:
    """What the descriptions take their names from."""
    return {"room_names": t.aulas, "teacher_names": t.profesores, "subject_names": t.asignaturas, "context": C.subject_context(t.enlaces, t.programas, t.menciones)}


def detected(t: Tables, **options) -> DataFrame:
    return C.detect_conflicts(sessions(t), t.restricciones, **names(t), **options)


def keyed(t: Tables) -> DataFrame:
    """The findings of detected with descriptions that know no names, for queries that leave descriptions out: names decide nothing else."""
    return C.detect_conflicts(sessions(t), t.restricciones)


@query("j1_room_overlaps", J1, ("sesiones",))
def j1(t):
    return C.room_overlaps(sessions(t))


@query("j2_teacher_overlaps", f"WITH {TEACHERS} {J2}", ("sesiones",))
def j2(t):
    return C.teacher_overlaps(sessions(t))


@query("j3_cohort_overlaps", J3, ("sesiones",))
def j3(t):
    return C.cohort_overlaps(sessions(t))


@query("j4_restriction_violations", f"WITH {TEACHERS} {J4}", ("sesiones", "restricciones"))
def j4(t):
    return C.restriction_violations(sessions(t), t.restricciones)


DATED = "f AS (SELECT id, aula_id, CAST(dia AS TIMESTAMP) + to_minutes(CAST(ini AS BIGINT)) AS i, CAST(dia AS TIMESTAMP) + to_minutes(CAST(fin AS BIGINT)) AS e FROM fechadas)"


@query("j5_f2_dated_overlaps", f"WITH {DATED} SELECT a.id AS s1, b.id AS s2, a.aula_id FROM f a JOIN f b ON a.aula_id = b.aula_id AND a.i < b.e AND b.i < a.e AND a.id < b.id", ("fechadas",))
def j5(t):
    f = t.fechadas.selectExpr("id", "aula_id", "CAST(dia AS TIMESTAMP) + make_dt_interval(0, 0, ini) AS inicio", "CAST(dia AS TIMESTAMP) + make_dt_interval(0, 0, fin) AS fin_ts")
    return C.dated_overlaps(f, "aula_id", period=False)


EXAMS = "x AS (SELECT id, profesor_id, periodo, CAST(dia AS TIMESTAMP) + to_minutes(CAST(ini AS BIGINT)) AS i, CAST(dia AS TIMESTAMP) + to_minutes(CAST(fin AS BIGINT)) AS e FROM examenes)"


@query("j5_dated_teacher_overlaps", f"WITH {EXAMS} SELECT a.id AS s1, b.id AS s2, a.profesor_id FROM x a JOIN x b ON a.profesor_id = b.profesor_id AND a.periodo = b.periodo AND a.i < b.e AND b.i < a.e AND a.id < b.id", ("examenes",))
def j5b(t):
    x = t.examenes.selectExpr("id", "profesor_id", "periodo", "CAST(dia AS TIMESTAMP) + make_dt_interval(0, 0, ini) AS inicio", "CAST(dia AS TIMESTAMP) + make_dt_interval(0, 0, fin) AS fin_ts")
    return C.dated_overlaps(x, "profesor_id")


@query(
    "j6_effective_teachers",
    """SELECT s.id, coalesce(array_to_string(CASE WHEN s.id % 2 = 0 THEN [s.profesor_id] END, ','), array_to_string(p.l, ','), '') AS profesores
       FROM sesiones s LEFT JOIN (SELECT asignatura_id, list_sort(list(DISTINCT profesor_id)) AS l FROM profesores_asignaturas GROUP BY 1) p ON p.asignatura_id = s.asignatura_id""",
    ("sesiones", "profesores_asignaturas"),
)
def j6(t):
    own = t.sesiones.where("id % 2 = 0").selectExpr("id AS sesion_id", "profesor_id")
    out = C.effective_teachers(t.sesiones.select("id", "asignatura_id"), own, t.profesores_asignaturas)
    return out.select("id", F.array_join("profesor_ids", ",").alias("profesores"))


@query("j7_first_context", "SELECT asignatura_id, programa_id, mencion_id, curso FROM enlaces QUALIFY row_number() OVER (PARTITION BY asignatura_id ORDER BY id) = 1", ("enlaces",))
def j7(t):
    return C.first_context(t.enlaces)


@query("f1_weekly_overlap_counts", f"SELECT a.plan_id, count(*) AS n FROM sesiones a JOIN sesiones b ON a.plan_id = b.plan_id AND a.aula_id = b.aula_id AND {PAIR} GROUP BY 1", ("sesiones",))
def f1(t):
    pairs = interval_pairs(t.sesiones.select("id", "plan_id", "aula_id", "periodo", "dia_semana", "ini", "fin"), ["plan_id", "aula_id", "periodo", "dia_semana"], "ini", "fin", C.BIN)
    return pairs.where(overlaps_weekly("a", "b")).groupBy(F.col("a.plan_id").alias("plan_id")).agg(F.count("*").alias("n"))


@query("f3_recurrence", "SELECT CASE WHEN id % 7 = 0 THEN 'FECHADA' ELSE 'SEMANAL' END AS tipo_recurrencia, count(*) AS n FROM sesiones GROUP BY 1", ("sesiones",))
def f3(t):
    s = t.sesiones.withColumn("fin", F.when(F.col("id") % 7 != 0, F.col("fin")))
    return recurrence(s).groupBy("tipo_recurrencia").agg(F.count("*").alias("n"))


@query("g2_n39_n40_w1_detect_conflicts", f"{ALL} SELECT * FROM found", NEEDS)
def g2(t):
    return detected(t)


@query("g2_min_severity", f"{ALL} SELECT * FROM found WHERE severidad = '{C.CRITICAL}'", NEEDS)
def g2_min(t):
    return detected(t, min_severity=C.CRITICAL)


@query("g3_detect_for", f"{ALL} SELECT * FROM found WHERE sesion_id % 50 = 7 OR sesion_2_id % 50 = 7", NEEDS)
def g3(t):
    s = sessions(t)
    return C.detect_for(s, s.where("id % 50 = 7"), t.restricciones, **names(t))


@query("g4_unique_conflicts", f"{ALL} SELECT tipo, count(DISTINCT hash) AS n FROM found WHERE sesion_id % 3 <> 0 GROUP BY 1", NEEDS)
def g4(t):
    both = detected(t)
    both = both.unionByName(both).withColumn("estado", F.when(F.col("sesion_id") % 3 != 0, "por_revisar").otherwise("solucionado"))
    return C.unique_conflicts(both).groupBy("tipo").agg(F.count("*").alias("n"))


def calendar(t: Tables) -> DataFrame:
    """The weekly sessions and exams, which have a date instead of a weekday."""
    exams = t.examenes.selectExpr(
        "id", "aula_id", "array(profesor_id) AS profesor_ids", "asignatura_id", "curso", "periodo", "tipo_grupo", "grupo_codigo", "CAST(array() AS ARRAY<BIGINT>) AS mencion_ids", "CAST(NULL AS INT) AS dia_semana", "CAST(NULL AS INT) AS ini", "CAST(NULL AS INT) AS fin",
        "CAST(dia AS TIMESTAMP) + make_dt_interval(0, 0, ini) AS inicio", "CAST(dia AS TIMESTAMP) + make_dt_interval(0, 0, fin) AS fin_ts",
    )
    weekly = sessions(t).withColumns({"inicio": F.lit(None).cast("timestamp"), "fin_ts": F.lit(None).cast("timestamp")})
    return weekly.select(exams.columns).unionByName(exams)


def dated_sql(met: str) -> str:
    """Findings over sessions and exams: met says whether a and b are held at the same time."""
    return f"""WITH x AS (SELECT id, aula_id, profesor_id, profesor_2_id, asignatura_id, curso, periodo, tipo_grupo, grupo_codigo, mencion_id, dia_semana, ini, fin, CAST(NULL AS TIMESTAMP) AS i, CAST(NULL AS TIMESTAMP) AS e FROM sesiones
  UNION ALL SELECT id, aula_id, profesor_id, NULL, asignatura_id, curso, periodo, tipo_grupo, grupo_codigo, NULL, NULL, NULL, NULL, CAST(dia AS TIMESTAMP) + to_minutes(CAST(ini AS BIGINT)), CAST(dia AS TIMESTAMP) + to_minutes(CAST(fin AS BIGINT)) FROM examenes),
xp AS (SELECT *, profesor_id AS pid, profesor_2_id IS NULL AS one FROM x UNION ALL SELECT *, profesor_2_id, false FROM x WHERE profesor_2_id IS NOT NULL),
u AS (SELECT '{C.ROOM}' AS tipo, '{C.CRITICAL}' AS severidad, a.id AS s1, b.id AS s2, a.aula_id AS res FROM x a JOIN x b ON a.aula_id = b.aula_id AND a.periodo = b.periodo AND a.id < b.id WHERE {met}
  UNION ALL SELECT '{C.TEACHER}', CASE WHEN a.one AND b.one THEN '{C.CRITICAL}' ELSE '{C.MILD}' END, a.id, b.id, a.pid FROM xp a JOIN xp b ON a.pid = b.pid AND a.periodo = b.periodo AND a.id < b.id WHERE {met}
  UNION ALL SELECT '{C.COHORT}', '{C.CRITICAL}', a.id, b.id, a.asignatura_id FROM x a JOIN x b ON a.curso = b.curso AND a.periodo = b.periodo AND a.id < b.id WHERE {met}
    AND NOT coalesce(a.mencion_id <> b.mencion_id, false) AND (a.asignatura_id <> b.asignatura_id OR a.tipo_grupo = 'TEORIA' OR b.tipo_grupo = 'TEORIA' OR a.grupo_codigo = b.grupo_codigo))
SELECT tipo, severidad, s1 AS sesion_id, s2 AS sesion_2_id, sha256(concat(tipo, ':', CAST(s1 AS VARCHAR), '-', CAST(s2 AS VARCHAR), ':', CAST(res AS VARCHAR))) AS hash FROM u"""


ON_WEEK = "(a.dia_semana = b.dia_semana AND a.ini < b.fin AND b.ini < a.fin)"
MIXED = " OR ".join(f"({w}.dia_semana = isodow({d}.i) - 1 AND {w}.ini < date_diff('minute', date_trunc('day', {d}.i), least({d}.e, TIMESTAMP '1996-03-01 12:00:00')) AND date_diff('minute', date_trunc('day', {d}.i), greatest({d}.i, TIMESTAMP '1995-02-01 09:30:00')) < {w}.fin AND {d}.i < TIMESTAMP '1996-03-01 12:00:00' AND {d}.e > TIMESTAMP '1995-02-01 09:30:00')" for w, d in (("a", "b"), ("b", "a")))


@query("g2_dated_conflicts", dated_sql(f"({ON_WEEK} OR (a.i < b.e AND b.i < a.e))"), ("sesiones", "examenes"))
def g2_dated(t):
    """Weekly and dated sessions, each kind against its own."""
    return C.detect_conflicts(calendar(t)).select("tipo", "severidad", "sesion_id", "sesion_2_id", "hash")


@query("g2_f2_mixed_conflicts", dated_sql(f"({ON_WEEK} OR (least(a.e, b.e, TIMESTAMP '1996-03-01 12:00:00') > greatest(a.i, b.i, TIMESTAMP '1995-02-01 09:30:00') AND a.i IS NOT NULL AND b.i IS NOT NULL) OR {MIXED})"), ("sesiones", "examenes"))
def g2_mixed(t):
    """Dated sessions of a range of dates against all, weekly ones too."""
    dates = (datetime(1995, 2, 1, 9, 30), datetime(1996, 3, 1, 12))
    return C.detect_conflicts(calendar(t), mixed=True, dates=dates).select("tipo", "severidad", "sesion_id", "sesion_2_id", "hash")
