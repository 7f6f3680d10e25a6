"""Queries that run the streaming jobs over feeds made from the tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quadrille.functions import text as T
from quadrille.operators import conflicts as C
from quadrille.operators import maintenance as M
from quadrille.plans.detection import J1, J2, J3, J4, TEACHERS, sessions
from quadrille.plans.maintenance import changes, flat
from quadrille.plans.extraction import VALID
from quadrille.plans.registry import query
from quadrille.sources.snapshots import Snapshots
from quadrille.sources.storage import scratch
from quadrille.sources.tables import read_sheet, read_stage, read_stages, write_stage
from quadrille.streaming import jobs


FEED = "SELECT id, aula_id, [profesor_id, profesor_2_id] AS p, asignatura_id, curso, periodo, tipo_grupo, grupo_codigo, mencion_id, dia_semana, CASE WHEN id % 10 = 1 THEN ini + 30 ELSE ini END AS ini, CASE WHEN id % 10 = 1 THEN fin + 30 ELSE fin END AS fin FROM sesiones WHERE id % 10 <> 2"
MADE = "SELECT (SELECT max(id) FROM sesiones) + row_number() OVER (ORDER BY id), aula_id, [profesor_id, profesor_2_id], asignatura_id, curso, periodo, tipo_grupo, grupo_codigo, mencion_id, dia_semana, ini + 30, fin + 30 FROM sesiones WHERE id % 10 = 0"


#: Detection over the edited sessions.
EDITED = re.sub(r"\bsesiones\b", "ed", f"{TEACHERS}, j1 AS ({J1}), j2 AS ({J2}), j3 AS ({J3}), j4 AS ({J4})")
AFTER = """WITH ed AS (SELECT * EXCLUDE (p), p[1] AS profesor_id, p[2] AS profesor_2_id FROM (FEED UNION ALL MADE)), """ + f"""{EDITED},
u AS (SELECT '{C.ROOM}' AS tipo, s1 AS sesion_id, s2 AS sesion_2_id, aula_id AS res FROM j1 UNION ALL SELECT '{C.TEACHER}', s1, s2, profesor_id FROM j2
  UNION ALL SELECT '{C.COHORT}', s1, s2, asignatura_id FROM j3 UNION ALL SELECT '{C.RESTRICTION}', s1, NULL, restriccion_id FROM j4)
SELECT DISTINCT tipo, sesion_id, sesion_2_id, sha256(concat(tipo, ':', CAST(sesion_id AS VARCHAR), CASE WHEN tipo = '{C.RESTRICTION}' THEN '' ELSE concat('-', CAST(sesion_2_id AS VARCHAR)) END, ':', CAST(res AS VARCHAR))) AS hash, 'por_revisar' AS estado FROM u"""


@query("t1_stream_session_changes", AFTER.replace("FEED", FEED).replace("MADE", MADE), ("sesiones", "restricciones"))
def t1(t):
    """The conflicts after all batches of a feed: those of the edited sessions, whichever batch an edit came in. All creates are in one batch, as their ids depend on that."""
    base, s = scratch(t.spark, "streams"), flat(t)
    state = Snapshots(t.spark, f"{base}/estado", jobs.SCHEDULE)
    state.commit({"sesiones": s, "conflictos": C.detect_conflicts(s, t.restricciones).withColumn("estado", F.lit(M.OPEN))})
    feed = changes(t, s)
    feed.where("op = 'create'").coalesce(1).write.parquet(f"{base}/cambios")
    feed.where("op <> 'create'").repartition(1, "id").write.mode("append").parquet(f"{base}/cambios")
    jobs.stream_session_changes(jobs.feed(t.spark, f"{base}/cambios", feed.schema), state, f"{base}/check", restrictions=t.restricciones).awaitTermination()
    return state.read("conflictos").select("tipo", "sesion_id", "sesion_2_id", "hash", "estado")


@query("j24_simulated_conflicts", AFTER.replace("FEED", FEED).replace("MADE", MADE.replace("(SELECT max(id) FROM sesiones) + row_number() OVER (ORDER BY id)", "-(id + 1)")).replace(", 'por_revisar' AS estado", ""), ("sesiones", "restricciones"))
def j24(t):
    """All rules over edits that aren't stored: what is made has negative ids."""
    s = flat(t)
    return C.detect_conflicts(M.simulate_changes(s, changes(t, s)), t.restricciones).select("tipo", "sesion_id", "sesion_2_id", "hash")


@query("t2_stream_sheet_intake", r"SELECT concat('G', CAST(k AS VARCHAR)) AS codigo_plan FROM (SELECT DISTINCT p_partkey % 9000 + 100 AS k FROM part)")
def t2(t):
    return intake(t, t.fichas).read("asignaturas").select("codigo_plan")


def intake(t, sheets):
    """The catalogue after all batches of a feed of sheets, from nothing."""
    base, spark = scratch(t.spark, "streams"), t.spark
    schemas = {
        "asignaturas": "id long, codigo_plan string, nombre string, periodo string, ects int, modalidad string, idioma string, english_friendly boolean", "programas": "id long, nombre string, tipo string, activo boolean", "profesores": "id long, nombre string, apellidos string, activo boolean",
        "enlaces": "id long, programa_id long, asignatura_id long, curso int, tipo_asignatura string", "profesores_asignaturas": "profesor_id long, asignatura_id long", "rechazos": "doc_id long, errores array<string>", "ejecuciones": "feed string, lote long, validas long, con_avisos long, rechazadas long",
    }
    state = Snapshots(spark, f"{base}/estado", jobs.CATALOGUE)
    state.commit({k: spark.createDataFrame([], schema) for k, schema in schemas.items()})
    sheets.repartition(2, "doc_id").write.parquet(f"{base}/entrada")
    jobs.stream_sheet_intake(jobs.feed(spark, f"{base}/entrada", "doc_id long, text string"), state, f"{base}/check").awaitTermination()
    return state


@query("g7_m16_counted_runs", f"""SELECT count(*) FILTER ({VALID}) AS validas, count(*) FILTER ({VALID} AND (doc_id % 7 = 1 OR doc_id % 4 = 2)) AS con_avisos, count(*) FILTER (NOT ({VALID})) AS rechazadas, (SELECT count(*) FROM fichas_varias WHERE NOT ({VALID})) AS guardadas FROM fichas_varias""", ("fichas_varias",))
def g7_m16(t):
    """What the runs of an intake say of themselves, counted while they wrote, beside the rejects that they left."""
    state = intake(t, t.fichas_varias)
    runs = state.read("ejecuciones").agg(*[F.sum(c).alias(c) for c in ("validas", "con_avisos", "rechazadas")])
    return runs.withColumn("guardadas", F.lit(state.read("rechazos").count()))


PAPER = "SELECT id, CASE id % 8 WHEN 3 THEN '' WHEN 5 THEN ' nan ' WHEN 7 THEN NULL ELSE concat(nombre, ' ', apellidos) END AS PROFESOR, CASE id % 6 WHEN 5 THEN NULL ELSE 'L, X' END AS dias, CASE WHEN id % 24 IN (5, 11, 23) THEN ' ' WHEN id % 7 = 0 THEN '' ELSE '09:00-11:00' END AS franja FROM profesores"
BLANK = "(id % 8 IN (3, 5, 7)) AS p, id % 6 = 5 AS d, (id % 24 IN (5, 11, 23) OR id % 7 = 0) AS f"


@query("src2_read_sheet", f"WITH n AS (SELECT *, row_number() OVER (ORDER BY id) + 1 AS fila, {BLANK} FROM profesores) SELECT fila, CASE WHEN p THEN '' ELSE concat(nombre, ' ', apellidos) END AS profesor, CASE WHEN d THEN '' ELSE 'L, X' END AS dias, CASE WHEN f THEN '' ELSE '09:00-11:00' END AS franja, p OR d OR f AS avisada FROM n WHERE NOT (p AND d AND f)", ("profesores",))
def src2(t):
    """A sheet written as one CSV file and read back with its rows' numbers; rows that are blank in part are warned of."""
    base = scratch(t.spark, "hoja")
    sheet = t.spark.sql(PAPER.replace("FROM profesores", "FROM {profesores}"), profesores=t.profesores)
    sheet.coalesce(1).sortWithinPartitions("id").drop("id").withColumnRenamed("dias", "Días").write.option("header", True).csv(base)
    rows, _ = M.read_restrictions(read_sheet(t.spark, base))
    warned = M.restriction_warnings(rows).select("fila", F.lit(True).alias("avisada"))
    return rows.join(warned, "fila", "left").na.fill(False, ["avisada"])


@query("src5_write_stage", "SELECT id, profesor_id, aula_id FROM sesiones", ("sesiones",))
def src5(t):
    base = scratch(t.spark, "streams")
    out = sessions(t).select("id", "profesor_id", "aula_id")
    write_stage(out, base, "parsing")
    return read_stage(t.spark, base, "parsing", out.schema)


@query("src5_nested_stages", """SELECT 'parsing' AS stage, plan_id, id, aula_id, hora, profesores FROM (SELECT *, concat(lpad(CAST(ini // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(ini % 60 AS VARCHAR), 2, '0')) AS hora, CAST(1 + CAST(profesor_2_id IS NOT NULL AS INT) AS INT) AS profesores FROM sesiones)""", ("sesiones",))
def src5_nested(t):
    """A plan is one nested document: its sessions, each with a slot and teachers. Two stages are written, and one is read by its folder."""
    base = scratch(t.spark, "etapas")
    slot = F.struct("dia_semana", T.to_hhmm(F.col("ini")).alias("hora")).alias("franja")
    plan = t.sesiones.groupBy("plan_id").agg(F.collect_list(F.struct("id", "aula_id", slot, F.array_compact(F.array("profesor_id", "profesor_2_id")).alias("profesores"))).alias("sesiones"))
    write_stage(plan, base, "parsing")
    write_stage(plan.limit(0), base, "normalizacion")
    back = read_stages(t.spark, base, f"plan_id long, sesiones {dict(plan.dtypes)['sesiones']}, stage string").where("stage = 'parsing'")
    return back.select("stage", "plan_id", F.explode("sesiones").alias("s")).select("stage", "plan_id", "s.id", "s.aula_id", F.col("s.franja.hora").alias("hora"), F.size("s.profesores").alias("profesores"))
