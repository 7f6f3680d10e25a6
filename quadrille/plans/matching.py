"""Queries of the entity matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.operators import matching as M
from quadrille.plans.registry import query

KEY = "replace(translate(trim(regexp_replace(upper({0}), '\\s+', ' ', 'g')), 'ÁÉÍÓÚÜÑ.,', 'AEIOUUN'), '-', ' ')"
ALIASES = "SELECT id AS asignatura_id, concat('Alias ', CAST(id // 2 AS VARCHAR)) AS alias, id % 4 AS veces_usado FROM asignaturas WHERE id % 5 < 2"
NAMES = "SELECT id AS qid, CASE id % 6 WHEN 0 THEN upper(nombre) WHEN 1 THEN replace(nombre, 'á', 'a') WHEN 2 THEN concat('alias  ', CAST(id // 2 AS VARCHAR)) WHEN 3 THEN concat(nombre, ' grupo') WHEN 4 THEN replace(nombre, 'Materia', 'Mteria') ELSE 'zz' END AS texto, CASE WHEN id % 4 > 0 THEN id // 32 END AS prog_id, CAST(CASE WHEN id % 3 > 0 THEN id % 4 + 1 ELSE 0 END AS INT) AS curso FROM asignaturas"
ROOMS = "SELECT id AS qid, CASE id % 5 WHEN 0 THEN lower(nombre) WHEN 1 THEN replace(nombre, ' ', '') WHEN 2 THEN substr(codigo, 4) WHEN 3 THEN concat('Aulla ', CAST(id AS VARCHAR)) ELSE 'sótano' END AS texto FROM aulas"


def own(t, sql: str, **frames):
    for name in ("asignaturas", "aulas", "profesores", "sesiones", "enlaces", "fechadas", "fichas_varias"):
        sql = sql.replace(f"FROM {name}", "FROM {" + name + "}")
        if "{" + name + "}" in sql:
            frames[name] = getattr(t, name)
    return t.spark.sql(sql.replace("VARCHAR", "STRING").replace("//", "div"), **frames)


INDEX = f"al AS ({ALIASES}), qs AS ({NAMES}), a0 AS (SELECT id, nombre AS t FROM asignaturas WHERE activo UNION ALL SELECT al.asignatura_id, al.alias FROM al JOIN asignaturas x ON x.id = al.asignatura_id AND x.activo), ix AS (SELECT DISTINCT {KEY.format('t')} AS key, id AS asignatura_id FROM a0)"
RANKED = """ex AS (SELECT qs.qid, ix.asignatura_id FROM qs JOIN ix ON ix.key = {k} AND length(ix.key) >= 2
  QUALIFY row_number() OVER (PARTITION BY qs.qid ORDER BY (EXISTS (SELECT 1 FROM enlaces e WHERE e.asignatura_id = ix.asignatura_id AND e.programa_id = qs.prog_id)) DESC,
    (qs.curso > 0 AND EXISTS (SELECT 1 FROM enlaces e WHERE e.asignatura_id = ix.asignatura_id AND e.programa_id = qs.prog_id AND e.curso = qs.curso)) DESC, ix.asignatura_id) = 1)""".format(k=KEY.format("qs.texto"))


@query("j8_j11_exact_subject", f"WITH {INDEX}, {RANKED} SELECT * FROM ex", ("asignaturas", "enlaces"))
def j8(t):
    return M.exact_subject(own(t, NAMES), M.subject_index(t.asignaturas, own(t, ALIASES)), t.enlaces)


@query(
    "j9_candidate_universe",
    f"""WITH {INDEX}, k AS (SELECT DISTINCT ix.key, e.programa_id, e.curso FROM ix JOIN enlaces e ON e.asignatura_id = ix.asignatura_id),
    c AS (SELECT qs.qid, k.key FROM qs JOIN k ON k.programa_id = qs.prog_id AND k.curso = qs.curso WHERE qs.curso > 0),
    p AS (SELECT DISTINCT qs.qid, k.key FROM qs JOIN k ON k.programa_id = qs.prog_id WHERE qs.qid NOT IN (SELECT qid FROM c)),
    n AS (SELECT count(DISTINCT key) AS n FROM ix)
    SELECT qs.qid, CAST(CASE WHEN qs.qid IN (SELECT qid FROM c) THEN (SELECT count(*) FROM c WHERE c.qid = qs.qid) WHEN qs.qid IN (SELECT qid FROM p) THEN (SELECT count(*) FROM p WHERE p.qid = qs.qid) ELSE n.n END AS BIGINT) AS n FROM qs, n""",
    ("asignaturas", "enlaces"),
)
def j9(t):
    """How many keys each query may be like; of those that may be like any, all keys' number."""
    index = M.subject_index(t.asignaturas, own(t, ALIASES))
    near, rest = M.candidate_universe(own(t, NAMES), index, t.enlaces)
    keys = index.select("key").distinct().count()
    return near.groupBy("qid").agg(F.count("*").alias("n")).unionByName(rest.select("qid", F.lit(keys).cast("long").alias("n")))


@query("j10_w3_match_subjects")
def j10(t):
    """The score has no SQL form; tests hold it against a plain version."""
    return M.match_subjects(own(t, NAMES), t.asignaturas, own(t, ALIASES), t.enlaces)


@query("j12_infer_program")
def j12(t):
    programs = own(t, "SELECT DISTINCT id // 32 AS id, concat('Grado en Plan ', CAST(id // 32 AS VARCHAR)) AS nombre, true AS activo FROM asignaturas")
    queries = own(t, "SELECT DISTINCT id // 32 AS qid, CASE WHEN (id // 32) % 2 = 0 THEN concat('Plan ', CAST(id // 32 AS VARCHAR)) ELSE concat('GRADO EN  Plan ', CAST(id // 32 AS VARCHAR)) END AS texto FROM asignaturas")
    return M.infer_program(queries, programs)


RKEY = "trim(regexp_replace(regexp_replace(translate(trim(upper({0})), 'ÁÉÍÓÚ', 'AEIOU'), '([A-Z])(\\d)', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))"
RIX = f"qs AS ({ROOMS}), ac AS (SELECT * FROM aulas WHERE activo), ix AS (SELECT {RKEY.format('x')} AS key, max(id) AS aula_id FROM (SELECT id, unnest([nombre, replace(nombre, ' ', ''), codigo, replace(codigo, ' ', '')]) AS x FROM ac) GROUP BY 1)"


@query(
    "j13_match_rooms_u2_key_variants",
    f"""WITH {RIX}, al AS (SELECT qid, texto, {RKEY.format('texto')} AS key, upper(regexp_replace(texto, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS code FROM qs),
    m AS (SELECT qid, texto, (SELECT aula_id FROM ix WHERE ix.key = al.key) AS l1, (SELECT aula_id FROM ix WHERE ix.key = replace(al.key, ' ', '')) AS l2,
      (SELECT min(id) FROM ac WHERE suffix(upper(regexp_replace(codigo, '[^\\p{{L}}\\p{{N}}]', '', 'g')), al.code)) AS l3 FROM al)
    SELECT qid, texto, coalesce(l1, l2, l3) AS aula_id, CAST(CASE WHEN l1 IS NOT NULL THEN 1 WHEN l2 IS NOT NULL THEN 2 WHEN l3 IS NOT NULL THEN 3 END AS INT) AS nivel FROM m""",
    ("aulas",),
)
def j13(t):
    return M.match_rooms(own(t, ROOMS), t.aulas, fuzzy=False)


@query("j13_match_rooms_fuzzy")
def j13f(t):
    return M.match_rooms(own(t, ROOMS), t.aulas)


@query("j14_resolve_rooms")
def j14(t):
    return M.resolve_rooms(own(t, ROOMS), t.aulas)


@query(
    "j15_resolve_subjects",
    f"""WITH al AS ({ALIASES}), qs AS ({NAMES}), n AS (SELECT qid, texto, prog_id, curso, coalesce((SELECT min(id) FROM asignaturas WHERE lower(nombre) = lower(trim(texto))), (SELECT min(asignatura_id) FROM al WHERE lower(alias) = lower(trim(texto)))) AS asignatura_id FROM qs)
    SELECT *, CASE WHEN asignatura_id IS NULL THEN concat('Asignatura no encontrada: ', texto) END AS error FROM n""",
    ("asignaturas",),
)
def j15(t):
    return M.resolve_subjects(own(t, NAMES), t.asignaturas, own(t, ALIASES))


WHO = "SELECT id AS fila, CASE WHEN id % 3 = 0 THEN upper(concat('  ', nombre, '  ', apellidos)) WHEN id % 3 = 1 THEN concat(nombre, ' ', apellidos) ELSE 'Fantasma' END AS profesor FROM profesores"


@query("j16_match_teachers", f"WITH r AS ({WHO}), k AS (SELECT lower(concat(nombre, ' ', apellidos)) AS k, min(id) AS profesor_id FROM profesores WHERE activo GROUP BY 1) SELECT r.fila, k.profesor_id FROM r LEFT JOIN k ON k.k = lower(trim(regexp_replace(profesor, '\\s+', ' ', 'g')))", ("profesores",))
def j16(t):
    found, lost = M.match_teachers(own(t, WHO), t.profesores)
    return found.select("fila", "profesor_id").unionByName(lost.select("fila", F.lit(None).cast("long").alias("profesor_id")))


@query("j17_missing_refs", "SELECT DISTINCT aula_id FROM sesiones WHERE aula_id NOT IN (SELECT id FROM aulas WHERE activo)", ("sesiones", "aulas"))
def j17(t):
    return M.missing_refs(t.sesiones, t.aulas.where("activo"), "aula_id")


@query("m5_learn_aliases", f"WITH al AS ({ALIASES}), qs AS ({NAMES}) SELECT alias, asignatura_id FROM (SELECT trim(q.texto) AS alias, max_by(a.id, a.id) AS asignatura_id FROM qs q JOIN asignaturas a ON a.id = q.qid WHERE lower(trim(q.texto)) <> lower(a.nombre) GROUP BY 1) WHERE lower(alias) NOT IN (SELECT lower(alias) FROM al)", ("asignaturas",))
def m5(t):
    draft = own(t, NAMES).join(t.asignaturas.select(F.col("id").alias("qid"), F.col("nombre").alias("nombre_oficial")), "qid").withColumns({"asignatura_id": F.col("qid"), "orden": F.col("qid")})
    return M.learn_aliases(draft, own(t, ALIASES))


@query(
    "m6_register_alias_usage",
    f"""WITH al AS (SELECT alias, min(asignatura_id) AS asignatura_id, CAST(sum(veces_usado) AS BIGINT) AS veces_usado FROM ({ALIASES}) GROUP BY alias), u AS (SELECT trim(regexp_replace(texto, '\\s+', ' ', 'g')) AS a, qid FROM ({NAMES})),
    g AS (SELECT lower(a) AS k, count(*) AS n, min(a) AS a, min(qid) AS s FROM u GROUP BY 1)
    SELECT coalesce(al.alias, g.a) AS alias, coalesce(al.asignatura_id, g.s) AS asignatura_id, CAST(coalesce(al.veces_usado, 0) + coalesce(g.n, 0) AS BIGINT) AS veces_usado FROM al FULL JOIN g ON lower(al.alias) = g.k""",
    ("asignaturas",),
)
def m6(t):
    known = own(t, ALIASES).groupBy("alias").agg(F.min("asignatura_id").alias("asignatura_id"), F.sum("veces_usado").alias("veces_usado"))
    return M.register_alias_usage(known, own(t, NAMES).select(F.col("texto").alias("alias"), F.col("qid").alias("asignatura_id")))
