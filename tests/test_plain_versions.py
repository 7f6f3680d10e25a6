"""Queries that have no SQL, or whose SQL can't see all, against plain versions."""

import re

import pytest
from pyspark.sql import functions as F

from quadrille import plans
from quadrille.functions import text as T
from quadrille.operators import conflicts as C
from quadrille.operators import extraction as X
from quadrille.operators import maintenance as M
from quadrille.operators import matching as MM
from quadrille.plans import extraction as PX
from quadrille.plans import maintenance as PM
from quadrille.plans.detection import sessions
from quadrille.plans.matching import ALIASES, NAMES, ROOMS, own
from quadrille.plans.registry import Tables
from quadrille.sources.snapshots import Snapshots
from quadrille.streaming import jobs


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("small"))
    spark.range(1300).selectExpr("id AS event_id").write.parquet(f"{folder}/events.parquet")
    spark.range(180).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "concat('lace y 3 e sky', id) AS p_name").write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.fixture(scope="module")
def t(spark, small):
    return Tables(spark, small)


def test_clean_text(spark):
    texts = ["ver https://a.b/c?d=e y www.x.es fin", "tel 123456789 +34 600123 12345678", "5€ y 3$", "hola 😀🚀 ok ✂", "a.b@uni.com c.d@univ.org e@f.edu g@h.es\ni@j.net", "  x\n\n\n\ny  ", None, ""]

    def plain(s):
        s = re.sub(r"(https?://\S+|www\.\S+|\b\d{9,}\b|\+\d{1,3}\s\d{3,})", "", s or "")
        s = re.sub("[€$£¥₹¢]", "", s)
        s = re.sub("[\U0001f600-\U0001f64f\U0001f300-\U0001f5ff\U0001f680-\U0001f6ff\U0001f1e0-\U0001f1ff✂-➰Ⓜ-\U0001f251]+", "", s)
        s = re.sub(r"\b[a-zA-Z0-9._%+-]+@(?!.*(?:univ|\.es|\.edu))[a-zA-Z0-9.-]+\.[a-z]{2,}\b", "", s, flags=re.I)
        return re.sub(r"^\s+|\s+$", "", re.sub(r"\n{3,}", "\n\n", s))

    got = {r.i: r.v for r in spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", T.clean_text(F.col("s")).alias("v")).collect()}
    assert got == {i: plain(s) for i, s in enumerate(texts)}


def test_lane_numbers_are_the_first_that_are_free(spark, small, t):
    got = {r.id: (r.lane, r.lanes) for r in plans.queries()["w7_lane_index"](spark, small).collect()}
    rows, want = {}, {}
    for r in t.sesiones.collect():
        rows.setdefault((r.aula_id, r.dia_semana), []).append((r.ini, r.fin, r.id))
    for own_rows in rows.values():
        cluster, ends = [], []
        for ini, fin, i in [*sorted(own_rows), (10**6, 0, None)]:
            if ends and ini >= max(ends):
                want.update({j: (lane, len(ends)) for j, lane in cluster})
                cluster, ends = [], []
            lane = next((k for k, e in enumerate(ends) if e <= ini), len(ends))
            ends[lane : lane + 1] = [fin]
            cluster.append((i, lane))
    assert got == want and len({lanes for _, lanes in got.values()}) > 1


def test_infer_program(spark):
    programs = [(1, "Grado en Física", True), (2, "Grado en Matemáticas", True), (3, "GRADO EN FISICA", True), (4, "Grado en Química", False), (5, "Doble Grado", True)]
    texts = ["grado  en física", "Grado Matemáticas", "Grado en Quimica", "zz", None, "", "Grad en Fisca", "Doble"]
    got = {r.qid: (r.programa_id, r.score) for r in MM.infer_program(spark.createDataFrame(list(enumerate(texts)), "qid long, texto string"), spark.createDataFrame(programs, "id long, nombre string, activo boolean")).collect()}
    key = lambda s: re.sub(r"\s+", " ", s.upper().translate(str.maketrans("ÁÉÍÓÚÑ", "AEIOUN"))).strip()
    keys = {key(n): i for i, n, active in sorted(programs) if active}
    for q, s in enumerate(texts):
        k = key(s or "")
        score, best = min((-MM.token_set_ratio(k, c), c) for c in keys) if k else (0, "")
        want = (keys[k], 100.0) if k in keys else (keys[best], -score) if -score >= MM.PROGRAM else (None, None)
        assert got[q] == want, s


def plain_rooms(texts, rooms):
    """Level 4 of the rooms, over all keys."""
    found = {}
    for text in texts:
        score, best = min((-MM.token_sort_ratio(text, k), k) for k in rooms)
        if -score >= MM.ROOM:
            found[text] = rooms[best]
    return found


def test_rooms_by_likeness_and_by_name(spark, small, t):
    rooms = t.aulas.collect()
    index = {r.key: r.aula_id for r in MM.room_index(t.aulas).collect()}
    queries = own(t, ROOMS).withColumn("key", MM.room_key(F.col("texto"))).collect()
    exact = {r.qid: (r.aula_id, r.nivel) for r in MM.match_rooms(own(t, ROOMS), t.aulas, fuzzy=False).collect()}
    like = plain_rooms({q.key for q in queries if exact[q.qid][0] is None and len(q.texto.strip()) >= 2}, index)
    want = {q.qid: exact[q.qid] if exact[q.qid][0] is not None else (like[q.key], 4) if q.key in like else (None, None) for q in queries}
    assert {r.qid: (r.aula_id, r.nivel) for r in plans.queries()["j13_match_rooms_fuzzy"](spark, small).collect()} == want and any(n == 4 for _, n in want.values())
    names, codes = {}, {}
    for r in sorted(rooms, key=lambda r: -r.id):
        names[r.nombre.lower()], codes[r.codigo.lower()] = r.id, r.id
    got = {r.qid: (r.aula_id, r.error) for r in plans.queries()["j14_resolve_rooms"](spark, small).collect()}
    for q in queries:
        k = q.texto.strip().lower()
        room = names.get(k, codes.get(k, want[q.qid][0]))
        assert got[q.qid] == (room, None if room is not None else f"Aula no encontrada: {q.texto}")


def test_bound_by_letters_never_loses_the_best(spark):
    import random

    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("ABCDE") for _ in range(rnd.randint(1, 5)))
    texts = sorted({" ".join(word() for _ in range(rnd.randint(1, 4))) for _ in range(60)})
    keys = sorted({" ".join(word() for _ in range(rnd.randint(1, 4))) for _ in range(80)})
    frames = [spark.createDataFrame([(x,) for x in xs], f"{c} string") for c, xs in (("key", texts), ("candidate", keys))]
    for fn, cutoff in ((MM.token_set_ratio, 65), (MM.token_sort_ratio, 80)):
        got = {r.key: (-r.score, r.candidate) for r in MM.best_of_all(*frames, fn, cutoff, rows=20, block=30).collect()}
        want = {x: min((-fn(x, k), k) for k in keys) for x in texts}
        assert got == {x: w for x, w in want.items() if -w[0] >= cutoff}


def test_draft_is_matched_in_its_context(spark, small, t):
    documents, tables, subjects, links, programs = (df.collect() for df in PX.draft_inputs(t))
    rows = plans.queries()["x9_build_draft"](spark, small).collect()
    merged = X.merge_cells(X.parse_cells(X.cell_times(X.day_matrix(t.rejilla), ["doc", "page", "col"]))).collect()
    groups = lambda g: [p.strip() for p in re.split(r"\s*[,/&+]\s*|\s+(?:y|e)\s+", (g or "").strip(), flags=re.I) if p.strip()] or [None]
    assert len(rows) == sum(len(groups(m.grupo)) for m in merged) and rows
    bare = lambda x: x.upper().translate(str.maketrans("ÁÉÍÓÚ", "AEIOU"))
    plan = {d.doc: next((p.id for p in programs if bare(p.nombre) == bare(d.plan or d.titulo)), None) for d in documents}
    course = {r.doc: int("".join(c for c in r.curso if c.isdigit()) or 0) for r in tables}
    names = {s.id: bare(s.nombre) for s in subjects}
    days = {(r.doc, r.col): r.dia for r in X.day_columns(t.rejilla).collect()}
    states = set()
    for r in rows:
        assert r.dia == days[r.doc, r.col] and r.programa_id == plan[r.doc] and r.curso == course[r.doc] and r.ini <= r.fin
        mine = [x.asignatura_id for x in links if x.programa_id == plan[r.doc]]
        here = [x.asignatura_id for x in links if x.programa_id == plan[r.doc] and x.curso == course[r.doc]] or mine or list(names)
        k = bare(r.texto_original)
        equal = [i for i in names if names[i] == k]
        if equal:
            want = (min(equal, key=lambda i: (i not in mine, i not in here, i)), "EXACT")
        else:
            score, best = min((-MM.token_set_ratio(k, names[i]), names[i]) for i in here)
            same = [i for i in names if names[i] == best]
            want = (min(same, key=lambda i: (i not in mine, not (course[r.doc] and i in here), i)), "FUZZY_AUTO" if -score >= MM.AUTO else "FUZZY_LOW_CONFIDENCE") if -score >= MM.CUTOFF else (None, "NO_MATCH")
        states.add(want[1])
        assert (r.asignatura_id, r.estado) == want and r.asignatura_sugerida == next((s.nombre for s in subjects if s.id == want[0]), None)
        assert r.tipo == {"laboratorio": "PRÁCTICAS DE LABORATORIO", "practica": "PRÁCTICAS DE AULA"}.get(r.tipo_grupo, "TEORÍA")
    assert states >= {"EXACT", "FUZZY_AUTO", "FUZZY_LOW_CONFIDENCE"} and {r.tipo_grupo for r in rows} >= {"laboratorio", "teoria"}


def test_matching_is_refined_text_by_text(spark, small, t):
    got = {r.id: (r.asignatura_id, r.estado, r.score) for r in plans.queries()["m15_refine_matching"](spark, small).collect()}
    plan = own(t, NAMES).withColumn("prog_id", F.floor(F.col("qid") / 32)).select("qid", "texto", "prog_id", "curso")
    want = {r.qid: (r.asignatura_id, r.estado, r.score) for r in MM.match_subjects(plan, t.asignaturas, own(t, ALIASES), t.enlaces).collect()}
    assert got == want and {e for _, e, _ in got.values()} > {"EXACT", "NO_MATCH"}
    gone = spark.createDataFrame([(1, None, "2º", None, 5, "x"), (2, "nada", None, "zzzz", 5, "x")], "id long, plan string, curso string, asignatura string, asignatura_id long, asignatura_sugerida string")
    programs = spark.createDataFrame([(1, "Grado en Plan 1", True)], "id long, nombre string, activo boolean")
    assert {r.id: (r.asignatura_id, r.estado) for r in MM.refine_matching(gone, t.asignaturas, None, t.enlaces, programs).collect()} == {1: (None, None), 2: (None, "NO_MATCH")}


def test_confirmed_draft_has_the_conflicts_of_its_sessions(spark, small, t):
    out, errors = PM.confirmed(t)
    assert errors.isEmpty()
    groups = out["grupos"].select(F.col("id").alias("grupo_docente_id"), "asignatura_id", F.col("codigo").alias("grupo_codigo"), F.col("tipo").alias("tipo_grupo"), "curso")
    mention = {r.asignatura_id: r.mencion_id for r in C.first_context(out["enlaces"]).collect()}
    full = out["sesiones"].join(groups, "grupo_docente_id").join(t.asignaturas.select(F.col("id").alias("asignatura_id"), "periodo"), "asignatura_id").collect()
    pairs = {(min(a.id, b.id), max(a.id, b.id)) for a in full for b in full if a.id < b.id and a.aula_id == b.aula_id and a.periodo == b.periodo and a.dia_semana == b.dia_semana and a.ini < b.fin and b.ini < a.fin}
    before = {r.id for r in t.sesiones.collect()}
    fresh = {r.id for r in full} - before
    got = {(r.sesion_id, r.sesion_2_id) for r in out["conflictos"].where(f"tipo = '{C.ROOM}'").collect()}
    assert fresh and {p for p in got if set(p) & fresh} == {p for p in pairs if set(p) & fresh}
    own = {}
    for r in out["profesores_sesiones"].collect():
        own.setdefault(r.sesion_id, set()).add(r.profesor_id)
    taught = {}
    for r in t.profesores_asignaturas.collect():
        taught.setdefault(r.asignatura_id, set()).add(r.profesor_id)
    who = {r.id: own.get(r.id) or taught.get(r.asignatura_id, set()) for r in full}
    assert not set(own) & fresh and set(own) <= {r.id for r in full} and own
    teachers = {(a.id, b.id, p) for a in full for b in full if a.id < b.id and {a.id, b.id} & fresh and a.periodo == b.periodo and a.dia_semana == b.dia_semana and a.ini < b.fin and b.ini < a.fin for p in who[a.id] & who[b.id]}
    assert {(r.sesion_id, r.sesion_2_id, r.profesor_id) for r in out["conflictos"].where(f"tipo = '{C.TEACHER}'").collect() if {r.sesion_id, r.sesion_2_id} & fresh} == teachers and teachers
    cohort = {(r.sesion_id, r.sesion_2_id) for r in out["conflictos"].where(f"tipo = '{C.COHORT}'").collect()}
    of = {r.id: r for r in full}
    for p in cohort:
        if set(p) & fresh:
            ms = [mention.get(of[i].asignatura_id) for i in p]
            assert None in ms or ms[0] == ms[1]
    # an unknown plan, subject or room leaves all as it was
    state = PM.tables(t) | {"programas": spark.createDataFrame([(1, "Plan A")], "id long, nombre string"), "menciones": spark.createDataFrame([], "id long, programa_id long, nombre string, activo boolean"), "aulas": t.aulas, "aliases": spark.createDataFrame([], "asignatura_id long, alias string"), "conflictos": out["conflictos"]}
    bad = spark.createDataFrame([("Plan B", None, "nada", None, None, "G1", "TEORIA", 1, "sótano", 0, 540, 600, 1)], "plan string, mencion string, asignatura string, texto string, elegida long, grupo string, tipo string, curso long, aula string, dia_semana int, ini int, fin int, orden long")
    same, errors = M.confirm_schedule(state, bad)
    assert same is state and {r.error for r in errors.collect()} == {"Plan no encontrado: Plan B", "Asignatura no encontrada: nada", "Aula no encontrada: sótano"}


def test_stream_of_changes_ends_where_detection_would(spark, t, tmp_path):
    base = str(tmp_path)
    s = PM.flat(t)
    state = Snapshots(spark, f"{base}/estado", jobs.SCHEDULE)
    state.commit({"sesiones": s, "conflictos": C.detect_conflicts(s, t.restricciones).withColumn("estado", F.lit(M.OPEN))})
    feed = PM.changes(t, s)
    feed.repartition(2, "id").write.parquet(f"{base}/cambios")
    for _ in range(2):  # a second run has nothing new to do
        jobs.stream_session_changes(jobs.feed(spark, f"{base}/cambios", feed.schema), state, f"{base}/check", restrictions=t.restricciones).awaitTermination()
    after = state.read("sesiones")
    assert after.count() == s.count() - s.where("id % 10 = 2").count() + s.where("id % 10 = 0").count()
    want = {r.hash for r in C.detect_conflicts(after, t.restricciones).collect()}
    assert {r.hash for r in state.read("conflictos").collect()} == want and want != {r.hash for r in C.detect_conflicts(sessions(t), t.restricciones).collect()}
