"""Weekly and dated sessions together, against a plain version minute by minute."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quadrille.operators import conflicts as C
from quadrille.operators.intervals import overlaps_dated, session_pairs

SCHEMA = "id long, k int, dia_semana int, ini int, fin int, inicio timestamp, fin_ts timestamp"
MONDAY = datetime(2023, 10, 2)


def weekly(i, day, ini, fin, k=1):
    return (i, k, day, ini, fin, None, None)


def dated(i, start, end, k=1):
    return (i, k, None, None, None, datetime.fromisoformat(start), datetime.fromisoformat(end))


def met(rows, spark, **options):
    return sorted((r.a, r.b) for r in session_pairs(spark.createDataFrame(rows, SCHEMA), ["k"], 60, **options).select("a.id", "b.id").toDF("a", "b").collect())


def plain(x, y, mixed=False, dates=None):
    """Whether two sessions share a moment; dates cut everything."""
    low, high = dates or (datetime(1900, 1, 1), datetime(2200, 1, 1))
    cut = lambda s: (max(s[5], low), min(s[6], high)) if s[5] is not None else None
    if x[2] is not None and y[2] is not None:
        if x[2] != y[2] or max(x[3], y[3]) >= min(x[4], y[4]):
            return False
        spans = [(low + timedelta(days=d)).replace(hour=0, minute=0, second=0) for d in range(-1, min((high - low).days + 2, 9))]
        return dates is None or any(s.weekday() == x[2] and s + timedelta(minutes=max(x[3], y[3])) < high and low < s + timedelta(minutes=min(x[4], y[4])) for s in spans)
    a, b = cut(x), cut(y)
    if a and b and max(a[0], b[0]) < min(a[1], b[1]):
        return True
    if not mixed or (x[2] is None) == (y[2] is None):
        return False
    w, (start, end) = (x, b) if x[2] is not None else (y, a)
    day = start.replace(hour=0, minute=0, second=0, microsecond=0)
    while day < end:
        if day.weekday() == w[2] and max(day + timedelta(minutes=w[3]), start) < min(day + timedelta(minutes=w[4]), end):
            return True
        day += timedelta(days=1)
    return False


def test_kinds_do_not_meet_unless_asked(spark):
    """A class every Monday from 10 to 12, and exams: on a Monday, on a Tuesday, in the afternoon."""
    rows = [weekly(1, 0, 600, 720), dated(2, "2023-10-02T10:30:00", "2023-10-02T12:30:00"), dated(3, "2023-10-03T10:30:00", "2023-10-03T12:30:00"), dated(4, "2023-10-02T15:00:00", "2023-10-02T17:00:00"), dated(5, "2023-10-02T12:00:00", "2023-10-02T13:00:00")]
    assert met(rows, spark) == [(2, 5)]
    assert met(rows, spark, mixed=True) == [(1, 2), (2, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = df.alias("a").join(df.alias("b"), F.col("a.id") < F.col("b.id")).where(overlaps_dated("a", "b", mixed=True)).select("a.id", F.col("b.id").alias("id2"))
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (2, 5)]


@pytest.mark.parametrize("seed, days", [(1, None), (2, 3), (3, 40), (4, 8)])
def test_pairs_equal_a_nested_loop(spark, seed, days):
    rnd = random.Random(seed)
    rows = []
    for i in range(90):
        start = MONDAY + timedelta(minutes=rnd.randint(0, 60 * 24 * 40))
        end = start + timedelta(minutes=rnd.choice([0, 45, 90, 60 * 30, 60 * 24 * 6, 60 * 24 * 8 + 50, 60 * 24 * 30]))
        day, ini = rnd.randint(0, 6), rnd.randint(0, 1380)
        fin = min(1440, ini + rnd.choice([0, 30, 60, 120]))
        kind = rnd.randint(0, 2)
        rows.append((i, rnd.randint(0, 3), *((day, ini, fin) if kind != 1 else (None,) * 3), *((start, end) if kind else (None, None))))
    dates = days and (MONDAY + timedelta(days=5, minutes=630), MONDAY + timedelta(days=5 + days, minutes=77))
    for mixed in (False, True):
        want = sorted((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and plain(x, y, mixed, dates))
        assert met(rows, spark, mixed=mixed, dates=dates) == want


def test_all_three_rules_find_dated_pairs(spark):
    one = dict(aula_id=5, profesor_ids=[1], asignatura_id=9, curso=1, periodo="p1", tipo_grupo="TEORIA", grupo_codigo="A", mencion_ids=[], dia_semana=None, ini=None, fin=None)
    rows = [tuple([i, *one.values(), datetime(2024, 1, 8, 9 + i), datetime(2024, 1, 8, 11 + i)]) for i in (1, 2)]
    schema = "id long, aula_id long, profesor_ids array<long>, asignatura_id long, curso int, periodo string, tipo_grupo string, grupo_codigo string, mencion_ids array<long>, dia_semana int, ini int, fin int, inicio timestamp, fin_ts timestamp"
    s = spark.createDataFrame(rows, schema)
    assert sorted(r.tipo for r in C.detect_conflicts(s).collect()) == sorted([C.ROOM, C.TEACHER, C.COHORT])
    assert C.detect_for(s, s.where("id = 2").select("id")).count() == 3
    assert C.detect_conflicts(s, dates=(datetime(2024, 1, 8, 12), datetime(2024, 1, 9))).count() == 0
    assert C.detect_conflicts(s, dates=(datetime(2024, 1, 8, 11, 59), datetime(2024, 1, 9))).count() == 3


def test_restrictions_within_dates(spark):
    r = spark.createDataFrame([(7, 100, 0, 540, 660)], "id long, profesor_id long, dia_semana int, ini int, fin int")
    s = spark.createDataFrame([(1, 0, 600, 720, [100])], "id long, dia_semana int, ini int, fin int, profesor_ids array<long>")
    assert C.restriction_violations(s, r, dates=(MONDAY, MONDAY + timedelta(days=1))).count() == 1
    assert C.restriction_violations(s, r, dates=(MONDAY + timedelta(minutes=660), MONDAY + timedelta(days=5))).count() == 0
    assert C.restriction_violations(s, r, dates=(MONDAY + timedelta(minutes=660), MONDAY + timedelta(days=8))).count() == 1


def test_descriptions_name_teachers_in_full_and_the_context(spark):
    links = spark.createDataFrame([(1, 9, 3, 4, 1)], "id long, asignatura_id long, programa_id long, mencion_id long, curso int")
    context = C.subject_context(links, spark.createDataFrame([(3, "Grado en Física")], "id long, nombre string"), spark.createDataFrame([(4, "Óptica")], "id long, nombre string"))
    row = lambda i, subject: (i, None, [1], subject, 2, "primer_cuatrimestre", "TEORIA", "A", [], 0, 540, 600)
    s = spark.createDataFrame([row(1, 9), row(2, 10)], "id long, aula_id long, profesor_ids array<long>, asignatura_id long, curso int, periodo string, tipo_grupo string, grupo_codigo string, mencion_ids array<long>, dia_semana int, ini int, fin int")
    who = spark.createDataFrame([(1, "Ana", "García Gil")], "id long, nombre string, apellidos string")
    got = {r.tipo: r.descripcion for r in C.detect_conflicts(s, teacher_names=who, context=context).collect()}
    assert got == {C.TEACHER: "Ana García Gil tiene dos clases a la vez (único docente).", C.COHORT: "Solape en Grado en Física: Curso 2º, Primer Cuatrimestre (Óptica)"}
