"""Golden cases and properties of the detector."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.operators import conflicts as C
from quadrille.operators.intervals import interval_pairs

SCHEMA = "id long, aula_id long, profesor_ids array<long>, asignatura_id long, curso int, periodo string, tipo_grupo string, grupo_codigo string, mencion_ids array<long>, dia_semana int, ini int, fin int"


def session(i, teachers=(1,), room=None, subject=100, course=1, kind="TEORIA", code="UNICO", mentions=(), day=0, ini=540, fin=660):
    return (i, room, list(teachers), subject, course, "p1", kind, code, list(mentions), day, ini, fin)


CASES = {
    "room": ([session(1, [1], 101), session(2, [2], 101, ini=600, fin=720, course=2)], [(C.ROOM, C.CRITICAL)]),
    "teacher": ([session(1, [99], course=1), session(2, [99], subject=200, course=2)], [(C.TEACHER, C.CRITICAL)]),
    "co-teaching": ([session(1, [99, 100], course=1), session(2, [99], course=2)], [(C.TEACHER, C.MILD)]),
    "same subgroup": ([session(1, [1], subject=50, kind="PRACTICA", code="A"), session(2, [2], subject=50, kind="PRACTICA", code="A", ini=600, fin=720)], [(C.COHORT, C.CRITICAL)]),
    "split groups": ([session(1, [1], subject=50, kind="PRACTICA", code="A"), session(2, [2], subject=50, kind="PRACTICA", code="B")], []),
    "plan": ([session(1, [1]), session(2, [2], subject=200, ini=600, fin=720)], [(C.COHORT, C.CRITICAL)]),
    "disjoint mentions": ([session(1, [1], course=4, mentions=[1]), session(2, [2], subject=200, course=4, mentions=[2])], []),
    "touching": ([session(1, [1], 1, ini=540, fin=600), session(2, [2], 1, ini=600, fin=660, course=2)], []),
    "other day": ([session(1, [1], 1), session(2, [1], 1, day=1)], []),
}


@pytest.mark.parametrize("name", CASES)
def test_golden(spark, name):
    rows, want = CASES[name]
    got = C.detect_conflicts(spark.createDataFrame(rows, SCHEMA)).select("tipo", "severidad").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_hash_is_the_same_in_either_order(spark):
    one = C.detect_conflicts(spark.createDataFrame([session(1, [1], 99), session(2, [2], 99, course=2)], SCHEMA)).first()["hash"]
    kind, s1, s2, room = F.lit(C.ROOM), F.lit(2), F.lit(1), F.lit(99)
    assert spark.range(1).select(C.conflict_hash(kind, s1, s2, room, F.lit("")).alias("h")).first()["h"] == one


def test_restrictions(spark):
    r = spark.createDataFrame([(7, 100, 0, 540, 660)], "id long, profesor_id long, dia_semana int, ini int, fin int")
    s = spark.createDataFrame([session(1, [100], ini=600, fin=720), session(2, [100], ini=660, fin=780), session(3, [100], day=1), session(4, [5])], SCHEMA)
    assert [(x.s1, x.restriccion_id) for x in C.restriction_violations(s, r).collect()] == [(1, 7)]


def test_whole_year_sessions_meet_halves_if_asked(spark):
    rows = [session(1, [1], 5), session(2, [2], 5, course=2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("periodo", F.when(F.col("id") == 1, "anual").otherwise("primer_cuatrimestre"))
    assert C.room_overlaps(df).count() == 0 and C.room_overlaps(df, period_aware=True).count() == 1


@pytest.mark.parametrize("width", [7, 60, 100_000])
def test_binned_join_equals_a_nested_loop(spark, width):
    rnd = random.Random(width)
    rows = [(i, rnd.randint(0, 2), (a := rnd.randint(0, 300)), a + rnd.randint(0, 90)) for i in range(120)]
    got = interval_pairs(spark.createDataFrame(rows, "id long, k int, a int, b int"), ["k"], "a", "b", width).select("a.id", F.col("b.id").alias("id2")).collect()
    want = [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3]]
    assert sorted(map(tuple, got)) == sorted(want)
