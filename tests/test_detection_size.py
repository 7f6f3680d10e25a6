"""How the detector's rows are dealt out and met, for tables that are large."""

from pyspark.sql import functions as F

from quadrille.operators import conflicts as C
from quadrille.operators import maintenance as M
from quadrille.operators.intervals import interval_pairs, session_pairs
from tests.test_detection import SCHEMA, session


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_meet_in_a_number_of_tasks_that_bytes_do_not_lower(spark):
    """Rows that are all alike are few bytes on the way, and were sorted by one task."""
    rows = spark.range(2000).select("id", (F.col("id") % 500).alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    assert interval_pairs(rows, ["k"], "a", "b", 10).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_dated_sessions_laid_onto_the_week_too(spark):
    rows = spark.createDataFrame([session(1, room=5), session(2, room=5)], SCHEMA).withColumns({c: F.expr(f"timestamp'2024-01-01 {h}:00' + make_dt_interval(0, 0, CAST(id AS INT) - 2)") for c, h in (("inicio", "09"), ("fin_ts", 10))})
    rows = rows.withColumn("dia_semana", F.when(F.col("id") == 1, F.col("dia_semana"))).select("id", "aula_id", "dia_semana", "ini", "fin", "inicio", "fin_ts")
    met = session_pairs(rows, ["aula_id"], 60, mixed=True)
    assert met.count() == 1 and plan(met).count("REPARTITION_BY_NUM") == 6


def test_findings_are_not_moved_by_their_hash(spark):
    """Equal keys meet by rule, sessions and resource; the key and the text come after."""
    s = spark.createDataFrame([session(1, [1], 7), session(2, [1], 7), session(2, [1], 7)], SCHEMA)
    found = C.detect_conflicts(s)
    assert "hashpartitioning(hash" not in plan(found)
    assert sorted(r.tipo for r in found.collect()) == sorted([C.ROOM, C.TEACHER, C.COHORT])


def test_names_that_come_twice_give_one_finding(spark):
    names = spark.createDataFrame([(7, "B"), (7, "A")], "id long, nombre string")
    found = C.detect_conflicts(spark.createDataFrame([session(1, [1], 7), session(2, [2], 7, course=2)], SCHEMA), room_names=names, teacher_names=names, subject_names=names)
    assert [r.descripcion for r in found.collect()] == ["El aula 'A' está ocupada simultáneamente."]


def test_pairs_of_two_subjects_look_for_no_name_in_one_task(spark):
    """Their common subject is 0 throughout, by which all of them would be dealt to one task."""
    s = spark.createDataFrame([session(i, [i], subject=100 + i) for i in range(40)], SCHEMA)
    subjects = spark.createDataFrame([(100 + i, f"S{i}") for i in range(40)], "id long, nombre string")
    names = subjects.join(subjects.hint("shuffle_merge").select("id"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = C.detect_conflicts(s, rooms=False, teachers=False, subject_names=names)
        assert "hashpartitioning(asignatura_comun" not in plan(found) and found.count() == 40 * 39 // 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_detecting_for_some_equals_all_findings_of_theirs(spark):
    s = spark.createDataFrame([session(i, [i % 5, i % 3], i % 4, subject=i % 6, ini=480 + 20 * (i % 20), fin=560 + 20 * (i % 20), course=i % 2) for i in range(60)], SCHEMA)
    r = spark.createDataFrame([(i, i % 5, 0, 500, 600) for i in range(10)], "id long, profesor_id long, dia_semana int, ini int, fin int")
    ids, every = spark.createDataFrame([(3,), (8,), (8,), (999,)], "id long"), C.detect_conflicts(s, r).cache()
    mine = every.where("sesion_id IN (3, 8) OR sesion_2_id IN (3, 8)").select("hash", "descripcion").collect()
    some = C.detect_for(s, ids, r)
    assert sorted(some.select("hash", "descripcion").collect()) == sorted(mine) and mine
    assert sorted(C.touching(every, ids).select("hash", "descripcion").collect()) == sorted(mine)
    assert C.untouched(every, ids).count() == every.count() - len(mine)
    assert "concat(p" not in plan(some)  # no second copy of the sessions, by all their keys, says first which may meet


def test_stored_conflicts_are_read_once_when_some_are_replaced(spark):
    """Those of session 1 go; a fresh one with the key of one that stays is left out, a fresh one with the key of one that goes isn't."""
    schema = "hash string, sesion_id long, sesion_2_id long"
    stored = spark.createDataFrame([("a", 1, 2, "solucionado"), ("b", 3, 1, "solucionado"), ("c", 3, 4, "solucionado"), ("d", 5, None, "solucionado"), ("e", 1, None, "solucionado")], schema + ", estado string")
    fresh = spark.createDataFrame([("a", 1, 2), ("c", 1, 4), ("n", 1, 9)], schema)
    out = M.sync_session_conflicts(stored, fresh, spark.createDataFrame([(1,)], "id long"))
    assert sorted((r.hash, r.estado) for r in out.collect()) == [("a", M.OPEN), ("c", "solucionado"), ("d", "solucionado"), ("n", M.OPEN)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [hash") == 2


def test_rows_stay_where_they_are_when_some_ids_are_marked(spark):
    """Ids below zero, of the last bit of a word, that come twice and that are null; a null value is among none. Many scattered ids meet by a shuffle, with the same marks."""
    ids = [-65, -64, -1, 0, 63, 64, 2**40, 2**40, None]
    rows = spark.createDataFrame([(i, i if i % 2 else None) for i in [*range(-70, 70), 2**40]] + [(None, 63)], "a long, b long")
    want = sorted((str(r.a), str(r.b), r.a is not None and r.a in ids, r.b is not None and r.b in ids) for r in rows.collect())
    marked = lambda: C.marked(rows, spark.createDataFrame([(i,) for i in ids], "id long"), _a=C.F.col("a"), _b=C.F.col("b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, limit = marked(), C.WORDS
        assert "BroadcastHashJoin" in plan(few) and "hashpartitioning" not in plan(few)
        C.WORDS = 2
        many = marked()
        assert "hashpartitioning" in plan(many)
        for out in (few, many):
            assert sorted((str(r.a), str(r.b), r._a, r._b) for r in out.collect()) == want
    finally:
        C.WORDS = limit
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_whole_conflicts_stay_where_they_are_when_some_are_replaced(spark):
    """Only numbers of keys meet, and keys of which the numbers are equal."""
    schema = "hash string, sesion_id long, sesion_2_id long, estado string"
    stored = spark.createDataFrame([(f"k{i}", i, i + 1, "solucionado") for i in range(40)], schema)
    fresh = spark.createDataFrame([(f"n{i}", 1, i) for i in range(40)] + [("k30", 1, 2), ("k0", 0, 1)], "hash string, sesion_id long, sesion_2_id long")
    for threshold in ("-1", "10m"):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            out = M.sync_session_conflicts(stored, fresh, spark.createDataFrame([(1,)], "id long"))
            assert "hashpartitioning" not in plan(out) and "Window" not in plan(out)
            assert sorted(r.hash for r in out.collect()) == sorted([f"k{i}" for i in range(2, 40)] + [f"n{i}" for i in range(40)] + ["k0"])
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
