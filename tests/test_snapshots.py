"""Commits of several tables: killed at any point, run again, and written only where something changed."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from quadrille.operators import conflicts as C
from quadrille.operators import maintenance as M
from quadrille.sources.fixtures import TABLES
from quadrille.sources.snapshots import Snapshots
from quadrille.streaming import jobs

SESSIONS = "id long, aula_id long, profesor_ids array<long>, asignatura_id long, curso int, periodo string, tipo_grupo string, grupo_codigo string, mencion_ids array<long>, dia_semana int, ini int, fin int"
EDITS = "op string, id long, temp_id long, aula_id long, dia_semana int, ini int, fin int, orden int"


def rows(state, table, commit=None):
    return sorted(map(str, state.read(table, commit).collect()))


def all_rows(state):
    return {t: rows(state, t) for t in state.keys}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


class Killed(Exception):
    pass


def killed_at(state, monkeypatch, k):
    """Lets k writes of data pass; the one after ends the writer. The commit's own file counts as the last write."""
    left = [k]

    def guarded(name):
        real = getattr(Snapshots, name)

        def run(self, *a, **b):
            if left[0] == 0:
                raise Killed
            left[0] -= 1
            return real(self, *a, **b)

        monkeypatch.setattr(Snapshots, name, run)

    guarded("_write")
    guarded("_publish")


@pytest.fixture(scope="module")
def origin(spark, tmp_path_factory):
    s = spark.createDataFrame([(i, i % 4, [i % 5], i % 3, 1, "p1", "TEORIA", f"G{i % 2}", [], i % 2, 540 + 30 * (i % 6), 600 + 30 * (i % 6)) for i in range(40)], SESSIONS)
    state = Snapshots(spark, str(tmp_path_factory.mktemp("origin")), jobs.SCHEDULE, buckets=8)
    state.commit({"sesiones": s, "conflictos": C.detect_conflicts(s).withColumn("estado", F.lit("solucionado"))})
    return state


def copied(origin, path):
    """A state of its own that starts from origin's commit: data is never changed, so that commits may share it."""
    shutil.copytree(f"{origin.path}/_commits", f"{path}/_commits")
    return Snapshots(origin.spark, path, origin.keys, origin.buckets)


def edits(spark):
    new = [("create", None, 2, 1, 0, 540, 630, 0), ("create", None, 1, 2, 1, 570, 690, 0)]
    return spark.createDataFrame([("update", 3, None, 2, 1, 540, 660, 1), ("update", 3, None, 1, 0, 570, 700, 2), ("delete", 7, None, None, None, None, None, 0), ("update", 9, None, 9, None, None, None, 0), ("delete", 9, None, None, None, None, None, 0), *new], EDITS)


def test_a_killed_batch_of_edits_runs_again(spark, origin, tmp_path):
    want = copied(origin, f"{tmp_path}/a")
    jobs.apply_session_changes(want, edits(spark), 0)
    state = copied(origin, f"{tmp_path}/b")
    before = all_rows(state)
    for k in range(3):
        with pytest.MonkeyPatch.context() as patch:
            killed_at(state, patch, k)
            with pytest.raises(Killed):
                jobs.apply_session_changes(state, edits(spark), 0)
        assert all_rows(state) == before and state.last().number == 0
    for _ in range(2):  # the second run finds its batch committed
        jobs.apply_session_changes(state, edits(spark), 0)
        assert all_rows(state) == all_rows(want) and state.last().number == 1
    after = state.read("sesiones")
    assert after.count() == 40 and {r.id for r in after.collect()} == set(range(42)) - {7, 9}
    assert next(r for r in after.collect() if r.id == 3)["fin"] == 700
    assert {r.hash for r in state.read("conflictos").collect()} == {r.hash for r in C.detect_conflicts(after).collect()}
    assert rows(state, "sesiones", state.at(0)) == before["sesiones"]


def test_only_touched_buckets_are_written(spark, origin, tmp_path):
    state = copied(origin, f"{tmp_path}/s")
    old, was = files(state.path), state.last()
    jobs.apply_session_changes(state, spark.createDataFrame([("update", 3, None, 77, None, None, None, 0)], EDITS), 0)
    now = state.last()
    moved = {t: {b for b in range(8) if was.folders[t].get(b) != now.folders[t].get(b)} for t in state.keys}
    assert moved["sesiones"] == set(state.touched("sesiones", spark.createDataFrame([(3,)], "id long")))
    new = {f for f in files(state.path) - old if "/_commits/" not in f}
    assert len([f for f in new if "/sesiones/" in f]) == 1 and len([f for f in new if "/conflictos/" in f]) <= len(moved["conflictos"])
    # whole tables: the buckets that differ are found by comparing hashes of rows
    c = state.read("conflictos")
    state.commit({"conflictos": M.set_state(c.withColumn("resuelto_en", F.lit(None).cast("timestamp")), c.orderBy("hash").limit(1).select("hash", F.lit("abierto").alias("estado"), F.lit(None).cast("timestamp").alias("ahora"))).select(*c.columns), "sesiones": state.read("sesiones")})
    last = state.last()
    assert sum(now.folders["conflictos"][b] != last.folders["conflictos"][b] for b in last.folders["conflictos"]) == 1 and now.folders["sesiones"] == last.folders["sesiones"]


def test_feeds_are_told_apart_and_old_batches_do_nothing(spark, origin, tmp_path):
    state = copied(origin, f"{tmp_path}/s")
    one = spark.createDataFrame([("delete", 1, None, None, None, None, None, 0)], EDITS)
    two = spark.createDataFrame([("delete", 2, None, None, None, None, None, 0)], EDITS)
    jobs.apply_session_changes(state, one, 0)
    jobs.apply_session_changes(state, two, 0, feed="otro")
    jobs.apply_session_changes(state, two, 0)
    jobs.apply_session_changes(state, one.limit(0), 1)
    jobs.apply_session_changes(state, two, 0)
    assert {r.id for r in state.read("sesiones").collect()} == set(range(40)) - {1, 2} and dict(state.last().batches) == {"cambios": 1, "otro": 0}


def test_a_stream_run_from_a_new_checkpoint_changes_nothing(spark, origin, tmp_path):
    state = copied(origin, f"{tmp_path}/s")
    edits(spark).coalesce(1).write.parquet(f"{tmp_path}/in")
    for k in range(2):
        jobs.stream_session_changes(jobs.feed(spark, f"{tmp_path}/in", EDITS), state, f"{tmp_path}/check{k}").awaitTermination()
        assert state.last().number == 1 and state.read("sesiones").count() == 40


def sheets(spark, k):
    row = TABLES["fichas"].replace("{part}", "(SELECT id AS p_partkey, CAST(id % 50 AS INT) AS p_size, concat('lace tea ', chr(CAST(97 + id % 26 AS INT))) AS p_name FROM r)").replace("//", "div").replace("VARCHAR", "STRING")
    spark.range(k, k + 12).createOrReplaceTempView("r")
    good = spark.sql(row)
    return good.unionByName(spark.createDataFrame([(1000 + k, "nada")], "doc_id long, text string"))


CATALOGUE = {
    "asignaturas": "id long, codigo_plan string, nombre string, periodo string, ects int, modalidad string, idioma string, english_friendly boolean", "programas": "id long, nombre string, tipo string, activo boolean", "profesores": "id long, nombre string, apellidos string, activo boolean",
    "enlaces": "id long, programa_id long, asignatura_id long, curso int, tipo_asignatura string", "profesores_asignaturas": "profesor_id long, asignatura_id long", "rechazos": "doc_id long, errores array<string>", "ejecuciones": "feed string, lote long, validas long, con_avisos long, rechazadas long",
}


def test_a_killed_batch_of_sheets_runs_again(spark, tmp_path):
    def catalogue(name):
        state = Snapshots(spark, f"{tmp_path}/{name}", jobs.CATALOGUE, buckets=4)
        state.commit({k: spark.createDataFrame([], v) for k, v in CATALOGUE.items()})
        jobs.apply_sheets(state, sheets(spark, 0), 0)
        return state

    state = catalogue("b")
    before = all_rows(state)
    with pytest.MonkeyPatch.context() as patch:
        killed_at(state, patch, 7)  # all data is written, the commit isn't
        with pytest.raises(Killed):
            jobs.apply_sheets(state, sheets(spark, 6), 1)
    assert all_rows(state) == before
    for _ in range(2):
        jobs.apply_sheets(state, sheets(spark, 6), 1)
        assert state.last().number == 2
    # merging by parts gives what merging whole tables gives
    from quadrille.operators.extraction import normalize_sheets, parse_sheets

    whole = {k: spark.createDataFrame([], v) for k, v in CATALOGUE.items()}
    for k in (0, 6):
        whole = whole | M.upsert_sheets(whole, *normalize_sheets(parse_sheets(sheets(spark, k))[0]))
    for t in ("asignaturas", "programas", "profesores", "profesores_asignaturas", "enlaces"):
        assert rows(state, t) == sorted(map(str, whole[t].select(*state.read(t).columns).collect())), t
    assert sorted(r.doc_id for r in state.read("rechazos").collect()) == [1000, 1006]
    assert sorted((r.lote, r.validas, r.rechazadas) for r in state.read("ejecuciones").collect()) == [(0, 12, 1), (1, 12, 1)]


def test_rows_of_large_tables_are_not_moved_to_their_buckets(spark, tmp_path):
    """Each of eight tasks writes its own files; small tables have one file a bucket."""
    from quadrille.sources import snapshots

    state = Snapshots(spark, f"{tmp_path}/s", {"t": ["id"]}, 2)
    many = lambda: spark.range(0, 400, 1, 8)
    of = lambda commit: [f for b in (0, 1) for f in os.listdir(commit.folders["t"][b].replace("file:", "")) if f.startswith("part-")]
    assert len(of(state.commit({"t": many()}))) == 16 and state.read("t").count() == 400
    assert len(of(state.commit({"t": many()}, parts={"t": [0, 1]}))) == 2
    limit, snapshots.LARGE = snapshots.LARGE, 1
    try:
        assert len(of(state.commit({"t": many()}, parts={"t": [0, 1]}))) == 16 and sorted(r.id for r in state.read("t").collect()) == list(range(400))
    finally:
        snapshots.LARGE = limit


def test_nothing_shuffled_stays_behind_when_rows_are_written(spark, tmp_path):
    """cut, laid and a commit leave no shuffle's files on the disks."""
    from quadrille.sources.storage import cut, laid

    # PySpark names no public way to ask where shuffles lie
    base = spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {f for d in base for root, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_")}
    before = shuffled()
    df = lambda: spark.range(1000).groupBy((F.col("id") % 7).alias("id")).agg(F.count("*").alias("n"))
    assert cut(df()).count() == 7 and laid(df(), "t").count() == 7
    Snapshots(spark, f"{tmp_path}/s", {"t": ["id"]}, 2).commit({"t": df()})
    for _ in range(50):
        if len({f for f in shuffled() - before if f.endswith(".data")}) <= 2:  # counts on the driver keep theirs
            break
        time.sleep(0.1)
    assert len({f for f in shuffled() - before if f.endswith(".data")}) <= 2 and df().collect()
