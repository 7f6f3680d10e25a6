"""Deletes over graphs of tables, constraints, and what a confirmed draft does to the teachers of others."""

import random

import pytest

from quadrille.operators import conflicts as C
from quadrille.operators import extraction as X
from quadrille.operators import maintenance as M


def frames(spark, tables):
    return {t: spark.createDataFrame(rows, ", ".join(f"{c} long" for c in cols)) for t, (cols, rows) in tables.items()}


def deleted(spark, tables, table, ids, rules):
    out, held = M.cascade_delete(frames(spark, tables), table, spark.createDataFrame([(i,) for i in ids], "id long"), rules)
    return {t: sorted(map(tuple, df.collect()), key=str) for t, df in out.items()}, sorted(r.id for r in held.collect())


def plain(tables, table, ids, rules):
    """A row goes with all below it, or not at all."""
    cols = {t: c for t, (c, _) in tables.items()}
    refs = lambda child, key, row: row[cols[child].index(key)]

    def below(t, i):
        found, todo = {(t, i)}, [(t, i)]
        while todo:
            p, x = todo.pop()
            for parent, child, key, how in rules:
                if parent == p and how == "cascade":
                    for row in tables[child][1]:
                        if refs(child, key, row) == x and (child, row[0]) not in found:
                            found.add((child, row[0]))
                            todo.append((child, row[0]))
        return found

    there = {r[0] for r in tables[table][1]}
    held = {i for i in ids if i in there and any(how == "restrict" and (parent, refs(child, key, row)) in below(table, i) for parent, child, key, how in rules for row in tables[child][1])}
    gone = set().union(*[below(table, i) for i in ids if i in there and i not in held])
    out = {}
    for t, (c, rows) in tables.items():
        keep = []
        for row in rows:
            if (t, row[0]) not in gone:
                lose = {k for parent, child, k, how in rules if child == t and how == "set_null" and (parent, refs(t, k, row)) in gone}
                keep.append(tuple(None if n in lose else v for n, v in zip(c, row)))
        out[t] = sorted(keep, key=str)
    return out, sorted(held)


def test_restrict_below_a_cascade_holds_the_row_above(spark):
    tables = {"a": (["id"], [(1,), (2,)]), "b": (["id", "a_id"], [(10, 1), (11, 2)]), "c": (["id", "b_id"], [(100, 10)])}
    out, held = deleted(spark, tables, "a", [1, 2, 3], [("a", "b", "a_id", "cascade"), ("b", "c", "b_id", "restrict")])
    assert held == [1] and out == {"a": [(1,)], "b": [(10, 1)], "c": [(100, 10)]}


@pytest.mark.parametrize("seed", [1, 2])
def test_mixed_rules_leave_nothing_dangling(spark, seed):
    """A diamond (a to d by b and by c), a table that refers to itself, and every kind of rule."""
    rnd = random.Random(seed)
    some = lambda n: rnd.choice([None, *range(n)])
    tables = {
        "a": (["id", "up"], [(i, some(i) if i else None) for i in range(8)]), "b": (["id", "a_id"], [(i, some(8)) for i in range(10)]), "c": (["id", "a_id"], [(i, some(8)) for i in range(10)]),
        "d": (["id", "b_id", "c_id"], [(i, some(10), some(10)) for i in range(14)]), "e": (["id", "d_id", "a_id"], [(i, some(14), some(8)) for i in range(3)]),
    }
    rules = [("a", "a", "up", "cascade"), ("a", "b", "a_id", "cascade"), ("a", "c", "a_id", "cascade"), ("b", "d", "b_id", "cascade"), ("c", "d", "c_id", "set_null"), ("d", "e", "d_id", "restrict"), ("a", "e", "a_id", "set_null")]
    got = deleted(spark, tables, "a", [1, 2, 3, 5, 6], rules)
    assert got == plain(tables, "a", [1, 2, 3, 5, 6], rules)
    left = {t: {r[0] for r in rows} for t, rows in got[0].items()}
    for parent, child, key, _ in rules:
        assert all(row[tables[child][0].index(key)] in left[parent] | {None} for row in got[0][child])


def test_a_cycle_of_tables(spark):
    tables = {"a": (["id", "b_id"], [(1, 11), (2, 12), (3, None)]), "b": (["id", "a_id"], [(11, 2), (12, 1), (13, 3)])}
    out, held = deleted(spark, tables, "a", [1], [("a", "b", "a_id", "cascade"), ("b", "a", "b_id", "cascade")])
    assert held == [] and out == {"a": [(3, None)], "b": [(13, 3)]}


def test_unique_keys_with_nulls_and_marks(spark):
    df = spark.createDataFrame([(None, "1", "2"), ("1", None, "2"), ("1", None, "2"), ("a|b", "c", "x"), ("a", "b|c", "x"), ("K", "l", "m"), ("k", "L", "M")], "p string, q string, r string")
    assert [tuple(r) for r in M.check_constraints(df, unique=["p", "q", "r"]).collect()] == [("unico", "k|l|m", 2)]
    assert M.check_constraints(df, unique=["p", "q", "r"], ignore_case=False).count() == 0


def test_lines_at_the_tolerance_merge(spark):
    lines = spark.createDataFrame([(1, 1, "v", float(p)) for p in (0, 5, 20)] + [(1, 1, "h", 0.0), (1, 1, "h", 5.01)], "doc long, page int, axis string, pos double")
    assert sorted((r.axis, r.pos) for r in X.dedup_lines(lines).collect()) == [("h", 0.0), ("h", 5.01), ("v", 2.5), ("v", 20.0)]


def test_confirming_a_draft_knows_the_teachers_of_other_sessions(spark):
    """A session that stays has teacher 7 of its own (8 by its subject); the draft's subject is taught by 7 at the same hour."""
    one = spark.createDataFrame
    state = {
        "programas": one([(1, "Plan A")], "id long, nombre string"), "menciones": one([], "id long, programa_id long, nombre string, activo boolean"), "enlaces": one([(1, 50, 1, 1, None), (2, 60, 1, 2, None)], "id long, asignatura_id long, programa_id long, curso int, mencion_id long"),
        "asignaturas": one([(50, "G50", "Cálculo", "p1", True), (60, "G60", "Física", "p1", True)], "id long, codigo_plan string, nombre string, periodo string, activo boolean"), "aliases": one([], "asignatura_id long, alias string"),
        "aulas": one([(1, "Aula 1", "A1", True), (2, "Aula 2", "A2", True)], "id long, nombre string, codigo string, activo boolean"), "grupos": one([(5, 60, "G1", "PRACTICA", 2)], "id long, asignatura_id long, codigo string, tipo string, curso long"),
        "sesiones": one([(100, 5, 2, 0, 540, 600)], "id long, grupo_docente_id long, aula_id long, dia_semana int, ini int, fin int"), "profesores_sesiones": one([(100, 7)], "sesion_id long, profesor_id long"),
        "profesores_asignaturas": one([(8, 60), (7, 50)], "profesor_id long, asignatura_id long"), "conflictos": one([], "hash string, tipo string, sesion_id long, sesion_2_id long, estado string"),
    }
    draft = one([("Plan A", None, "Cálculo", None, None, "G1", "TEORIA", 1, "Aula 1", 0, 570, 630, 1)], "plan string, mencion string, asignatura string, texto string, elegida long, grupo string, tipo string, curso long, aula string, dia_semana int, ini int, fin int, orden long")
    out, errors = M.confirm_schedule(state, draft)
    assert errors.isEmpty() and [(r.tipo, r.profesor_id) for r in out["conflictos"].collect()] == [(C.TEACHER, 7)]


def test_rows_of_a_sheet_are_numbered_however_it_is_split(spark, tmp_path):
    from quadrille.sources.tables import read_sheet

    lines = ["Profesor,Días,Franja", *[f"Profesor número {i},{'L' if i % 5 else ''},09:00-11:00" for i in range(3000)]]
    lines[10] = ",,"
    (tmp_path / "h.csv").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        raw = read_sheet(spark, str(tmp_path / "h.csv"))
        assert {r.fila: r.Profesor for r in raw.collect()} == {i + 1: line.split(",")[0] or None for i, line in enumerate(lines) if i}
        rows, missing = M.read_restrictions(raw)
        warned = M.restriction_warnings(rows).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert not missing and rows.count() == 2999 and {r.fila for r in warned} == {i + 2 for i in range(3000) if i % 5 == 0 and i != 9}
    assert warned[0].severity == "minor" and warned[0].message.startswith(f"Fila {warned[0].fila}: ")


def test_stages_of_other_forms(spark, tmp_path):
    from quadrille.sources.tables import CORRUPT, read_stage, write_stage

    base = str(tmp_path)
    rows = spark.createDataFrame([(1, "uno"), (2, "dos, tres")], "id long, texto string")
    write_stage(rows, base, "tabla", "csv")
    write_stage(rows.select("texto"), base, "plano", "text")
    assert sorted(map(tuple, read_stage(spark, base, "tabla", "id long, texto string", "csv").collect())) == [(1, "uno"), (2, "dos, tres")]
    assert sorted(r[0] for r in read_stage(spark, base, "plano", form="text").collect()) == ["dos, tres", "uno"]
    (tmp_path / "stage=mano").mkdir()
    (tmp_path / "stage=mano" / "a.json").write_text('{\n "id": 7,\n "celdas": [["a", null],\n ["b"]]\n}\n')
    (tmp_path / "stage=mano" / "b.json").write_text('{"id": 8, "celdas": [')
    got = {r.id: r for r in read_stage(spark, base, "mano", f"id long, celdas array<array<string>>, {CORRUPT} string", whole_files=True).collect()}
    assert got[7].celdas == [["a", None], ["b"]] and got[7][CORRUPT] is None and any(r[CORRUPT] for i, r in got.items() if i != 7)
    (tmp_path / "stage=roto").mkdir()
    (tmp_path / "stage=roto" / "a.csv").write_text("id,texto\n1,uno\nx,dos\n3,tres\n")
    got = read_stage(spark, base, "roto", f"id long, texto string, {CORRUPT} string", "csv").cache().collect()
    assert [(r.id, r.texto) for r in got if r[CORRUPT] is None] == [(1, "uno"), (3, "tres")] and [r[CORRUPT] for r in got if r[CORRUPT]] == ["x,dos"]


def test_rooms_that_share_a_code_are_one_row(spark, tmp_path):
    """From 100,000 rooms on codes are cut to five digits, so that some repeat."""
    from quadrille import plans

    spark.range(250_000, 250_200).union(spark.range(2_500_000, 2_500_200)).selectExpr("id AS event_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(1, 4).selectExpr("id AS s_suppkey", "concat('P', id) AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    rooms = {r.codigo for r in plans.registry.table(spark, str(tmp_path), "aulas").select("codigo").collect()}
    got = [(r.codigo, r.hay) for r in plans.queries()["src6_seed_rooms"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((c, True) for c in rooms | {"S1", "S2", "S3"})


def test_sheets_that_share_a_code_are_subjects_of_their_editions(spark, tmp_path):
    """From 260,000 sheets on codes come round again; the SQL has a row for every sheet."""
    from collections import Counter

    duckdb = pytest.importorskip("duckdb")
    from quadrille import plans

    spark.range(0, 90).union(spark.range(260_000, 260_090)).union(spark.range(2_340_000, 2_340_090)).selectExpr("id AS p_partkey", "concat('cosa ', id) AS p_name", "CAST(id % 50 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = Counter(duck.sql(plans.oracle_sql()["m3_merged_tables"]).fetchall())
    assert Counter(map(tuple, plans.queries()["m3_merged_tables"](spark, str(tmp_path)).collect())) == want
