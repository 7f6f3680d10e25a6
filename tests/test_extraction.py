"""Sheets, timetable columns, lines and merges by golden rows."""

from pyspark.sql import functions as F

from quadrille.operators import extraction as X
from quadrille.operators import maintenance as M

SHEET = """DATOS DEL TITULO
Grado en Física OBLIGATORIA 2
Grado en Matemáticas BÁSICA 1
CODIGO Y DENOMINACION : G652 CÁLCULO  II
Nº CRÉDITOS ECTS: 6,00 SECUENCIA: Cuatrimestral Nº: 1
Idioma: Inglés  English friendly: sí
DATOS DEL PROFESORADO
CU GARCIA LOPEZ, ANA Universidad N
TUPEREZ RUIZ, JUAN 12,5
PROFESOR EXTERNO 77
TOTAL 1"""


def test_sheet(spark):
    df = spark.createDataFrame([(1, SHEET), (2, "nada"), (3, None)], "doc_id long, text string")
    good, bad = X.parse_sheets(df)
    s = good.first()
    assert (s.codigo_plan, s.ects, s.periodo, s.num_periodo, s.idioma, s.english_friendly) == ("G652", 6, "CUATRIMESTRAL", 1, "INGLES", True)
    assert sorted(r.doc_id for r in bad.collect()) == [2, 3]
    subject, degrees, teachers = X.normalize_sheets(good)
    assert (subject.first().nombre, subject.first().periodo) == ("Cálculo II", "primer_cuatrimestre")
    assert sorted((r.programa_nombre, r.tipo_asignatura, r.curso) for r in degrees.collect()) == [("Grado En Física", "obligatoria", 2), ("Grado En Matemáticas", "basica", 1)]
    assert sorted((r.nombre, r.apellidos) for r in teachers.collect()) == [("77", "Profesor Externo"), ("Ana", "Garcia Lopez"), ("Juan", "Perez Ruiz")]


def test_cells_merge_down_a_column(spark):
    rows = [
        (1, 1, 0, 0, "08:30", "Estructuras de"), (1, 1, 1, 0, "09:30", "Datos AULA 5"), (1, 1, 2, 0, "10:30", "LSC 2 Grupo 1"), (1, 1, 3, 0, "11:30", ""),
        (1, 1, 4, 0, "12:30", "Física"), (1, 1, 5, 0, "13:30", "Física"), (1, 1, 6, 0, "14:30", "(*) nota"), (1, 1, 0, 1, "08:30", "Álgebra PL1"),
    ]
    cells = spark.createDataFrame(rows, "doc long, page int, fila int, col int, hora string, text string")
    got = X.merge_cells(X.parse_cells(X.cell_times(cells, ["doc", "page", "col"]))).orderBy("col", "ini").collect()
    assert [(r.col, r.asignatura, r.aula, r.ini, r.fin) for r in got] == [(0, "Estructuras de Datos", "AULA 5", 510, 690), (0, "Física", "POR DETERMINAR", 750, 870), (1, "Álgebra", "POR DETERMINAR", 510, 570)]
    assert got[2].tipo == "PRÁCTICA" and got[0].tipo == "PRÁCTICA"


def test_lines_within_the_tolerance_become_one(spark):
    df = spark.createDataFrame([(1, 1, "v", float(p)) for p in (0, 3, 20, 24, 60)], "doc long, page int, axis string, pos double")
    assert sorted(r.pos for r in X.dedup_lines(df).collect()) == [1.5, 22.0, 60.0]


def test_footer(spark):
    df = spark.createDataFrame([(1, 1, "Horas", 10.0, 100.0, 40.0, 110.0), (1, 1, "reservadas para", 50.0, 102.0, 90.0, 112.0), (1, 1, "x", 0.0, 50.0, 9.0, 60.0), (2, 1, "y", 0.0, 50.0, 9.0, 60.0)], "doc long, page int, text string, x0 double, top double, x1 double, bottom double")
    assert {r.doc: r.cutoff for r in X.footer_cutoff(df).collect()} == {1: 98.0, 2: 842.0}


def test_restriction_import_is_all_or_nothing(spark):
    teachers = spark.createDataFrame([(1, "Juan", "Pérez Gómez", True), (2, "Ana", "García", True)], "id long, nombre string, apellidos string, activo boolean")
    old = spark.createDataFrame([(9, 1, 4, 600, 660)], "id long, profesor_id long, dia_semana int, ini int, fin int")
    sheet = lambda extra: spark.createDataFrame([(2, "Juan Pérez Gómez", "L, M", "09:00-11:00"), (3, "Ana García", "X", "15:00-20:00"), (4, None, "", "nan"), *extra], "fila long, profesor string, ` Días ` string, FRANJA string")
    rows, missing = M.read_restrictions(sheet([]))
    new, errors = M.import_restrictions(old, rows, teachers)
    assert not missing and errors.isEmpty() and sorted((r.profesor_id, r.dia_semana, r.ini) for r in new.collect()) == [(1, 0, 540), (1, 1, 540), (2, 2, 900)]
    kept, errors = M.import_restrictions(old, M.read_restrictions(sheet([(5, "Profesor Fantasma", "L", "09:00-10:00")]))[0], teachers)
    assert [tuple(r) for r in kept.collect()] == [(9, 1, 4, 600, 660)] and [(r.fila, r.error) for r in errors.collect()] == [(5, "profesor")]
    assert M.read_restrictions(rows.select("fila", "dias"))[1] == ["Profesor", "Franja"]


def test_sync_twice_changes_nothing(spark):
    stored = spark.createDataFrame([("a", 1, 2, "solucionado"), ("b", 1, 3, "por_revisar")], "hash string, sesion_id long, sesion_2_id long, estado string")
    found = spark.createDataFrame([("a", 1, 2), ("c", 4, 5)], "hash string, sesion_id long, sesion_2_id long")
    once, counts = M.sync_conflicts(stored, found)
    assert tuple(counts.first()) == (1, 1, 2)
    twice, counts = M.sync_conflicts(once, found)
    assert tuple(counts.first()) == (0, 0, 2)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) and {r.hash: r.estado for r in once.collect()}["a"] == "solucionado"


def test_new_ids_are_dense_and_in_order(spark):
    df = spark.createDataFrame([(f"k{i:02d}",) for i in range(25)], "k string")
    got = M.new_ids(df.repartition(5), spark.createDataFrame([(7,)], "id long"), ["k"]).orderBy("k").collect()
    assert [r.id for r in got] == list(range(8, 33))


def test_sheet_fields_are_worked_out_once(spark):
    """A step that a later one reads stands in the plan once, not once for every field that is made of it."""
    sheets = spark.range(3).selectExpr("id AS doc_id", "concat('CODIGO Y DENOMINACION : G10', id, ' X\\nECTS: 6\\nDATOS DEL PROFESORADO\\nCU GARCIA LOPEZ, ANA Universidad N\\nTOTAL') AS text")
    good, _ = X.parse_sheets(sheets)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(good).count("[ \\t]+") == 1
    assert plan(X.extract_teachers(sheets)).count("\\bCSIC N\\b") == 1
    teachers = X.normalize_sheets(good)[2]
    assert [(r.nombre, r.apellidos) for r in teachers.limit(1).collect()] == [("Ana", "Garcia Lopez")] and plan(teachers).count("\\bCSIC N\\b") == 1
