"""Scans of schedule tables and the files that stages leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.operators.conflicts import effective_teachers, first_context
from quadrille.operators.intervals import recurrence
from quadrille.sources.storage import cut


def load_sessions(tables: dict[str, DataFrame]) -> DataFrame:
    """Sessions as the detector takes them: joined to group and subject (both needed), the first program link, and their teachers.

    tables has sesiones (id, grupo_docente_id, aula_id, dia_semana, ini, fin),
    grupos (id, asignatura_id, codigo, tipo, curso), asignaturas, enlaces,
    profesores_sesiones (sesion_id, profesor_id) and profesores_asignaturas.
    """
    g = tables["grupos"].select(F.col("id").alias("grupo_docente_id"), "asignatura_id", F.upper("codigo").alias("grupo_codigo"), F.upper("tipo").alias("tipo_grupo"), F.coalesce("curso", F.lit(0)).alias("curso"))
    a = tables["asignaturas"].select(F.col("id").alias("asignatura_id"), F.coalesce("periodo", F.lit("")).alias("periodo"))
    link = first_context(tables["enlaces"]).select("asignatura_id", "programa_id", "mencion_id")
    s = tables["sesiones"].join(g, "grupo_docente_id").join(a, "asignatura_id").join(link, "asignatura_id", "left")
    s = effective_teachers(s, tables["profesores_sesiones"], tables["profesores_asignaturas"])
    return recurrence(s.withColumn("mencion_ids", F.array_compact(F.array("mencion_id"))))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A spreadsheet saved as CSV: all texts, blanks kept, and fila, the row of the sheet (its header is row 1), however the file is split.

    Lines without anything, not even separators, are no rows.
    """
    rows = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=False)
    own = rows.columns
    rows = cut(rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n")))
    blocks = rows.groupBy("_file", "_block").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(blocks.select("_file", "_block", before.alias("_before")), ["_file", "_block"])
    place = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_n"))
    return rows.select(*own, (F.col("_before") + place + 1).cast("long").alias("fila"))


def write_stage(df: DataFrame, path: str, stage: str, form: str = "json", **options) -> None:
    """A stage's results, one folder a stage. json keeps nested results as they are, csv takes flat ones (with a header), text one column of lines."""
    writer = df.write.mode("overwrite").options(**({"header": True} | options if form == "csv" else options))
    writer.format(form).save(f"{path}/stage={stage}")


#: Where a line of a stage that doesn't fit its schema is kept.
CORRUPT = "linea_rota"


def read_stage(spark: SparkSession, path: str, stage: str, schema=None, form: str = "json", whole_files: bool = False, **options) -> DataFrame:
    """A stage's results. whole_files: each JSON file is one value over many lines, as people write them.

    With a schema that has the text column linea_rota, lines (or files) that
    don't fit come back there, with nulls in the others; without it they come
    as nulls.
    """
    reader = spark.read.options(**({"header": True} if form == "csv" else {}), multiLine=whole_files, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **options)
    return (reader.schema(schema) if schema is not None else reader).format(form).load(f"{path}/stage={stage}")


def read_stages(spark: SparkSession, path: str, schema, form: str = "json") -> DataFrame:
    """All stages that were written under path, with the column stage; a filter on it reads only their folders."""
    return spark.read.schema(schema).format(form).load(path)
