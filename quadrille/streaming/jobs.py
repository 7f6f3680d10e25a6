"""Change feeds: sessions that are edited, documents that arrive. A batch is one commit of all the tables that it changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadrille.operators import conflicts as C
from quadrille.operators import maintenance as M
from quadrille.operators.extraction import normalize_sheets, read_sheet_texts, split_sheets
from quadrille.sources.snapshots import Snapshots
from quadrille.sources.storage import cut, laid, observed

#: Key expressions of the tables of the two states.
SCHEDULE = {"sesiones": ["id"], "conflictos": ["hash"]}
CATALOGUE = {
    "asignaturas": ["codigo_plan"], "programas": ["lower(nombre)", "tipo"], "profesores": ["lower(nombre)", "lower(apellidos)"],
    "enlaces": ["asignatura_id"], "profesores_asignaturas": ["asignatura_id"], "rechazos": ["doc_id"], "ejecuciones": ["feed", "lote"],
}


def apply_session_changes(state: Snapshots, batch: DataFrame, number: int, feed: str = "cambios", restrictions: DataFrame | None = None) -> None:
    """Applies a batch of edits to sessions, finds the conflicts of the touched ones anew and replaces theirs: one commit.

    All is read as of the commit before, so that a batch that was killed at any
    point can be run again, and one that was committed does nothing. Only the
    buckets of touched sessions and conflicts are read whole and written. Of
    several edits of one session in a batch the last one (by orden, where batch
    has such a column) counts.
    """
    before = state.last()
    if state.done(feed, number, before):
        return
    batch = cut(M.last_edits(batch))
    known = batch.where("op <> 'create'").select("id")
    rows = state.read("sesiones", before)
    made = cut(M.created_sessions(rows, batch))
    ids = known.unionByName(made.select("id"))
    touched = state.touched("sesiones", ids)
    part = M.simulate_changes(state.read("sesiones", before, only=touched), batch.where("op <> 'create'")).unionByName(made.select(*rows.columns))
    part = laid(part, "sesiones")
    after = state.read("sesiones", before, without=touched).unionByName(part)
    found = laid(C.detect_for(after, ids, restrictions), "conflictos")
    stored = state.read("conflictos", before)
    hashes = state.touched("conflictos", found.select("hash"))
    if len(hashes) < state.buckets:  # else all are read, whatever goes; the buckets are moved, and not the hashes, which are long
        gone = C.touching(stored.select(state.bucket("conflictos").alias("b"), "sesion_id", "sesion_2_id"), ids)
        hashes = sorted({*hashes, *(r["b"] for r in gone.select("b").distinct().collect())})
    fresh = M.sync_session_conflicts(state.read("conflictos", before, only=hashes), found, ids)
    state.commit({"sesiones": part, "conflictos": fresh.select(*stored.columns)}, parts={"sesiones": touched, "conflictos": hashes}, feed=feed, batch=number, base=before)


def stream_session_changes(changes: DataFrame, state: Snapshots, checkpoint: str, feed: str = "cambios", restrictions: DataFrame | None = None) -> StreamingQuery:
    """apply_session_changes for every batch of a feed. A feed that starts anew, with a checkpoint of its own, needs a name of its own."""
    return changes.writeStream.foreachBatch(lambda batch, n: apply_session_changes(state, batch, n, feed, restrictions)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_sheets(state: Snapshots, batch: DataFrame, number: int, feed: str = "fichas") -> None:
    """Parses arriving sheets (doc_id, text) and merges them into the catalogue; invalid ones go to its rejects. One commit, which reads the one before.

    Only the buckets of the sheets' codes, programs, teachers and links are read
    whole and written. A row of ejecuciones (feed, lote, validas, con_avisos,
    rechazadas) says what the batch was; its counts are taken while the parsed
    sheets are written, which happens once.
    """
    before = state.last()
    if state.done(feed, number, before):
        return
    ok = F.size("errores") == 0
    sheets, seen = observed(read_sheet_texts(batch), "fichas", validas=F.count_if(ok), con_avisos=F.count_if(ok & (F.size("avisos") > 0)), rechazadas=F.count_if(~ok))
    good, bad = split_sheets(sheets)
    run = state.spark.createDataFrame([(feed, number, seen["validas"], seen["con_avisos"], seen["rechazadas"])], "feed string, lote long, validas long, con_avisos long, rechazadas long")
    parts: dict[str, list[int]] = {}

    def part(table: str, keys: DataFrame) -> DataFrame:
        parts[table] = state.touched(table, keys)
        return state.read(table, before, only=parts[table])

    names = ("asignaturas", "programas", "profesores", "enlaces", "profesores_asignaturas")
    merged = M.upsert_sheets({k: state.read(k, before) for k in names}, *normalize_sheets(good), part=part)
    rejects = part("rechazos", bad.select("doc_id")).unionByName(bad)
    runs = part("ejecuciones", run.select("feed", "lote")).unionByName(run)
    state.commit(merged | {"rechazos": rejects, "ejecuciones": runs}, parts=parts, feed=feed, batch=number, base=before)


def stream_sheet_intake(documents: DataFrame, state: Snapshots, checkpoint: str, feed: str = "fichas") -> StreamingQuery:
    """apply_sheets for every batch of arriving documents."""
    return documents.writeStream.foreachBatch(lambda batch, n: apply_sheets(state, batch, n, feed)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def commit_schedule(state: Snapshots, draft: DataFrame, number: int, feed: str = "borradores", restrictions: DataFrame | None = None) -> DataFrame:
    """Confirms a draft over a state and commits all tables that it changes at once; with any error nothing is committed. Returns the errors."""
    before = state.last()
    tables = {k: state.read(k, before) for k in state.keys}
    if state.done(feed, number, before):
        return M.no_errors(state.spark)
    after, errors = M.confirm_schedule(tables, draft, restrictions)
    if errors.isEmpty():
        state.commit({k: cut(df.select(*tables[k].columns)) for k, df in after.items() if df is not tables[k]}, feed=feed, batch=number, base=before)
    return errors


def feed(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
