"""Merging detected, imported and edited rows into stored snapshots.

Every operator returns the new frames; sources.snapshots keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import text as T
from quadrille.operators import conflicts as C
from quadrille.operators.intervals import TIMES
from quadrille.operators.matching import learn_aliases, match_teachers, resolve_rooms, resolve_subjects
from quadrille.sources.storage import cut, laid

OPEN = "por_revisar"
#: Rows that every task may hold.
FEW = 200_000


def conflict_diff(stored: DataFrame, detected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored conflicts that are no longer detected, and detected ones that aren't stored."""
    return stored.join(detected.select("hash"), "hash", "left_anti"), detected.join(stored.select("hash"), "hash", "left_anti")


def sync_conflicts(stored: DataFrame, detected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new snapshot, where survivors keep all they have and new ones are open, and one row eliminated, inserted, total."""
    kept = stored.join(detected.select("hash").distinct(), "hash", "left_semi")
    new = C.keep_first(detected.join(stored.select("hash"), "hash", "left_anti"), ["hash"], ["sesion_id"]).withColumn("estado", F.lit(OPEN))
    out = kept.unionByName(new, allowMissingColumns=True)
    sides = stored.select("hash", F.lit(1).alias("s")).join(detected.select("hash").distinct().withColumn("d", F.lit(1)), "hash", "full_outer")
    counts = sides.agg(F.count(F.when(F.col("d").isNull(), 1)).alias("eliminados"), F.count(F.when(F.col("s").isNull(), 1)).alias("insertados"), F.count("d").alias("total"))
    return out, counts


def sync_session_conflicts(stored: DataFrame, detected: DataFrame, ids: DataFrame) -> DataFrame:
    """All conflicts of the given sessions are replaced by the fresh ones. A fresh one with the key of one that stays is left out.

    The keys, which are long, first meet by numbers made from them, and only those that may be equal by themselves, so that
    whole rows stay where they are. stored and detected are each read for that and for the result: long plans should be laid down.
    """
    rest, new, number = C.untouched(stored, ids), detected.withColumn("estado", F.lit(OPEN)), F.xxhash64("hash").alias("_n")
    maybe = cut(rest.select(number).join(detected.select(number).distinct(), "_n", "left_semi").distinct())
    met = maybe.limit(FEW + 1).count()
    if met:
        few = F.broadcast if met <= FEW else (lambda df: df)
        known = cut(rest.select("hash", number).join(few(maybe), "_n", "left_semi").select(F.col("hash").alias("_known")).distinct())
        new = new.join(few(known), F.col("hash").eqNullSafe(F.col("_known")), "left_anti")
    return rest.unionByName(new, allowMissingColumns=True)


def set_state(conflicts: DataFrame, changes: DataFrame) -> DataFrame:
    """Applies (hash, estado, ahora): solved ones get the moment, others lose it."""
    c = changes.select("hash", F.col("estado").alias("_e"), F.col("ahora").alias("_t"))
    out = conflicts.join(c, "hash", "left")
    when = F.when(F.col("_e") == "solucionado", F.col("_t")).when(F.col("_e").isNotNull(), None).otherwise(F.col("resuelto_en"))
    return out.withColumns({"resuelto_en": when, "estado": F.coalesce("_e", "estado")}).drop("_e", "_t")


def sync_links(stored: DataFrame, incoming: DataFrame, scope: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Links to add, and links to remove: those that incoming lacks of the scopes that it speaks of."""
    add = incoming.select(*keys).distinct().join(stored, keys, "left_anti")
    remove = stored.join(incoming.select(scope).distinct(), scope, "left_semi").join(incoming, keys, "left_anti")
    return add, remove.select(*keys)


def new_ids(df: DataFrame, taken: DataFrame, order: list[str]) -> DataFrame:
    """Gives rows ids above all that are taken, in the order of their natural key.

    Rows are numbered within ranges of that order, so that no task has all of them.
    """
    top = taken.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    # written before it is counted: the numbers of rows and partitions must be of one and the same evaluation
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    ranged = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    out = ranged.join(before.drop("_n"), "_part")
    return out.withColumn("id", (F.lit(top) + F.coalesce("_before", F.lit(0)) + F.col("_row")).cast("long")).drop("_part", "_row", "_before")


def upsert(stored: DataFrame, incoming: DataFrame, keys: Mapping[str, Column] | list[str], taken: DataFrame | None = None) -> DataFrame:
    """Rows merged by a natural key: given fields replace, null ones keep what was; new rows get ids above those taken (by default those of stored).

    Of incoming rows with one key the one with the largest other fields counts.
    """
    expr = keys if isinstance(keys, Mapping) else {k: F.col(k) for k in keys}
    names = [f"_k{i}" for i in range(len(expr))]
    keyed = lambda df: df.withColumns(dict(zip(names, expr.values())))
    cols = [c for c in stored.columns if c != "id"]
    inc = keyed(incoming)
    inc = C.keep_first(inc, names, [F.desc_nulls_last(c) for c in cols if c in incoming.columns])
    inc = inc.select(*names, *[(F.col(c) if c in incoming.columns else F.lit(None).cast(dict(stored.dtypes)[c])).alias(f"_{c}") for c in cols], F.lit(True).alias("_in"))
    both = keyed(stored).join(inc, names, "full_outer")
    both = both.select("id", *[F.coalesce(f"_{c}", c).alias(c) for c in cols])
    return both.where("id IS NOT NULL").unionByName(new_ids(both.where("id IS NULL").drop("id"), stored if taken is None else taken, [next(iter(expr)) if next(iter(expr)) in cols else cols[0]]).select("id", *cols))


def upsert_sheets(state: dict[str, DataFrame], subject: DataFrame, degrees: DataFrame, teachers: DataFrame, part: Callable[[str, DataFrame], DataFrame] | None = None, subject_key: tuple[str, ...] = ("codigo_plan",)) -> dict[str, DataFrame]:
    """Subjects by code, programs by name and type, teachers by name (re-activated), and both kinds of links, from normalised sheets.

    state has asignaturas, programas, profesores (all with id), enlaces and
    profesores_asignaturas. A subject's teachers who aren't on its sheet lose
    their link. part, given a table's name and keys (a subject's code; a
    program's lower-case name and its type; a teacher's lower-case names; the
    links' subjects), may return just the rows of the table that can have them:
    then only these come back, merged. Where a catalogue holds several editions
    of a code, subject_key names the columns that tell its subjects apart.
    """
    key = list(subject_key)
    part = part or (lambda table, keys: state[table])
    low = lambda df, *names: df.select(*[F.lower(n).alias(n) for n in names])
    subject, degrees, teachers = cut(subject), cut(degrees), cut(teachers)  # each is read several times, and none is read out of its text again
    asig = cut(upsert(part("asignaturas", subject.select(*key)), subject.drop("doc_id"), key, state["asignaturas"]))
    code = subject.select("doc_id", *key).join(asig.select(*key, F.col("id").alias("asignatura_id")), key).drop(*key)
    code = cut(code)
    deg = degrees.withColumn("tipo", T.program_type(F.col("programa_nombre")))
    names = cut(deg.select(F.col("programa_nombre").alias("nombre"), "tipo").distinct())
    prog = cut(upsert(part("programas", names.select(F.lower("nombre").alias("nombre"), "tipo")), names.withColumn("activo", F.lit(True)), {"nombre": F.lower("nombre"), "tipo": F.col("tipo")}, state["programas"]))
    names = cut(teachers.select("nombre", "apellidos").distinct())
    prof = cut(upsert(part("profesores", low(names, "nombre", "apellidos")), names.withColumn("activo", F.lit(True)), {"nombre": F.lower("nombre"), "apellidos": F.lower("apellidos")}, state["profesores"]))
    named = deg.withColumn("_k", F.lower("programa_nombre")).join(prog.select(F.lower("nombre").alias("_k"), "tipo", F.col("id").alias("programa_id")), ["_k", "tipo"])
    link = named.join(code, "doc_id").groupBy("programa_id", "asignatura_id").agg(F.max("curso").alias("curso"), F.max("tipo_asignatura").alias("tipo_asignatura"))
    links = upsert(part("enlaces", code.select("asignatura_id")), link, ["programa_id", "asignatura_id"], state["enlaces"])
    who = teachers.join(prof.select(F.lower("nombre").alias("_n"), F.lower("apellidos").alias("_a"), F.col("id").alias("profesor_id")), (F.lower(teachers["nombre"]) == F.col("_n")) & (F.lower(teachers["apellidos"]) == F.col("_a"))).join(code, "doc_id").select("profesor_id", "asignatura_id").distinct()
    who = cut(who)
    stored = part("profesores_asignaturas", code.select("asignatura_id"))
    add, remove = sync_links(stored, who, "asignatura_id", ["profesor_id", "asignatura_id"])
    pa = stored.join(remove, ["profesor_id", "asignatura_id"], "left_anti").unionByName(add)
    return {"asignaturas": asig, "programas": prog, "profesores": prof, "enlaces": links, "profesores_asignaturas": pa}


def read_restrictions(raw: DataFrame) -> tuple[DataFrame, list[str]]:
    """(fila, profesor, dias, franja) of a sheet with any capitals in its headers, and the columns that are missing.

    A column fila, if there is one, is the row's number; blank rows go.
    """
    names = {c: (t if (t := c.strip().title()) != "Días" else "Dias") for c in raw.columns}
    df = raw.toDF(*names.values())
    missing = [c for c in ("Profesor", "Dias", "Franja") if c not in df.columns]
    if missing:
        return raw.sparkSession.createDataFrame([], "fila long, profesor string, dias string, franja string"), missing
    tidy = lambda c: F.when(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "nan", "").otherwise(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    out = df.select((F.col("Fila") if "Fila" in df.columns else F.lit(None)).cast("long").alias("fila"), tidy("Profesor").alias("profesor"), tidy("Dias").alias("dias"), tidy("Franja").alias("franja"))
    return out.where("NOT (profesor = '' AND dias = '' AND franja = '')"), []


def restriction_warnings(rows: DataFrame) -> DataFrame:
    """(fila, message, severity) for the rows that are blank in part; they are tried all the same."""
    blank = rows.where("profesor = '' OR dias = '' OR franja = ''")
    return blank.select("fila", F.concat(F.lit("Fila "), F.col("fila").cast("string"), F.lit(": Contiene celdas en blanco. El parser intentará procesarlo.")).alias("message"), F.lit("minor").alias("severity"))


def expand_restrictions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row a day, (fila, profesor, dia, ini, fin), and rejects (fila, error)."""
    range_ = T.parse_range(F.col("franja"))
    r = rows.withColumns({"_r": range_, "_incompleta": (F.col("profesor") == "") | (F.col("dias") == "") | (F.col("franja") == "")})
    bad = r.where("_incompleta").select("fila", F.lit("incompleta").alias("error")).unionByName(r.where("NOT _incompleta AND _r.error IS NOT NULL").select("fila", F.col("_r.error").alias("error")))
    days = r.where("NOT _incompleta AND _r.error IS NULL").select("fila", "profesor", "_r.ini", "_r.fin", F.explode(F.split("dias", ",")).alias("_d")).withColumn("_d", F.trim("_d")).where("_d <> ''").withColumn("dia", T.map_day_code(F.col("_d")))
    return days.where("dia IS NOT NULL").select("fila", T.norm_name(F.col("profesor")).alias("profesor"), "dia", "ini", "fin"), bad.unionByName(days.where("dia IS NULL").select("fila", F.lit("dia").alias("error")))


def import_restrictions(stored: DataFrame, rows: DataFrame, teachers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new table and the errors. With any error the old table stays; else it is replaced whole."""
    good, bad = expand_restrictions(rows)
    found, lost = match_teachers(good, teachers)
    errors = bad.unionByName(lost.select("fila", F.lit("profesor").alias("error")))
    day = F.array_position(F.array(*map(F.lit, ("lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo"))), F.col("dia")).cast("int") - 1
    new = found.select("profesor_id", day.alias("dia_semana"), "ini", "fin").distinct()
    if not errors.isEmpty():
        return stored, errors
    return new_ids(new, stored.limit(0), ["profesor_id", "dia_semana", "ini", "fin"]).select("id", "profesor_id", "dia_semana", "ini", "fin"), errors


def simulate_changes(s: DataFrame, changes: DataFrame) -> DataFrame:
    """Sessions under edits (op, id, temp_id and session columns), nothing stored: deletes go, updates replace what they give, creates get negative ids."""
    cols = [c for c in s.columns if c != "id"]
    gone = changes.where("op = 'delete'").select("id")
    up = changes.where("op = 'update'").select("id", *[F.col(c).alias(f"_{c}") for c in cols if c in changes.columns])
    kept = s.join(gone, "id", "left_anti").join(up, "id", "left")
    kept = kept.select("id", *[(F.coalesce(f"_{c}", c) if c in changes.columns else F.col(c)).alias(c) for c in cols])
    new = changes.where("op = 'create'").select((-F.abs("temp_id")).alias("id"), *[(F.col(c) if c in changes.columns else F.lit(None).cast(dict(s.dtypes)[c])).alias(c) for c in cols])
    return kept.unionByName(new)


def last_edits(changes: DataFrame) -> DataFrame:
    """Edits with one of each session: a delete, else the last update (by orden, where that is a column). Creates all stay."""
    order = [(F.col("op") != "delete"), *([F.desc("orden")] if "orden" in changes.columns else [])]
    old = C.keep_first(changes.where("op <> 'create'"), ["id"], [*order, *[c for c, t in changes.dtypes if t in ("int", "bigint", "string") and c != "id"]])
    return old.unionByName(changes.where("op = 'create'"))


def created_sessions(s: DataFrame, changes: DataFrame) -> DataFrame:
    """The sessions that changes create, with ids above all of s in the order of their temp_id."""
    cols = [c for c in s.columns if c != "id"]
    new = changes.where("op = 'create'").select(F.abs("temp_id").alias("_t"), *[(F.col(c) if c in changes.columns else F.lit(None).cast(dict(s.dtypes)[c])).alias(c) for c in cols])
    return new_ids(new, s.select("id"), ["_t"]).select(*s.columns)


def apply_session_batch(s: DataFrame, changes: DataFrame) -> DataFrame:
    """As simulate_changes, with lasting ids for what is created."""
    return simulate_changes(s, changes.where("op <> 'create'")).unionByName(created_sessions(s, changes))


def confirm_mentions(state: dict[str, DataFrame], rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mentions (id, programa_id, nombre, activo) with those that rows (programa_id, asignatura_id, mencion, orden) name anew, and the
    links, of which those of the rows' programs and subjects point to the mention named last."""
    named = rows.withColumn("_m", T.clean_mention(F.coalesce("mencion", F.lit("")))).where("_m <> ''")
    wanted = C.keep_first(named.withColumn("_k", F.lower("_m")), ["programa_id", "_k"], ["orden"]).select("programa_id", F.col("_m").alias("nombre"), "_k")
    known = state["menciones"].groupBy("programa_id", F.lower("nombre").alias("_k")).agg(F.min("id").alias("mencion_id"))
    new = wanted.join(known, ["programa_id", "_k"], "left_anti").select("programa_id", "nombre", F.lit(True).alias("activo"))
    mentions = cut(state["menciones"].unionByName(new_ids(new, state["menciones"], ["programa_id", "nombre"]), allowMissingColumns=True))
    ids = mentions.groupBy("programa_id", F.lower("nombre").alias("_k")).agg(F.min("id").alias("_id"))
    last = named.withColumn("_k", F.lower("_m")).join(ids, ["programa_id", "_k"]).groupBy("programa_id", "asignatura_id").agg(F.max_by("_id", "orden").alias("_id"))
    links = state["enlaces"].join(last, ["programa_id", "asignatura_id"], "left").withColumn("mencion_id", F.coalesce("_id", "mencion_id"))
    return mentions, links.select(*state["enlaces"].columns)


def confirm_schedule(state: dict[str, DataFrame], draft: DataFrame, restrictions: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Publishes a draft (plan, mencion, asignatura, texto, elegida, grupo, tipo, curso, aula, dia_semana, ini, fin, orden): the new state, and the errors.

    Plans, subjects and rooms are resolved first; with any error the state
    comes back as it was. Where a row's text (texto, else asignatura) isn't the
    name of the subject chosen by hand (elegida), it becomes an alias. Mentions
    that a plan lacks are made, and the plan's links of the subjects point to
    them. The subjects that the draft touches lose their groups, sessions and
    conflicts, and get the draft's: one group a code, one session a group, day
    and start. Conflicts are found once for all new sessions, with each
    subject's mention by its first link; sessions that stay keep the teachers
    that they have of their own. state has programas, menciones, enlaces,
    asignaturas, aliases, aulas, grupos, sesiones, profesores_sesiones (may be
    missing), profesores_asignaturas and conflictos.
    """
    q = cut(draft.withColumn("qid", F.monotonically_increasing_id()))
    plans = state["programas"].groupBy(F.lower("nombre").alias("_plan")).agg(F.min("id").alias("programa_id"))
    planned = q.withColumn("_plan", F.lower(F.trim(F.coalesce("plan", F.lit(""))))).join(plans, "_plan", "left")
    learnt = q.where("elegida IS NOT NULL").select(F.trim(F.coalesce(F.nullif(F.trim("texto"), F.lit("")), "asignatura", F.lit(""))).alias("texto"), F.col("elegida").alias("asignatura_id"), "orden").where("texto <> ''")
    learnt = learn_aliases(learnt.join(state["asignaturas"].select(F.col("id").alias("asignatura_id"), F.col("nombre").alias("nombre_oficial")), "asignatura_id"), state["aliases"])
    aliases = cut(state["aliases"].unionByName(learnt, allowMissingColumns=True))
    subj = resolve_subjects(q.select("qid", F.col("asignatura").alias("texto")), state["asignaturas"], aliases)
    places = q.select(F.col("aula").alias("qid"), F.col("aula").alias("texto")).distinct()
    room = cut(resolve_rooms(places, state["aulas"]))
    room = q.select("qid", "aula").join(room.select(F.col("qid").alias("aula"), "aula_id", "error"), "aula").drop("aula")
    unknown = planned.where("programa_id IS NULL").select(F.concat(F.lit("Plan no encontrado: "), F.coalesce("plan", F.lit(""))).alias("error"))
    errors = cut(unknown.unionByName(subj.where("error IS NOT NULL").select("error")).unionByName(room.where("error IS NOT NULL").select("error")).distinct())
    if not errors.isEmpty():
        return state, errors
    rows = planned.select("qid", "programa_id", "mencion", "grupo", "tipo", "curso", "dia_semana", "ini", "fin", "orden").join(subj.select("qid", "asignatura_id"), "qid").join(room.select("qid", "aula_id"), "qid")
    rows = cut(rows.withColumn("codigo", F.when(F.upper(F.trim(F.coalesce("grupo", F.lit("")))) == "", "UNICO").otherwise(F.upper(F.trim("grupo")))))
    mentions, links = confirm_mentions(state, rows)
    links = cut(links)
    touched = rows.select("asignatura_id").distinct()
    group = C.keep_first(rows, ["asignatura_id", "codigo"], ["orden"]).select("asignatura_id", "codigo", "tipo", "curso")
    groups = cut(new_ids(group, state["grupos"], ["asignatura_id", "codigo"]))
    old = state["grupos"].join(touched, "asignatura_id", "left_semi").select(F.col("id").alias("grupo_docente_id"))
    lost = state["sesiones"].join(old, "grupo_docente_id", "left_semi").select("id")
    keyed = rows.join(groups.select("asignatura_id", "codigo", F.col("id").alias("grupo_docente_id")), ["asignatura_id", "codigo"])
    session = C.keep_first(keyed, ["grupo_docente_id", "dia_semana", "ini"], ["orden"]).select("grupo_docente_id", "aula_id", "dia_semana", "ini", "fin")
    new = new_ids(session, state["sesiones"], ["grupo_docente_id", "dia_semana", "ini"]).select("id", "grupo_docente_id", "aula_id", "dia_semana", "ini", "fin")
    new = cut(new)
    grupos = state["grupos"].join(touched, "asignatura_id", "left_anti").unionByName(groups, allowMissingColumns=True)
    sesiones = state["sesiones"].join(lost, "id", "left_anti").unionByName(new, allowMissingColumns=True)
    own = state.get("profesores_sesiones")
    own = sesiones.sparkSession.createDataFrame([], "sesion_id long, profesor_id long") if own is None else own.join(lost.withColumnRenamed("id", "sesion_id"), "sesion_id", "left_anti")
    full = sesiones.select("id", "grupo_docente_id", "aula_id", *[c for c in TIMES if c in sesiones.columns]).join(grupos.select(F.col("id").alias("grupo_docente_id"), "asignatura_id", F.col("codigo").alias("grupo_codigo"), F.col("tipo").alias("tipo_grupo"), "curso"), "grupo_docente_id").join(state["asignaturas"].select(F.col("id").alias("asignatura_id"), "periodo"), "asignatura_id")
    full = C.effective_teachers(full, own, state["profesores_asignaturas"])
    full = full.join(C.first_context(links).select("asignatura_id", "mencion_id"), "asignatura_id", "left").withColumn("mencion_ids", F.array_compact(F.array(F.col("mencion_id").cast("bigint")))).drop("mencion_id")
    found = laid(C.detect_for(laid(full, "sesiones"), new.select("id"), restrictions), "conflictos")
    conflicts = sync_session_conflicts(state["conflictos"], found, lost.unionByName(new.select("id")))
    kept = {"profesores_sesiones": own} if "profesores_sesiones" in state else {}
    return state | {"aliases": aliases, "menciones": mentions, "enlaces": links, "grupos": grupos, "sesiones": sesiones, "conflictos": conflicts} | kept, errors


def no_errors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "error string")


def delete_schedule(s: DataFrame, links: DataFrame, programa_id: int, curso: int, periodo: str, mencion_id: int | None = None) -> tuple[DataFrame, int]:
    """Sessions without those of one program, course, half-year and mention (None: links without one), and how many went."""
    mention = F.col("mencion_id").isNull() if mencion_id is None else F.col("mencion_id") == mencion_id
    keys = links.where((F.col("programa_id") == programa_id) & (F.col("curso") == curso) & mention).select("asignatura_id").distinct()
    gone = s.where(F.col("periodo") == periodo).join(keys, "asignatura_id", "left_semi").select("id")
    return s.join(gone, "id", "left_anti"), gone.count()


def soft_delete(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct().withColumn("_d", F.lit(True)), "id", "left").withColumn("activo", F.when(F.col("_d"), False).otherwise(F.col("activo"))).drop("_d")


def _reached(tables: dict[str, DataFrame], start: dict[str, DataFrame], steps: list[tuple[str, str, str, bool]]) -> dict[str, DataFrame]:
    """Ids by table that start leads to: a step (parent, child, key, down) goes from parents to the children that refer to them, or up from children."""
    found = {t: cut(df.select("id").distinct()) for t, df in start.items()}
    edge = dict(found)
    while edge:
        new: dict[str, DataFrame] = {}
        for parent, child, key, down in steps:
            if (parent if down else child) not in edge:
                continue
            if down:
                to, ids = child, tables[child].join(edge[parent].select(F.col("id").alias(key)), key, "left_semi").select("id")
            else:
                to, ids = parent, tables[child].join(edge[child], "id", "left_semi").select(F.col(key).alias("id")).where("id IS NOT NULL")
            new[to] = new[to].unionByName(ids) if to in new else ids
        edge = {}
        for t, ids in new.items():
            ids = ids.distinct()
            ids = cut(ids.join(found[t], "id", "left_anti") if t in found else ids)
            if not ids.isEmpty():
                edge[t] = ids
                found[t] = found[t].unionByName(ids) if t in found else ids
    return found


def cascade_delete(tables: dict[str, DataFrame], table: str, ids: DataFrame, rules: list[tuple[str, str, str, str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Deletes rows and what hangs on them by rules (parent, child, key, cascade | restrict | set_null); the new tables, and those of ids that are held back.

    First all that would go is found, down every cascade. A row of it that
    another refers to by a restrict rule is held, and so is every row whose
    deletion would take it along, up to ids. What the others lead to is then
    deleted, whole, and references to it by a set_null rule become null. Rules
    may meet again (a diamond) or come back to a table (a cycle, or a table that
    refers to itself).
    """
    cascades = [(p, c, k) for p, c, k, how in rules if how == "cascade"]
    seeds = ids.select("id").join(tables[table], "id", "left_semi").distinct()
    doomed = _reached(tables, {table: seeds}, [(*r, True) for r in cascades])
    held: dict[str, DataFrame] = {}
    for parent, child, key, how in rules:
        if how == "restrict" and parent in doomed:
            used = doomed[parent].join(tables[child].select(F.col(key).alias("id")), "id", "left_semi")
            held[parent] = held[parent].unionByName(used) if parent in held else used
    up = _reached({t: df.join(doomed[t], "id", "left_semi") if t in doomed else df.limit(0) for t, df in tables.items()}, held, [(*r, False) for r in cascades]) if held else {}
    back = cut(seeds.join(up[table], "id", "left_semi")) if table in up else cut(seeds.limit(0))
    gone = _reached(tables, {table: seeds.join(back, "id", "left_anti")}, [(*r, True) for r in cascades])
    out = {t: df.join(gone[t], "id", "left_anti") if t in gone else df for t, df in tables.items()}
    for parent, child, key, how in rules:
        if how == "set_null" and parent in gone:
            refs = gone[parent].select(F.col("id").alias(key), F.lit(True).alias("_d"))
            out[child] = out[child].join(refs, key, "left").withColumn(key, F.when(F.col("_d").isNull(), F.col(key))).drop("_d").select(*tables[child].columns)
    return out, back


def check_constraints(df: DataFrame, *, unique: list[str] | None = None, ignore_case: bool = True, refs: dict[str, DataFrame] | None = None, checks: dict[str, Column] | None = None) -> DataFrame:
    """(regla, clave, n): keys that repeat, references that lead nowhere, and checks that fail. A key with a null in it repeats none, and a null check doesn't fail."""
    parts = []
    if unique:
        key = {f"_k{i}": F.lower(F.col(c).cast("string")) if ignore_case else F.col(c).cast("string") for i, c in enumerate(unique)}
        again = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in unique)).groupBy(*[k.alias(n) for n, k in key.items()]).agg(F.count("*").alias("n")).where("n > 1")
        parts.append(again.select(F.lit("unico").alias("regla"), F.concat_ws("|", *key).alias("clave"), "n"))
    for c, dim in (refs or {}).items():
        lost = df.where(F.col(c).isNotNull()).join(dim.select(F.col("id").alias(c)), c, "left_anti")
        parts.append(lost.groupBy(F.col(c).cast("string").alias("clave")).agg(F.count("*").alias("n")).select(F.lit(f"referencia:{c}").alias("regla"), "clave", "n"))
    for name, test in (checks or {}).items():
        parts.append(df.where(~test).agg(F.count("*").alias("n")).where("n > 0").select(F.lit(f"control:{name}").alias("regla"), F.lit("").alias("clave"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def propagate_edits(draft: DataFrame, edits: DataFrame, common: tuple[str, ...] = ("basica", "obligatoria", "troncal")) -> DataFrame:
    """Draft sessions (id, bloque, curso, asignatura, grupo, tipo_asignatura, aula, dia, ini, fin) under edits (id and new aula, dia, ini, fin).

    An edit of a common subject also moves the sessions with the same folded
    name and group in other blocks of the course; a move without an end keeps
    the duration.
    """
    key = lambda df: df.withColumns({"_n": T.fold_key(F.coalesce("asignatura", F.lit(""))), "_g": T.fold_key(F.coalesce("grupo", F.lit("")))})
    e = edits.select("id", *[F.col(c).alias(f"e_{c}") for c in ("aula", "dia", "ini", "fin")])
    own = key(draft.join(e, "id")).where(F.lower("tipo_asignatura").isin(*common))
    own = own.withColumn("e_fin", F.coalesce("e_fin", F.col("e_ini") + F.col("fin") - F.col("ini")))
    spread = C.keep_first(own, ["curso", "_n", "_g"], ["id"]).select("curso", "_n", "_g", F.col("bloque").alias("s_bloque"), *[F.col(f"e_{c}").alias(f"s_{c}") for c in ("aula", "dia", "ini", "fin")])
    out = key(draft).join(e, "id", "left").join(spread, ["curso", "_n", "_g"], "left")
    other = F.col("s_bloque").isNotNull() & (F.col("s_bloque") != F.col("bloque"))
    pick = lambda c: F.coalesce(f"e_{c}", F.when(other, F.col(f"s_{c}")), c)
    end = F.coalesce("e_fin", F.when(F.col("e_ini").isNotNull(), F.col("e_ini") + F.col("fin") - F.col("ini")), F.when(other, F.col("s_fin")), "fin")
    return out.select(*[{"aula": pick("aula"), "dia": pick("dia"), "ini": pick("ini"), "fin": end}.get(c, F.col(c)).alias(c) for c in draft.columns])


def seed_rooms(stored: DataFrame, seed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored rooms with the seed rows whose code is absent, and one row inserted, skipped."""
    first = C.keep_first(seed, ["codigo"], ["nombre"])
    new = first.join(stored.select("codigo"), "codigo", "left_anti")
    counts = seed.join(stored.select("codigo").distinct().withColumn("_k", F.lit(True)), "codigo", "left").agg(F.countDistinct(F.when(F.col("_k").isNull(), F.col("codigo"))).alias("insertadas"), F.count("*").alias("_n"))
    return stored.unionByName(new_ids(new, stored, ["codigo"]), allowMissingColumns=True), counts.select("insertadas", (F.col("_n") - F.col("insertadas")).alias("omitidas"))


def record_run(runs: DataFrame, run_id: str, results: DataFrame) -> DataFrame:
    """Lineage with one more run: its state (error if any block failed) and counts by block state."""
    new = results.groupBy().agg(F.count("*").alias("bloques"), F.sum((F.col("estado") == "error").cast("int")).alias("errores"))
    new = new.select(F.lit(run_id).alias("run_id"), F.when(F.col("errores") > 0, "con_errores").otherwise("completado").alias("estado"), "bloques", F.coalesce("errores", F.lit(0)).cast("long").alias("errores"))
    return runs.unionByName(new)


def record_blocks(lineage: dict[str, DataFrame], results: DataFrame) -> dict[str, DataFrame]:
    """Lineage of documents, runs and extracted blocks after results (documento, tipo, ruta, run_id, bloque, contenido, estado).

    documentos (id, nombre, tipo, ruta) gets the documents that it lacks, by
    name; import_runs (id, documento_id, run_id, estado, bloques, errores) a row
    for every document of a run, with its state; extracciones (id,
    import_run_id, documento_id, tipo, bloque, contenido) a row for every block
    that didn't fail. Rows are only added.
    """
    named = C.keep_first(results, ["documento"], ["ruta", "tipo"]).select(F.col("documento").alias("nombre"), "tipo", "ruta")
    new = named.join(lineage["documentos"].select("nombre"), "nombre", "left_anti")
    docs = cut(lineage["documentos"].unionByName(new_ids(new, lineage["documentos"], ["nombre"])))
    of = docs.select(F.col("nombre").alias("documento"), F.col("id").alias("documento_id"))
    failed = F.sum((F.col("estado") == "error").cast("int"))
    runs = results.groupBy("documento", "run_id").agg(F.count("*").alias("bloques"), F.coalesce(failed, F.lit(0)).cast("long").alias("errores"))
    runs = runs.withColumn("estado", F.when(F.col("errores") > 0, "con_errores").otherwise("completado")).join(of, "documento").drop("documento")
    runs = cut(new_ids(runs, lineage["import_runs"], ["run_id", "documento_id"]))
    blocks = results.where("estado <> 'error'").join(of, "documento").join(runs.select("run_id", "documento_id", F.col("id").alias("import_run_id")), ["run_id", "documento_id"]).select("import_run_id", "documento_id", "tipo", "bloque", "contenido")
    blocks = lineage["extracciones"].unionByName(new_ids(blocks, lineage["extracciones"], ["import_run_id", "bloque"]))
    return {"documentos": docs, "import_runs": lineage["import_runs"].unionByName(runs), "extracciones": blocks}
