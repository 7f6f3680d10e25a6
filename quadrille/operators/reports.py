"""Searches, listings, pages, counts and summaries of schedules and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.text import fold_key, to_hhmm
from quadrille.operators.conflicts import SEVERITY_RANK, severity_rank

DAYS = ("lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo")


def where_all(df: DataFrame, **equal) -> DataFrame:
    """Rows equal to every value that is given; None doesn't filter."""
    for k, v in equal.items():
        if v is not None:
            df = df.where(F.col(k) == F.lit(v))
    return df


def search_conflicts(df: DataFrame, *, sesion: int | None = None, **equal) -> DataFrame:
    """Conflicts by tipo, severidad, estado, profesor_id, aula_id, and by a session on either side."""
    df = where_all(df, **equal)
    return df if sesion is None else df.where((F.col("sesion_id") == sesion) | (F.col("sesion_2_id") == sesion))


def search_sessions(s: DataFrame, links: DataFrame, *, programa_id: int | None = None, curso: int | None = None, mencion_id: int | None = None, profesor_id: int | None = None, desde=None, hasta=None, **equal) -> DataFrame:
    """Sessions by their own columns, a teacher, the program, course and mention of a link of their subject, and dates: dated sessions
    (inicio, fin_ts) that begin no earlier than desde and end no later than hasta. A session comes once, however many links fit."""
    s = where_all(s, **equal)
    if desde is not None:
        s = s.where(F.col("inicio") >= F.lit(desde))
    if hasta is not None:
        s = s.where(F.col("fin_ts") <= F.lit(hasta))
    if profesor_id is not None:
        s = s.where(F.array_contains("profesor_ids", F.lit(profesor_id)))
    if programa_id is None and curso is None and mencion_id is None:
        return s
    return s.join(where_all(links, programa_id=programa_id, curso=curso, mencion_id=mencion_id).select("asignatura_id"), "asignatura_id", "left_semi")


def search_subjects(df: DataFrame, **equal) -> DataFrame:
    return where_all(df, **equal).orderBy("codigo_plan")


def search_rooms(df: DataFrame, *, texto: str | None = None, min_capacidad: int | None = None, max_capacidad: int | None = None, **equal) -> DataFrame:
    df = where_all(df, **equal)
    if texto:
        df = df.where(F.lower("nombre").contains(texto.lower()) | F.lower("codigo").contains(texto.lower()))
    if min_capacidad is not None:
        df = df.where(F.col("capacidad") >= min_capacidad)
    if max_capacidad is not None:
        df = df.where(F.col("capacidad") <= max_capacidad)
    return df.orderBy("codigo")


def listing(df: DataFrame, *order: str, **equal) -> DataFrame:
    """Programs, mentions, groups, teachers: filtered and ordered."""
    return where_all(df, **equal).orderBy(*order)


def common_filters(df: DataFrame, *, activo: bool | None = None, nombre: str | None = None, desde=None, hasta=None, min_severidad: str | None = None) -> DataFrame:
    if activo is not None:
        df = df.where(F.col("activo") == activo)
    if nombre:
        df = df.where(F.col("nombre").ilike(f"%{nombre}%"))
    if desde is not None:
        df = df.where(F.col("creado_en") >= F.lit(desde))
    if hasta is not None:
        df = df.where(F.col("creado_en") <= F.lit(hasta))
    return df if min_severidad is None else df.where(severity_rank(F.col("severidad")) >= SEVERITY_RANK[min_severidad])


def text_filter(df: DataFrame, q: str, cols: list[str]) -> DataFrame:
    """Rows with q in one of the columns, capitals and accents aside; a column can be an array of texts."""
    needle = fold_key(F.lit(q.strip()))
    kinds = dict(df.dtypes)
    test = F.lit(False)
    for c in cols:
        hit = F.exists(c, lambda x: fold_key(x).contains(needle)) if kinds[c].startswith("array") else fold_key(F.col(c)).contains(needle)
        test = test | F.coalesce(hit, F.lit(False))
    return df.where(test)


def status_of(df: DataFrame) -> Column:
    """error without a match, valid if exact or validated by hand, else a suggestion."""
    return F.when(F.coalesce("manual", F.lit(False)) | (F.col("estado") == "EXACT"), "valid").when(F.col("estado") == "NO_MATCH", "error").otherwise("suggestion")


def pending_review(df: DataFrame) -> DataFrame:
    return df.where(status_of(df) != "valid")


def review_counts(df: DataFrame, *keys: str) -> DataFrame:
    s = status_of(df)
    return df.groupBy(*keys).agg(F.sum((s == "error").cast("int")).alias("errors"), F.sum((s == "suggestion").cast("int")).alias("suggestions"))


def review_order(df: DataFrame, *within: str) -> DataFrame:
    """Adds pos, the place of a row among those to review: errors first, then suggestions, then by day and time. within names columns that
    have an order of their own for each of their values; without any, rows come sorted and without pos, as no task numbers all of them."""
    rank = F.when(status_of(df) == "error", 0).when(status_of(df) == "suggestion", 1).otherwise(2)
    order = [rank, F.col("dia_semana"), F.col("ini"), F.col("id")]
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*within).orderBy(*order))) if within else df.orderBy(*order)


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds errores: the names of the rules that a row breaks; a rule that is null holds."""
    return df.withColumn("errores", F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()])))


# The kinds of rooms, programs and groups.
ROOM_KINDS = ("teorica", "laboratorio", "informatica", "seminario", "taller", "auditorio", "biblioteca", "gimnasio", "virtual")
PROGRAM_KINDS = ("grado", "master", "doctorado", "curso_especializacion")
GROUP_KINDS = ("teoria", "practica", "laboratorio", "seminario", "taller", "tutoria", "examen")


def entity_rules(entity: str = "asignatura") -> dict[str, Column]:
    """The rules of a subject, room (aula), program, mention, alias or group (grupo) by name. Texts count without blanks at the ends and with single ones within."""
    c = F.col
    size = lambda n, most: F.length(F.trim(F.regexp_replace(c(n), r"\s+", " "))).between(1, most)
    there = lambda n: c(n).isNotNull() & (c(n) > 0)
    return {
        "asignatura": {"ects": c("ects").between(1, 12), "modalidad": c("modalidad").isin("presencial", "online", "semipresencial", "hibrida"), "idioma": c("idioma").isin("español", "ingles", "frances", "aleman", "italiano", "portugues", "catalan", "euskera", "gallego"), "codigo": F.length("codigo_plan") <= 6, "nombre": F.length(F.trim("nombre")).between(1, 250)},
        "aula": {"nombre": c("nombre").isNotNull() & size("nombre", 200), "codigo": c("codigo").isNotNull() & size("codigo", 50), "tipo": c("tipo").isNotNull() & c("tipo").isin(*ROOM_KINDS), "capacidad": c("capacidad") > 0},
        "programa": {"nombre": c("nombre").isNotNull() & size("nombre", 200), "tipo": c("tipo").isNotNull() & c("tipo").isin(*PROGRAM_KINDS)},
        "mencion": {"programa": there("programa_id"), "nombre": c("nombre").isNotNull() & size("nombre", 200)},
        "alias": {"asignatura": there("asignatura_id"), "alias": c("alias").isNotNull() & size("alias", 250)},
        "grupo": {"asignatura": there("asignatura_id"), "codigo": c("codigo").isNotNull() & size("codigo", 50), "tipo": c("tipo").isNotNull() & c("tipo").isin(*GROUP_KINDS), "curso": c("curso").between(1, 6)},
    }[entity]


def validate_session(df: DataFrame) -> DataFrame:
    """One-off sessions have start and end and no weekly slot; others have a slot and no dates; what starts, ends later."""
    c = F.col
    once = c("tipo_recurrencia") == "puntual"
    slot, dates = c("dia_semana").isNotNull() & c("ini").isNotNull() & c("fin").isNotNull(), c("inicio").isNotNull() & c("fin_ts").isNotNull()
    any_slot, any_date = c("dia_semana").isNotNull() | c("ini").isNotNull() | c("fin").isNotNull(), c("inicio").isNotNull() | c("fin_ts").isNotNull()
    return validate(df, {"faltan_fechas": ~once | dates, "sobra_horario": ~once | ~any_slot, "falta_horario": once | slot, "sobran_fechas": once | ~any_date, "orden_horas": c("ini") < c("fin"), "orden_fechas": c("inicio") < c("fin_ts")})


def paginate(df: DataFrame, order: list, skip: int = 0, limit: int = 100, cap: int = 100) -> DataFrame:
    """One page, with the total and the page's number; order should end in a key, so that pages don't overlap."""
    limit = min(limit, cap)
    total = df.count()
    return df.orderBy(*order).offset(skip).limit(limit).withColumns({"total": F.lit(total).cast("long"), "pagina": F.lit(skip // limit + 1)})


def sort_by(df: DataFrame, col: str | None = None, desc: bool = False) -> DataFrame:
    c = F.col(col if col in df.columns else "id")
    return df.orderBy(c.desc() if desc else c.asc(), "id")


def ordered_restrictions(df: DataFrame) -> DataFrame:
    return df.orderBy("dia_semana", "ini", "id")


def subject_counts(subjects: DataFrame, links: DataFrame, teachers: DataFrame) -> DataFrame:
    n = lambda df, name: df.groupBy(F.col("asignatura_id").alias("id")).agg(F.count("*").alias(name))
    out = subjects.select("id").join(n(links, "n_programas"), "id", "left").join(n(teachers, "n_profesores"), "id", "left")
    return out.na.fill(0, ["n_programas", "n_profesores"])


def teacher_counts(teachers: DataFrame, restrictions: DataFrame) -> DataFrame:
    n = restrictions.groupBy(F.col("profesor_id").alias("id")).agg(F.count("*").alias("n_restricciones"))
    return teachers.select("id").join(n, "id", "left").na.fill(0, ["n_restricciones"])


def facets(df: DataFrame, cols: list[str], chosen: dict[str, str] | None = None) -> DataFrame:
    """(faceta, valor, n): counts of each column's values among rows that fit the choices in the other columns.

    One scan: a grouping set a column, and a count a column of the rows that
    fit all choices but its own, of which a set takes its column's.
    """
    fits = {k: F.coalesce(F.col(k) == v, F.lit(False)) for k, v in (chosen or {}).items()}

    def others(c: str) -> Column:
        out = F.lit(True)
        for k, fit in fits.items():
            out = out & fit if k != c else out
        return out

    masked = df.select(*cols, *[others(c).alias(f"_fits_{i}") for i, c in enumerate(cols)])
    counts = [F.count_if(f"_fits_{i}").alias(f"_n_{i}") for i in range(len(cols))]
    sets = masked.groupingSets([[c] for c in cols], *cols).agg(*counts, *[F.grouping(c).alias(f"_g_{i}") for i, c in enumerate(cols)])
    mine = [F.col(f"_g_{i}") == 0 for i in range(len(cols))]
    value = F.coalesce(*[F.when(m, F.struct(F.lit(c).alias("faceta"), F.col(c).cast("string").alias("valor"), F.col(f"_n_{i}").alias("n"))) for i, (c, m) in enumerate(zip(cols, mine))])
    return sets.select(value.alias("f")).select("f.*").where("n > 0")


def import_stats(actions: DataFrame) -> DataFrame:
    return actions.groupBy("run_id").pivot("action", ["created", "updated", "removed", "error", "warning"]).agg(F.count(F.lit(1))).na.fill(0)


def schedule_summary(sessions: DataFrame, links: DataFrame, conflicts: DataFrame, *, programa_id: int | None = None, curso: int | None = None, periodo: str | None = None) -> DataFrame:
    """Per program, course, period and mention: subjects, sessions, open conflicts (by key) and whether there are any.

    A subject counts for the program asked for, else for its first one.
    """
    links = where_all(links, programa_id=programa_id)
    context = links.groupBy("asignatura_id").agg(F.min_by(F.struct("programa_id", F.coalesce("curso", F.lit(1)).alias("curso"), "mencion_id"), "id").alias("c"))
    s = where_all(sessions, periodo=periodo).join(context, "asignatura_id").select("id", "asignatura_id", "periodo", "c.*")
    s = where_all(s, curso=curso)
    sides = conflicts.where("estado = 'por_revisar'").select("hash", F.explode(F.array("sesion_id", "sesion_2_id")).alias("id")).where("id IS NOT NULL")
    keys = ["programa_id", "curso", "periodo", "mencion_id"]
    counts = s.groupBy(*keys).agg(F.countDistinct("asignatura_id").alias("total_asignaturas"), F.count("*").alias("total_sesiones"))
    hashes = s.join(sides, "id").groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.countDistinct("hash").alias("conflictos"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = counts.join(hashes, on, "left").drop(*[f"_{k}" for k in keys]).withColumn("conflictos", F.coalesce("conflictos", F.lit(0)))
    return out.withColumn("estado", F.when(F.col("conflictos") > 0, "conflicto").otherwise("ok")).orderBy("programa_id", "curso", "periodo")


def session_summary(s: DataFrame, links: DataFrame) -> DataFrame:
    """(id, grupo, curso_label, horario, programa_id): the link whose course is the group's goes before the first."""
    best = s.select("id", "asignatura_id", "curso").join(links.select("asignatura_id", F.col("id").alias("_l"), "programa_id", F.col("curso").alias("_c")), "asignatura_id", "left")
    best = best.groupBy("id").agg(F.min_by("programa_id", F.struct(F.when(F.col("_c") == F.col("curso"), 0).otherwise(1).alias("o"), "_l")).alias("programa_id"))
    label = F.when(F.coalesce("curso", F.lit(0)) > 0, F.concat(F.col("curso").cast("string"), F.lit("°"))).otherwise("Optativa")
    day = F.element_at(F.array(*map(F.lit, DAYS)), F.col("dia_semana") + 1)
    return s.join(best, "id").select("id", F.concat_ws(" ", "tipo_grupo", "grupo_codigo").alias("grupo"), label.alias("curso_label"), F.concat(day, F.lit(" "), to_hhmm(F.col("ini")), F.lit("-"), to_hhmm(F.col("fin"))).alias("horario"), "programa_id")


def conflict_details(conflicts: DataFrame, summary: DataFrame) -> DataFrame:
    """Conflicts with the summaries of both sessions."""
    side = lambda n: summary.select(*[F.col(c).alias(f"{c}_{n}") for c in summary.columns])
    return conflicts.join(side(1), F.col("sesion_id") == F.col("id_1"), "left").join(side(2), F.col("sesion_2_id") == F.col("id_2"), "left").drop("id_1", "id_2")


def bridge(left: DataFrame, links: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Both sides of a many-to-many link: (left_key, right_key, nombre of the right)."""
    return left.select(F.col("id").alias(left_key)).join(links.select(left_key, right_key).distinct(), left_key).join(right.select(F.col("id").alias(right_key), "nombre"), right_key).select(left_key, right_key, "nombre")


def grid_sessions(s: DataFrame, subjects: DataFrame, rooms: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Sessions with the names of subject and room, and a colour: conflict, new, edited, or none."""
    open_ids = conflicts.where("estado = 'por_revisar'").select(F.explode(F.array("sesion_id", "sesion_2_id")).alias("id"), F.lit(True).alias("_c")).distinct()
    out = s.join(subjects.select(F.col("id").alias("asignatura_id"), F.col("nombre").alias("asignatura")), "asignatura_id", "left").join(rooms.select(F.col("id").alias("aula_id"), F.col("nombre").alias("aula")), "aula_id", "left").join(open_ids, "id", "left")
    colour = F.when(F.col("_c"), "conflicto").when(F.col("op") == "create", "nueva").when(F.col("op") == "update", "editada").otherwise("normal")
    return out.select("id", "asignatura", "aula", "dia_semana", "ini", "fin", colour.alias("color"))


def slot_occupancy(s: DataFrame, start: int, end: int, step: int, *keys: str) -> DataFrame:
    """(keys, dia_semana, hueco, n): sessions in each slot of step minutes between start and end."""
    first, last = F.greatest(F.col("ini"), F.lit(start)), F.least(F.col("fin"), F.lit(end))
    slots = F.sequence(F.floor((first - start) / step), F.ceil((last - start) / step) - 1)
    return s.where(first < last).select(*keys, "dia_semana", F.explode(slots).alias("hueco")).groupBy(*keys, "dia_semana", "hueco").agg(F.count("*").alias("n"))


def overlap_clusters(s: DataFrame, keys: list[str]) -> DataFrame:
    """Adds cluster: sessions of a key and day that hang together; one starts where no earlier one still runs."""
    order = Window.partitionBy(*keys, "dia_semana").orderBy("ini", "fin", "id")
    before = F.max("fin").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("ini") >= before), 1).otherwise(0)
    return s.withColumn("_f", fresh).withColumn("cluster", F.sum("_f").over(order)).drop("_f")


def assign_lanes(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Adds lane, the first that is free in start order, and lanes, how many the cluster needs; a fold over each cluster's sorted sessions."""
    each = F.array_sort(F.collect_list(F.struct("ini", "fin", "id")))
    start = F.expr("named_struct('ends', CAST(array() AS array<int>), 'out', CAST(array() AS array<struct<id:bigint,lane:int>>))")

    def step(acc: Column, x: Column) -> Column:
        ends = acc["ends"]
        free = F.array_position(F.transform(ends, lambda e: e <= x["ini"]), True).cast("int")
        lane = F.when(free > 0, free).otherwise(F.size(ends) + 1)
        now = F.when(free > 0, F.transform(ends, lambda e, i: F.when(i + 1 == free, x["fin"]).otherwise(e))).otherwise(F.concat(ends, F.array(x["fin"])))
        return F.struct(now.alias("ends"), F.concat(acc["out"], F.array(F.struct(x["id"].alias("id"), (lane - 1).alias("lane")))).alias("out"))

    done = clusters.groupBy(*keys, "dia_semana", "cluster").agg(F.aggregate(each, start, step).alias("a"))
    lanes = done.select(F.explode("a.out").alias("o"), F.size("a.ends").alias("lanes")).select("o.id", "o.lane", "lanes")
    return clusters.join(lanes, "id")
