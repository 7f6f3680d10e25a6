"""Detection of clashes between sessions: rooms, teachers, cohorts, restrictions; severity, key, description, first of equals.

A session has id, aula_id, profesor_ids (array), asignatura_id, curso, periodo,
tipo_grupo, grupo_codigo, mencion_ids (array), dia_semana (0 is Monday), ini and
fin (minutes from midnight); other columns may be there. Where inicio and fin_ts
are among them, a session without a weekly slot is held once, between them. In
a pair the first session is the one with the lower id. mixed and dates of the
three overlap rules are those of session_pairs.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.operators.intervals import TIMES, held_between, interval_pairs, overlaps, session_pairs
from quadrille.sources.storage import cut

ROOM, TEACHER, COHORT, RESTRICTION = "solapamiento_aula", "solapamiento_profesor", "solapamiento_grupo", "incumplimiento_restriccion"
CRITICAL, MILD = "critico", "no_bloqueante"
SEVERITY_RANK = {"leve": 1, MILD: 2, CRITICAL: 3}
#: Minutes; a session lasts from half an hour to two hours, so that it touches few bins.
BIN = 60

INNER = "Incompatibilidad interna: Teoría se solapa con otra sesión."
LEVEL = "Incoherencia del Plan de Estudios (Asignaturas del mismo nivel solapadas)."


def _weekly(s: DataFrame) -> DataFrame:
    return s.where("dia_semana IS NOT NULL AND ini IS NOT NULL AND fin IS NOT NULL")


def _period(period_aware: bool) -> list[str]:
    return [] if period_aware else ["periodo"]


def _same_time_of_year(period_aware: bool) -> Column:
    """With period_aware, sessions of whole years meet those of halves too."""
    if not period_aware:
        return F.lit(True)
    return (F.col("a.periodo") == F.col("b.periodo")) | (F.col("a.periodo") == "anual") | (F.col("b.periodo") == "anual")


#: Where a frame of sessions has this column, only pairs count of which one has it true.
MINE = "_mine"


def _times(s: DataFrame) -> list[str]:
    return [c for c in (*TIMES, MINE) if c in s.columns]


def _pairs(s: DataFrame, keys: list[str], period_aware: bool, width: int, mixed: bool, dates: tuple[datetime, datetime] | None) -> DataFrame:
    pairs = session_pairs(s, [*keys, *_period(period_aware)], width, mixed=mixed, dates=dates).where(_same_time_of_year(period_aware))
    return pairs.where(F.col(f"a.{MINE}") | F.col(f"b.{MINE}")) if MINE in s.columns else pairs


def room_overlaps(s: DataFrame, *, period_aware: bool = False, width: int = BIN, mixed: bool = False, dates: tuple[datetime, datetime] | None = None) -> DataFrame:
    """(s1, s2, aula_id): sessions at the same time in the same room and period; sessions without a room are left out."""
    s = s.where("aula_id IS NOT NULL").select("id", "aula_id", "periodo", *_times(s))
    pairs = _pairs(s, ["aula_id"], period_aware, width, mixed, dates)
    return pairs.select(F.col("a.id").alias("s1"), F.col("b.id").alias("s2"), F.col("a.aula_id").alias("aula_id"))


def teacher_overlaps(s: DataFrame, *, period_aware: bool = False, width: int = BIN, mixed: bool = False, dates: tuple[datetime, datetime] | None = None) -> DataFrame:
    """(s1, s2, profesor_id, alone): sessions at the same time with a teacher in common; alone if both have no other teacher."""
    s = s.select("id", "periodo", *_times(s), (F.size("profesor_ids") == 1).alias("alone"), F.explode("profesor_ids").alias("profesor_id"))
    pairs = _pairs(s, ["profesor_id"], period_aware, width, mixed, dates)
    return pairs.select(F.col("a.id").alias("s1"), F.col("b.id").alias("s2"), F.col("a.profesor_id").alias("profesor_id"), (F.col("a.alone") & F.col("b.alone")).alias("alone"))


def cohort_overlaps(s: DataFrame, *, extra_keys: tuple[str, ...] = (), period_aware: bool = False, width: int = BIN, mixed: bool = False, dates: tuple[datetime, datetime] | None = None) -> DataFrame:
    """(s1, s2, asignatura_comun, motivo, asignatura_id): sessions that the students of one course would have at the same time.

    Mentions that are known on both sides must have one in common. Sessions of
    the same subject clash if either is theory or their group codes are equal;
    those of different subjects always do. asignatura_comun is 0 for the
    latter, and asignatura_id is the first session's.
    """
    pairs = _cohort_pairs(s, extra_keys=extra_keys, period_aware=period_aware, width=width, mixed=mixed, dates=dates)
    return pairs.select("s1", "s2", "asignatura_comun", _reason(F.col("_same"), F.col("_theory"), F.col("_code")).alias("motivo"), "asignatura_id")


def _reason(same: Column, theory: Column, code: Column) -> Column:
    """Why two sessions clash; code is that of both groups, if they have the same."""
    return F.when(~same, LEVEL).when(theory, INNER).when(code.isNotNull(), F.concat(F.lit("Solapamiento de subgrupo idéntico ("), code, F.lit(").")))


def _cohort_pairs(s: DataFrame, *, extra_keys: tuple[str, ...] = (), period_aware: bool = False, width: int = BIN, mixed: bool = False, dates: tuple[datetime, datetime] | None = None) -> DataFrame:
    """The pairs of cohort_overlaps with what their reason follows from (_same, _theory, _code), and the first session's _curso and _periodo."""
    s = s.select("id", F.coalesce("curso", F.lit(0)).alias("curso"), F.coalesce("periodo", F.lit("")).alias("periodo"), *_times(s), "asignatura_id", F.upper("tipo_grupo").contains("TEORIA").alias("theory"), "grupo_codigo", F.coalesce("mencion_ids", F.array().cast("array<bigint>")).alias("mencion_ids"), *extra_keys)
    pairs = _pairs(s, ["curso", *extra_keys], period_aware, width, mixed, dates)
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    apart = (F.size(a("mencion_ids")) > 0) & (F.size(b("mencion_ids")) > 0) & ~F.arrays_overlap(a("mencion_ids"), b("mencion_ids"))
    same, theory, code = a("asignatura_id") == b("asignatura_id"), a("theory") | b("theory"), F.when(a("grupo_codigo") == b("grupo_codigo"), a("grupo_codigo"))
    pairs = pairs.where(~apart & _reason(same, theory, code).isNotNull())
    return pairs.select(a("id").alias("s1"), b("id").alias("s2"), F.when(same, a("asignatura_id")).otherwise(0).alias("asignatura_comun"), a("asignatura_id").alias("asignatura_id"), same.alias("_same"), theory.alias("_theory"), code.alias("_code"), a("curso").alias("_curso"), a("periodo").alias("_periodo"))


def restriction_violations(s: DataFrame, r: DataFrame, *, dates: tuple[datetime, datetime] | None = None) -> DataFrame:
    """(s1, restriccion_id, profesor_id, r_ini, r_fin): weekly sessions while one of their teachers isn't available, on some date of the range if there is one."""
    s = (s.where(MINE) if MINE in s.columns else s).transform(_weekly).select(F.col("id").alias("s1"), "dia_semana", "ini", "fin", F.explode("profesor_ids").alias("profesor_id"))
    r = r.select(F.col("id").alias("restriccion_id"), "profesor_id", "dia_semana", F.col("ini").alias("r_ini"), F.col("fin").alias("r_fin"))
    met = s.join(r, ["profesor_id", "dia_semana"]).where(overlaps(F.col("ini"), F.col("fin"), F.col("r_ini"), F.col("r_fin")))
    if dates is not None:
        met = met.where(held_between(dates, F.col("dia_semana"), F.greatest("ini", "r_ini"), F.least("fin", "r_fin")))
    return met.select("s1", "restriccion_id", "profesor_id", "r_ini", "r_fin")


def dated_overlaps(s: DataFrame, key: str, *, period: bool = True, width_s: int = 6 * 3600) -> DataFrame:
    """(s1, s2, key): dated sessions, from inicio to fin_ts, at the same time on the same resource and in the same period."""
    keys = [key, *(["periodo"] if period else [])]
    t = s.where(F.col(key).isNotNull() & F.col("inicio").isNotNull() & F.col("fin_ts").isNotNull())
    t = t.select("id", *keys, F.unix_micros(F.col("inicio").cast("timestamp")).alias("u0"), F.unix_micros(F.col("fin_ts").cast("timestamp")).alias("u1"))
    pairs = interval_pairs(t, keys, "u0", "u1", width_s * 1_000_000)
    return pairs.select(F.col("a.id").alias("s1"), F.col("b.id").alias("s2"), F.col(f"a.{key}").alias(key))


def effective_teachers(s: DataFrame, session_teachers: DataFrame, subject_teachers: DataFrame) -> DataFrame:
    """Adds profesor_ids: those of the session, or if it has none those of its subject; sorted."""
    own = session_teachers.groupBy(F.col("sesion_id").alias("id")).agg(F.array_sort(F.collect_set("profesor_id")).alias("_own"))
    subject = subject_teachers.groupBy("asignatura_id").agg(F.array_sort(F.collect_set("profesor_id")).alias("_subject"))
    out = s.join(own, "id", "left").join(subject, "asignatura_id", "left")
    return out.withColumn("profesor_ids", F.coalesce("_own", "_subject", F.array().cast("array<bigint>"))).drop("_own", "_subject")


def first_context(links: DataFrame) -> DataFrame:
    """The first program link of each subject, by link id: (asignatura_id, programa_id, mencion_id, curso)."""
    first = links.groupBy("asignatura_id").agg(F.min_by(F.struct("programa_id", "mencion_id", "curso"), "id").alias("l"))
    return first.select("asignatura_id", "l.*")


def subject_context(links: DataFrame, programs: DataFrame, mentions: DataFrame) -> DataFrame:
    """(asignatura_id, grado, mencion): names of the program and the mention of each subject's first link, null where there is none."""
    named = first_context(links).join(programs.select(F.col("id").alias("programa_id"), F.col("nombre").alias("grado")), "programa_id", "left")
    return named.join(mentions.select(F.col("id").alias("mencion_id"), F.col("nombre").alias("mencion")), "mencion_id", "left").select("asignatura_id", "grado", "mencion")


def conflict_hash(kind: Column, s1: Column, s2: Column, resource: Column, description: Column) -> Column:
    """The key of a finding, the same whichever session comes first; without a resource, from its description."""
    low, high = F.least(s1, F.coalesce(s2, F.lit(0))), F.greatest(s1, F.coalesce(s2, F.lit(0)))
    text = lambda c: c.cast("string")
    pair = F.concat(kind, F.lit(":"), text(low), F.lit("-"), text(high), F.lit(":"), text(resource))
    one = F.concat(kind, F.lit(":"), text(s1), F.lit(":"), F.coalesce(text(resource), F.lit("None")))
    generic = F.concat(kind, F.lit(":"), text(s1), F.lit(":"), F.coalesce(text(s2), F.lit("None")), F.lit(":"), description)
    return F.sha2(F.when(kind == RESTRICTION, one).when(resource.isNull(), generic).otherwise(pair), 256)


def hhmm(minutes: Column) -> Column:
    return F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def detect_conflicts(s: DataFrame, r: DataFrame | None = None, *, rooms: bool = True, teachers: bool = True, cohorts: bool = True, restrictions: bool = True, min_severity: str | None = None, room_names: DataFrame | None = None, teacher_names: DataFrame | None = None, subject_names: DataFrame | None = None, context: DataFrame | None = None, **options) -> DataFrame:
    """All findings: tipo, severidad, sesion_id, sesion_2_id, aula_id, profesor_id, asignatura_id, restriccion_id, descripcion, hash.

    Rooms and cohorts are critical, teachers only if both sessions have no
    other, restrictions never. The names (id, nombre, and apellidos for
    teachers) and the subjects' context (asignatura_id, grado, mencion) fill
    descriptions and may be missing. Of equal keys the first stays: they are equal if the rule, the sessions and the resource are, by which
    a rule's rows meet before they have their key and text, both long. Options are those of the rules: period_aware, width, mixed, dates, and extra_keys
    for cohorts.
    """
    plain = {k: v for k, v in options.items() if k != "extra_keys"}
    null = lambda t: F.lit(None).cast(t)
    parts = []

    def named(df: DataFrame, names: DataFrame | None, key: str, word: str) -> tuple[DataFrame, Column]:
        other = F.concat(F.lit(f"{word} "), F.col(key).cast("string"))
        if names is None:
            return df, other
        full = F.concat_ws(" ", "nombre", "apellidos") if "apellidos" in names.columns else F.col("nombre")
        names = names.groupBy(F.col("id").alias(key)).agg(F.min(full).alias("_name"))
        return df.join(names, key, "left"), F.coalesce("_name", other)

    def finding(df: DataFrame, kind: str, severity: Column, text: Column, **have: str) -> None:
        cols = {k: F.col(have[k]).cast("bigint") if k in have else null("bigint") for k in ("sesion_2_id", "aula_id", "profesor_id", "asignatura_id", "restriccion_id")}
        parts.append(df.select(F.lit(kind).alias("tipo"), severity.alias("severidad"), F.col("s1").alias("sesion_id"), *[c.alias(k) for k, c in cols.items()], text.alias("descripcion")))

    def first(df: DataFrame, resource: Column | str, order: Column | str, severity: Column, *second: str) -> DataFrame:
        if min_severity:
            df = df.where(severity_rank(severity) >= SEVERITY_RANK[min_severity])
        return keep_first(df, ["s1", *second, resource], [order])

    if rooms:
        severity = F.lit(CRITICAL)
        df, name = named(first(room_overlaps(s, **plain), "aula_id", "s2", severity, "s2"), room_names, "aula_id", "Aula")
        finding(df, ROOM, severity, F.concat(F.lit("El aula '"), name, F.lit("' está ocupada simultáneamente.")), sesion_2_id="s2", aula_id="aula_id")
    if teachers:
        severity = F.when(F.col("alone"), CRITICAL).otherwise(MILD)
        df, name = named(first(teacher_overlaps(s, **plain), "profesor_id", F.desc("alone"), severity, "s2"), teacher_names, "profesor_id", "Docente")
        text = F.concat(name, F.when(F.col("alone"), " tiene dos clases a la vez (único docente).").otherwise(" tiene solapamiento (con apoyo)."))
        finding(df, TEACHER, severity, text, sesion_2_id="s2", profesor_id="profesor_id")
    if cohorts:
        severity = F.lit(CRITICAL)
        df = first(_cohort_pairs(s, **options), F.coalesce("asignatura_id", F.lit(0)), "s2", severity, "s2")
        if subject_names is not None:
            # two subjects have no common name: such pairs look for none, each in a place of its own, as all of them would meet in one task
            key = F.when(F.col("asignatura_comun") != 0, F.col("asignatura_comun")).otherwise(-1 - F.abs("s1"))
            subjects = subject_names.groupBy(F.col("id").alias("_subject")).agg(F.min("nombre").alias("_name"))
            df = df.join(subjects, key == F.col("_subject"), "left").drop("_subject")
        else:
            df = df.withColumn("_name", null("string"))
        if context is not None:
            df = df.join(context.groupBy("asignatura_id").agg(F.min(F.struct(F.col("grado").alias("_grado"), F.col("mencion").alias("_mencion"))).alias("_c")).select("asignatura_id", "_c.*"), "asignatura_id", "left")
        else:
            df = df.withColumns({"_grado": null("string"), "_mencion": null("string")})
        level = F.concat(F.lit("Solape en "), F.coalesce("_grado", F.lit("Grado")), F.lit(": Curso "), F.col("_curso").cast("string"), F.lit("º, "), F.initcap(F.translate("_periodo", "_", " ")), F.coalesce(F.concat(F.lit(" ("), "_mencion", F.lit(")")), F.lit("")))
        inner = F.concat(F.lit("Asignatura '"), F.coalesce("_name", F.lit("None")), F.lit("': "), _reason(F.col("_same"), F.col("_theory"), F.col("_code")))
        finding(df, COHORT, severity, F.when(F.col("asignatura_comun") != 0, inner).otherwise(level), sesion_2_id="s2", asignatura_id="asignatura_id")
    if restrictions and r is not None:
        severity = F.lit(MILD)
        df, name = named(first(restriction_violations(s, r, dates=options.get("dates")), "restriccion_id", "profesor_id", severity), teacher_names, "profesor_id", "Docente")
        text = F.concat(F.lit("Restricción de "), name, F.lit(": No disponible de "), hhmm(F.col("r_ini")), F.lit(" a "), hhmm(F.col("r_fin")), F.lit("."))
        finding(df, RESTRICTION, severity, text, profesor_id="profesor_id", restriccion_id="restriccion_id")
    if not parts:
        raise ValueError("no rule is switched on")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    resource = F.when(F.col("tipo") == ROOM, F.col("aula_id")).when(F.col("tipo") == TEACHER, F.col("profesor_id")).when(F.col("tipo") == COHORT, F.coalesce("asignatura_id", F.lit(0))).otherwise(F.col("restriccion_id"))
    return out.withColumn("hash", conflict_hash(F.col("tipo"), F.col("sesion_id"), F.col("sesion_2_id"), resource, F.col("descripcion")))


def severity_rank(col: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv]), col)


def detect_for(s: DataFrame, ids: DataFrame, r: DataFrame | None = None, **options) -> DataFrame:
    """Findings with one of ids on either side: pairs without one are none as soon as they meet."""
    return detect_conflicts(marked(s, ids, **{MINE: F.col("id")}), r, **options)


#: Words of ids that every task may hold.
WORDS = 1_000_000


def marked(df: DataFrame, ids: DataFrame, **marks: Column) -> DataFrame:
    """Adds columns that say whether the given ones are among ids (id).

    The ids are words of 64 bits. Words go to all tasks, so that df's rows, which may be
    long, stay where they are; only of more than WORDS words, that is of
    scattered ids or more than some ten millions, rows meet them by a shuffle.
    """
    number = lambda c: c.cast("bigint")
    bit = lambda c: number(c).bitwiseAND(F.lit(63).cast("bigint")).cast("int")
    words = cut(ids.where("id IS NOT NULL").groupBy(F.shiftright(number(F.col("id")), 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col("id")))).alias("_bits")))
    few = words.limit(WORDS + 1).count() <= WORDS
    for name, c in marks.items():
        met = words.select(F.col("_word").alias("_word_here"), F.col("_bits").alias("_bits_here"))
        df = df.join(F.broadcast(met) if few else met, F.shiftright(number(c), 6) == F.col("_word_here"), "left")
        df = df.withColumn(name, F.coalesce(F.getbit("_bits_here", bit(c)) == 1, F.lit(False))).drop("_word_here", "_bits_here")
    return df


def _other() -> Column:
    """The second session, or the first where there is no other, so that no task gets all conflicts of one session."""
    return F.coalesce("sesion_2_id", "sesion_id")


def touching(conflicts: DataFrame, ids: DataFrame) -> DataFrame:
    """Conflicts with one of ids on either side."""
    return marked(conflicts, ids, _first=F.col("sesion_id"), _second=_other()).where("_first OR _second").drop("_first", "_second")


def untouched(conflicts: DataFrame, ids: DataFrame) -> DataFrame:
    """Conflicts with none of ids on either side."""
    return marked(conflicts, ids, _first=F.col("sesion_id"), _second=_other()).where("NOT _first AND NOT _second").drop("_first", "_second")


def unique_conflicts(df: DataFrame) -> DataFrame:
    """Open conflicts, one a key."""
    return keep_first(df.where("estado = 'por_revisar'"), ["hash"], ["sesion_id", "sesion_2_id"])
