"""Overlap predicates and interval joins."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Microseconds, and the width of bins on the calendar.
MINUTE, DAY = 60_000_000, 86_400_000_000
CALENDAR_BIN = DAY // 4
#: What says when a session is held: every week, or from one moment to another.
TIMES = ("dia_semana", "ini", "fin", "inicio", "fin_ts")


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Half-open intervals that share a moment; touching ones don't."""
    return (start_a < end_b) & (start_b < end_a)


def overlaps_weekly(a: str, b: str) -> Column:
    """Two aliased session frames meet on the same weekday."""
    c = F.col
    return (c(f"{a}.dia_semana") == c(f"{b}.dia_semana")) & overlaps(c(f"{a}.ini"), c(f"{a}.fin"), c(f"{b}.ini"), c(f"{b}.fin"))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def overlaps_dated(a: str, b: str, mixed: bool = False) -> Column:
    """Two dated sessions meet. mixed=True also holds a dated one against a weekly one, by its weekday and its time of day."""
    c = F.col
    dated = overlaps(c(f"{a}.inicio"), c(f"{a}.fin_ts"), c(f"{b}.inicio"), c(f"{b}.fin_ts"))
    if not mixed:
        return dated

    def cross(w: str, d: str) -> Column:
        return (c(f"{w}.dia_semana") == F.weekday(c(f"{d}.inicio"))) & overlaps(c(f"{w}.ini"), c(f"{w}.fin"), minute_of_day(c(f"{d}.inicio")), minute_of_day(c(f"{d}.fin_ts")))

    return F.coalesce(dated, F.lit(False)) | F.coalesce(cross(a, b), F.lit(False)) | F.coalesce(cross(b, a), F.lit(False))


def recurrence(df: DataFrame) -> DataFrame:
    """Adds tipo_recurrencia: SEMANAL where the weekly slot is complete, else FECHADA."""
    weekly = F.col("dia_semana").isNotNull() & F.col("ini").isNotNull() & F.col("fin").isNotNull()
    return df.withColumn("tipo_recurrencia", F.when(weekly, "SEMANAL").otherwise("FECHADA"))


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    return df.where(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by their keys over a number of tasks that Spark doesn't lower: rows that repeat themselves shrink so much on the way that tasks made up by bytes would sort far more of them at once."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def interval_pairs(df: DataFrame, keys: list[str], start: str, end: str, width: int, id_col: str = "id") -> DataFrame:
    """Pairs (a, b) of rows with equal keys, a's id below b's, whose [start, end) overlap.

    Every row is put into the bins of the given width that it touches and the
    join is by keys and bin, so that a crowded key is spread over its bins; a
    pair comes out only in the bin where the later of the two starts. start
    and end are numbers; empty intervals meet nothing.
    """
    binned = dealt(_binned(df, start, end, width), *keys, "_bin")
    a, b = binned.alias("a"), binned.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_bin"]]
    on = same[0]
    for x in same[1:]:
        on = on & x
    ca, cb = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    on = on & (ca(id_col) < cb(id_col)) & overlaps(ca(start), ca(end), cb(start), cb(end)) & (ca("_bin") == F.floor(F.greatest(ca(start), cb(start)) / width))
    fields = [c for c in df.columns]
    return a.join(b, on).select(F.struct(*[ca(f).alias(f) for f in fields]).alias("a"), F.struct(*[cb(f).alias(f) for f in fields]).alias("b"))


def wall(ts: Column) -> Column:
    """Microseconds from 1970 by the clock on the wall: no zone moves them."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _clock(moment: datetime) -> int:
    return (moment - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def held_between(dates: tuple[datetime, datetime], day: Column, start: Column, end: Column) -> Column:
    """Some date of the range [from, to) has this weekday and a moment of these minutes within the range."""
    first, last = map(_clock, dates)
    days = range(first // DAY, min((last - 1) // DAY, first // DAY + 8) + 1)  # nine dates have every weekday whole, but for the ends
    found = F.lit(False)
    for d in days:
        found = found | ((day == (d + 3) % 7) & (F.lit(d * DAY) + start.cast("long") * MINUTE < last) & (F.lit(first) < F.lit(d * DAY) + end.cast("long") * MINUTE))
    return found


def session_pairs(s: DataFrame, keys: list[str], width: int, *, mixed: bool = False, dates: tuple[datetime, datetime] | None = None) -> DataFrame:
    """Pairs (a, b), a's id below b's, of sessions with equal keys that are held at the same time.

    Two weekly sessions (dia_semana, ini, fin) meet within the week. Two of
    which one isn't weekly meet on the calendar, if both have inicio and
    fin_ts, columns that s may lack. mixed also holds a dated session against
    weekly ones: its days are laid onto the week, eight at most, as more repeat
    whole ones. With dates, a range [from, to), only what meets within it
    counts: dated sessions are cut to it, and weekly ones must meet on one of
    its dates. A pair comes out once for equal keys. a and b have the columns
    of s but for the times.
    """
    fields = [c for c in s.columns if c not in TIMES]
    sides = lambda pairs: pairs.select(*[F.struct(*[F.col(f"{x}.{f}").alias(f) for f in fields]).alias(x) for x in ("a", "b")])
    slot = F.col("dia_semana").isNotNull() & F.col("ini").isNotNull() & F.col("fin").isNotNull()
    weekly = s.where(slot)
    pairs = interval_pairs(weekly.drop("inicio", "fin_ts"), [*keys, "dia_semana"], "ini", "fin", width)
    if dates is not None:
        pairs = pairs.where(held_between(dates, F.col("a.dia_semana"), F.greatest("a.ini", "b.ini"), F.least("a.fin", "b.fin")))
    out = sides(pairs)
    if not {"inicio", "fin_ts"} <= set(s.columns):
        return out
    start, end = wall(F.col("inicio")), wall(F.col("fin_ts"))
    if dates is not None:
        start, end = F.greatest(start, F.lit(_clock(dates[0]))), F.least(end, F.lit(_clock(dates[1])))
    timed = s.where("inicio IS NOT NULL AND fin_ts IS NOT NULL").select(*fields, slot.alias("_slot"), start.alias("_u0"), end.alias("_u1"))
    met = interval_pairs(timed, keys, "_u0", "_u1", CALENDAR_BIN).where(~(F.col("a._slot") & F.col("b._slot")))
    out = out.unionByName(sides(met))
    if not mixed:
        return out
    day = lambda u: F.floor(F.col(u) / DAY)
    laid = timed.where("NOT _slot AND _u0 < _u1").withColumn("_n", F.explode(F.sequence(F.lit(0), F.least(F.lit(7), F.floor((F.col("_u1") - 1) / DAY) - day("_u0")))))
    base = (day("_u0") + F.col("_n")) * DAY
    laid = laid.withColumns({"_day": F.pmod(day("_u0") + F.col("_n") + 3, F.lit(7)).cast("int"), "_s": F.greatest(F.col("_u0") - base, F.lit(0)), "_e": F.least(F.col("_u1") - base, F.lit(DAY)), "_first": F.when(F.col("_n") == 7, F.pmod("_u0", F.lit(DAY)))})
    start, end = (wall(F.col(c)) if c in s.columns else F.lit(None).cast("long") for c in ("inicio", "fin_ts"))
    recurring = weekly.select(*fields, F.col("dia_semana").alias("_day"), (F.col("ini").cast("long") * MINUTE).alias("_s"), (F.col("fin").cast("long") * MINUTE).alias("_e"), start.alias("_v0"), end.alias("_v1"))
    a, b = (dealt(_binned(df, "_s", "_e", width * MINUTE), "_bin", *keys, "_day").alias(x) for df, x in ((recurring, "w"), (laid, "d")))
    c = F.col
    on = c("w._bin") == c("d._bin")
    for k in [*keys, "_day"]:
        on = on & (c(f"w.{k}") == c(f"d.{k}"))
    on = on & (c("w.id") != c("d.id")) & overlaps(c("w._s"), c("w._e"), c("d._s"), c("d._e")) & (c("w._bin") == F.floor(F.greatest("w._s", "d._s") / (width * MINUTE)))
    again = F.coalesce(c("w._e") > c("d._first"), F.lit(False))  # the same weekday a week before has met it already
    on_dates = F.coalesce((c("w._v0") < c("w._v1")) & overlaps(c("w._v0"), c("w._v1"), c("d._u0"), c("d._u1")), F.lit(False))
    cross = a.join(b, on).where(~again & ~on_dates)
    struct = lambda x: F.struct(*[c(f"{x}.{f}").alias(f) for f in fields])
    first = c("w.id") < c("d.id")
    return out.unionByName(cross.select(F.when(first, struct("w")).otherwise(struct("d")).alias("a"), F.when(first, struct("d")).otherwise(struct("w")).alias("b")))
