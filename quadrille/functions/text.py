"""Normalisers of names, rooms, groups, periods and times, as column functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words and tables that results must agree on.
DAYS = {"LUNES": "lunes", "LUN": "lunes", "MARTES": "martes", "MAR": "martes", "MIERCOLES": "miercoles", "MIE": "miercoles", "X": "miercoles", "JUEVES": "jueves", "JUE": "jueves", "VIERNES": "viernes", "VIE": "viernes", "SABADO": "sabado", "SAB": "sabado", "DOMINGO": "domingo", "DOM": "domingo"}
DAY_CODES = {"L": "lunes", "M": "martes", "X": "miercoles", "MI": "miercoles", "J": "jueves", "V": "viernes", "S": "sabado", "D": "domingo"}
PERIODS = {"PRIMER CUATRIMESTRE": "primer_cuatrimestre", "1C": "primer_cuatrimestre", "C1": "primer_cuatrimestre", "SEGUNDO CUATRIMESTRE": "segundo_cuatrimestre", "2C": "segundo_cuatrimestre", "C2": "segundo_cuatrimestre", "ANUAL": "anual", "PRIMER SEMESTRE": "primer_semestre", "SEGUNDO SEMESTRE": "segundo_semestre"}
COURSES = {"PRIMER": 1, "PRIMERO": 1, "1": 1, "1º": 1, "I": 1, "SEGUNDO": 2, "2": 2, "2º": 2, "II": 2, "TERCER": 3, "TERCERO": 3, "3": 3, "3º": 3, "III": 3, "CUARTO": 4, "4": 4, "4º": 4, "IV": 4, "QUINTO": 5, "5": 5, "5º": 5, "V": 5, "SEXTO": 6, "6": 6, "6º": 6, "VI": 6}
SHEET_COURSES = {"primero": 1, "1": 1, "primer": 1, "segundo": 2, "2": 2, "tercero": 3, "3": 3, "tercer": 3, "cuarto": 4, "4": 4, "quinto": 5, "5": 5, "sexto": 6, "6": 6}
ROOM_WORDS = {"informatica": ("INF", "ORDENADOR", "COMPUT", "LSC"), "laboratorio": ("LAB", "FÍSICA", "FISICA", "QUÍMICA", "QUIMICA", "BIOLOGÍA", "LATC"), "seminario": ("SEM", "SEMINARIO"), "taller": ("TALLER",)}
OCR_FIXES = ((r"\bAULA\s+S\b", "AULA 5"), (r"\bAULA\s+LA\b", "AULA 14"), (r"\bAULA\s+L4\b", "AULA 14"), (r"\bLSC\s+I\b", "LSC 1"), (r"informacio\s+n", "información"))
REPAIRS = (
    (r"I\s+n\s+g\s+e\s+n\s+i\s+e\s+r\s*[íi]\s*a", "Ingeniería"),
    (r"Ing\s+en\s+ier[íi]a", "Ingeniería"),
    (r"Estructurade", "Estructura de"),
    (r"Intr\s*\.\s*a", "Intr. a"),
    (r"Fundam\s+en\s+tos", "Fundamentos"),
    (r"Fund\.\s+F[íi]sicos", "Fund. Físicos"),
    (r"Comp\s+u\s+tadores", "Computadores"),
    (r"Compu\s+tadores", "Computadores"),
    (r"P\s+r\s+o\s+g\s+r\s+a\s+m\s+a\s+c\s+i\s*[óo]\s*n", "Programación"),
    (r"Progra\s+mación", "Programación"),
    (r"informacio\s+n\b", "información"),
    (r"Sist\.\s+informaci[oó]n", "Sist. Información"),
    (r"animationand", "animation and"),
    (r"operativosavanzados", "operativos avanzados"),
)
ROMANS = ("II", "III", "IV", "VI", "VII", "VIII")
UNKNOWN_ROOM = "POR DETERMINAR"

_PLAIN_FROM, _PLAIN_TO = "áàäâãåéèëêíìïîóòöôõúùüûñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def title(c: Column) -> Column:
    """A capital after anything that isn't a letter, small letters else."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def first_of(c: Column, rules: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule that holds."""
    out = None
    for test, value in rules:
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(default))


def lookup(c: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def subject_key(c: Column) -> Column:
    return F.translate(F.translate(collapse(F.upper(c)), "ÁÉÍÓÚÜÑ.,", "AEIOUUN"), "-", " ")


def room_key(c: Column) -> Column:
    plain = F.translate(F.trim(F.upper(c)), "ÁÉÍÓÚ", "AEIOU")
    return collapse(F.regexp_replace(plain, r"([A-Z])(\d)", "$1 $2"))


def room_alnum(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def norm_name(c: Column) -> Column:
    return title(collapse(F.coalesce(c, F.lit(""))))


def norm_name_roman(c: Column) -> Column:
    out = norm_name(c)
    for r in ROMANS:
        out = F.regexp_replace(out, rf"(?U)\b{r.capitalize()}\b", r)
    return out


def norm_room(c: Column) -> Column:
    return F.when(c.isNull() | (c == "") | (c == UNKNOWN_ROOM), UNKNOWN_ROOM).otherwise(F.upper(collapse(c)))


def map_day(c: Column) -> Column:
    return lookup(F.translate(F.upper(c), "ÁÉÍÓ", "AEIO"), DAYS)


def map_day_code(c: Column) -> Column:
    return lookup(F.upper(F.trim(c)), DAY_CODES)


def period_in(c: Column) -> Column:
    return first_of(c, [(F.upper(c).contains(k), v) for k, v in PERIODS.items()])


def infer_period(local: Column, document: Column) -> Column:
    """From the table's own text, else the document's, else the first half."""
    return F.coalesce(period_in(local), period_in(document), F.lit("primer_cuatrimestre"))


def parse_course(c: Column) -> Column:
    up = F.upper(c)
    return first_of(c, [(up.rlike(rf"(?U)\b\Q{k}\E\b") | (up == k), v) for k, v in COURSES.items()])


def parse_course_sheet(c: Column) -> Column:
    """1 to 6, by the first word or digit that is in the label; null is an error."""
    low = F.lower(F.trim(c))
    return first_of(c, [(low.contains(k), v) for k, v in SHEET_COURSES.items()])


def course_digits(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"\D", "").try_cast("int"), F.lit(0))


def room_type(c: Column) -> Column:
    up = F.upper(c)
    rules = [(c == UNKNOWN_ROOM, "teorica")] + [(up.contains(w), kind) for kind, words in ROOM_WORDS.items() for w in words]
    return first_of(c, rules, "teorica")


def manual_type(c: Column) -> Column:
    up = F.upper(c)
    return first_of(c, [(up.contains("LABORATORIO"), "laboratorio"), (up.contains("AULA") | up.contains("PRACTICA") | up.contains("PRÁCTICA"), "practica"), (up.contains("TEOR"), "teoria")])


def clean_group(c: Column) -> Column:
    bare = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?iu)^(GRUPO|GR\.|G\.)\s*", "")
    return F.trim(F.replace(bare, F.lit(" "), F.lit("")))


def split_groups(c: Column) -> Column:
    """Array of single groups: one empty group for null or empty text, none for blanks."""
    cut = F.split(F.trim(c), r"(?iu)\s*[,/&+]\s*|\s+(?:y|e)\s+|y(?=(?:PA|PL|GR|G\.|[0-9]))")
    parts = F.filter(F.transform(cut, lambda p: F.trim(p)), lambda p: p != "")
    return F.when(c.isNull() | (c == ""), F.array(F.lit(""))).otherwise(parts)


def infer_group_type(group: Column, room: Column) -> Column:
    g, up = F.upper(clean_group(group)), F.upper(F.trim(F.coalesce(room, F.lit(""))))
    lab = F.lit(False)
    for w in (*ROOM_WORDS["laboratorio"], *ROOM_WORDS["informatica"]):
        lab = lab | up.contains(w)
    return first_of(g, [(g == "", "teoria"), (g.contains("PA"), "practica"), (lab, "laboratorio"), (g.contains("PL"), "laboratorio")], "teoria")


def normalize_sessions(df: DataFrame) -> DataFrame:
    """Rows (asignatura, aula, dia, tipo, grupo, ...) to normalised sessions, one for each single group.

    Rows without a usable subject or day go.
    """
    bad = F.col("asignatura").isNull() | F.col("asignatura").isin("", "DESCONOCIDA") | F.col("asignatura").contains("(*)")
    rows = df.where(~bad).withColumn("grupo", F.explode(split_groups(F.col("grupo"))))
    rows = rows.withColumns({"asignatura": norm_name(F.col("asignatura")), "dia": map_day(F.col("dia")), "aula": norm_room(F.col("aula"))}).where("dia IS NOT NULL")
    kind = F.coalesce(manual_type(F.col("tipo")), infer_group_type(F.col("grupo"), F.col("aula")))
    return rows.withColumns({"tipo": kind, "aula_tipo": room_type(F.col("aula")), "grupo": clean_group(F.col("grupo")), "modalidad": F.lit("presencial"), "tipo_recurrencia": F.lit("semanal")})


def sheet_period(period: Column, number: Column) -> Column:
    low = F.lower(F.trim(period))
    half = low.isin("cuatrimestral", "quarterly", "semestral", "semester")
    return F.when(low.isin("anual", "annual"), "anual").when(half & (number == 1), "primer_cuatrimestre").when(half & (number == 2), "segundo_cuatrimestre")


def sheet_type(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return first_of(c, [(low.contains("básica") | low.contains("basica"), "basica"), (low.contains("obligatoria"), "obligatoria"), (low.contains("optativa"), "optativa")])


def sheet_mode(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return first_of(c, [(low.contains("presencial") & ~low.contains("semi"), "presencial"), (low.contains("online") | low.contains("virtual"), "online"), (low.contains("semi") | low.contains("hibrida") | low.contains("híbrida"), "semipresencial")], "presencial")


def sheet_language(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return first_of(c, [(low.contains("español") | low.contains("castellano") | low.contains("spanish"), "español"), (low.contains("inglés") | low.contains("ingles") | low.contains("english"), "ingles")], "español")


def map_sheet_enums(df: DataFrame) -> DataFrame:
    """Adds the enum columns to (periodo, num_periodo, tipo, modalidad, idioma) and an array of errors."""
    period, kind = sheet_period(F.col("periodo"), F.col("num_periodo")), sheet_type(F.col("tipo"))
    errors = F.array_compact(F.array(F.when(period.isNull(), "periodo"), F.when(kind.isNull(), "tipo")))
    return df.withColumns({"periodo_enum": period, "tipo_enum": kind, "modalidad_enum": sheet_mode(F.col("modalidad")), "idioma_enum": sheet_language(F.col("idioma")), "errores": errors})


def norm_code(c: Column) -> Column:
    return F.upper(F.trim(c))


def valid_code(c: Column) -> Column:
    return c.rlike(r"^[A-Z]{1,2}\d{1,4}[A-Z]?$")


def minutes(c: Column) -> Column:
    """HH:MM to minutes; null where that isn't a time."""
    h, m = F.regexp_extract(c, r"^(\d{1,2}):(\d{2})$", 1).try_cast("int"), F.regexp_extract(c, r"^(\d{1,2}):(\d{2})$", 2).try_cast("int")
    return F.when((h < 24) & (m < 60), h * 60 + m)


def to_hhmm(m: Column) -> Column:
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def parse_range(c: Column) -> Column:
    """struct(ini, fin, error) of 'HH:MM-HH:MM'; the error is null where both are times and in order."""
    pattern = r"^(\d{1,2}:\d{2})\s*-\s*(\d{1,2}:\d{2})$"
    text = F.trim(c)
    a, b = minutes(F.regexp_extract(text, pattern, 1)), minutes(F.regexp_extract(text, pattern, 2))
    error = F.when(~text.rlike(pattern) | a.isNull() | b.isNull(), "formato").when(a >= b, "orden")
    return F.struct(F.when(error.isNull(), a).alias("ini"), F.when(error.isNull(), b).alias("fin"), error.alias("error"))


def norm_time(c: Column) -> Column:
    found = F.replace(F.regexp_extract(c, r"\b(([01]?\d|2[0-3])[:.]?[0-5]\d)\b", 1), F.lit("."), F.lit(":"))
    h = F.split_part(found, F.lit(":"), F.lit(1))
    return F.when(found.contains(":"), F.concat(F.lpad(h, 2, "0"), F.lit(":"), F.lpad(F.split_part(found, F.lit(":"), F.lit(2)), 2, "0")))


def ocr_fix(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for pattern, right in OCR_FIXES:
        out = F.regexp_replace(out, f"(?iuU){pattern}", right)
    return out


def split_camel(c: Column) -> Column:
    """A blank between a small letter and the capital glued to it."""
    return collapse(F.regexp_replace(c, "([a-zñáéíóú])([A-ZÑÁÉÍÓÚ])", "$1 $2"))


def repair_words(c: Column, repairs: tuple[tuple[str, str], ...] = REPAIRS) -> Column:
    """Mends words that were broken in two, given as (pattern, word), then glued ones."""
    out = c
    for pattern, word in repairs:
        out = F.regexp_replace(out, f"(?iu){pattern}", word)
    return split_camel(out)


def clean_subject(c: Column) -> Column:
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?iuU)\b(TE|PL|PA|y)\b|[/\.,:–\-\?\*\(\)]+", " "))


def preprocess_text(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\r\n?", "\n")
    return F.trim(F.regexp_replace(out, r"\n{2,}", "\n"))


def clean_text(c: Column) -> Column:
    """Takes out addresses, long numbers, currency signs, pictographs and e-mail addresses outside universities."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(https?://\S+|www\.\S+|\b\d{9,}\b|\+\d{1,3}\s\d{3,})", "")
    out = F.regexp_replace(out, "[€$£¥₹¢]", "")
    out = F.regexp_replace(out, r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+", "")
    out = F.regexp_replace(out, r"(?iu)\b[a-zA-Z0-9._%+-]+@(?!.*(?:univ|\.es|\.edu))[a-zA-Z0-9.-]+\.[a-z]{2,}\b", "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _bare_letters() -> tuple[str, str]:
    """Letters with marks of the Latin, Greek and Cyrillic blocks and what canonical decomposition leaves of them; then the marks, which stand for nothing."""
    pairs = {}
    for code in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(code))
        bare = "".join(x for x in parts if not unicodedata.combining(x))
        if len(parts) > 1 and len(bare) == 1:
            pairs[chr(code)] = bare
    marks = "".join(chr(code) for code in range(0x300, 0x370))
    return "".join(pairs) + marks, "".join(pairs.values())


_MARKED, _BARE = _bare_letters()


def fold_key(c: Column) -> Column:
    """Small letters without marks, whether a mark is part of its letter or follows it."""
    return F.translate(F.lower(c), _MARKED, _BARE)


def period_matches(a: Column, b: Column) -> Column:
    """Whether a subject's period a goes with the chosen period b: whole years with all, else the same half, else one text within the other."""
    x, y = fold_key(F.coalesce(a, F.lit(""))), fold_key(F.coalesce(b, F.lit("")))
    has = lambda t, *words: t.rlike("|".join(words))
    return F.when(x.contains("anual") | (y == ""), True).when(has(y, "primer", "1"), has(x, "primer", "1")).when(has(y, "segundo", "2"), has(x, "segundo", "2")).otherwise(x.contains(y) | y.contains(x))


def slot_index(t: Column, start: int, step: int) -> Column:
    return F.greatest(F.lit(0), F.floor((t - start) / step)).cast("int")


def enum_label(c: Column) -> Column:
    return title(F.translate(c, "_", " "))


def norm_contact(df: DataFrame) -> DataFrame:
    """Names collapsed, e-mail in small letters, phone trimmed, room code in capitals; an alias is collapsed, empty ones are null."""
    have = set(df.columns)
    fixes = {"nombre": collapse, "apellidos": collapse, "email": lambda c: F.lower(F.trim(c)), "telefono": F.trim, "codigo": lambda c: F.upper(F.trim(c)), "alias": lambda c: F.nullif(collapse(c), F.lit(""))}
    return df.withColumns({k: f(F.col(k)) for k, f in fixes.items() if k in have})


def program_type(c: Column) -> Column:
    low = F.lower(c)
    return first_of(c, [(low.contains("doble"), "doble_grado"), (low.contains("máster") | low.contains("master"), "master")], "grado")


def clean_mention(c: Column) -> Column:
    return F.trim(F.replace(F.replace(c, F.lit("Mención en "), F.lit("")), F.lit("MENCION EN "), F.lit("")))


def split_title(c: Column) -> Column:
    """struct(titulo, periodo) of 'degree|period'."""
    parts = F.split(c, r"\|")
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("titulo"), F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("Primer Cuatrimestre")).alias("periodo"))


def classify_title(c: Column) -> Column:
    """'degree|period' from a first page: the double degree, informatics, mathematics, physics, or '-'; the second half if it is named, else the first."""
    t = F.replace(F.upper(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))
    physics, maths = t.contains("FÍSICA") | t.contains("FISICA"), t.contains("MATEMÁTICAS") | t.contains("MATEMATICAS")
    informatics = t.contains("GRADO EN INGENIERÍA INFORMÁTICA") | t.contains("GRADO EN INGENIERIA INFORMATICA")
    degree = first_of(t, [(t.contains("DOBLE GRADO") & physics & maths, "Doble Grado en Física y Matemáticas"), (informatics, "Grado en Ingeniería Informática"), (t.contains("GRADO") & maths, "Grado en Matemáticas"), (t.contains("GRADO") & physics, "Grado en Física")], "-")
    second = t.contains("SEGUNDO CUATRIMESTRE") | t.contains("2º CUATRIMESTRE")
    return F.concat(degree, F.lit("|"), F.when(second, "Segundo Cuatrimestre").otherwise("Primer Cuatrimestre"))


def semantic_key(name: Column, kind: Column, group: Column, day: Column, start: Column) -> Column:
    """NAME|TYPE|GROUP|DAY|START, blanks as underscores, with a word for what is missing."""

    def part(c: Column, default: str, joined: bool = True) -> Column:
        out = F.upper(F.trim(F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(default)))
        return F.regexp_replace(out, r"\s+", "_") if joined else out

    return F.concat_ws("|", part(fold_key(name), "UNK"), part(kind, "GEN"), part(group, "U"), part(day, "UNK", False), part(start, "00:00", False))
