"""Entity matching of subjects, programs, rooms and teachers: exact keys first, similar ones for what is left."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.text import collapse, room_alnum, room_key, subject_key
from quadrille.sources.storage import cut

CUTOFF, AUTO, STRICT_MORE, PROGRAM, ROOM = 65, 88, 5, 85, 80
#: Letters taken off to find what is near (two off texts of at most LONG and keys of at most SHORT letters, one off longer ones), and the words of which all subsets are looked up.
LONG, SHORT, WORDS = 64, 12, 8


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a bit for each letter of a."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every = row = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Similarity 0 to 100 by the letters to insert or delete; two empty texts are equal."""
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Similarity of word sets: what both have, with what only one has or without."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (left and right):
        return 100.0
    with_left, with_right = f"{both} {left}".strip(), f"{both} {right}".strip()
    found = [ratio(with_left, with_right)]
    if both:
        found += [ratio(both, with_left), ratio(both, with_right)]
    return max(found)


def scorer(fn: Callable[[str, str], float]):
    """A similarity as an Arrow-batched column function; null texts score 0."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x, y) if x is not None and y is not None else 0.0 for x, y in zip(a, b)], dtype="float64")

    return score


def subject_index(subjects: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(key, asignatura_id): keys of the names and aliases of active subjects."""
    active = subjects.where("activo").select(F.col("id").alias("asignatura_id"), F.col("nombre").alias("texto"))
    if aliases is not None:
        active = active.unionByName(aliases.join(active.select("asignatura_id"), "asignatura_id").select("asignatura_id", F.col("alias").alias("texto")))
    return active.select(subject_key(F.col("texto")).alias("key"), "asignatura_id").where("key <> ''").distinct()


def resolve_ambiguity(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """One candidate (asignatura_id) a query: best if in its program and course, then in its program, then the lowest id."""
    in_program = links.select("asignatura_id", F.col("programa_id").alias("prog_id"), F.lit(1).alias("_p")).distinct()
    in_course = links.select("asignatura_id", F.col("programa_id").alias("prog_id"), F.coalesce("curso", F.lit(0)).alias("curso"), F.lit(1).alias("_c")).distinct()
    ranked = candidates.join(in_program, ["asignatura_id", "prog_id"], "left").join(in_course, ["asignatura_id", "prog_id", "curso"], "left")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc_nulls_last("_p"), F.when(F.col("curso") > 0, F.col("_c")).desc_nulls_last(), "asignatura_id"))
    return ranked.withColumn("_place", place).where("_place = 1").drop("_place", "_p", "_c")


def exact_subject(queries: DataFrame, index: DataFrame, links: DataFrame) -> DataFrame:
    """(qid, asignatura_id) of queries (qid, texto, prog_id, curso) whose key is a subject's."""
    q = queries.withColumn("key", subject_key(F.coalesce("texto", F.lit("")))).where(F.length("key") >= 2)
    return resolve_ambiguity(q.join(index, "key"), links).select("qid", "asignatura_id")


def _near_universe(queries: DataFrame, index: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (qid, candidate) by program and course, else by program, and the queries that have none there."""
    keyed = index.join(links.select("asignatura_id", F.col("programa_id").alias("prog_id"), F.coalesce("curso", F.lit(0)).alias("curso")), "asignatura_id")
    keyed, queries = cut(keyed), cut(queries)
    course = queries.where("curso > 0").join(keyed.select("prog_id", "curso", "key").distinct(), ["prog_id", "curso"]).select("qid", F.col("key").alias("candidate"))
    course = cut(course)
    rest = queries.join(course.select("qid").distinct(), "qid", "left_anti")
    program = rest.join(keyed.select("prog_id", "key").distinct(), "prog_id").select("qid", F.col("key").alias("candidate"))
    return course.unionByName(program), rest.join(program.select("qid").distinct(), "qid", "left_anti")


def _grid(left: DataFrame, by: str, keys: DataFrame, rows: int, block: int, growth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Deals left and keys (candidate) to the cells (_t, _b) of a grid, so that every row meets every key in one cell.

    A cell has about rows x block pairs; with more than eight cells a side, its
    sides grow up to growth times, so that fewer copies of rows and keys are dealt.
    """
    parts, blocks = (max(1, -(-count // min(max(n, count // 8), n * growth))) for count, n in ((left.count(), rows), (keys.count(), block)))

    def dealt(column: str, n: int):
        return F.pmod(F.xxhash64(column), F.lit(n).cast("long"))

    def all_of(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    return left.select("*", dealt(by, parts).alias("_t"), all_of(blocks).alias("_b")), keys.select("*", all_of(parts).alias("_t"), dealt("candidate", blocks).alias("_b"))


def candidate_universe(queries: DataFrame, index: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (qid, key) of keys that a query may be like, from its program and course or without any there its program; and the queries
    (qid) that have none there and may be like any key. These aren't written out as pairs: best_of_all meets them in blocks."""
    near, rest = _near_universe(queries.select("qid", "prog_id", "curso"), index, links)
    return near.select("qid", F.col("candidate").alias("key")), rest.select("qid")


def letters(texts: list[str]) -> np.ndarray:
    """How often each letter (by code point, folded to 64) comes in each text, and the texts' lengths last."""
    out = np.zeros((len(texts), 65), dtype=np.int32)
    for i, t in enumerate(texts):
        for c, n in Counter(t).items():
            out[i, ord(c) % 64] += n
        out[i, 64] = len(t)
    return out


def at_most(text: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The ratio that a text can't exceed with any of others, all as letters() has them: no subsequence is longer than the letters that both have."""
    both = np.minimum(text[:64], others[:, :64]).sum(axis=1)
    total = text[64] + others[:, 64]
    return np.where(total > 0, 200.0 * both / np.maximum(total, 1), 100.0)


def likely_scores(texts: DataFrame, keys: DataFrame, fn: Callable[[str, str], float], rare: int = 20) -> DataFrame:
    """(key, floor): the best score of each text (key) with the keys (candidate) that share one of its rare words. It is a bound from below, and texts may have none."""
    words = lambda df, c: df.select(c, F.explode(F.array_distinct(F.split(c, " "))).alias("_w")).where("_w <> ''")
    known = words(keys, "candidate")
    few = known.groupBy("_w").agg(F.count("*").alias("_n")).where(F.col("_n") <= rare).select("_w")
    pairs = words(texts, "key").join(known.join(few, "_w"), "_w").select("key", "candidate").distinct()
    return pairs.withColumn("_s", scorer(fn)("key", "candidate")).groupBy("key").agg(F.max("_s").alias("floor"))


def compared(text: str, sets: bool) -> str:
    """The sorted words of a text, each once if sets."""
    return " ".join(sorted(set(text.split()) if sets else text.split()))


def shortened(form: str, off: int, sets: bool) -> dict[str, int]:
    """What is left of a form without up to off letters, and how many are gone at least. With sets the order of words is not kept, and a blank that goes joins any two."""

    def shorter(v: str) -> set[str]:
        if not sets:
            return {v[:k] + v[k + 1 :] for k in range(len(v))}
        words = v.split()
        cut_words = [(i, [w[:k] + w[k + 1 :]]) for i, w in enumerate(words) for k in range(len(w))]
        out = {" ".join(sorted(filter(None, words[:i] + new + words[i + 1 :]))) for i, new in cut_words}
        return out | {" ".join(sorted([w for n, w in enumerate(words) if n not in (i, j)] + [words[i] + words[j]])) for i in range(len(words)) for j in range(len(words)) if i != j}

    found = edge = {form: 0}
    for n in range(1, off + 1):
        edge = {w: n for v in edge for w in shorter(v) if w and w not in found}
        found = found | edge
    return found


def text_off(n: int) -> int:
    return 2 if n <= LONG else 1


def key_off(n: int) -> int:
    return 2 if n <= SHORT else 1


def beyond(form: str, lengths: list[int]) -> float:
    """The ratio that no form of these lengths exceeds unless a shortened form of the text is one of its own."""
    best, off = 0.0, text_off(len(form))
    for n in lengths:
        i = max(0, len(form) - n)
        while i <= off and i + n - len(form) <= key_off(n):
            i += 1
        if i <= len(form):
            best = max(best, 200.0 * (len(form) - i) / max(len(form) + n, 1))
    return best


def _spread(df: DataFrame, rows: int = 5_000) -> DataFrame:
    return df.repartition(max(1, -(-df.count() // rows)))


def near_of_all(texts: DataFrame, keys: DataFrame, sets: bool, cutoff: float, fn: Callable[[str, str], float]) -> DataFrame:
    """(key, candidate, score, open): each text's best candidate by equality joins. Where open is false it is the best of all, or without a candidate there is none from cutoff.

    Texts without one or two letters meet keys without as many. In a ratio of sorted
    words that says the score, so that of all keys with a shortened form the
    first is enough. In a set ratio, pairs with one in common are scored; its other
    ratios depend on the words in common and one side's length, and of the
    keys that have a subset of words the first and the shortest are enough.
    A text is open if a pair that isn't met may still reach the best score.

    A text has hundreds of forms, and Spark takes them for as small as the text:
    the joins are merges, as else all forms would go through the driver.
    """

    def cut_texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            forms = [(t, compared(t, sets)) for t in f["key"]]
            yield pd.DataFrame([(t, len(x), v, n) for t, x in forms for v, n in shortened(x, text_off(len(x)), sets).items()], columns=["key", "_la", "_v", "_i"])

    def cut_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            forms = [(t, compared(t, sets)) for t in f["candidate"]]
            yield pd.DataFrame([(t, len(x), v, n) for t, x in forms for v, n in shortened(x, key_off(len(x)), sets).items()], columns=["candidate", "_lb", "_v", "_j"])

    def subsets(column: str):
        def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                forms = [(t, compared(t, True)) for t in f[column]]
                rows = [(t, len(x), " ".join(some)) for t, x in forms if x and x.count(" ") < WORDS for n in range(1, x.count(" ") + 2) for some in combinations(x.split(" "), n)]
                yield pd.DataFrame(rows, columns=[column, "_l", "_b"])

        return of

    lengths = sorted(r[0] for r in keys.select(_form_length(sets)("candidate")).distinct().collect())

    def is_open(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            forms = [compared(t, sets) for t in f["key"]]
            limit = [beyond(x, lengths) + 1e-9 for x in forms]
            wide = [not x or (sets and x.count(" ") >= WORDS) for x in forms]
            yield f.assign(open=[w or b >= (cutoff if s != s else s) for w, b, s in zip(wide, limit, f["score"].astype("float64"))])

    c, best = F.col, lambda df: df.where(F.col("score") >= cutoff).groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("_s"), "candidate")).alias("_m")).select("key", F.col("_m.candidate").alias("candidate"), (-F.col("_m._s")).alias("score"))
    texts, keys = _spread(texts), _spread(keys)
    mine = texts.mapInPandas(cut_texts, "key string, _la int, _v string, _i int").hint("merge")
    others = keys.mapInPandas(cut_keys, "candidate string, _lb int, _v string, _j int")
    like = 200.0 * (c("_la") - c("_i")) / F.greatest(c("_la") + c("_lb"), F.lit(1))
    if sets:
        b = F.length("_b")
        with_words = keys.mapInPandas(subsets("candidate"), "candidate string, _l int, _b string").groupBy("_b").agg(F.min("candidate").alias("_first"), F.min(F.struct("_l", "candidate")).alias("_short"))
        met = texts.mapInPandas(subsets("key"), "key string, _l int, _b string").hint("merge").join(with_words, "_b")
        shared = F.explode(F.array(F.struct(c("_first").alias("candidate"), (200.0 * b / (b + c("_l"))).alias("score")), F.struct(c("_short.candidate").alias("candidate"), (200.0 * b / (b + c("_short._l"))).alias("score"))))
        words = cut(best(met.select("key", shared.alias("_c")).select("key", "_c.*")))
        pairs = mine.join(others, "_v").groupBy("key", "candidate").agg(F.max(like).alias("_most")).join(words.select("key", c("score").alias("_top")), "key", "left")
        pairs = pairs.where(c("_most") + 1e-9 >= F.greatest(F.coalesce("_top", F.lit(0.0)), F.lit(float(cutoff))))
        found = best(words.unionByName(pairs.select("key", "candidate", scorer(fn)("key", "candidate").alias("score"))))
    else:
        found = best(mine.join(others.groupBy("_v", "_j", "_lb").agg(F.min("candidate").alias("candidate")), "_v").select("key", "candidate", like.alias("score")))
    return cut(texts.join(found, "key", "left").mapInPandas(is_open, "key string, candidate string, score double, open boolean"))


def _form_length(sets: bool):
    @F.pandas_udf("int")
    def length(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(compared(t, sets))).astype("int32")

    return length


def _wide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f[[len(set(t.split())) > WORDS for t in f["candidate"]]]


def best_of_all(texts: DataFrame, keys: DataFrame, fn: Callable[[str, str], float] = token_set_ratio, cutoff: float = CUTOFF, rows: int = 200, block: int = 2_000, growth: int = 10) -> DataFrame:
    """(key, candidate, score): for each of the distinct texts (key) its most similar candidate of all, from cutoff; of equal ones the first.

    Most texts have theirs from near_of_all. Those that it leaves open meet all
    candidates in a grid, and in set ratios the others still meet those of more than
    WORDS words, whose subsets aren't looked up.
    """
    sets = fn is token_set_ratio
    texts, keys = cut(texts.select("key").distinct()), cut(keys.select("candidate").distinct())
    if texts.isEmpty():
        return texts.selectExpr("key", "key AS candidate", "0D AS score")
    if not sets and fn is not token_sort_ratio:
        return grid_best(texts.withColumn("floor", F.lit(float("nan"))), keys, fn, cutoff, rows, block, growth)
    near = near_of_all(texts, keys, sets, cutoff, fn)
    left = near.where("open").select("key", F.col("score").alias("floor"))
    found = near.where("NOT open AND candidate IS NOT NULL").select("key", "candidate", "score")
    if not left.isEmpty():
        found = found.unionByName(grid_best(left, keys, fn, cutoff, rows, block, growth))
    wide = cut(keys.mapInPandas(_wide, "candidate string")) if sets else None
    if wide is not None and not wide.isEmpty():
        found = found.unionByName(grid_best(near.where("NOT open").select("key", F.col("score").alias("floor")), wide, fn, cutoff, rows, block, growth))
        return best_candidate(found.withColumn("qid", F.col("key"))).drop("qid")
    return found


def grid_best(texts: DataFrame, keys: DataFrame, fn: Callable[[str, str], float], cutoff: float, rows: int, block: int, growth: int) -> DataFrame:
    """(key, candidate, score) of texts (key, and the score floor that they have already), each of which meets every candidate in a cell.

    Every text first gets the best score that it has with candidates of a rare
    word in common. Texts and candidates are then dealt to the cells of a grid.
    Within a cell, letters that two have in common bound their ratio, for all
    candidates of the same letters at once; a set ratio is bounded by the
    letters, whatever the words' order, and by the length of the words that
    both have. Only pairs whose bound reaches the cutoff and the best score so
    far are compared. Each cell hands on one candidate a text.
    """
    sets = fn is token_set_ratio

    def best(texts: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        found = []
        candidates = sorted(keys["candidate"])
        forms = [compared(c, sets) for c in candidates]
        lengths = np.array([len(f) for f in forms], dtype=np.int64)
        plain, of = np.unique(letters(forms), axis=0, return_inverse=True) if forms else (letters([]), np.zeros(0, dtype=np.int64))
        of = of.reshape(-1)
        near = sorted(range(len(forms)), key=forms.__getitem__)
        sorted_forms = [forms[i] for i in near]
        with_word: dict[str, list[int]] = {}
        for i, f in enumerate(forms if sets else []):
            for w in f.split():
                with_word.setdefault(w, []).append(i)
        places = {w: np.array(ids, dtype=np.int64) for w, ids in with_word.items()}
        for text, floor in zip(texts["key"], texts["floor"]):
            form = compared(text, sets)
            bound = at_most(letters([form])[0], plain)[of]
            if sets:
                shared = np.zeros(len(candidates), dtype=np.int64)
                for w in form.split():
                    if w in places:
                        shared[places[w]] += len(w) + 1
                both = np.maximum(shared - 1, 0)
                bound = np.maximum(bound, 200.0 * both / np.maximum(both + np.minimum(lengths, len(form)), 1))
            bound = bound + 1e-9
            top, chosen = (-1.0 if floor != floor else floor), None  # a floor that is missing is NaN

            def compare(i: int) -> None:
                nonlocal top, chosen
                score = fn(text, candidates[i])
                if score > top or (score == top and (chosen is None or candidates[i] < chosen)):
                    top, chosen = score, candidates[i]

            at = bisect_left(sorted_forms, form)
            for i in near[max(at - 2, 0) : at + 2]:
                if bound[i] >= max(top, cutoff):
                    compare(i)
            left = np.flatnonzero(bound >= max(top, cutoff))
            for i in left[np.lexsort((left, -bound[left]))]:
                if bound[i] < top:
                    break
                compare(i)
            if chosen is not None and top >= cutoff:
                found.append((text, chosen, top))
        return pd.DataFrame(found, columns=["key", "candidate", "score"])

    likely = likely_scores(texts, keys, fn).withColumnRenamed("floor", "_likely")
    floored = cut(texts.join(likely, "key", "left").select("key", F.coalesce(F.greatest(F.nanvl("floor", F.lit(None)), "_likely"), F.lit(float("nan"))).alias("floor")))
    mine, others = _grid(floored, "key", keys, rows, block, growth)
    cells = mine.groupBy("_t", "_b").cogroup(others.groupBy("_t", "_b")).applyInPandas(best, "key string, candidate string, score double")
    return best_candidate(cells.withColumn("qid", F.col("key"))).drop("qid")


def best_candidate(scored: DataFrame, key: str = "candidate") -> DataFrame:
    """The highest score of each query; of equal ones the first key."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))
    return scored.withColumn("_place", place).where("_place = 1").drop("_place")


def match_subjects(queries: DataFrame, subjects: DataFrame, aliases: DataFrame | None, links: DataFrame, strict: bool = False) -> DataFrame:
    """Adds asignatura_id, estado and score (0 to 100) to queries (qid, texto, prog_id, curso).

    EXACT for equal keys; else the most similar key of the query's universe,
    FUZZY_AUTO from 88 (93 if strict) and FUZZY_LOW_CONFIDENCE from 65; else
    NO_MATCH. Only what has no equal key is scored. Where all keys are the
    universe, each distinct text meets them once, whatever queries have it.
    """
    index = cut(subject_index(subjects, aliases))
    exact = cut(exact_subject(queries, index, links).withColumns({"estado": F.lit("EXACT"), "score": F.lit(100.0)}))
    rest = cut(queries.withColumn("key", subject_key(F.coalesce("texto", F.lit("")))).where(F.length("key") >= 2).join(exact.select("qid"), "qid", "left_anti"))
    near, far = _near_universe(rest.select("qid", "prog_id", "curso"), index, links)
    pairs = _spread(cut(near.join(rest.select("qid", "key"), "qid")), 20_000)
    scored = pairs.withColumn("score", scorer(token_set_ratio)("key", "candidate")).where(F.col("score") >= CUTOFF)
    best = best_candidate(scored).select("qid", F.col("candidate").alias("key"), "score")
    far = cut(rest.join(far.select("qid").distinct(), "qid", "left_semi").select("qid", "key"))
    best = cut(best.unionByName(far.join(best_of_all(far.select("key").distinct(), index.select(F.col("key").alias("candidate")).distinct()), "key").select("qid", F.col("candidate").alias("key"), "score")))
    chosen = resolve_ambiguity(best.join(index, "key").join(rest.select("qid", "prog_id", "curso"), "qid"), links)
    auto = F.col("score") >= AUTO + (STRICT_MORE if strict else 0)
    fuzzy = chosen.select("qid", "asignatura_id", F.when(auto, "FUZZY_AUTO").otherwise("FUZZY_LOW_CONFIDENCE").alias("estado"), F.bround("score", 2).alias("score"))
    found = exact.select("qid", "asignatura_id", "estado", "score").unionByName(fuzzy)
    return queries.join(found, "qid", "left").withColumns({"estado": F.coalesce("estado", F.lit("NO_MATCH")), "score": F.coalesce("score", F.lit(0.0))})


def infer_program(queries: DataFrame, programs: DataFrame) -> DataFrame:
    """Adds programa_id and score to queries (qid, texto): an equal key, else the most similar one from 85."""
    keys = cut(programs.where("activo").groupBy(subject_key(F.col("nombre")).alias("candidate")).agg(F.max("id").alias("programa_id")).where("candidate <> ''"))
    queries = cut(queries)
    q = queries.select("qid", subject_key(F.coalesce("texto", F.lit(""))).alias("key")).where("key <> ''")
    exact = cut(q.join(keys, q["key"] == keys["candidate"]).select("qid", "programa_id", F.lit(100.0).alias("score")))
    rest = cut(q.join(exact.select("qid"), "qid", "left_anti"))
    best = best_of_all(rest.select("key").distinct(), keys.select("candidate"), cutoff=PROGRAM).join(keys, "candidate")
    found = exact.unionByName(rest.join(best, "key").select("qid", "programa_id", "score"))
    return queries.join(found, "qid", "left")


def room_index(rooms: DataFrame) -> DataFrame:
    """(key, aula_id): keys of names and codes, with and without blanks; the last room to have a key holds it."""
    each = F.explode(F.array("nombre", F.replace("nombre", F.lit(" "), F.lit("")), "codigo", F.replace("codigo", F.lit(" "), F.lit("")))).alias("texto")
    keys = rooms.where("activo").select("id", each).where("texto IS NOT NULL").select(room_key(F.col("texto")).alias("key"), "id")
    return keys.where(F.length("key") >= 2).groupBy("key").agg(F.max("id").alias("aula_id"))


def match_rooms(queries: DataFrame, rooms: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Adds aula_id and nivel to queries (qid, texto).

    Levels: 1 the key, 2 the key without blanks, 3 a room whose code ends in
    the query's letters and digits (the lowest id), 4 the most similar key from
    80. Each level only sees what the ones before left, which is worked out once. Codes are looked up by
    all their endings, so that level 3 is an equality join.
    """
    index = cut(room_index(rooms))
    q = cut(queries.where(F.length(F.trim("texto")) >= 2).select("qid", room_key(F.col("texto")).alias("key")))
    one = cut(q.join(index, "key").select("qid", "aula_id", F.lit(1).alias("nivel")))
    rest = cut(q.join(one, "qid", "left_anti"))
    two = rest.withColumn("key", F.replace("key", F.lit(" "), F.lit(""))).join(index, "key").select("qid", "aula_id", F.lit(2).alias("nivel"))
    two = cut(two)
    rest = cut(rest.join(two, "qid", "left_anti"))
    code = rooms.where("activo AND codigo IS NOT NULL").select(F.col("id"), room_alnum(F.col("codigo")).alias("code")).where(F.length("code") >= 2)
    ends = code.select("id", F.explode(F.transform(F.sequence(F.lit(2), F.length("code")), lambda n: F.substr("code", F.length("code") - n + 1, n))).alias("ending"))
    ends = ends.groupBy("ending").agg(F.min("id").alias("aula_id"))
    three = rest.withColumn("ending", room_alnum(F.col("key"))).where(F.length("ending") >= 2).join(ends, "ending").select("qid", "aula_id", F.lit(3).alias("nivel"))
    three = cut(three)
    found = one.unionByName(two).unionByName(three)
    if fuzzy:
        rest = cut(rest.join(three, "qid", "left_anti"))
        best = best_of_all(rest.select("key").distinct(), index.select(F.col("key").alias("candidate")), token_sort_ratio, ROOM).select("key", "candidate")
        four = rest.join(best, "key").join(index.select(F.col("key").alias("candidate"), "aula_id"), "candidate").select("qid", "aula_id", F.lit(4).alias("nivel"))
        found = found.unionByName(four)
    return queries.join(found, "qid", "left")


def first_by_lower(df: DataFrame, text: str, value: str) -> DataFrame:
    """(_k, value): the lowest value for each text in small letters."""
    return df.where(F.col(text).isNotNull()).groupBy(F.lower(text).alias("_k")).agg(F.min(value).alias(value))


def resolve_rooms(queries: DataFrame, rooms: DataFrame) -> DataFrame:
    """Adds aula_id by equal name, else equal code (capitals don't matter), else match_rooms; error where none."""
    names = first_by_lower(rooms.withColumnRenamed("id", "_name"), "nombre", "_name")
    codes = first_by_lower(rooms.withColumnRenamed("id", "_code"), "codigo", "_code")
    q = queries.withColumn("_k", F.lower(F.trim("texto"))).join(names, "_k", "left").join(codes, "_k", "left").withColumn("_id", F.coalesce("_name", "_code"))
    q = cut(q)
    rest = match_rooms(q.where("_id IS NULL").select("qid", "texto"), rooms).select("qid", F.col("aula_id").alias("_match"))
    out = q.join(rest, "qid", "left").withColumn("aula_id", F.coalesce("_id", "_match"))
    return out.select(*queries.columns, "aula_id", F.when(F.col("aula_id").isNull(), F.concat(F.lit("Aula no encontrada: "), F.coalesce("texto", F.lit("")))).alias("error"))


def resolve_subjects(queries: DataFrame, subjects: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds asignatura_id by equal name, else equal alias (capitals don't matter); error where none."""
    names = first_by_lower(subjects.withColumnRenamed("id", "_name"), "nombre", "_name")
    other = first_by_lower(aliases.withColumnRenamed("asignatura_id", "_alias"), "alias", "_alias")
    q = queries.withColumn("_k", F.lower(F.trim("texto"))).join(names, "_k", "left").join(other, "_k", "left")
    out = q.withColumn("asignatura_id", F.coalesce("_name", "_alias"))
    return out.select(*queries.columns, "asignatura_id", F.when(F.col("asignatura_id").isNull(), F.concat(F.lit("Asignatura no encontrada: "), F.coalesce("texto", F.lit("")))).alias("error"))


def match_teachers(rows: DataFrame, teachers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with profesor_id, by 'nombre apellidos' in small letters among active teachers, and the rows without."""
    key = F.lower(collapse(F.concat_ws(" ", "nombre", "apellidos")))
    keys = teachers.where("activo").groupBy(key.alias("_k")).agg(F.min("id").alias("profesor_id"))
    keyed = rows.withColumn("_k", F.lower(collapse(F.col("profesor"))))
    return keyed.join(keys, "_k").drop("_k"), keyed.join(keys, "_k", "left_anti").drop("_k")


def missing_refs(df: DataFrame, dim: DataFrame, key: str, dim_key: str = "id") -> DataFrame:
    """Distinct values of key that the dimension lacks."""
    ids = df.select(F.col(key).alias(dim_key)).where(F.col(dim_key).isNotNull()).distinct()
    return ids.join(dim.select(dim_key), dim_key, "left_anti").withColumnRenamed(dim_key, key)


def key_variants(rooms: DataFrame) -> DataFrame:
    return room_index(rooms)


def refine_matching(draft: DataFrame, subjects: DataFrame, aliases: DataFrame | None, links: DataFrame, programs: DataFrame) -> DataFrame:
    """Draft sessions (id, plan, curso, asignatura) matched again under their plan: asignatura_id, asignatura_sugerida, estado and score anew.

    Each plan's program is inferred once, and each text of a plan and course is
    matched once. Rows without a text keep nothing; NO_MATCH leaves no subject.
    """
    plans = infer_program(draft.select(F.col("plan").alias("qid"), F.col("plan").alias("texto")).where("plan IS NOT NULL").distinct(), programs)
    curso = F.expr("coalesce(try_cast(regexp_replace(cast(curso AS string), '[^0-9]', '') AS int), 0)")
    rows = draft.drop("asignatura_id", "asignatura_sugerida", "estado", "score").withColumn("_curso", curso)
    texts = rows.where(F.coalesce("asignatura", F.lit("")) != "").select("plan", "_curso", "asignatura").distinct()
    texts = texts.join(plans.select(F.col("qid").alias("plan"), F.col("programa_id").alias("prog_id")), "plan", "left")
    texts = cut(texts.select(F.monotonically_increasing_id().alias("qid"), F.col("plan").alias("_p"), F.col("_curso").alias("curso"), F.col("asignatura").alias("texto"), "prog_id"))
    found = match_subjects(texts.select("qid", "texto", "prog_id", "curso"), subjects, aliases, links).select("qid", "asignatura_id", "estado", "score")
    found = texts.join(found, "qid").join(subjects.select(F.col("id").alias("asignatura_id"), F.col("nombre").alias("asignatura_sugerida")), "asignatura_id", "left")
    on = F.col("plan").eqNullSafe(F.col("_p")) & (F.col("_curso") == F.col("_c")) & (F.col("asignatura") == F.col("texto"))
    return rows.join(found.withColumnRenamed("curso", "_c").drop("prog_id", "qid"), on, "left").drop("_p", "_c", "_curso", "texto")


def learn_aliases(draft: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases to insert: original texts that differ from the chosen subject's name, the last choice of each, unless they are known."""
    new = draft.where(F.col("asignatura_id").isNotNull() & (F.lower(F.trim("texto")) != F.lower(F.trim("nombre_oficial"))))
    last = new.groupBy(F.trim("texto").alias("alias")).agg(F.max_by("asignatura_id", "orden").alias("asignatura_id"))
    known = aliases.select(F.lower("alias").alias("_k")).distinct()
    return last.withColumn("_k", F.lower("alias")).join(known, "_k", "left_anti").drop("_k")


def register_alias_usage(aliases: DataFrame, uses: DataFrame) -> DataFrame:
    """Aliases (alias, asignatura_id, veces_usado) after uses (alias, asignatura_id): known ones count up, whatever their capitals, new ones start."""
    used = uses.select(collapse(F.col("alias")).alias("_a"), "asignatura_id").where("_a <> ''").groupBy(F.lower("_a").alias("_k")).agg(F.count("*").alias("_n"), F.min("_a").alias("_a"), F.min("asignatura_id").alias("_s"))
    out = aliases.withColumn("_k", F.lower("alias")).join(used, "_k", "full_outer")
    return out.select(F.coalesce("alias", "_a").alias("alias"), F.coalesce("asignatura_id", "_s").alias("asignatura_id"), (F.coalesce("veces_usado", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("veces_usado"))
