"""Similarities against plain versions, and the cascades."""

import random
from functools import lru_cache

from quadrille.operators import matching as M


def plain_lcs(a, b):
    @lru_cache(None)
    def go(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + go(i + 1, j + 1) if a[i] == b[j] else max(go(i + 1, j), go(i, j + 1))

    return go(0, 0)


def test_common_subsequence():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 14))) for _ in "12")
        assert M.common_subsequence(a, b) == plain_lcs(a, b)


def test_scores():
    assert M.ratio("", "") == 100 and M.ratio("abc", "") == 0
    assert M.token_sort_ratio("B  A", "A B") == 100
    assert M.token_set_ratio("CALCULO I", "CALCULO I GRUPO") == 100 and M.token_set_ratio("", "A") == 0
    assert round(M.token_set_ratio("ALGEBRA LINEAL", "ALGEBRA LINIAL"), 2) == round(max(200 * plain_lcs("ALGEBRA LINEAL", "ALGEBRA LINIAL") / 28, 200 * 7 / (7 + 14)), 2)


def test_subjects(spark):
    subjects = spark.createDataFrame([(1, "Cálculo I", True), (2, "Álgebra Lineal", True), (3, "Física", False), (4, "Calculo  I", True)], "id long, nombre string, activo boolean")
    aliases = spark.createDataFrame([(2, "Alg. Lin"), (3, "Fis")], "asignatura_id long, alias string")
    links = spark.createDataFrame([(1, 10, 1), (2, 10, 2), (4, 20, 1)], "asignatura_id long, programa_id long, curso int")
    q = spark.createDataFrame([(1, "CALCULO I", 20, 1), (2, "algebra lineall", 10, 2), (3, "alg lin", None, 0), (4, "Fis", None, 0), (5, "x", None, 0), (6, None, None, 0)], "qid long, texto string, prog_id long, curso int")
    got = {r.qid: (r.asignatura_id, r.estado) for r in M.match_subjects(q, subjects, aliases, links).collect()}
    assert got[1] == (4, "EXACT") and got[2] == (2, "FUZZY_AUTO") and got[3] == (2, "EXACT")
    assert got[4][1] in ("NO_MATCH", "FUZZY_LOW_CONFIDENCE") and got[5] == got[6] == (None, "NO_MATCH")


def test_rooms(spark):
    rooms = spark.createDataFrame([(1, "Aula 5", "ED-005", True), (2, "Laboratorio Química", "ED-LQ1", True), (3, "Aula 9", "X", False)], "id long, nombre string, codigo string, activo boolean")
    q = spark.createDataFrame([(1, "aula 5"), (2, "AULA5"), (3, "LQ1"), (4, "laboratorio quimca"), (5, "Aula 9 norte larga"), (6, "z"), (7, None)], "qid long, texto string")
    got = {r.qid: (r.aula_id, r.nivel) for r in M.match_rooms(q, rooms).collect()}
    assert got[1] == (1, 1) and got[2] == (1, 1) and got[3] == (2, 3) and got[4] == (2, 4) and got[5] == got[6] == got[7] == (None, None)


def test_far_fewer_pairs_are_compared_than_there_are(spark, tmp_path):
    """Names that all share a word: the best of all is found, and few pairs are scored for it."""
    counter = str(tmp_path)

    def counted(a, b):
        import os

        with open(f"{counter}/{os.getpid()}", "a") as f:
            f.write("x")
        return plain_ratio(a, b)

    plain_ratio = M.token_set_ratio
    texts, keys = [f"MTERIA {i} CALCULO" for i in range(0, 400, 4)], [f"MATERIA {i} CALCULO" for i in range(400) if i % 3]
    want = {}
    for t in texts:
        score, key = min((-plain_ratio(t, k), k) for k in keys)
        if -score >= M.CUTOFF:
            want[t] = (key, -score)
    M.token_set_ratio = counted
    try:
        found = M.best_of_all(spark.createDataFrame([(t,) for t in texts], "key string"), spark.createDataFrame([(k,) for k in keys], "candidate string"), counted)
        got = {r.key: (r.candidate, r.score) for r in found.collect()}
    finally:
        M.token_set_ratio = plain_ratio
    assert got == want and sum(p.stat().st_size for p in tmp_path.iterdir()) < len(texts) * len(keys) / 4
