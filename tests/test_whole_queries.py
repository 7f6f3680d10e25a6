"""Queries that must take in the whole table, against plain versions on small tables of their own."""

import re

import pytest

from quadrille import plans
from quadrille.operators import matching as M
from quadrille.plans import matching as PM
from quadrille.plans.registry import Tables


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("small"))
    spark.range(3000).selectExpr("id AS event_id").write.parquet(f"{folder}/events.parquet")
    spark.range(200).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "concat('lace y 3 e sky', id) AS p_name").write.parquet(f"{folder}/part.parquet")
    return folder


def test_split_groups_takes_all_texts(spark, small):
    want = []
    for r in Tables(spark, small).textos.collect():
        cut = re.split(r"\s*[,/&+]\s*|\s+(?:y|e)\s+|y(?=PA|PL|GR|G\.|[0-9])", r.t.strip(" "), flags=re.I)
        want += [(r.id, p.strip(" ")) for p in cut if p.strip(" ")]
    got = [(r.id, r.grupo) for r in plans.queries()["n16_split_groups"](spark, small).collect()]
    assert sorted(got) == sorted(want) and {i % 16 for i, _ in got} == set(range(16))


@pytest.fixture(scope="module")
def world(spark, small):
    """Queries, (key, asignatura_id) pairs and links, as plain rows."""
    t = Tables(spark, small)
    index = {(r.key, r.asignatura_id) for r in M.subject_index(t.asignaturas, PM.own(t, PM.ALIASES)).collect()}
    queries = PM.own(t, PM.NAMES).withColumn("key", M.subject_key(M.F.col("texto"))).collect()
    return queries, index, {(r.asignatura_id, r.programa_id, r.curso) for r in t.enlaces.collect()}


def universe(q, index, links):
    course = {(a, c) for a, p, c in links if p == q.prog_id}
    keys = {k for k, a in index if q.curso > 0 and (a, q.curso) in course}
    return keys or {k for k, a in index if a in {a for a, _ in course}} or {k for k, _ in index}


def test_candidate_universe_of_all_queries(spark, small, world):
    queries, index, links = world
    want = {q.qid: len(universe(q, index, links)) for q in queries}
    assert sum(n == len({k for k, _ in index}) for n in want.values()) >= len(queries) / 4
    assert {r.qid: r.n for r in plans.queries()["j9_candidate_universe"](spark, small).collect()} == want


def resolved(q, ids, links):
    return min(ids, key=lambda a: (not any(x == a and p == q.prog_id for x, p, _ in links), not (q.curso > 0 and (a, q.prog_id, q.curso) in links), a))


def test_match_subjects_reaches_all_keys(spark, small, world):
    queries, index, links = world
    of = {}
    for k, a in index:
        of.setdefault(k, set()).add(a)
    want = {}
    for q in queries:
        want[q.qid] = (None, "NO_MATCH", 0.0, q.prog_id)
        if q.key in of:
            want[q.qid] = (resolved(q, of[q.key], links), "EXACT", 100.0, q.prog_id)
        elif len(q.key) >= 2:
            score, best = min((-M.token_set_ratio(q.key, c), c) for c in universe(q, index, links))
            if -score >= M.CUTOFF:
                want[q.qid] = (resolved(q, of[best], links), "FUZZY_AUTO" if -score >= M.AUTO else "FUZZY_LOW_CONFIDENCE", round(-score, 2), q.prog_id)
    got = {r.qid: (r.asignatura_id, r.estado, r.score, r.prog_id) for r in plans.queries()["j10_w3_match_subjects"](spark, small).collect()}
    assert got == want and any(q.prog_id is None and want[q.qid][1].startswith("FUZZY") for q in queries)


def test_best_of_all_over_several_cells(spark):
    texts, keys = [f"MTERIA {i} X" for i in range(9)] + ["QQQQ"], [f"MATERIA {i}" for i in range(12)] + ["MATERIA 3 X", "Z"]
    candidates = spark.createDataFrame([(k,) for k in keys], "candidate string")
    want = {t: min((-M.token_set_ratio(t, k), k) for k in keys) for t in texts}
    got = {r.key: (-r.score, r.candidate) for r in M.best_of_all(spark.createDataFrame([(t,) for t in texts], "key string"), candidates, rows=3, block=4).collect()}
    assert got == {t: w for t, w in want.items() if -w[0] >= M.CUTOFF}
