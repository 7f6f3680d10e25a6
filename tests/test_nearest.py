"""The best of all by equality joins: it equals the plain search, and what settles a text doesn't grow with the keys."""

import itertools
import random

import pytest

from quadrille.operators import matching as M


@pytest.mark.parametrize("fn, cutoff", [(M.token_set_ratio, 65), (M.token_set_ratio, 85), (M.token_sort_ratio, 80)])
def test_equals_the_plain_search(spark, fn, cutoff):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("ABCÑ") for _ in range(rnd.choice((1, 2, 3, 9))))
    keys = {" ".join(word() for _ in range(rnd.choice((1, 2, 3, 11)))) for _ in range(250)} | {"", "A A B", "MATERIA 12 CALCULO", "MATERIA 1 CALCULO"}
    texts = {" ".join(word() for _ in range(rnd.choice((1, 2, 3, 10)))) for _ in range(120)} | {"", "B A", "MTERIA 12 CALCULO", "MATERIA 77 CALCULO GRUPO"}
    for k in rnd.sample(sorted(keys), 80):
        at = rnd.randint(0, len(k))
        texts.add(k[:at] + rnd.choice(["", " ", "B", "Z"]) + k[at + rnd.randint(0, 2) :])
    frames = [spark.createDataFrame([(x,) for x in sorted(xs)], f"{c} string") for c, xs in (("key", texts), ("candidate", keys))]
    got = {r.key: (-r.score, r.candidate) for r in M.best_of_all(*frames, fn, cutoff).collect()}
    want = {x: min((-fn(x, k), k) for k in keys) for x in texts}
    assert got == {x: w for x, w in want.items() if -w[0] >= cutoff}


def test_numbered_names_are_settled_without_the_grid(spark, monkeypatch):
    """Texts that are one letter off their key, or have some of its words, meet no other keys."""
    met = []
    grid = M.grid_best
    monkeypatch.setattr(M, "grid_best", lambda texts, *rest: met.append(texts.count()) or grid(texts, *rest))
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    rooms = [f"AULA {i}" for i in range(10_000, 12_000) if i % 11]
    got = M.best_of_all(frame([f"AULLA {i}" for i in range(10_000, 12_000, 10)], "key"), frame(rooms, "candidate"), M.token_sort_ratio, 80).collect()
    assert len(got) == 200 and not met
    plans = [f"GRADO EN PLAN {i}" for i in range(3_000)]
    got = M.best_of_all(frame([f"PLAN {i}" for i in range(0, 3_000, 10)], "key"), frame(plans, "candidate"), cutoff=85).collect()
    assert {r.candidate for r in got} == {f"GRADO EN PLAN {i}" for i in range(0, 3_000, 10)} and not met


@pytest.mark.parametrize("fn", [M.token_set_ratio, M.token_sort_ratio])
def test_forms_of_texts_do_not_go_through_the_driver(spark, monkeypatch, fn):
    """A few texts have many forms, which Spark takes for as small as the texts."""
    ran, real = [], M.cut

    def cut(df):
        df.collect()
        ran.append(df._jdf.queryExecution().executedPlan().toString().split("\n"))
        return real(df)

    monkeypatch.setattr(M, "cut", cut)
    texts = spark.createDataFrame([(f"MATERIA {i} FISICA",) for i in range(40)], "key string")
    keys = spark.createDataFrame([(f"MATERIA {i} FISICAS",) for i in range(40)], "candidate string")
    assert M.near_of_all(texts, keys, fn is M.token_set_ratio, 65, fn).count() == 40
    below = lambda lines, k: [x for x in itertools.takewhile(lambda x: len(x) - len(x.lstrip(" :+-")) > len(lines[k]) - len(lines[k].lstrip(" :+-")), lines[k + 1 :])]
    sent = [x for lines in ran for k, line in enumerate(lines) if "BroadcastExchange" in line for x in below(lines, k) if "MapInPandas" in x]
    assert any("MapInPandas" in x for lines in ran for x in lines) and not sent
