"""Whitening, toxicity and hard negatives against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import hard_negatives as H
from quadrille.llm import toxicity as X
from quadrille.llm import whitening as W

SF = "/root/testdata/sf0.01"


def plain_whitening(x, k=16):
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    values, vectors = np.linalg.eigh((u - s / n).T @ (u - s / n) / n)
    order = np.argsort(-values)[:k]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-300)), values[order] / values.sum()


def test_whitening_equals_an_eigendecomposition(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((300, 20)) * np.linspace(3, 1, 20)
    v = np.concatenate([v, v[:7], v[:7]])
    rows = [(i, [float(c) for c in r], "x") for i, r in enumerate(v)]
    rows += [(None, rows[3][1], "x"), (901, None, "x"), (902, [float("nan")] * 20, "x"), (903, [None] + rows[0][1][1:], "x"), (904, [], "x"), (905, [1.0, 2.0], "x"), (906, [3.0, -2.0], "x"), (907, [0.0, 9.0], "x")]
    out = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string")).toPandas()
    assert sorted(out.vec_id.dropna().unique()) == [*range(314), 905, 906, 907]
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    n, deviation, whitened, explained = plain_whitening(x)
    one = out[out.vec_id < 900].sort_values(["vec_id", "component"])
    assert (one.n == n).all() and (one[one.component == 1].deviation.to_numpy() == deviation).all()
    got = one.whitened.to_numpy().reshape(314, 16)
    sign = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got * sign - whitened).max() < 1e-9
    assert np.allclose(one.explained.to_numpy()[:16], explained, rtol=1e-10) and one.identity_error.max() < 1e-10
    none = out[out.vec_id.isna()].sort_values("component").whitened.to_numpy()
    assert np.allclose(none, got[3], rtol=1e-12, atol=1e-12)
    assert len(out[out.vec_id >= 900]) == 6 and (out[out.vec_id >= 900].n == 3).all()


def test_whitening_of_flat_and_equal_data(spark):
    """A component without deviation isn't returned; equal eigenvalues all come out; equal vectors have nothing to whiten."""
    flat = [(i, [float(a), float(b), 0.0, float(a)]) for i, (a, b) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])]
    out = W.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<float>")).toPandas()
    assert out.component.max() == 2 and np.allclose(out.groupby("component").explained.first(), [2 / 3, 1 / 3]) and out.identity_error.max() < 1e-10
    cross = [(2 * i + s, [3.0 * (1 - 2 * s) if j == i else 0.0 for j in range(6)]) for i in range(6) for s in (0, 1)]
    out = W.whiten(spark.createDataFrame(cross, "vec_id long, embedding array<double>")).toPandas()
    assert out.component.max() == 6 and np.allclose(out.explained, 1 / 6) and out.identity_error.max() < 1e-10
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")).count() == 0
    assert W.whiten(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_bidiagonalisation_may_end_early():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((400, 60)) @ np.diag(0.5 ** np.arange(60))
    calls = []

    def product(v, p, c):
        calls.append(1)
        u = a @ p
        w = a @ v - u @ c
        return u.T @ w, float(w @ w), a.T @ w

    v, s = W.bidiagonalised(product, 60, 4, np.linalg.norm(a), 1e-10, 0)
    _, want, vt = np.linalg.svd(a, full_matrices=False)
    assert len(calls) < 40 and np.allclose(s[:4], want[:4], rtol=1e-9) and np.allclose(np.abs((v[:, :4] * vt[:4].T).sum(axis=0)), 1, atol=1e-8)


def test_deviations_too_large_for_a_long():
    fit = W.Whitening(2, np.array([0, 0]), np.array([1, 1]), np.zeros((2, 0)), np.zeros(0), 1.0)
    assert fit.deviations(np.array([[2**40, 0], [3, 4]])) == [None, 25 + 49]


def test_block_max_index_is_exact():
    rng = np.random.default_rng(2)
    v = np.where(rng.random((500, 30)) < 0.1, rng.integers(1, 4, (500, 30)), 0).astype(float)
    v[490:] = v[:10]
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    index = X.BlockMaxIndex(v)
    queries = np.concatenate([v[::7], np.zeros((1, 30)), np.eye(30)])
    place, cosine = index.nearest(queries, 9)
    full = np.round(queries @ v.T, 12)
    for i, q in enumerate(full):
        best = sorted((j for j in range(500) if q[j] > 0), key=lambda j: (-q[j], j))[:9]
        assert place[i][: len(best)].tolist() == best and (place[i][len(best) :] == -1).all() and cosine[i][: len(best)].tolist() == q[best].tolist()


def test_toxicity_equals_plain_neighbours(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where("doc_id % 4 <> 0")
    out = X.score_toxicity(docs, labels, terms=60, k=5).join(docs.select("doc_id", "text"), "doc_id").toPandas()
    sample = labels.join(docs, "doc_id").select("doc_id", "text", "toxic")
    chosen = X.chosen_terms(sample, 60, 5, 20.0)

    def counts(text):
        c = np.zeros(len(chosen) + 1)
        ws = (text or "").encode().split()
        for w in ws:
            for t in X.terms_of(w):
                if t in chosen:
                    c[chosen.index(t)] += 1
        c[-1] = len(ws)
        return c

    every = np.array([counts(t) for t in out.text])
    idf = np.log1p((every[:, -1] > 0).sum() / np.maximum(1, (every > 0).sum(axis=0)))
    tf = np.where(every > 0, 1 + np.log(np.maximum(every, 1)), 0) * idf
    tf /= np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-300)
    place = {d: i for i, d in enumerate(out.doc_id)}
    known = {r.doc_id: r.toxic for r in sample.collect()}
    cos = tf @ tf[[place[d] for d in known]].T
    for i in range(0, len(out), 23):
        best = np.sort(np.round(np.unique(np.round(cos[i], 10)), 9))[::-1]
        assert np.allclose([e["cosine"] for e in out.evidence[i]][:1], best[:1], atol=1e-8)
        for e in out.evidence[i]:
            assert e["doc_id"] in known and abs(tf[i] @ tf[place[e["doc_id"]]] - e["cosine"]) < 1e-9
    both = out[out.doc_id.isin(known)]
    assert ((both.predicted == [known[d] for d in both.doc_id]).mean()) > 0.95


def test_toxicity_of_odd_rows(spark):
    texts = [(i, f"you are a {'worthless idiot' if i % 4 == 0 else 'friend of mine'} number {i}") for i in range(60)]
    odd = [(100, None), (101, ""), (102, "\t \n"), (None, "you worthless idiot"), (103, "!!! ???"), (104, "\x00 日本 idiot!"), (104, "\x00 日本 idiot!"), (105, "idiot " * 40_000)]
    docs = spark.createDataFrame([(*t, 9.0, "e") for t in texts + odd], "doc_id long, text string, score double, evidence string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)] + [(0, 1), (5, None), (None, 1), (7, 3), (4, 1)], "doc_id long, toxic int")
    out = X.score_toxicity(docs, labels).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert len(out) == 68 and all(0 <= r.score <= 1 for r in out) and len(by[104]) == 2 and by[104][0].score == by[104][1].score
    assert by[None][0].predicted == by[104][0].predicted == by[105][0].predicted == 1
    assert len({by[i][0].score for i in (100, 101, 102)}) == 1 and by[100][0].predicted == 0 and by[100][0].evidence == []
    assert all(by[i][0].predicted == int(i % 4 == 0) for i in range(60))
    assert {r.score for r in X.score_toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in X.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert X.score_toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = X.op12_toxicity(spark, SF).where("held_out").join(labels, "doc_id").select("predicted", "toxic").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.93


def plain_negatives(rows, positives=5, negatives=10):
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for a in (r for r in rows if r[3]):
        others = [r for r in rows if len(r[2]) == len(a[2]) and r[0] != a[0]]
        rank = lambda r: (-score(a, r), r[0] is None, r[0] or 0)
        for p in sorted((r for r in others if r[1] == a[1]), key=rank)[:positives]:
            ps = score(a, p)
            far = sorted((r for r in others if r[1] != a[1] and 30 * ps <= 100 * score(a, r) <= 90 * ps), key=rank)[:negatives]
            out += [(a[0], p[0], i + 1, r[0], ps, score(a, r)) for i, r in enumerate(far)]
    return out


@pytest.mark.parametrize("chunk_rows, block_rows, sample_rows", [(8192, 2048, 4096), (40, 7, 30)])
def test_hard_negatives_equal_brute_force(spark, chunk_rows, block_rows, sample_rows):
    rng = np.random.default_rng(4)
    centres = rng.integers(-200, 200, (6, 8))
    rows = [(i, int(rng.integers(0, 3)), tuple(int(c) for c in centres[i % 6] + rng.integers(-30, 30, 8)), i % 25 == 0) for i in range(500)]
    same = rows[100][2]
    rows += [(1000 + i, i % 2, same, i % 20 == 0) for i in range(60)]  # copies, of two labels
    rows += [(2000 + i, 1, tuple([i % 3] * 4), i == 0) for i in range(9)] + [(None, 1, same, False), (None, 0, same, False), (7, 2, same, True), (7, 2, same, True), (3000, 0, (0,) * 8, True), (3001, 0, tuple([-5] * 8), True)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "id long, label long, x array<bigint>, anchor boolean, score string").repartition(4)
    got = H.mine_hard_negatives(frame, chunk_rows=chunk_rows, block_rows=block_rows, sample_rows=sample_rows).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_negatives(rows), key=key)


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, label long, x array<bigint>, anchor boolean")
    assert H.mine_hard_negatives(empty).count() == 0
    one = spark.createDataFrame([(100, 1, [1, 2], True)], empty.schema)
    assert H.mine_hard_negatives(one).count() == 0


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(5)
    x = (rng.integers(-1000, 1000, (20, 12))[np.arange(4000) % 20] + rng.integers(-20, 20, (4000, 12))).astype(np.int32)
    largest = np.linalg.norm(x.astype(float), axis=1).max()
    tree = H.CoverTree.unpacked(H.CoverTree.build(x, np.arange(4000) % 7, np.arange(4000), largest, leaf=50).packed())
    p, c = H.augmented(tree.x, largest), H.augmented(tree.centre, largest)
    assert sorted(tree.ids) == list(range(4000)) and len(tree.first) > 20
    for n in range(len(c)):
        assert np.linalg.norm(p[tree.first[n] : tree.last[n]] - c[n], axis=1).max() <= tree.radius[n]
        kids = range(tree.below[n], tree.until[n])
        assert not kids or (tree.first[kids[0]], tree.last[kids[-1]]) == (tree.first[n], tree.last[n])
        if len(kids) > 1:
            d = H._distances(c[kids.start : kids.stop], c[kids.start : kids.stop])
            assert d[~np.eye(len(d), dtype=bool)].min() > tree.radius[n] / H.BASE * 0.999 - 1
    seen = []
    plain = H.products
    H.products = lambda a, b: seen.append(len(b)) or plain(a, b)
    try:
        query, score, ids, _ = H.search(tree, x[:5], np.arange(5), np.arange(5) % 7, np.arange(5), True, np.full(5, -np.inf), np.full(5, np.inf), 5, largest)
    finally:
        H.products = plain
    full = x[:5].astype(np.int64) @ x.T.astype(np.int64)
    for q in range(5):
        want = sorted((j for j in range(4000) if j % 7 == q % 7 and j != q), key=lambda j: (-full[q, j], j))[:5]
        assert ids[query == q].tolist() == want
    assert sum(seen) < 2500  # centres and rows that were scored, of 4,000 rows


def test_products_beyond_doubles():
    a, b = np.array([[H.LARGEST, 3]], dtype=np.int32), np.array([[H.LARGEST, 1]] * 2, dtype=np.int32)
    big = np.repeat(a, 8, axis=1)
    assert H.products(a, b).tolist() == [[2**52 + 3] * 2] and H.products(big, big)[0, 0] == 8 * (2**52 + 9)


def test_queries_keep_ids(spark):
    out = H.op13_hard_negatives(spark, SF)
    assert dict(out.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    assert out.where(F.col("anchor_id") % 100 != 0).count() == 0
