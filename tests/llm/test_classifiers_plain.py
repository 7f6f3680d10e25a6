"""The classifiers' parts against plain versions: kernel ridge in its dual form, word vectors summed pair by pair, the temperature searched again."""

import random

import numpy as np
import pyarrow as pa

from quadrille.llm import language as L
from quadrille.llm import quality as Q
from quadrille.llm.common import Memo

WORDS = {"en": "the river and stone of light house green walk under seven", "es": "la casa verde niña que los ríos piedra luz bajo siete", "de": "der Fluß und Stein Licht Haus grün gehen unter sieben schön"}


def texts(n, seed):
    rnd = random.Random(seed)
    return [(lang, " ".join(rnd.choice(w.split()) for _ in range(rnd.randint(2, 14)))) for _ in range(n) for lang, w in WORDS.items()]


def grams(text, n):
    plain = f" {L._NOT_LETTERS.sub(' ', text.lower())} "
    return {plain[i : i + n] for i in range(len(plain) - n + 1)}


def kernel(a, b):
    return sum(len(grams(a, n) & grams(b, n)) / (len(grams(a, n)) * len(grams(b, n))) ** 0.5 for n in (1, 2, 3)) / 3


def test_features_are_the_blended_spectrum_kernel():
    some = [t for _, t in texts(8, 1)]
    x = L.presence(some)
    plain = np.array([[kernel(a, b) for b in some] for a in some])
    assert np.abs(x @ x.T - plain).max() < 0.1 and np.corrcoef((x @ x.T).ravel(), plain.ravel())[0, 1] > 0.99  # n-grams that share a cell, single letters above all, are all that differs
    for n, (a, e) in enumerate(zip((0, 256, 2304), (256, 2304, 6400)), 1):
        cells, sets = (x[:, a:e] > 0).sum(axis=1), np.array([len(grams(t, n)) for t in some])
        assert (cells <= sets).all() and (cells >= sets - 2).all()
    assert np.allclose(np.diag(x @ x.T), 1, atol=1e-5)


def test_language_scores_equal_dual_kernel_ridge(spark):
    """With every row a landmark the Nystroem map loses nothing: a * K(rows, x) with a from the dual system gives the same scores."""
    known, asked = texts(12, 2), [t for _, t in texts(9, 3)] + ["zzz", "la river und"]
    train = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(known)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.identify_languages(docs, train, landmarks=10_000, ridge=0.01).collect()}
    x, y = L.presence([t for _, t in known]).astype(np.float64), np.array([lang for lang, _ in known])
    names = sorted(WORDS)
    k = x @ x.T + 1  # 1: the constant, which is held down like any other weight
    goal = np.where(y[:, None] == np.array(names), 1.0, -1.0)
    a = np.linalg.solve(k + 0.01 * np.diag([float((y == lang).sum()) for lang in y]), goal)
    values = (L.presence(asked).astype(np.float64) @ x.T + 1) @ a
    for i, v in enumerate(values):
        assert abs(got[i].score - np.clip((v.max() + 1) / 2, 0, 1)) < 2e-3
        if np.sort(v)[-1] - np.sort(v)[-2] > 5e-3:
            assert got[i].lang_pred == names[int(v.argmax())]


def test_word_vectors_are_sums_of_neighbours(spark):
    some = [t for _, t in texts(5, 4)] + [None, "", "one", "two two Two!"]
    docs = spark.createDataFrame([(t,) for t in some], "text string").repartition(3)
    got = Q.word_vectors(docs, seed=5)
    place, sign = Q.index_vectors(5)
    want = np.zeros((Q.BUCKETS, Q.DIM))
    for t in some:
        ids, _ = Q.tokens(pa.array([t], pa.string()), Memo(Q._coded))
        for i in range(len(ids)):
            for j in range(max(0, i - Q.REACH), min(len(ids), i + Q.REACH + 1)):
                if i != j:
                    for p, s in zip(place[ids[j]], sign[ids[j]]):
                        want[ids[i], p] += s
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert np.allclose(got, want, atol=1e-6) and (np.abs(want).sum(axis=1) > 0).sum() > 20


def test_network_learns_and_its_temperature_fits_the_held_rows():
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.standard_normal((1500, 6)), np.full(1500, 50.0)])
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(1500) < 0.1)).astype(float)  # no line parts it, and a tenth is noise
    net = Q.Network(x, y)
    p = net.probabilities(x)
    assert ((p > 0.5) == y).mean() > 0.8 and p.min() >= 0 and p.max() <= 1
    held = np.random.default_rng(1).permutation(1500)[:300]
    loss = lambda t: np.logaddexp(0, np.where(y[held] == 1, -1, 1) * net.logits(x[held]) / t).mean()
    assert loss(net.temperature) <= min(loss(t) for t in np.geomspace(0.25, 8, 41)) + 1e-12
    for lo, hi in ((0, 0.3), (0.3, 0.7), (0.7, 1)):  # calibrated: as often as said
        some = (p[held] >= lo) & (p[held] < hi)
        assert abs(p[held][some].mean() - y[held][some].mean()) < 0.15
