"""Small fixtures with every awkward case, held against plain versions of each operator."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quadrille.llm import embedding_dedup, exact_dedup, language, line_dedup, lm, mixing, quality, sentencepiece_codec, simhash, substring_dedup
from quadrille.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gid long, unit string, score double, key long, at int"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def low(t):
    return (t or "").translate(str.maketrans(UPPER, LOWER))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def prose(n, seed):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(["the", "of", "river", "stone", "light", "house", "green", "walk", "under", "seven", "Ärger", "niño"]) + rnd.choice(["", "", "s", "ing", "ed"]) for _ in range(n))


TEXTS = [
    (1, prose(60, 1), "en"), (2, prose(60, 1).upper(), "en"), (3, prose(60, 1) + " end", "en"), (4, None, None), (5, "", "en"), (6, "  \n\t ", "en"), (7, "one", None),
    (8, prose(4000, 2), "en"), (9, prose(30, 3) + " " + prose(60, 1), "de"), (10, "a\nb\nc\nd\ne", "de"), (11, "x\na\nb\nc\nz", "de"), (12, "!!! ??? 123", "es"),
    (13, "x" * 50_000, "es"), (14, prose(60, 1), "en"), (None, prose(25, 5), "en"), (15, prose(25, 5), "en"), (15, prose(25, 5), "en"), (16, "日本語 テスト \x00 é", "fr"),
    (17, "la casa verde de la niña", "es"), (18, "der Hund und die Katze", "de"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, None if k % 5 == 0 else f"s{k % 3}", 0, 7, "u", 0.5, 3, 1) for k, (i, t, lang) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_exact_dedup(docs, none):
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect())
    groups = {}
    for i, t, _ in TEXTS:
        groups.setdefault(low(t), []).append(i)
    want = []
    for i, t, _ in TEXTS:
        g = groups[low(t)]
        keep = max((x for x in g if x is not None), default=None)
        want.append(((i is None, i or 0), keep, len(g), i == keep))
    assert got == sorted(want)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_checks_bytes_where_digests_collide(docs):
    sound = {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()}
    weak = {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs, digest=lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1).cast("binary"), broadcast_rows=0).collect()}
    assert weak == sound


def fingerprint(t, n):
    w = words(low(t))
    shingles = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else ([" ".join(w)] if w else [])
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if count[b] * 2 > len(shingles))


def joined(ids, near):
    label = {i: i for i in ids}
    while True:
        new = {i: min(label[j] for j in ids if near(i, j)) for i in ids}
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("refine_above,group_limit", [(10**9, 10**9), (0, 10**9), (10**9, 2)])
def test_simhash(docs, none, refine_above, group_limit):
    rows = simhash.simhash_near_dedup(docs, words=4, refine_above=refine_above, group_limit=group_limit).collect()
    prints = {t: fingerprint(t, 4) for _, t, _ in TEXTS}
    ids = [i for i, _, _ in TEXTS if i is not None]
    of = {i: prints[t] for i, t, _ in TEXTS}
    label = joined(ids, lambda a, b: bin(of[a] ^ of[b]).count("1") <= 4)
    assert len(rows) == len(TEXTS)
    for r in rows:
        if r.doc_id is not None:
            assert r.fingerprint == f"{of[r.doc_id]:016x}" and r.component_id == label[r.doc_id]
    assert simhash.simhash_near_dedup(none).count() == 0


def test_anchors_cover_and_meet():
    tables = simhash._tables()
    x = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    low_, high, leader = tables
    code = x ^ leader[low_[x & 0xFFF] ^ high[x >> 12]]
    assert np.bitwise_count(x ^ code).max() <= simhash.RADIUS
    assert not (low_[code & 0xFFF] ^ high[code >> 12]).any()


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((60, 16))
    v[10:20] = v[0] + 0.15 * rng.standard_normal((10, 16))
    v[30] = v[31] = v[32]
    rows = [(int(i), [float(np.float32(y)) for y in x]) for i, x in enumerate(v)]
    rows += [(100, None), (101, []), (102, [0.0] * 16), (103, [float("nan")] * 16), (104, [None] + [1.0] * 15), (105, [float("inf")] + [0.0] * 15), (106, [1.0, 2.0]), (107, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit("x"))
    got = {r.vec_id: r for r in embedding_dedup.embedding_near_dedup(df, tables=40, group_limit=3).collect()}
    x = np.array([r[1] for r in rows[:60]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    label = joined(range(60), lambda a, b: near[a, b] or a == b)
    for i in range(60):
        assert got[i].n_links == near[i].sum() - 1 and got[i].component_id == label[i] and got[i].kept == (label[i] == i)
    assert [(got[i].n_links, got[i].component_id) for i in range(100, 106)] == [(0, i) for i in range(100, 106)]
    assert got[106].n_links == got[107].n_links == 1 and got[107].component_id == 106
    assert embedding_dedup.embedding_near_dedup(df.limit(0)).count() == 0


def test_substring_dedup(docs, none):
    width = 20
    order = sorted({(i is not None, i or 0, t or "") for i, t, _ in TEXTS})
    seen, found = set(), {}
    for has, i, t in order:
        w, gone = words(t), set()
        for s in range(len(w) - width + 1):
            window = tuple(w[s : s + width])
            if window in seen:
                gone.update(range(s, s + width))
            seen.add(window)
        spans = [k for k in sorted(gone) if k - 1 not in gone]
        found[i if has else None, t] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone), len(spans))
    want = [(i or 0, *found[i, t or ""]) for i, t, _ in TEXTS]
    for group_bytes in (1 << 20, 600):
        rows = substring_dedup.substring_dedup(docs, width=width, group_bytes=group_bytes).collect()
        got = [(r.doc_id or 0, r.n_words, r.n_removed, r.kept, len(r.removed)) for r in rows]
        assert all(sum(b - a for a, b in r.removed) == r.n_removed for r in rows)
        assert sorted(got) == sorted(want)
    assert substring_dedup.substring_dedup(none).count() == 0


def test_rolling_hash_is_of_the_window_alone():
    x = np.random.default_rng(0).integers(0, 1 << 63, 100).astype(np.uint64)
    for width in (1, 3, 20, 37):
        h = substring_dedup.rolling(x, width, 12345)
        plain = [sum(int(v) * pow(12345, width - 1 - j, 1 << 64) for j, v in enumerate(x[i : i + width])) % (1 << 64) for i in range(100 - width + 1)]
        assert h.tolist() == plain


def test_line_dedup(docs, none):
    order = sorted({(TEXTS[k][0] is not None, TEXTS[k][0] or 0, TEXTS[k][1] or "") for k in range(len(TEXTS))})
    seen, want = set(), {}
    for has, i, t in order:
        lines, gone = t.split("\n"), set()
        for s in range(len(lines) - 2):
            w = tuple(lines[s : s + 3])
            if w in seen:
                gone.update(range(s, s + 3))
            seen.add(w)
        want[i if has else None, t] = (len(lines), len(gone), "\n".join(x for j, x in enumerate(lines) if j not in gone))
    got = [(r.doc_id, r.n_lines, r.n_removed, r.kept) for r in line_dedup.line_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(((i, *want[i, t or ""]) for i, t, _ in TEXTS), key=str)
    assert line_dedup.line_dedup(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted((r.doc_id or 0, r.taken) for r in rows) == sorted((r.doc_id or 0, r.taken) for r in again)
    assert len(rows) == len(TEXTS) and all(0 <= r.taken <= 3 * r.size and (r.taken == 0 or r.taken % r.size == 0) for r in rows)
    sizes = {}
    for r in rows:
        sizes.setdefault(r.sources[0], []).append(r)
    assert list(sizes) and abs(sum(v[0].target for v in sizes.values()) - sum(r.size for r in rows)) < 1e-6
    for own in sizes.values():
        assert own[0].source_size == sum(r.size for r in own) and own[0].target <= 3 * own[0].source_size + 1e-6
        assert sum(r.taken for r in own) <= own[0].target + 1
    assert mixing.mix_sources(none).count() == 0


def test_targets_share_the_excess():
    got = mixing.targets({"a": 10, "b": 1000, None: 1000}, {"a": 3, "b": 1, None: 2}, 3)
    assert got["a"] == 30 and abs(got["b"] * 2 - got[None]) < 1e-9 and abs(sum(got.values()) - 2010) < 1e-9


def test_route_takes_overlapping_patterns_where_they_are_needed():
    # the shared pattern must serve b, as a has its own words and b has none
    flow = mixing.route([100, 100], [[0], [0, 1]], [100.0, 100.0], 3)
    assert np.allclose(flow, [[100, 0], [0, 100]])
    flow = mixing.route([10], [[0]], [25.0], 3)
    assert np.allclose(flow, [[25.0]])
    # sending back: a first takes shared words, then must leave them to b
    flow = mixing.route([50, 50], [[0], [0, 1]], [60.0, 50.0], 2)
    assert np.allclose(flow.sum(axis=0), [60, 50])


def test_sentencepiece(docs, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    rows = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, batch_bytes=500)).collect()
    of = {}
    for i, t, _ in TEXTS:
        of[i] = t
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert list(r.ids) == (lib.encode(of[r.doc_id]) if of[r.doc_id] else []) and r.text == (of[r.doc_id] or "")
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(none)).count() == 0


def test_sentencepiece_on_random_texts():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    codec = sentencepiece_codec.Codec(open(sentencepiece_codec.default_model(), "rb").read())
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdeth  éñ\n😀!.0▁") for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    for block in (1 << 19, 100):
        assert codec.encode(pa.array(texts), block=block).to_pylist() == [lib.encode(t) for t in texts]
    plain = [t.replace("▁", "") for t in texts]
    assert codec.decode(codec.encode(pa.array(plain))).to_pylist() == plain
    # bytes that are no text, ids without a piece, null
    assert codec.decode(pa.array([[codec.byte_id[0xFF]], [1, 2], [], None], pa.list_(pa.int32()))).to_pylist() == ["\ufffd", "", "", None]


def test_pairs_of_pieces_stay_as_merging_has_it():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    rng = np.random.default_rng(5)
    left, right = rng.choice(codec.piece_ids, 3000), rng.choice(codec.piece_ids, 3000)
    near = rng.choice(codec.piece_ids[codec.piece_len > 4], 1500)  # pieces cut in two are the pairs that are merged
    left[:1500], right[:1500] = codec.left[near], codec.right[near]
    want = [codec._merged(list(codec.names[a] + codec.names[b]))[0] == [codec.names[a], codec.names[b]] for a, b in zip(left.tolist(), right.tolist())]
    assert codec.stays(left, right).tolist() == want and 0 < sum(want) < 3000


def test_language(docs, none):
    more = docs.sparkSession.createDataFrame([(100 + i, prose(20, i), "en") for i in range(20)] + [(200 + i, f"der kleine Hund läuft schnell über die Straße und bellt {i}", "de") for i in range(20)], "doc_id long, text string, lang string")
    rows = {(r.doc_id, r.lang_pred) for r in language.identify_languages(docs.unionByName(more, allowMissingColumns=True), more).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (12, "und")} <= rows and (100, "en") in rows and (200, "de") in rows and (18, "de") in rows
    assert {r.lang_pred for r in language.identify_languages(docs, none).collect()} == {"und"}
    assert language.identify_languages(none, more).count() == 0


def test_quality(docs, none):
    spark = docs.sparkSession
    good = [(1000 + i, prose(40, i)) for i in range(80)]
    bad = [(2000 + i, " ".join(w.upper() + "!!" for w in prose(40, i).split())) for i in range(80)]
    both = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:60]] + [(i, 0, 0) for i, _ in bad[:60]] + [(3, None, 0), (7, 5, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.score_quality(docs.select("doc_id", "text", "score", "key").unionByName(both, allowMissingColumns=True), labels).collect()}
    assert all(rows[i].predicted == 1 for i, _ in good) and all(rows[i].predicted == 0 for i, _ in bad)
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[4].score == rows[5].score == rows[6].score
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(none, labels).count() == 0


def test_language_model(docs, none):
    import math
    import zlib

    learn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 7 != 2
    rows = lm.score_texts(docs, learn, turns=2, group_bytes=2000).collect()
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2
    count, n = {}, 0
    for i, t, _ in TEXTS:
        if not held(i):
            for w in [*words(low(t)), None]:
                count[w] = count.get(w, 0) + 1
                n += 1
    want = sorted((i or 0, len(words(t)) + 1, sum(w in count for w in [*words(low(t)), None]), round(sum(math.log10((count.get(w, 0) + 1) / (n + len(count) + 1)) for w in [*words(low(t)), None]), 6)) for i, t, _ in TEXTS)
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert {r.train_tokens for r in rows} == {n} and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm.score_texts(none, learn).count() == 0
    assert {r.base_score for r in lm.score_texts(docs, F.lit(False)).collect()} == {0.0}


def test_attention_gradient_and_windows():
    from quadrille.llm import attention as A

    rng = np.random.default_rng(0)
    place = rng.permutation(A.OUTCOMES)
    logs = A.count_logs(rng.poisson(0.2, (A.INPUTS, A.OUTCOMES)), place)

    def net_of(dim):
        net = A.Attention(place, logs, dim)
        for k in ("to_class", "to_member"):
            net.p[k][:] = rng.standard_normal(net.p[k].shape)
        return net

    net = net_of(8)
    net.flat = net.flat.astype(np.float64)
    net.p = net._views(net.flat)
    ids = rng.integers(0, A.OUTCOMES, (3, A.WINDOW)).astype(np.int32)
    ids[0, 0], ids[2, 5], ids[1, 10:] = A.BEGIN, A.BEGIN, A.PAD
    asked = np.where(rng.random(ids.shape) < 0.9, rng.integers(0, A.OUTCOMES, ids.shape), -1)
    _, g, used = net.gradient(ids, asked)
    whole = {k: np.zeros(v.shape) for k, v in net.p.items()} | {k: v for k, v in g.items() if k != "table"}
    whole["table"][used] = g["table"]
    flat = np.concatenate([whole[k].ravel() for k in net.p])
    for i in rng.choice(np.flatnonzero(np.abs(flat) > 1e-4), 12):
        at, eps, loss = net.flat[i], 1e-3, []
        for step in (eps, -eps):
            net.flat[i] = at + step
            loss.append(net.gradient(ids, asked)[0])
        net.flat[i] = at
        assert abs((loss[0] - loss[1]) / (2 * eps) - flat[i]) < 2e-3 * max(1, abs(flat[i]))
    # every outcome is scored once, with the inputs before it in its window alone, whatever texts are beside it
    net = net_of(8)
    seq = rng.integers(2, A.OUTCOMES, 50)
    seq[-1] = A.END
    changed = seq.copy()
    changed[40] = 5
    got, other, alone = net.score(np.concatenate([seq, [A.END]]), np.array([50, 1])), net.score(np.concatenate([changed, [A.END]]), np.array([50, 1])), net.score(np.concatenate([[A.END], seq]), np.array([1, 50]))
    assert np.allclose(got[:40], other[:40], atol=1e-5) and not np.isclose(got[40], other[40]) and np.isclose(got[50], other[50])
    assert np.allclose(alone, np.roll(got, 1), atol=1e-5)
    # parts of a long text look back over their edge
    assert np.allclose(net.score(seq, np.array([50]), most=16), got[:50], atol=1e-5)
    # the outcomes after a beginning have probabilities that add up to 1
    first = np.full(2 * A.OUTCOMES, A.END)
    first[::2] = np.arange(A.OUTCOMES)
    at = net.score(first[1:], np.append(1, np.full(A.OUTCOMES - 1, 2)))
    assert abs(np.exp(np.append(at[0], at[1::2]).astype(np.float64)).sum() - 1) < 1e-3


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(30)] + [(500, i) for i in range(501, 560)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = sorted({x for e in edges if e[0] != e[1] for x in e})
    pairs = {frozenset(e) for e in edges}
    label = joined(ids, lambda a, b: a == b or frozenset((a, b)) in pairs)
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
