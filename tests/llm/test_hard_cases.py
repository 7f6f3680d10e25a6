"""Ids beyond 2^53 beside null, rows and ids that repeat, long texts, micro-batches, one-text languages: every operator."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrille.llm import embedding_dedup, exact_dedup, language, line_dedup, lm, mixing, quality, sentencepiece_codec, simhash, substring_dedup
from quadrille.llm.common import documents, merged
from test_llm import joined, prose

BIG = 2**60
IDS = [BIG + 1, None, BIG + 3]


@pytest.fixture(scope="module")
def big(spark):
    """Three rows in one batch."""
    rows = [(i, prose(30, k), "en", "s") for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)


OPERATORS = {
    "quality": lambda d: quality.score_quality(d, d.select("doc_id", F.lit(1).alias("quality"))),
    "lm": lambda d: lm.score_texts(d, F.lit(True), turns=2),
    "encode": lambda d: sentencepiece_codec.decode(sentencepiece_codec.encode(d)),
    "simhash": lambda d: simhash.simhash_near_dedup(d),
    "mixing": lambda d: mixing.mix_sources(d),
    "language": lambda d: language.identify_languages(d, d),
    "substring": lambda d: substring_dedup.substring_dedup(d, width=5),
    "lines": lambda d: line_dedup.line_dedup(d),
    "exact": lambda d: exact_dedup.exact_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_keep_all_their_digits(big, name):
    assert sorted((r.doc_id or 0) for r in OPERATORS[name](big).select("doc_id").collect()) == [0, BIG + 1, BIG + 3]


def test_vectors_keep_their_ids(spark):
    df = spark.createDataFrame([(BIG + 1, [1.0, 2.0]), (None, [3.0, -1.0]), (BIG + 3, [2.0, 4.0]), (None, [3.0, -1.0])], "vec_id long, embedding array<float>").coalesce(1)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.embedding_near_dedup(df).collect())
    assert got == [(0, 1, 0, True), (0, 1, 0, True), (BIG + 1, 1, BIG + 1, True), (BIG + 3, 1, BIG + 1, False)]


def test_vectors_at_the_default_tables_reach_their_recall(spark):
    """Pairs at cosine 0.95 and a little more: the hardest. Recall is measured against brute force."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((400, 32))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.951, 0.97, (400, 1))
    v = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side]).astype(np.float32)
    got = embedding_dedup.embedding_near_dedup(spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(800), "embedding": v.tolist()}), "vec_id long, embedding array<float>")).collect()
    w = v.astype(np.float64)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    links = (w @ w.T >= 0.95).sum() - 800
    assert 0.97 * links <= sum(r.n_links for r in got) <= links


def test_a_pair_counts_once_whatever_its_keys_share(spark):
    """With one projection a table nearly all pairs meet in many tables; each link counts once."""
    rng = np.random.default_rng(8)
    v = (rng.standard_normal((5, 8))[rng.integers(0, 5, 60)] + 0.1 * rng.standard_normal((60, 8))).astype(np.float32)
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_near_dedup(spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(60), "embedding": v.tolist()}), "vec_id long, embedding array<float>"), projections=1, group_limit=7).collect()}
    w = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    assert got == dict(enumerate(((w @ w.T >= 0.95).sum(axis=1) - 1).tolist()))


def test_labels_join_like_union_find():
    rng = np.random.default_rng(1)
    label, pairs = np.arange(300), []
    for _ in range(6):
        a, b = rng.integers(0, 300, 40), rng.integers(0, 300, 40)
        pairs += zip(a.tolist(), b.tolist())
        label = merged(label, a, b)
    near = {frozenset(p) for p in pairs}
    assert dict(enumerate(label.tolist())) == joined(range(300), lambda a, b: a == b or frozenset((a, b)) in near)


def test_state_holds_over_micro_batches(spark):
    rows = [(i, f"text {i % 70}", i % 3) for i in range(210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(6)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, bytes_per_batch=1).collect()}
    assert got == {i: (140 + i % 70, 3) for i in range(210)}
    # the state's partitions and the stream's settings are the stream's own
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider" and spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_a_language_of_one_text_is_learnt(spark):
    rows = [(i, "la casa verde de la niña está lejos", "es") for i in range(5000)] + [(10_000 + i, prose(20, i), "en") for i in range(200)] + [(None, "der kleine Hund läuft über die Straße", "de")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.lang, r.lang_pred) for r in language.identify_languages(docs, docs).join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "lang_pred").count().collect()}
    assert got == {("es", "es"), ("en", "en")}
    names, sample = language.sampled(docs, 500, 16_000, 3)
    assert names == ["de", "en", "es"] and {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()} == {"de": 1, "en": 200, "es": 500}


def test_equal_rows_in_a_mix(spark):
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") < 30_000, "a").otherwise("b").alias("source"))
    got = {r.source: r for r in mixing.mix_sources(docs, keep_columns=True).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n")).collect()}
    assert sum(r.n for r in got.values()) == 100_000 and all(r.target - 3 <= r.taken <= r.target for r in got.values())


def test_sources_that_overlap(spark):
    """Documents of a alone, and of a and b: what they share must go to b, as b has nothing else."""
    rows = [(i, "w " * 10, ["a"] if i % 2 else ["a", "b"]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s array<string>")
    out = mixing.mix_sources(docs, sources=F.col("s"), weights=(1, 1), bucket_rows=20).collect()
    assert abs(taken_of(out, ["a", "b"]) - 2000) <= 20 and abs(taken_of(out, ["a"]) - 2000) <= 20
    route = mixing.routed([2000, 2000, 500], [[0], [0, 1], [2]], [2000.0, 2000.0, 900.0], 3)
    assert np.allclose(route, [2000, 2000, 900])


def taken_of(rows, sources):
    return sum(r.taken for r in rows if list(r.sources) == sources)


def test_every_pattern_goes_through_the_flow(spark, monkeypatch):
    """Sources that share nothing are parts of their own, each with a flow."""
    calls, route = [], mixing.route
    monkeypatch.setattr(mixing, "route", lambda capacity, *a: calls.append(len(capacity)) or route(capacity, *a))
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.col("id").cast("string").alias("source"))
    out = mixing.mix_sources(docs).agg(F.count("*").alias("n"), F.sum("taken").alias("t")).first()
    assert out.n == 3_000 and out.t <= 6_000 and calls == [1] * 3_000
    calls.clear()
    joined = mixing.routed([10, 20, 30, 40, 50], [[0], [0, 1], [2], [2, 3], [4]], [10.0, 20.0, 40.0, 30.0, 60.0], 3)
    assert sorted(calls) == [1, 2, 2] and np.allclose(joined, [10, 20, 30, 40, 60]) and mixing.routed([], [], [], 3).size == 0


def test_columns_with_the_names_of_a_result(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", 9, "x") for i in range(6)], "doc_id long, text string, source string, size long, taken string")
    out = mixing.mix_sources(docs, keep_columns=True)
    assert sorted(out.columns) == ["doc_id", "size", "source", "source_size", "sources", "taken", "target", "text"] and {r.size for r in out.collect()} == {3}
    encoded = sentencepiece_codec.encode(docs).withColumn("text", F.lit(7))
    assert sentencepiece_codec.decode(encoded).columns == ["doc_id", "ids", "text"] and {r.text for r in sentencepiece_codec.decode(encoded).collect()} == {"a b c"}


def test_an_id_that_all_rows_share_is_dealt_out(spark):
    rows = [(None, prose(40, i)) for i in range(300)] + [(7, prose(40, i)) for i in range(300)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string")
    out = substring_dedup.substring_dedup(docs, width=20, group_bytes=5000)
    got = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_removed").alias("gone")).collect()
    assert {r.doc_id: (r.n, r.gone > 0) for r in got} == {None: (600, False), 7: (600, True)}
    assert {r.doc_id: r.n for r in lm.score_texts(docs, F.lit(True), group_bytes=5000, turns=2).groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {None: 600, 7: 600}


def test_one_long_text(spark):
    """A text of 10 MB, beside short ones: whole, in every operator that reads words."""
    part = prose(50_000, 4)
    docs = spark.createDataFrame([(1, part), (2, "short one"), (3, None)], "doc_id long, text string").withColumn("text", F.when(F.col("doc_id") == 1, F.repeat("text", F.lit(30))).otherwise(F.col("text")))
    n = (len(part.split()) - 1) * 30 + 1
    assert {r.doc_id: r.n_words for r in substring_dedup.substring_dedup(docs, width=20).select("doc_id", "n_words").collect()} == {1: n, 2: 2, 3: 0}
    assert {r.doc_id: r.n_tokens for r in lm.score_texts(docs, F.col("doc_id") == 2).collect()} == {1: n + 1, 2: 3, 3: 1}
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).select("doc_id", F.length("text").alias("n")).collect()
    assert {r.doc_id: r.n for r in out} == {1: 30 * len(part), 2: 9, 3: 0}


def brute_quality(texts, vectors):
    """Mean vectors of shapes and of stems, word by word."""
    out = []
    for t in texts:
        code = [quality._coded(w) for w in (t or "").encode().split()]
        half = quality.SHAPES // 2
        shapes = [quality.STEMS + c % half + (half if i and code[i - 1] == c else 0) for i, c in enumerate(code)]
        stems = [c // half for c in code]
        out.append(np.concatenate([vectors[x].mean(axis=0) if x else np.zeros(quality.DIM) for x in (shapes, stems)] + [[len(code)]]))
    return np.array(out)


def test_quality_features_and_held_out_accuracy(spark):
    import pyarrow as pa

    from quadrille.llm.common import Memo

    vectors = np.random.default_rng(0).standard_normal((quality.BUCKETS, quality.DIM)).astype(np.float32)
    texts = [None, "", " \n", "One one ONE!! 12", prose(50, 1), "ñandú Ñ été..."]
    assert np.allclose(quality.pooled(pa.array(texts), vectors, Memo(quality._coded)), brute_quality(texts, vectors), atol=1e-5)
    sf = "/root/testdata/sf0.01"
    rows = quality.op2_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out AND quality IS NOT NULL").select("score", "predicted", "quality").collect()
    assert len(rows) > 40 and np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = language.op7_language_id(spark, sf).join(documents(spark, sf).select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").select("lang", "lang_pred").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


def test_mix_of_the_query_against_a_plain_version(spark):
    """Targets by hand; every source takes whole documents, comes within its largest document of the target, and nothing above three times."""
    sf = "/root/testdata/sf0.001"
    rows = mixing.op6_source_mixing(spark, sf).collect()
    docs = {r.doc_id: r for r in documents(spark, sf).collect()}
    size = {i: len((d.text or "").encode().split()) for i, d in docs.items()}
    source = {}
    for i, d in docs.items():
        source[d.source] = source.get(d.source, 0) + size[i]
    names = sorted(source, key=lambda s: (s is None, s or ""))
    goal, left, total = {}, {s: k % 3 + 1 for k, s in enumerate(names)}, sum(source.values())
    while left:
        room = total - sum(goal.values())
        over = [s for s in left if room * left[s] / sum(left.values()) > 3 * source[s]]
        goal |= {s: 3 * source[s] for s in over} if over else {s: room * left[s] / sum(left.values()) for s in left}
        left = {s: w for s, w in left.items() if over and s not in over}
    taken = {}
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == source[docs[r.doc_id].source] and abs(r.target - goal[docs[r.doc_id].source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and (r.taken == 0 or r.taken % r.size == 0)
        taken[docs[r.doc_id].source] = taken.get(docs[r.doc_id].source, 0) + r.taken
    for s in names:
        assert goal[s] - max(size[i] for i, d in docs.items() if d.source == s) <= taken[s] <= goal[s] + 1
