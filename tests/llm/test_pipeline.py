"""The pipeline, stage by stage, against plain versions, on rows that are hard to tell apart."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from quadrille.llm import sentencepiece_codec
from quadrille.llm.simhash import fingerprint_batch
from test_llm import TEXTS, low, prose, words

BIG = 2**60
ROWS = [(i, t, lang, f"s{k % 3}", 0) for k, (i, t, lang) in enumerate(TEXTS)] + [
    (5, "alpha beta gamma", "en", "a", 1), (5, "completely other words here", "en", "a", 1), (9, "ALPHA beta gamma", "en", "b", 1), (None, prose(90, 7), "en", "a", 1), (None, prose(90, 7), "en", "a", 1), (None, prose(90, 8), None, None, None),
    (BIG + 1, prose(50, 9), "en", "a", 1), (BIG + 3, prose(50, 9), "en", "a", 1), (BIG + 3, prose(50, 9), "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_in_stage int, kept string, digest int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in ROWS], SCHEMA).repartition(3)


def rows_of(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_exact_stage(spark, docs):
    got = rows_of(cp.exact(spark, docs, ""))
    groups = {}
    for r in ROWS:
        groups.setdefault(low(r[1]), []).append(r)
    assert sum(got.values()) == len(groups) and set(got) <= set(ROWS)
    for text, own in groups.items():
        assert sum(n for r, n in got.items() if low(r[1]) == text and (r[0] or -1) == max(x[0] if x[0] is not None else -1 for x in own)) == 1


def test_near_stage(spark, docs):
    got = rows_of(cp.near(spark, docs, ""))
    prints = [int(x) for x in fingerprint_batch([r[1] for r in ROWS], 4)]
    label = list(range(len(ROWS)))
    for _ in ROWS:
        label = [min(label[j] for j in range(len(ROWS)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(ROWS))]
    assert sum(got.values()) == len(set(label))
    for g in set(label):
        own = [r for r, x in zip(ROWS, label) if x == g]
        least = min((r[0] is None, r[0] or 0) for r in own)
        assert any((r[0] is None, r[0] or 0) == least and got[r] for r in own)


def test_mixing_stage(spark, docs):
    got = rows_of(cp.mixing(spark, docs, ""))
    assert set(got) <= set(ROWS) and all(n <= 3 * ROWS.count(r) for r, n in got.items())
    total = sum(len(words(r[1])) for r in ROWS)
    assert 0 < sum(n * len(words(r[1])) for r, n in got.items()) <= total + 3


def test_quality_stage_keeps_rows_as_they_are(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (8, 1, 0), (9, 1, 0), (12, 0, 0), (13, 0, 0), (BIG + 1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = rows_of(cp.quality(spark, docs, str(tmp_path)))
    assert set(got) <= set(ROWS) and all(got[r] == ROWS.count(r) for r in got) and got[BIG + 1, prose(50, 9), "en", "a", 1] == 1


def test_run(spark, docs, tmp_path):
    import sentencepiece

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (8, 1, 0), (9, 1, 0), (12, 0, 0), (13, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == list(cp.COLUMNS)
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    want = Counter((r.doc_id, tuple(lib.encode(r.text or ""))) for r in now.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in cp.run(spark, str(tmp_path)).collect()) == want and want


def test_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
