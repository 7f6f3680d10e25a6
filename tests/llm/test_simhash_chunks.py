"""SimHash links of an anchor that is cut into several chunks of homes and of visitors, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import simhash


def hot_anchor(rng, pairs):
    """Fingerprints that are equal in the first block, far apart in the others, but for partners with two bits flipped in each: these meet in one anchor alone."""
    first = np.uint64(rng.integers(0, 1 << 21))
    base = (rng.integers(0, 1 << 43, pairs, dtype=np.uint64) << np.uint64(21)) | first
    partner = base.copy()
    for low, width in simhash.BLOCKS[1:]:
        for i in range(pairs):
            for bit in rng.choice(width, 2, replace=False):
                partner[i] ^= np.uint64(1 << (low + int(bit)))
    return np.concatenate([base, partner])


def brute(fp, distance):
    near = np.bitwise_count(fp[:, None] ^ fp) <= distance
    label = np.arange(len(fp))
    while True:
        new = np.where(near, label, len(fp)).min(axis=1)
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("group_limit", [10**9, 60, 30])
def test_links_survive_chunks(spark, monkeypatch, group_limit):
    rng = np.random.default_rng(11)
    fp = np.concatenate([hot_anchor(rng, 100), rng.integers(0, 1 << 63, 20, dtype=np.uint64)])
    want = brute(fp, 4)
    assert (want != np.arange(len(fp))).sum() >= 100
    docs = spark.createDataFrame([(i, "", int(v)) for i, v in enumerate(fp.view(np.int64))], "doc_id long, text string, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.select("doc_id", "fp"))
    cut = simhash.split_large(simhash.anchored(docs, 4, 1), ["anchor", "home"], group_limit, F.col("fp"))
    assert group_limit > 10**6 or {r.home for r in cut.where("n_chunks > 2").select("home").distinct().collect()} == {True, False}
    got = {r.doc_id: r.component_id for r in simhash.simhash_near_dedup(docs, group_limit=group_limit).collect()}
    assert got == dict(enumerate(want.tolist()))
