"""Operator 5: SimHash near-duplicates by anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import components, documents, map_groups, map_texts, merged, split_large, stored

#: Generator of the perfect binary Golay code: 23 bits, 12 of them free, covering radius 3. A fixed value.
GOLAY = 0b101011100011
RADIUS = 3
#: The 64 bits are cut in three blocks; of two fingerprints with at most `distance` differing bits some block has at most distance // 3.
BLOCKS = ((0, 21), (21, 21), (42, 22))

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and for each syndrome the lightest word that has it."""

    def remainder(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= np.where((x >> bit) & 1, GOLAY << (bit - 11), 0)
        return x

    low, high = remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12)
    one = 1 << np.arange(23)
    pairs = (one[:, None] | one)[np.triu_indices(23, 1)]
    threes = np.unique((pairs[:, None] | one)[np.bitwise_count(pairs[:, None] | one) == 3])
    leader = np.zeros(1 << 11, dtype=np.int64)
    for words in (threes, pairs, one):
        leader[remainder(words)] = words
    leader[0] = 0
    return low, high, leader


def nearest_anchor(x: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Number (0 to 4095) of the only code word within the covering radius."""
    low, high, leader = tables
    return (x ^ leader[low[x & 0xFFF] ^ high[x >> 12]]) >> 11


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint_batch(texts: list[str | None], words: int) -> np.ndarray:
    """SimHash of each text, from the XXH64 of its word shingles with repeats."""
    hashes, sizes = [], np.zeros(len(texts), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        parts = (text or "").encode().translate(_LOWER).split()
        if not parts:
            continue
        joined = b" ".join(parts)
        if len(parts) <= words:
            spans = [joined]
        else:
            lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            ends = np.cumsum(lengths + 1) - 1
            first = (ends - lengths)[: len(parts) - words + 1].tolist()
            spans = [joined[a:b] for a, b in zip(first, ends[words - 1 :].tolist())]
        hashes.append(np.array([digest(s, 42) for s in spans], dtype=np.uint64))
        sizes[i] = len(spans)
    out = np.zeros(len(texts), dtype=np.uint64)
    if not hashes:
        return out
    full = np.flatnonzero(sizes)
    each = np.concatenate(hashes).view(np.uint8).reshape(-1, 8)
    starts = np.append(0, np.cumsum(sizes[full]))
    for a in range(0, len(full), 64):  # some documents at a time: their byte histograms, then the bits in them
        b = min(a + 64, len(full))
        part = each[starts[a] : starts[b]]
        row = np.repeat(np.arange(b - a), sizes[full[a:b]])
        cell = ((row[:, None] * 8 + np.arange(8)) * 256 + part).ravel()
        ones = np.bincount(cell, minlength=(b - a) * 2048).reshape(-1, 256) @ _BITS
        over = ones.reshape(b - a, 64) * 2 > sizes[full[a:b], None]
        out[full[a:b]] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 5, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and fp: the fingerprint as a signed long; texts without words have 0."""

    def found(texts: pa.Array) -> dict:
        return {"fp": fingerprint_batch(texts.to_pylist(), words).view(np.int64)}

    return map_texts(docs, found, "fp long", carried)


def anchored(fps: DataFrame, distance: int, refine: int) -> DataFrame:
    """Replicates fingerprints to anchors: rows (anchor, home, fp).

    In every block a fingerprint's home is the code word within the covering
    radius; it also visits every code word within that radius plus the block's
    share of the distance. With refine > 1 the bits outside the block are cut
    in that many parts, and each part's value becomes part of the anchor: as
    long as refine > distance, one of the parts is equal in any two linked
    fingerprints, so that nothing is lost and groups are far smaller.
    """
    share = distance // len(BLOCKS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = _tables()
        for frame in batches:
            fp = frame["fp"].to_numpy().view(np.uint64)
            for k, (low, width) in enumerate(BLOCKS):
                x = ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
                near = [x]
                for _ in range(share):
                    near = [y ^ f for y in near for f in (0, *(1 << np.arange(width)))]
                visits = np.sort(np.stack([nearest_anchor(y, tables) for y in near], axis=1), axis=1)
                new = np.ones(visits.shape, dtype=bool)
                new[:, 1:] = visits[:, 1:] != visits[:, :-1]
                row, col = np.nonzero(new)
                anchor = np.concatenate([nearest_anchor(x, tables), visits[row, col]])
                value = np.concatenate([fp, fp[row]])
                home = np.repeat([True, False], [len(fp), len(row)])
                others = [b for b in range(64) if not low <= b < low + width]
                for j in range(refine):
                    key = (anchor * len(BLOCKS) + k) * refine + j
                    if refine > 1:
                        part = np.uint64(sum(1 << b for b in others[j::refine]))
                        mixed = (value & part) * np.uint64(0x9E3779B97F4A7C15)
                        key = key ^ ((mixed ^ (mixed >> np.uint64(29))) & np.uint64((1 << 62) - 1)).astype(np.int64) << 17
                    yield pd.DataFrame({"anchor": key, "home": home, "fp": value.view(np.int64)})

    return fps.select("fp").mapInPandas(run, "anchor long, home boolean, fp long")


def _linked(distance: int):
    def run(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        fp, home = frame["fp"].to_numpy().view(np.uint64), frame["home"].to_numpy()
        a, b = [], []
        for s, e in zip(starts[:-1], starts[1:]):
            mine, seen = fp[s:e][home[s:e]], np.unique(fp[s:e][~home[s:e]])
            if not len(mine) or not len(seen):
                continue
            every = np.unique(np.concatenate([mine, seen]))
            label, at = np.arange(len(every)), np.searchsorted(every, seen)
            own = np.searchsorted(every, mine)
            step = max(1, 4_000_000 // len(seen))
            for lo in range(0, len(mine), step):
                apart = np.bitwise_count(mine[lo : lo + step, None] ^ seen)
                i, j = np.nonzero((apart <= distance) & (apart > 0))  # a home may sit in another chunk of visitors, so that itself never counts
                label = merged(label, own[lo + i], at[j])
            joined = np.flatnonzero(label != np.arange(len(every)))
            a.append(every[joined])
            b.append(every[label[joined]])
        if a:
            yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    return run


def simhash_near_dedup(docs: DataFrame, *, row: str | None = None, words: int = 5, distance: int = 4, refine_above: int = 4_000_000, group_limit: int = 20_000) -> DataFrame:
    """Groups documents whose SimHash fingerprints are linked, directly or through others.

    A fingerprint has 64 bits, from the XXH64 (seed 42) of the text's word
    shingles: A-Z lower-cased, shingles joined by a space, repeats counted,
    fewer words than a shingle making one. Two fingerprints link at `distance`
    or fewer differing bits. Equal fingerprints are one class; the classes are
    replicated to the anchors of a Golay code in each of three blocks of bits,
    and within an anchor homes are compared with visitors. Links of a group
    leave it as a forest, never as all pairs; a group of more than group_limit
    rows is cut into chunks of homes that each meet all chunks of visitors.
    Above refine_above distinct fingerprints the anchors also take in bits
    outside their block, which keeps groups small; the links found are the
    same.

    docs needs doc_id and text; other columns are ignored. Null, empty and
    wordless texts have fingerprint 0 and link like any other. Returns doc_id,
    fingerprint (16 lowercase hex digits), component_id (the smallest doc_id
    reachable) and kept (doc_id = component_id), one row per row of docs. A
    null doc_id is never chosen while the group has another; where all are
    null, component_id is null and all say kept. row names a column that
    numbers the rows of docs: it comes back too, and then only the first of
    the rows that have the chosen id says kept.
    """
    if not 0 <= distance <= 5:
        raise ValueError("distance must be from 0 to 5: one block may then differ in at most one bit")
    fps = stored(fingerprints(docs, words, ("doc_id",) if row is None else ("doc_id", row)), "simhash")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", (F.lit(0) if row is None else F.col(row)).alias("row"))
    classes = fps.groupBy("fp").agg(F.min(place).alias("first"))
    refine = distance + 1 if classes.count() > refine_above else 1
    rows = split_large(anchored(classes, distance, refine), ["anchor", "home"], group_limit, F.col("fp"))
    sizes = rows.where("n_chunks > 1").groupBy("anchor").pivot("home", [True, False]).agg(F.max("n_chunks"))
    if not sizes.isEmpty():
        sizes = stored(sizes.select("anchor", F.coalesce("true", F.lit(1)).alias("homes"), F.coalesce("false", F.lit(1)).alias("visitors")), "simhash_chunks")
        rows = rows.join(sizes, "anchor", "left")
        other = F.when(F.col("home"), F.col("visitors")).otherwise(F.col("homes"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        rows = rows.withColumn("unit", F.when(F.col("home"), F.col("chunk") * 100_000 + F.col("other")).otherwise(F.col("other") * 100_000 + F.col("chunk")))
    else:
        rows = rows.withColumn("unit", F.lit(0))
    edges = map_groups(rows.select("anchor", "unit", "home", "fp"), ["anchor", "unit"], _linked(distance), "a long, b long")
    found = components(edges).withColumnRenamed("id", "fp").withColumnRenamed("component_id", "root")
    rooted = stored(classes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash_classes")
    roots = rooted.groupBy("root").agg(F.min("first").alias("chosen"))
    named = stored(rooted.join(roots, "root").select("fp", "chosen"), "simhash_named")
    kept = F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) if row is None else F.col(row) == F.col("chosen.row")
    own = [] if row is None else [row]
    return fps.join(named, "fp").select(*own, "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("chosen.doc_id").alias("component_id"), kept.alias("kept"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(documents(spark, sf_dir), words=4).select("doc_id", "fingerprint", "component_id")
