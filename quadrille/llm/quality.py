"""Operator 2: quality classifier on random-indexing word vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import Memo, Words, documents, fold, map_texts, released, slices

#: Buckets for words by their letters, and for their shapes; a shape says also whether the word repeats the one before.
STEMS, SHAPES = 1 << 15, 1 << 12
BUCKETS = STEMS + SHAPES
DIM, NONZERO, REACH = 32, 2, 2
_SHAPE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", b"A" * 26 + b"a" * 26 + b"0" * 10)
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_EDGE = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def _coded(word: bytes) -> int:
    stem = xxhash.xxh32_intdigest(word.lower().strip(_EDGE)) % STEMS
    shape = word.translate(_SHAPE)
    shape = re.sub(rb"[\x80-\xff]+", b"a", shape)
    return stem * (SHAPES // 2) + xxhash.xxh32_intdigest(_RUN.sub(rb"\1\1", shape)) % (SHAPES // 2)


def tokens(texts: pa.Array, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers, a shape before each stem, of all texts together; the number of tokens of each text."""
    words = Words(texts)
    if len(memo) > 150_000:
        memo.clear()
    known = np.fromiter(map(memo.__getitem__, words.listed()), dtype=np.int64, count=len(words.names))
    code = known[words.of]
    same = np.zeros(len(code), dtype=bool)
    same[1:] = code[1:] == code[:-1]
    out = np.empty(2 * len(code), dtype=np.int64)
    out[0::2] = STEMS + code % (SHAPES // 2) + np.where(same, SHAPES // 2, 0)
    out[1::2] = code // (SHAPES // 2)
    return out, 2 * words.sizes


def index_vectors(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse ternary index vectors: NONZERO places and signs of every bucket."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def word_vectors(docs: DataFrame, seed: int = 5) -> np.ndarray:
    """Context vectors of all buckets over all documents, of length 1: the sum of the index vectors of the tokens within REACH.

    Every task adds up its own table of BUCKETS by DIM; Spark adds the tables.
    The result's size doesn't depend on the documents.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors(seed)
        total, memo = np.zeros(BUCKETS * DIM), Memo(_coded)
        for batch in batches:
            for part in slices(batch):
                ids, sizes = tokens(part.column("text"), memo)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                for step in range(1, REACH + 1):
                    near = np.flatnonzero(owner[step:] == owner[:-step])
                    left, right = ids[near], ids[near + step]
                    for k in range(NONZERO):
                        total += np.bincount(left * DIM + place[right, k], weights=sign[right, k], minlength=len(total))
                        total += np.bincount(right * DIM + place[left, k], weights=sign[left, k], minlength=len(total))
        rows = total.reshape(BUCKETS, DIM)
        used = np.flatnonzero(np.abs(rows).sum(axis=1))
        memo.clear()
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(rows[used, i]) for i in range(DIM))], names=["bucket", *(f"v{i}" for i in range(DIM))])
        del total, rows
        released()

    columns = [f"v{i}" for i in range(DIM)]
    summed = docs.select("text").mapInArrow(added, "bucket int, " + ", ".join(f"{c} double" for c in columns))
    summed = summed.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    vectors = summed[columns].to_numpy()
    out[summed["bucket"].to_numpy(dtype=np.int64)] = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return out


def pooled(texts: pa.Array, vectors: np.ndarray, memo: Memo) -> np.ndarray:
    """Mean vector of a text's shapes, mean vector of its stems (zeros for a text without words) and its number of words, side by side."""
    ids, sizes = tokens(texts, memo)
    out = np.zeros((len(texts), 2 * DIM + 1), dtype=np.float32)
    out[:, -1] = sizes // 2
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.append(0, np.cumsum(sizes[full] // 2)[:-1])
        for half in (0, 1):
            sums = np.add.reduceat(vectors[ids[half::2]], starts, axis=0)
            out[full, half * DIM : (half + 1) * DIM] = sums / (sizes[full, None] // 2)
    return out


class Network:
    """Two layers, a hidden one of tanh units and a logistic output, whose logit is divided by a calibrated temperature.

    The last column of x is a text's number of words: features of short texts
    are drawn to the mean, as a few words say little.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x[:, :-1].mean(axis=0), x[:, :-1].std(axis=0) + 1e-3
        x = self.standard(x)
        order = rng.permutation(len(x))
        held = order[: len(x) // 5]
        rest = order[len(held) :]
        self.w = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
        first, second, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            rng.shuffle(rest)
            for a in range(0, len(rest), 128):
                part = rest[a : a + 128]
                h = np.tanh(x[part] @ self.w[0] + self.w[1])
                p = 1 / (1 + np.exp(-(h @ self.w[2] + self.w[3])))
                d = (p - y[part]) / len(part)
                back = np.outer(d, self.w[2]) * (1 - h * h)
                grads = [x[part].T @ back + 1e-4 * self.w[0], back.sum(axis=0), h.T @ d + 1e-4 * self.w[2], np.array([d.sum()])]
                t += 1
                for w, g, m, v in zip(self.w, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        if len(held):
            z, goal = self.logits(x[held], scaled=True), y[held]
            grid = np.geomspace(0.25, 8, 41)
            loss = [np.logaddexp(0, np.where(goal == 1, -z, z) / k).mean() for k in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x[:, :-1] - self.mean) / self.scale * (x[:, -1:] / (x[:, -1:] + 4))

    def logits(self, x: np.ndarray, scaled: bool = False) -> np.ndarray:
        x = x if scaled else self.standard(x)
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def score_quality(docs: DataFrame, labels: DataFrame, *, train_rows: int = 20_000, threshold: float = 0.3, seed: int = 5, row: str | None = None) -> DataFrame:
    """Scores every text of docs for quality, learning from labels.

    Words are counted in hashed buckets, once by their letters and once by
    their shape (case, digits, punctuation, and whether they repeat the word
    before). Random indexing over all texts gives every bucket a vector; a
    document's features are its mean vectors. A two-layer network learns on
    them, and its logits are divided by a temperature fitted on a fifth of the
    sample.

    labels needs doc_id and quality (0 or 1; other values and nulls are left
    out; of several labels of an id the lowest counts). The train_rows labels
    first in the order of a seeded hash of the id are fitted on: the bounded
    sample, which is also what is broadcast. Where docs repeat an id, one of its rows is learnt from. docs needs
    doc_id and text; other columns are ignored. Null and empty texts and those
    without words share one score. Without labels of both kinds all scores are
    0.5, or 1 or 0 if one kind is there. Returns doc_id, score (0 to 1),
    predicted (1 if score >= threshold), one row per row of docs; row names a
    column that numbers the rows of docs, which comes back too.
    """
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, seed))
    labels = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = labels.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(train_rows)

    def featured(texts: pa.Array, memo: Memo) -> dict:
        return {"features": [r.tobytes() for r in pooled(texts, vectors.value, memo)]}

    rows = map_texts(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), featured, "features binary", ("doc_id", "quality"), start=lambda: Memo(_coded))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("quality", "features")).alias("one")).select("one.*", "doc_id").collect()  # no more than train_rows
    rows = sorted((r["doc_id"], r["quality"], bytes(r["features"])) for r in rows)
    y = np.array([q for _, q, _ in rows], dtype=np.float64)
    both = len(set(y.tolist())) == 2
    model = Network(np.frombuffer(b"".join(f for *_, f in rows), dtype=np.float32).reshape(len(rows), -1).astype(np.float64), y) if both else None
    constant = float(y[0]) if len(y) else 0.5

    def scored(texts: pa.Array, memo: Memo) -> dict:
        score = model.probabilities(pooled(texts, vectors.value, memo).astype(np.float64)) if model else np.full(len(texts), constant)
        return {"score": score, "predicted": (score >= threshold).astype(np.int32)}

    return map_texts(docs, scored, "score double, predicted int", ["doc_id"] if row is None else [row, "doc_id"], start=lambda: Memo(_coded))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 5) != 0)
    out = score_quality(documents(spark, sf_dir), labels)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
