"""Operator 11: whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import released, stored, with_fields

#: Bytes of vectors in one stored row of the fit list.
BLOCK_BYTES = 2 << 20
#: Lengths below this share of the matrix's norm count as zero.
TINY = 1e-11


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(lists.flatten(), dtype=np.int64).reshape(-1, dim)


def _packed(rows: DataFrame, dim: int) -> DataFrame:
    """Distinct vectors x in blocks of bytes: what every pass reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_BYTES // (8 * dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            parts = [x[at : at + step] for at in range(0, len(x), step)]
            yield pa.RecordBatch.from_arrays([pa.array([len(p) for p in parts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["rows", "block"])
        released()

    return stored(rows.select("x").distinct().mapInArrow(run, "rows int, block binary"), "whitening_fit")


def _summed(packed: DataFrame, dim: int, size: int, fn: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all blocks of fn(vectors), which has a fixed size: each task adds up its own, Spark adds the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("block"):
                part = fn(np.frombuffer(raw.as_buffer(), dtype=np.int64).reshape(-1, dim))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["pos", "value"])

    out = np.zeros(size, dtype=np.int64 if kind == "long" else np.float64)
    for r in packed.mapInArrow(run, f"pos int, value {kind}").groupBy("pos").agg(F.sum("value").alias("value")).collect():
        out[r["pos"]] = r["value"]
    return out


@dataclass
class Whitening:
    """n vectors of sums S = whole * n + rest; components by column, their eigenvalues, the covariance's trace."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; None where that is no 64-bit number."""
        near = x - self.whole
        if float(np.abs(near).max(initial=0) + 1) * self.n < 2**31 / np.sqrt(x.shape[1]):
            return ((near * self.n - self.rest) ** 2).sum(axis=1).tolist()
        sums = [sum((int(v) * self.n - int(r)) ** 2 for v, r in zip(row, self.rest)) for row in near]
        return [s if s < 2**63 else None for s in sums]


def bidiagonalised(product: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]], dim: int, wanted: int, norm: float, tolerance: float | None, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (by column) and singular values, falling, of a matrix X that only product() sees.

    Each step takes X v without its parts along all left vectors u so far, and
    X'u without its parts along all v so far: full reorthogonalisation on both
    sides, twice. Left vectors are as long as the table and never leave the
    tasks: u = X p, and p stays. product(v, P, c) forms w = X v - U c row by row
    with U = X P and returns U'w, w'w and X'w, so a step is one pass. Where the
    process breaks down (an invariant subspace, equal singular values), it
    starts anew from a random direction. It takes dim steps, or fewer if
    tolerance is given: then it ends when the wanted triplets' residuals are
    below that share of the largest value.
    """
    rng = np.random.default_rng(seed)
    right = np.zeros((dim, dim))
    left = np.zeros((dim, dim))  # the p of each u
    back = np.zeros((dim, dim))  # X'u
    b = np.zeros((dim, dim))

    def apart(v: np.ndarray, k: int) -> np.ndarray:
        for _ in range(2):
            v = v - right[:, :k] @ (right[:, :k].T @ v)
        return v

    v = rng.standard_normal(dim)
    v /= np.linalg.norm(v)
    k = 0
    while True:
        right[:, k] = v
        c = back[:, :k].T @ v
        again, length, forward = product(v, left[:, :k], c)
        alpha = np.sqrt(max(0.0, length - again @ again))
        if alpha > TINY * norm:
            left[:, k] = (v - left[:, :k] @ (c + again)) / alpha
            back[:, k] = (forward - back[:, :k] @ again) / alpha
            b[k, k] = alpha
        k += 1
        if k == dim:
            break
        v = apart(back[:, k - 1] - alpha * v, k)
        beta = np.linalg.norm(v)
        if beta > TINY * norm:
            b[k - 1, k] = beta
            if tolerance is not None:
                u, s, _ = np.linalg.svd(b[:k, :k])
                if k >= wanted and beta * np.abs(u[-1, :wanted]).max() <= tolerance * s[0]:
                    break
        else:
            v = apart(rng.standard_normal(dim), k)
            beta = np.linalg.norm(v)
        v = v / beta
    _, s, w = np.linalg.svd(b[:k, :k])
    return right[:, :k] @ w.T, s


def fit_whitening(rows: DataFrame, dim: int, *, components: int = 16, tolerance: float | None = None, seed: int = 3) -> Whitening:
    """Mean, components and deviations of the distinct vectors of rows (x, whole numbers, all of length dim)."""
    packed = _packed(rows, dim)
    sums = _summed(packed, dim, dim + 1, lambda x: np.append(x.sum(axis=0), len(x)), "long")
    n = int(sums[-1])
    fit = Whitening(n, sums[:-1] // max(n, 1), sums[:-1] % max(n, 1), np.zeros((dim, 0)), np.zeros(0), 0.0)
    if n < 2:
        return fit
    total = float(_summed(packed, dim, 1, lambda x: np.array([(fit.centred(x) ** 2).sum()]))[0])
    fit.trace = total / n
    if not total:
        return fit

    def product(v: np.ndarray, p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        def of(x: np.ndarray) -> np.ndarray:
            centred = fit.centred(x)
            u = centred @ p
            w = centred @ v - u @ c
            return np.concatenate([u.T @ w, [w @ w], centred.T @ w])

        k = len(c)
        out = _summed(packed, dim, k + 1 + dim, of)
        return out[:k], float(out[k]), out[k + 1 :]

    vectors, values = bidiagonalised(product, dim, min(components, dim), np.sqrt(total), tolerance, seed)
    keep = np.flatnonzero(values[:components] > 1e-6 * values[0])
    fit.components, fit.eigenvalues = vectors[:, keep], values[keep] ** 2 / n
    k = len(keep)

    def moments(x: np.ndarray) -> np.ndarray:
        z = fit.whitened(x)
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    out = _summed(packed, dim, k + k * k, moments) / n
    fit.identity_error = float(np.abs(out[k:].reshape(k, k) - np.outer(out[:k], out[:k]) - np.eye(k)).max())
    return fit


def whiten(vectors: DataFrame, *, components: int = 16, scale: int = 64, offset: int = 1_000_000, tolerance: float | None = None, seed: int = 3) -> DataFrame:
    """Principal components of vectors, scaled to a deviation of 1: one row a vector and component.

    vectors needs vec_id and embedding; other columns are ignored. Rows whose
    embedding is null or empty, or has null or non-finite parts, go. A part
    becomes floor(scale * part) + offset (parts beyond 2^50 count as that).
    The distinct vectors are the fit list: equal ones weigh as one. Vectors of
    different lengths are fitted apart, each length by its own list. All
    steps of the bidiagonalisation are taken unless a tolerance is given; then
    equal eigenvalues may come out once only.

    Returns vec_id (null where it was), component (from 1), n (size of the fit
    list), deviation (null where it is no 64-bit number), whitened, explained,
    identity_error. Components of a deviation below a millionth of the largest
    aren't returned, so that a list of equal vectors gives no rows; repeated
    rows come back as often as they were there.
    """
    parts = F.transform("embedding", lambda c: c.cast("double"))
    valid = F.coalesce((F.size("embedding") > 0) & F.forall(parts, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    limit = F.lit(float(2**50))
    whole = F.transform(parts, lambda c: F.floor(F.greatest(-limit, F.least(limit, c * F.lit(float(scale))))).cast("long") + F.lit(offset).cast("long"))
    rows = vectors.where(valid).select("vec_id", whole.alias("x"))
    out = None
    for (dim,) in sorted(rows.select(F.size("x")).distinct().collect()):
        mine = rows.where(F.size("x") == dim)
        fit = fit_whitening(mine, dim, components=components, tolerance=tolerance, seed=seed)
        done = _applied(mine, fit, dim)
        out = done if out is None else out.unionByName(done)
    return out if out is not None else _applied(rows, Whitening(0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, 0)), np.zeros(0), 0.0), 1)


def _applied(rows: DataFrame, fit: Whitening, dim: int) -> DataFrame:
    schema = with_fields(rows.select("vec_id"), "component int, n long, deviation long, whitened double, explained double, identity_error double")
    k = len(fit.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column("x"), dim)
                n = len(x)
                of = np.repeat(np.arange(n), k)
                columns = [
                    part.column("vec_id").take(pa.array(of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, fit.n, dtype=np.int64)),
                    pa.array(fit.deviations(x), pa.int64()).take(pa.array(of)), pa.array(fit.whitened(x).ravel()), pa.array(np.tile(fit.eigenvalues / fit.trace, n)), pa.array(np.full(n * k, fit.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        released()

    return rows.mapInArrow(run, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
