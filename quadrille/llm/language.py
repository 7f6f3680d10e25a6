"""Operator 7: language identification by string kernels."""

from __future__ import annotations

import re
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import documents, fold, map_texts, stored

#: Cells for the hashed n-grams of 1, 2 and 3 letters.
CELLS = (256, 2048, 4096)
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def presence(texts: list[str | None]) -> np.ndarray:
    """Rows of the blended-spectrum feature space: which n-grams a text has, each order scaled to length 1 and weighing alike."""
    out = np.zeros((len(texts), sum(CELLS)), dtype=np.float32)
    for row, text in enumerate(texts):
        plain = _NOT_LETTERS.sub(" ", (text or "").lower())
        code = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        mixed, at = np.zeros(len(code), dtype=np.uint32), 0
        for n, cells in enumerate(CELLS, 1):
            if len(code) < n:
                break
            mixed = (mixed[: len(code) - n + 1] + code[n - 1 :]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            out[row, at + (mixed & np.uint32(cells - 1)).astype(np.intp)] = 1
            at += cells
    at = 0
    for cells in CELLS:
        block = out[:, at : at + cells]
        block /= np.sqrt(np.maximum(block.sum(axis=1, keepdims=True), 1) * len(CELLS))
        at += cells
    return out


def fit(features: np.ndarray, labels: np.ndarray, names: list[str], landmarks: int, ridge: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Landmark rows, and the weights that turn kernel values against them into one score a language."""
    rng = np.random.default_rng(seed)
    chosen = []
    for name in names:
        own = np.flatnonzero(labels == name)
        chosen.append(rng.permutation(own)[: max(1, landmarks // len(names))])
    marks = features[np.concatenate(chosen)]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nystroem map: kernel values times this
    mapped = np.hstack([(features @ marks.T) @ root, np.ones((len(features), 1))])
    goal = np.where(labels[:, None] == np.array(names), 1.0, -1.0)
    share = np.array([1 / (labels == n).sum() for n in labels])[:, None]  # languages weigh alike
    weight = np.linalg.solve(mapped.T @ (mapped * share) + ridge * np.eye(mapped.shape[1]), mapped.T @ (goal * share))
    return marks, np.vstack([root @ weight[:-1], weight[-1:]]).astype(np.float32)


def sampled(training: DataFrame, per_language: int, fit_rows: int, seed: int) -> tuple[list[str], DataFrame]:
    """The languages, and (lang, text) of the rows to fit on: of each language those first in the order of a seeded hash of id and text, as exactly as many."""
    draw = F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw")
    usable = training.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", draw)
    names = sorted(r["lang"] for r in usable.select("lang").distinct().collect())
    if not names:
        return [], usable.select("lang", "text")
    each = max(1, min(per_language, fit_rows // len(names)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    # hashes are drawn first, so that no text is sorted; every task hands on no more than its own first rows of a language
    chosen = stored(usable.select("lang", "draw").withColumn("place", place).where(F.col("place") <= each).select("lang", "draw").distinct(), "language_sample")
    return names, usable.join(F.broadcast(chosen), ["lang", "draw"]).dropDuplicates(["lang", "draw"]).select("lang", "text")


def identify_languages(docs: DataFrame, training: DataFrame, *, per_language: int = 500, fit_rows: int = 16_000, landmarks: int = 160, ridge: float = 1e-3, seed: int = 3) -> DataFrame:
    """Predicts the language of every text of docs.

    The kernel of two texts is the mean over n = 1, 2, 3 of the cosine of their
    sets of (hashed) letter n-grams. Landmarks from the training sample give
    the Nystroem features, on which one ridge regression a language is
    fitted; batches are scored by matrix products.

    training needs doc_id, text and lang; of each lang the per_language rows
    first in the order of a seeded hash of id and text are fitted on (the
    bounded sample; rows equal in id and text count once in it, rows without
    text or lang are left out), fewer where there are so many languages that
    fit_rows would be exceeded, but one at least, so that none is unlearnt.
    docs needs doc_id and text; other columns are ignored. A null
    text and one without a letter are `und` with score 0, and so is all if
    there is nothing to learn from. Equal scores go to the name that sorts
    first. Returns doc_id, lang_pred, score (0 to 1), one row per row of docs.
    """
    names, sample = sampled(training, per_language, fit_rows, seed)
    model = None
    if names:

        def featured(texts: pa.Array) -> dict:
            return {"features": [np.packbits(r > 0).tobytes() for r in presence(texts.to_pylist())]}

        rows = sorted((r["lang"], bytes(r["features"])) for r in map_texts(sample, featured, "features binary", ("lang",)).collect())
        x = np.unpackbits(np.frombuffer(b"".join(f for _, f in rows), dtype=np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
        at = 0
        for cells in CELLS:
            x[:, at : at + cells] /= np.sqrt(np.maximum(x[:, at : at + cells].sum(axis=1, keepdims=True), 1) * len(CELLS))
            at += cells
        model = docs.sparkSession.sparkContext.broadcast((*fit(x, np.array([lang for lang, _ in rows]), names, landmarks, ridge, seed), names))

    def predicted(texts: pa.Array) -> dict:
        given = texts.to_pylist()
        letters = np.array([isinstance(t, str) and any(map(str.isalpha, t)) for t in given], dtype=bool)
        lang, score = np.full(len(given), "und", dtype=object), np.zeros(len(given))
        if model is not None:
            marks, weight, known = model.value
            values = (presence(given) @ marks.T) @ weight[:-1] + weight[-1]
            best = values.argmax(axis=1)
            lang[letters] = np.array(known, dtype=object)[best[letters]]
            score[letters] = np.clip((values[letters, best[letters]] + 1) / 2, 0, 1)
        return {"lang_pred": lang, "score": score}

    return map_texts(docs, predicted, "lang_pred string, score double", rows=128)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify_languages(docs, docs.where(fold(F.col("doc_id"), 5) != 0))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
