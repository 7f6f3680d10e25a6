"""Operator 12: toxicity by the nearest labelled examples, found by exact TF-IDF cosine in a block-max inverted index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import Memo, Words, documents, fold, map_texts, plain_texts, released, slices, stored, with_fields

#: Beside the whole word, its beginnings of so many letters are terms: words of a family share them.
STARTS = (4, 5, 6, 7)
#: Examples in a block of the index.
BLOCK = 64
_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def terms_of(word: bytes) -> list[str]:
    """The terms of a word: itself in lower case without marks at its edges, and its beginnings; none for marks alone."""
    w = word.decode("utf-8", "replace").lower().strip(_EDGE)
    return [f"={w}", *(w[:k] for k in STARTS if len(w) > k)] if w else []


def _term_counts(sample: DataFrame) -> DataFrame:
    """(term, n, toxic): labelled examples (text, toxic) that hold each term, and how many of them are toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, bad = Counter(), Counter()
                for text, toxic in zip(plain_texts(part.column("text")), part.column("toxic").to_pylist()):
                    found = {t for w in set(text.encode().split()) for t in terms_of(w)}
                    n.update(found)
                    if toxic:
                        bad.update(found)
                yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64()), pa.array([bad[t] for t in n], pa.int64())], names=["term", "n", "toxic"])
        released()

    return sample.select("text", "toxic").mapInArrow(run, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def chosen_terms(sample: DataFrame, limit: int, least_n: int, least_chi: float) -> list[str]:
    """The terms of the examples that speak most clearly for toxic ones, by chi-squared; of equal ones the first by name."""
    total, bad = sample.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    a, b = F.col("toxic").cast("double"), (F.col("n") - F.col("toxic")).cast("double")
    c, d = bad - a, (total - bad) - b
    chi = total * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d) + 1e-9)
    counts = _term_counts(sample).where(F.col("n") >= least_n).where(a * d > b * c).withColumn("chi", chi).where(F.col("chi") >= least_chi)
    return [r["term"] for r in counts.orderBy(F.desc("chi"), "term").limit(limit).collect()]


def _features(docs: DataFrame, terms: list[str], carried: list[str]) -> DataFrame:
    """Per document its chosen terms (found, by number) with their numbers of words (times), and its number of words."""
    number = {t: i for i, t in enumerate(terms)}

    def known(word: bytes) -> list[int]:
        return [number[t] for t in terms_of(word) if t in number]

    def counted(texts: pa.Array, memo: Memo) -> dict:
        words = Words(texts)
        if len(memo) > 150_000:
            memo.clear()
        listed = [memo[w] for w in words.listed()]
        size = np.fromiter(map(len, listed), dtype=np.int64, count=len(listed))
        flat = np.array([t for x in listed for t in x], dtype=np.int64)
        first = np.append(0, np.cumsum(size))
        at = np.flatnonzero(size[words.of]) if len(words.of) else np.zeros(0, dtype=np.int64)
        word = words.of[at]
        owner = np.searchsorted(words.ends, at, side="right")
        many = size[word]
        place = np.repeat(first[word] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum()) if len(at) else np.zeros(0, dtype=np.int64)
        key, times = np.unique(np.repeat(owner, many) * (len(terms) + 1) + flat[place], return_counts=True)
        text, term = key // (len(terms) + 1), (key % (len(terms) + 1)).astype(np.int32)
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
        times = times.astype(np.int32)
        return {"found": [term[a:e].tobytes() for a, e in zip(cuts[:-1], cuts[1:])], "times": [times[a:e].tobytes() for a, e in zip(cuts[:-1], cuts[1:])], "n_words": words.sizes.astype(np.int64)}

    return map_texts(docs, counted, "found binary, times binary, n_words long", carried, start=lambda: Memo(known))


def _document_counts(features: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term occurs; last, how many have words at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 1, dtype=np.int64)
        for batch in batches:
            total[:n_terms] += np.bincount(np.frombuffer(b"".join(batch.column("found").to_pylist()), dtype=np.int32), minlength=n_terms)
            total[n_terms] += int((np.asarray(batch.column("n_words")) > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(n_terms + 1), pa.int32()), pa.array(total)], names=["pos", "n"])

    out = np.zeros(n_terms + 1, dtype=np.int64)
    for r in features.select("found", "n_words").mapInArrow(run, "pos int, n long").groupBy("pos").agg(F.sum("n").alias("n")).collect():
        out[r["pos"]] = r["n"]
    return out


def unit_vectors(found: list[bytes], times: list[bytes], n_words: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length 1, tf being 1 + log of the count; the last term stands for any word. Zeros for a text without words."""
    out = np.zeros((len(found), len(idf)))
    sizes = [len(f) // 4 for f in found]
    row = np.repeat(np.arange(len(found)), sizes)
    out[row, np.frombuffer(b"".join(found), dtype=np.int32)] = 1 + np.log(np.frombuffer(b"".join(times), dtype=np.int32))
    out[:, -1] = np.where(n_words > 0, 1 + np.log(np.maximum(n_words, 1)), 0)
    out *= idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


class BlockMaxIndex:
    """Postings of example vectors, term by term, in blocks of neighbouring examples, with each term's greatest weight in each block.

    The bound of a block is the query's product with those weights. Blocks are
    opened from the highest bound down; a block whose bound is below the k-th
    cosine found is never opened, and what is opened is scored exactly.
    """

    def __init__(self, vectors: np.ndarray) -> None:
        self.n = len(vectors)
        self.blocks = []
        tops = []
        for at in range(0, self.n, BLOCK):
            part = vectors[at : at + BLOCK]
            terms = np.flatnonzero(part.any(axis=0))
            self.blocks.append((terms, np.ascontiguousarray(part[:, terms].T)))
            tops.append(part.max(axis=0))
        self.top = np.array(tops).T.reshape(vectors.shape[1], -1)

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines (to 12 digits) of the k nearest examples of each query, ties by number; -1 where there are fewer with a cosine above 0."""
        m = len(queries)
        place, score = np.full((m, k), self.n), np.zeros((m, k))
        bound = queries @ self.top + 1e-9
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        at, step = 0, 1
        while at < order.shape[1]:
            open_ = bound[:, at : at + step] >= np.maximum(score[:, -1:], 2e-9)
            if not open_.any():
                break
            query, col = np.nonzero(open_)
            block = order[query, at + col]
            for b in np.unique(block):
                who = query[block == b]
                terms, weights = self.blocks[b]
                new = np.round(queries[np.ix_(who, terms)] @ weights, 12)
                ids = np.broadcast_to(np.arange(b * BLOCK, b * BLOCK + new.shape[1]), new.shape)
                s, p = np.concatenate([score[who], new], axis=1), np.concatenate([place[who], ids], axis=1)
                best = np.lexsort((p, -s), axis=1)[:, :k]
                score[who], place[who] = np.take_along_axis(s, best, axis=1), np.take_along_axis(p, best, axis=1)
            at, step = at + step, step * 2
        return np.where(score > 0, place, -1), score


class Neighbours:
    """Labelled examples that vote by distance; votes become probabilities by a logistic curve fitted on the examples' own votes, each without itself."""

    def __init__(self, vectors: np.ndarray, toxic: np.ndarray, ids: np.ndarray, k: int) -> None:
        order = np.lexsort((ids, *vectors.T[::-1], vectors.argmax(axis=1)))
        vectors, toxic, ids = vectors[order], toxic[order].astype(np.float64), ids[order]
        full = vectors.any(axis=1)
        vectors, toxic, ids, self.rate = vectors[full], toxic[full], ids[full], float(toxic.mean())
        new = np.ones(len(vectors), dtype=bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        entry, first = np.cumsum(new) - 1, np.flatnonzero(new)
        self.k, self.ids = k, np.minimum.reduceat(ids, first) if len(first) else ids
        self.count, self.bad = np.bincount(entry), np.bincount(entry, weights=toxic)
        self.index = BlockMaxIndex(vectors[first])
        self.curve = (1.0, 0.0)
        if len(vectors):
            z = np.concatenate([self._logit(self.votes(*self.index.nearest(vectors[a : a + 1024], k + 1), own=(entry[a : a + 1024], toxic[a : a + 1024]))) for a in range(0, len(vectors), 1024)])
            self.curve = _logistic(z, toxic)

    @staticmethod
    def _logit(v: np.ndarray) -> np.ndarray:
        return np.log(v) - np.log1p(-v)

    def votes(self, place: np.ndarray, cosine: np.ndarray, own: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The toxic share of the k nearest examples, weighted by 1 / (0.02 + distance), with the general share as one weak vote.

        Equal examples are one entry and count as often as they were given; of the last entry only as many as still belong to the k.
        """
        there = place >= 0
        at = np.where(there, place, 0)
        count, bad = np.where(there, self.count[at], 0).astype(np.float64), np.where(there, self.bad[at], 0.0)
        if own is not None:
            mine = there & (at == own[0][:, None])
            count, bad = count - mine, bad - mine * own[1][:, None]
        share = bad / np.maximum(count, 1)
        before = np.cumsum(count, axis=1) - count
        count = np.clip(self.k - before, 0, count)
        weight = count / (0.02 + np.sqrt(np.maximum(0.0, 2 - 2 * cosine)))
        return ((weight * share).sum(axis=1) + self.rate) / (weight.sum(axis=1) + 1)

    def scores(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each vector, and its nearest entries with their cosines. Equal vectors are looked up once."""
        _, first, back = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        place, cosine = self.index.nearest(vectors[first], self.k)
        z = self._logit(np.clip(self.votes(place, cosine), 1e-6, 1 - 1e-6))
        p = 1 / (1 + np.exp(-np.clip(self.curve[0] * z + self.curve[1], -500, 500)))
        back = back.ravel()
        return p[back], place[back], cosine[back]


def _logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of y by z, by Newton steps, held near (1, 0) by a weak prior."""
    x, w = np.stack([z, np.ones(len(z))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (y - p) - (w - [1.0, 0.0]))
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), float(w[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, *, train_rows: int = 12_000, terms: int = 400, least_n: int = 5, least_chi: float = 20.0, k: int = 15, threshold: float = 0.5, evidence: int = 3, seed: int = 5, row: str | None = None) -> DataFrame:
    """Scores every text of docs for toxicity by the labelled examples nearest to it.

    Terms are words and their beginnings. Of those of the examples, the ones
    that mark toxic ones most clearly (chi-squared; at most `terms`) span the
    space, with one more term that stands for any word. Document frequencies
    are of all docs. The k nearest examples by cosine, exact, vote by distance;
    a logistic curve fitted on the examples' leave-one-out votes makes votes
    probabilities.

    labels needs doc_id and toxic (0 or 1; other values and nulls are left out;
    of several labels of an id the lowest counts). The train_rows labels first
    in the order of a seeded hash of the id are the examples: the bounded
    sample, the only rows that the driver sees and that are broadcast. Where
    docs repeat an id, one of its rows is the example. docs needs doc_id and
    text; other columns are ignored. Null and empty texts and those without
    words have no neighbour and share one score, that of the general share.
    Without labels of both kinds all scores are 0.5, or 1 or 0 if one kind is
    there. Returns doc_id, score (0 to 1), predicted (1 if score >= threshold),
    evidence (the nearest distinct examples: smallest doc_id, cosine, toxic
    share), one row per row of docs; row names a column that numbers the rows
    of docs, which comes back too.
    """
    carried = ["doc_id"] if row is None else [row, "doc_id"]
    kind = "evidence array<struct<doc_id:bigint,cosine:double,toxic:double>>"
    labels = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"))
    sample = stored(labels.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(train_rows), "toxicity_sample")  # no more than train_rows, which is what makes it safe to broadcast
    examples = stored(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("toxic", "text")).alias("one")).select("doc_id", "one.*"), "toxicity_examples")
    kinds = [r[0] for r in examples.select("toxic").distinct().collect()]
    if len(kinds) < 2:
        constant = float(kinds[0]) if kinds else 0.5
        return docs.select(*carried, F.lit(constant).alias("score"), F.lit(int(constant >= threshold)).alias("predicted"), F.array().cast(kind.split(" ", 1)[1]).alias("evidence"))
    chosen = chosen_terms(examples, terms, least_n, least_chi)
    features = stored(_features(docs, chosen, carried), "toxicity_features")
    counts = _document_counts(features, len(chosen))
    idf = np.log1p(max(1, counts[-1]) / np.maximum(1, counts))
    taught = sorted((r["doc_id"], r["toxic"], bytes(r["found"]), bytes(r["times"]), r["n_words"]) for r in _features(examples, chosen, ["doc_id", "toxic"]).collect())  # no more than train_rows
    vectors = unit_vectors([r[2] for r in taught], [r[3] for r in taught], np.array([r[4] for r in taught]), idf)
    model = docs.sparkSession.sparkContext.broadcast(Neighbours(vectors, np.array([r[1] for r in taught]), np.array([r[0] for r in taught], dtype=np.int64), k))
    schema = with_fields(docs.select(*carried), f"score double, predicted int, {kind}")
    fields = [pa.field("doc_id", pa.int64()), pa.field("cosine", pa.float64()), pa.field("toxic", pa.float64())]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                score, place, cosine = model.value.scores(unit_vectors(part.column("found").to_pylist(), part.column("times").to_pylist(), np.asarray(part.column("n_words")), idf))
                place, cosine = place[:, :evidence], cosine[:, :evidence]
                there = place >= 0
                at_ = place[there]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(there.sum(axis=1))), pa.int32()), pa.StructArray.from_arrays([pa.array(model.value.ids[at_]), pa.array(cosine[there]), pa.array(model.value.bad[at_] / model.value.count[at_])], fields=fields))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carried)], pa.array(score), pa.array((score >= threshold).astype(np.int32)), lists], names=schema.names)
        released()

    return features.mapInArrow(scored, schema)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 5) != 0)
    out = score_toxicity(documents(spark, sf_dir), labels)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "evidence")
