"""Operator 13: hard negatives by best-first descent of cover trees over norm-augmented candidates."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import map_groups, released, split_large, stored

#: Parts of a vector are held as 32-bit numbers of at most this size.
LARGEST = 1 << 26
#: How much the covering radius shrinks from a level to the next, and rows below which a node is not divided.
BASE, LEAF = 1.3, 128
#: Shuffled grid: bytes of anchors that meet a tree at once, and the most parts that the trees are dealt into.
SLOT_BYTES, GRID = 256 << 20, 4096
_LAST = np.iinfo(np.int64).max


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact: in doubles where all sums stay below 2^53, else in 64-bit numbers."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def augmented(x: np.ndarray, largest: float) -> np.ndarray:
    """Rows with one more part that makes all of them as long as the longest candidate, `largest`: the nearest are those of the highest inner product."""
    v = x.astype(np.float64)
    return np.concatenate([v, np.sqrt(np.maximum(0.0, largest**2 - (v * v).sum(axis=1)))[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T))


@dataclass
class CoverTree:
    """Rows laid down so that each node has a run of them, first to last.

    A node's centre is one of its rows, and radius the distance of the farthest
    of its rows. Its children's centres, the first of which is its own, lie
    more than radius / BASE apart and cover its rows within that. below and
    until say which nodes are its children (none: a leaf). A node of few rows,
    or one whose rows lie so far apart that children would hold next to nothing
    each, is a leaf.
    """

    x: np.ndarray
    label: np.ndarray
    ids: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    below: np.ndarray
    until: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray, label: np.ndarray, ids: np.ndarray, largest: float, leaf: int = LEAF) -> CoverTree:
        p = augmented(x, largest)
        order = np.arange(len(x))
        nodes = [[0, np.linalg.norm(p - p[0], axis=1).max(), 0, len(x), 0, 0]]  # centre (a row), radius, first, last, children
        at = 0
        while at < len(nodes):
            centre, radius, first, last, *_ = nodes[at]
            if last - first > leaf and radius > 0:
                rows = order[first:last]
                centres, of, far = _covered(p, rows, centre, radius / BASE)
                if centres is not None:
                    nodes[at][4:] = [len(nodes), len(nodes) + len(centres)]
                    turn = np.argsort(of, kind="stable")
                    order[first:last] = rows[turn]
                    cuts = first + np.searchsorted(of[turn], np.arange(len(centres) + 1))
                    nodes += [[c, far[of == i].max(), cuts[i], cuts[i + 1], 0, 0] for i, c in enumerate(centres)]
            at += 1
        centre, radius, first, last, below, until = map(np.array, zip(*nodes))
        # the radii are rounded sums: a little more covers for certain
        return cls(x[order], label[order], ids[order], x[centre.astype(np.int64)], radius * (1 + 1e-9) + 1e-6, first.astype(np.int64), last.astype(np.int64), below.astype(np.int64), until.astype(np.int64))

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def unpacked(cls, raw: bytes) -> CoverTree:
        with np.load(io.BytesIO(raw), allow_pickle=False) as z:
            return cls(**{k: z[k] for k in z.files})


def _covered(p: np.ndarray, rows: np.ndarray, centre: int, within: float) -> tuple[list[int] | None, np.ndarray, np.ndarray]:
    """Centres among rows that lie more than `within` apart and cover all; each row's centre and distance. None if they are more than an eighth of the rows."""
    pts = p[rows]
    of, far = np.full(len(rows), -1), np.zeros(len(rows))
    centres: list[int] = []
    fresh = np.array([int(np.flatnonzero(rows == centre)[0])])
    while True:
        open_ = np.flatnonzero(of < 0)
        if not len(fresh):
            if not len(open_):
                return centres, of, far
            head = open_[:64]
            d = _distances(pts[head], pts[head])
            chosen: list[int] = []
            for i in range(len(head)):
                if not chosen or (d[i, chosen] > within).all():
                    chosen.append(i)
            fresh = head[chosen]
        d = _distances(pts[open_], pts[fresh])
        near = d.argmin(axis=1)
        least = d[np.arange(len(open_)), near]
        own = np.searchsorted(open_, fresh)  # a centre is its own, whatever rounding or an equal row says
        near[own], least[own] = np.arange(len(fresh)), 0
        hit = least <= within
        of[open_[hit]], far[open_[hit]] = len(centres) + near[hit], least[hit]
        centres += rows[fresh].tolist()
        if len(centres) > max(4, len(rows) // 8):
            return None, of, far
        fresh = fresh[:0]


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the hits of each query the k first by score, then id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    start = np.searchsorted(q, q, side="left")
    order = order[np.arange(len(q)) - start < k]
    return tuple(v[order] for v in (query, score, ids, *more))


def search(tree: CoverTree, vectors: np.ndarray, of: np.ndarray, label: np.ndarray, own: np.ndarray, same: bool, lower: np.ndarray, upper: np.ndarray, k: int, largest: float) -> tuple[np.ndarray, ...]:
    """The k best rows (query, score, id, row) of each query in a tree, from lower to upper.

    A query is a vector (vectors[of]), the label that rows must share (or, not
    same, must not), the id that is left out, and the window of scores. Nodes
    whose bounds lie outside are never entered; leaves are opened from the
    highest bound down, a growing number at a time, and scored exactly; the
    k-th score found raises the lower end for the rest. A query without a window
    (lower above upper) finds nothing.
    """
    lower = lower.astype(np.float64)
    length = np.linalg.norm(vectors.astype(np.float64), axis=1)
    alive = (lower <= upper)[:, None]
    nodes = np.array([0])
    leaves, reach, open_ = [], [], []
    while len(nodes):
        dot = products(vectors, tree.centre[nodes]).astype(np.float64)
        gap = np.sqrt(np.maximum(0.0, largest**2 + length[:, None] ** 2 - 2 * dot))  # from the augmented vector to the centre
        r = tree.radius[nodes]
        high = np.minimum(dot + length[:, None] * r, np.where(gap > r, dot + gap * r - r * r / 2, (largest**2 + length[:, None] ** 2) / 2))
        low = np.maximum(dot - length[:, None] * r, dot - gap * r - r * r / 2)
        slack = 1e-9 * (np.abs(dot) + length[:, None] * r) + 1e-3
        high, low = (high + slack)[of], (low - slack)[of]
        alive = alive & (high >= lower[:, None]) & (low <= upper[:, None])
        leaf = tree.below[nodes] == tree.until[nodes]
        leaves.append(nodes[leaf])
        reach.append(np.where(alive, high, -np.inf)[:, leaf])
        open_.append(alive[:, leaf])
        inner = np.flatnonzero(~leaf & alive.any(axis=0))
        n = tree.until[nodes[inner]] - tree.below[nodes[inner]]
        alive = np.repeat(alive[:, inner], n, axis=1)
        nodes = np.concatenate([np.arange(a, b) for a, b in zip(tree.below[nodes[inner]], tree.until[nodes[inner]])]) if len(inner) else nodes[:0]
    leaves, reach = np.concatenate(leaves), np.concatenate(reach, axis=1)
    order = np.argsort(-reach, axis=1, kind="stable")
    reach = np.take_along_axis(reach, order, axis=1)
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    at, step = 0, 1
    while at < len(leaves):
        take = (reach[:, at : at + step] >= lower[:, None]) & np.isfinite(reach[:, at : at + step])
        if not take.any():
            break
        query, col = np.nonzero(take)
        which = order[query, at + col]
        parts = [found]
        for i in np.unique(which):
            who = query[which == i]
            a, b = tree.first[leaves[i]], tree.last[leaves[i]]
            used, back = np.unique(of[who], return_inverse=True)
            for lo in range(a, b, 4096):
                hi = min(b, lo + 4096)
                s = products(vectors[used], tree.x[lo:hi])[back.ravel()]
                ok = (s >= lower[who, None]) & (s <= upper[who, None]) & (tree.ids[lo:hi] != own[who, None]) & ((tree.label[lo:hi] == label[who, None]) == same)
                q, c = np.nonzero(ok)
                parts.append((who[q], s[q, c], tree.ids[lo + c], lo + c))
        found = _best(*(np.concatenate(p) for p in list(zip(*parts))[:3]), k, np.concatenate([p[3] for p in parts]))
        count = np.bincount(found[0], minlength=len(of))
        full = count >= k
        least = np.full(len(of), np.inf)
        np.minimum.at(least, found[0], found[1].astype(np.float64))
        lower = np.where(full, np.maximum(lower, least), lower)
        at, step = at + step, step * 2
    return found


def _stacked(column, kind=np.int32) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=kind)


def _as_bytes(frame: DataFrame, extra: str) -> DataFrame:
    """The vectors x as bytes of 32-bit numbers, beside other columns."""
    names = [f.name for f in frame.schema.fields if f.name != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            flat, cuts = np.asarray(lists.flatten(), dtype=np.int32), np.append(0, np.cumsum(np.asarray(lists.value_lengths())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([flat[a:e].tobytes() for a, e in zip(cuts[:-1], cuts[1:])], pa.binary())], names=[*names, "x"])

    return frame.select(*names, "x").mapInArrow(run, f"{extra}, x binary")


class Sample:
    """A bounded sample of the candidates: its cover tree's leaves divide all rows, and its scores are a first lower end."""

    def __init__(self, rows: list, largest: float) -> None:
        self.largest, self.trees = largest, {}
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(len(r["x"]), []).append(r)
        for size, mine in by.items():
            x = _stacked([bytes(r["x"]) for r in mine])
            self.trees[size] = CoverTree.build(x, np.array([r["label"] for r in mine]), np.array([r["id"] for r in mine]), largest, leaf=32)

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The leaf whose centre is nearest; 0 for lengths that the sample lacks."""
        tree = self.trees.get(x.shape[1] * 4)
        if tree is None:
            return np.zeros(len(x), dtype=np.int32)
        centres = tree.centre[tree.below == tree.until]
        return _distances(augmented(x, self.largest), augmented(centres, self.largest)).argmin(axis=1).astype(np.int32)

    def least(self, x: np.ndarray, of: np.ndarray, label: np.ndarray, own: np.ndarray, same: bool, lower: np.ndarray, upper: np.ndarray, k: int) -> np.ndarray:
        """lower, raised to the k-th score within the sample where it has so many: the sample's rows are candidates too."""
        tree = self.trees.get(x.shape[1] * 4)
        if tree is None or not len(x):
            return lower
        query, score, *_ = search(tree, x, of, label, own, same, lower, upper, k, self.largest)
        least = np.full(len(of), np.inf)
        np.minimum.at(least, query, score.astype(np.float64))
        return np.where(np.bincount(query, minlength=len(of)) >= k, np.maximum(lower, least), lower)


def _met(trees: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block of anchors beside every tree of vectors as long: both are dealt to the cells of a grid by an equal join, so that no side is broadcast and no key is hot."""
    n_trees, size = trees.count(), blocks.agg(F.sum(F.length("anchors"))).first()[0] or 0
    parts, slots = max(1, min(GRID, n_trees)), int(-(-size // SLOT_BYTES)) or 1
    left = trees.withColumns({"part": F.pmod(F.col("chunk_no"), F.lit(parts)), "slot": F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))})
    right = blocks.withColumns({"slot": F.pmod(F.col("block"), F.lit(slots)).cast("int"), "part": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))})
    return left.hint("shuffle_hash").join(right, ["dim", "part", "slot"])


def mine_hard_negatives(rows: DataFrame, *, positives: int = 5, negatives: int = 10, sample_rows: int = 4096, chunk_rows: int = 8192, block_rows: int = 2048) -> DataFrame:
    """For each anchor its first positives, and for each of those the hardest negatives within the window of its score.

    rows needs id, label, x (an array of whole numbers of at most 2^26 in size)
    and anchor (boolean); other columns are ignored, rows with a null label or
    x must be gone. Scores are inner products. Positives are the rows of the
    anchor's label with the highest score, negatives the rows of another label
    with the highest score from 0.3 to 0.9 of the positive's (none where that is
    below 0), ties by id, null ids last. Rows equal in id, label and x count
    once; rows that share the anchor's id alone are left out for it. Vectors of
    different lengths never meet. An id with several different rows is an anchor
    for each.

    A bounded sample's cover tree (sample_rows, by a seeded hash) divides the
    rows into cells; every row of a cell goes into a cover tree of chunk_rows or
    so. Of rows equal in x and label only so many with the smallest ids are laid
    down as a list can hold, which loses none. Blocks of anchors meet all trees.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score.
    """
    spark = rows.sparkSession
    depth = max(positives, negatives) + 1
    small = F.transform("x", lambda v: F.greatest(F.lit(-LARGEST).cast("long"), F.least(F.lit(LARGEST).cast("long"), v)).cast("int"))
    rows = rows.select(F.coalesce("id", F.lit(_LAST)).cast("long").alias("id"), F.col("label").cast("long").alias("label"), small.alias("x"), "anchor").groupBy("x", "label", "id").agg(F.max("anchor").alias("anchor"))
    rows = stored(_as_bytes(rows, "label long, id long, anchor boolean"), "negatives_rows")
    anchors = stored(rows.where("anchor").withColumn("aid", F.monotonically_increasing_id()).select("aid", "id", "label", "x"), "negatives_anchors")
    first = F.row_number().over(Window.partitionBy("x", "label").orderBy("id"))
    rows = stored(rows.withColumn("_place", first).where(F.col("_place") <= depth).select("id", "label", "x"), "negatives_candidates")

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [int((np.frombuffer(v.as_buffer(), dtype=np.int32).astype(np.int64) ** 2).sum()) for v in batch.column("x")]
            yield pa.RecordBatch.from_arrays([pa.array([max(tops, default=0)], pa.int64())], names=["n"])

    largest = float(np.sqrt(rows.select("x").mapInArrow(longest, "n long").agg(F.max("n")).first()[0] or 0)) * (1 + 1e-12)
    taken = rows.orderBy(F.xxhash64("x", "label", "id"), "id", "label").limit(sample_rows).collect()
    sample = spark.sparkContext.broadcast(Sample(taken, largest))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            size = np.asarray(pc.binary_length(x))
            cell = np.zeros(len(x), dtype=np.int32)
            for d in np.unique(size):
                of = np.flatnonzero(size == d)
                for at in range(0, len(of), 4096):
                    cell[of[at : at + 4096]] = sample.value.cell(_stacked(x.take(pa.array(of[at : at + 4096])).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((size // 4).astype(np.int32)), pa.array(cell)], names=["id", "label", "x", "dim", "cell"])
        released()

    dealt = stored(rows.select("id", "label", "x").mapInArrow(celled, "id long, label long, x binary, dim int, cell int"), "negatives_cells")
    dealt = split_large(dealt, ["dim", "cell"], chunk_rows, F.col("id")).drop("n_chunks")

    def built(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        for a, e in zip(starts[:-1], starts[1:]):
            part = frame.iloc[a:e]
            tree = CoverTree.build(_stacked(part["x"].tolist()), part["label"].to_numpy(), part["id"].to_numpy(), largest)
            yield pd.DataFrame({"dim": [np.int32(part["dim"].iat[0])], "tree": [tree.packed()]})

    trees = stored(map_groups(dealt, ["dim", "cell", "chunk"], built, "dim int, tree binary", sort=("id",)), "negatives_trees")
    trees = trees.withColumn("chunk_no", F.monotonically_increasing_id())

    def blocked(frame: DataFrame, columns: str) -> DataFrame:
        """Anchors in blocks of about block_rows, with the columns that a search needs, packed as bytes."""
        n = frame.count()
        block = F.pmod(F.xxhash64("aid"), F.lit(max(1, -(-n // block_rows)))).alias("block")
        names = columns.split()

        def packed(part: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
            for a, e in zip(starts[:-1], starts[1:]):
                one = part.iloc[a:e]
                out = io.BytesIO()
                held = {c: one[c].to_numpy() for c in names if c not in ("x", "goal")}
                held |= {"x": _stacked(one["x"].tolist())}
                if "goal" in names:
                    held |= {"n_goals": one["goal"].map(len).to_numpy(), "goal": np.concatenate(one["goal"].tolist()).astype(np.int64)}
                np.savez(out, **_queries(held, sample.value, positives, negatives))
                yield pd.DataFrame({"dim": [np.int32(held["x"].shape[1])], "block": [np.int64(one["block"].iat[0])], "anchors": [out.getvalue()]})

        dim = F.expr("CAST(length(x) div 4 AS INT)").alias("dim")
        return stored(map_groups(frame.select(dim, block, *names), ["dim", "block"], packed, "dim int, block long, anchors binary"), "negatives_blocks")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw_tree, raw in zip(batch.column("tree"), batch.column("anchors")):
                tree = CoverTree.unpacked(raw_tree.as_py())
                with np.load(io.BytesIO(raw.as_py()), allow_pickle=False) as z:
                    q = {k: z[k] for k in z.files}
                query, score, ids, _ = search(tree, q["x"], q["of"], q["label"], q["own"], bool(q["same"]), q["lower"], q["upper"], int(q["k"]), largest)
                yield pa.RecordBatch.from_arrays([pa.array(q["aid"][query]), pa.array(q["slot_no"][query].astype(np.int32)), pa.array(score), pa.array(ids)], names=["aid", "goal_no", "score", "other"])
        released()

    def best(blocks: DataFrame, k: int) -> DataFrame:
        hits = _met(trees, blocks).select("tree", "anchors").mapInArrow(searched, "aid long, goal_no int, score long, other long")
        rank = F.row_number().over(Window.partitionBy("aid", "goal_no").orderBy(F.desc("score"), "other"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k)

    near = stored(best(blocked(anchors, "aid id label x"), positives).select("aid", F.col("rank").alias("goal_no"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "negatives_positives")

    goals = near.groupBy("aid").agg(F.transform(F.array_sort(F.collect_list(F.struct("goal_no", "positive_score"))), lambda g: g["positive_score"]).alias("goal"))  # as many as there are positives at most
    far = best(blocked(anchors.join(goals, "aid"), "aid id label x goal"), negatives)
    out = far.join(near, ["aid", "goal_no"]).join(anchors.select("aid", F.col("id").alias("anchor_id")), "aid")
    back = lambda c: F.nullif(F.col(c), F.lit(_LAST)).alias(c)
    return out.withColumnRenamed("other", "negative_id").withColumnRenamed("score", "negative_score").select("anchor_id", back("positive_id"), "rank", back("negative_id"), "positive_score", "negative_score")


def _queries(held: dict[str, np.ndarray], sample: Sample, positives: int, negatives: int) -> dict[str, np.ndarray]:
    """The searches of a block of anchors: one each for positives, or one a positive for negatives, with what the sample says about their lower ends."""
    n = len(held["aid"])
    if "goal" in held:
        of = np.repeat(np.arange(n), held["n_goals"])
        slot = np.arange(len(of)) - np.repeat(np.append(0, np.cumsum(held["n_goals"])[:-1]), held["n_goals"]) + 1
        tens, ones = np.divmod(held["goal"], 10)
        lower, upper, same, k = tens * 3 + -(-ones * 3 // 10), tens * 9 + ones * 9 // 10, False, negatives
    else:
        of, slot = np.arange(n), np.zeros(n, dtype=np.int64)
        lower, upper, same, k = np.full(n, -np.inf), np.full(n, np.inf), True, positives
    label, own = held["label"][of], held["id"][of]
    lower = sample.least(held["x"], of, label, own, same, lower.astype(np.float64), upper.astype(np.float64), k)
    return {"x": held["x"], "of": of, "label": label, "own": own, "same": np.array(same), "lower": lower, "upper": upper.astype(np.float64), "k": np.array(k), "aid": held["aid"][of], "slot_no": slot}


#: The same by brute force.
SQL = """WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS other_id, a.label = e.label AS same, CAST(list_dot_product(a.x, e.x) AS BIGINT) AS score FROM e a JOIN e ON e.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform("embedding", lambda c: c.cast("double"))
    valid = F.coalesce((F.size("embedding") > 0) & F.forall(parts, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    limit = F.lit(float(LARGEST))
    whole = F.transform(parts, lambda c: F.floor(F.greatest(-limit, F.least(limit, c * F.lit(256.0)))).cast("long"))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(valid & F.col("label").isNotNull())
    return mine_hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), whole.alias("x"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)).alias("anchor")))
