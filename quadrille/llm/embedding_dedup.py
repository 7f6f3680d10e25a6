"""Operator 1: near-duplicate vectors by p-stable (Euclidean) hashing with exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import components, map_groups, merged, split_large, stored


def _hashed(tables: int, projections: int, width: float, seed: int):
    """Rows (table, key, keys, rep, size, vector): a unit vector's bucket in each table, and its buckets in all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for dim, part in frame.groupby(frame["embedding"].map(len)):
                raw = np.stack([np.asarray(v) for v in part["embedding"]])
                unit = raw.astype(np.float64)
                unit /= np.abs(unit).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                rng = np.random.default_rng([seed, dim])
                normal = rng.standard_normal((dim, tables * projections))
                shift = rng.uniform(0, width, tables * projections)
                cell = np.floor((unit @ normal + shift) / width).astype(np.int64).reshape(len(part), tables, projections)
                odd = rng.integers(1, 1 << 62, (tables, projections)) * 2 + 1
                keys = (cell * odd).sum(axis=2) + np.int64(dim)
                keys = (keys ^ (keys >> np.int64(32))).astype(np.int32)  # the bucket itself: what tells whether a pair has met before must be the same number
                packed = [k.tobytes() for k in keys]
                vectors = [v.tobytes() for v in raw]
                for t in range(tables):
                    yield pd.DataFrame({"tbl": np.int32(t), "key": keys[:, t], "keys": packed, "rep": part["rep"].to_numpy(), "size": part["size"].to_numpy(), "vector": vectors, "is_double": raw.dtype == np.float64})

    return run


def _compared(threshold: float):
    def run(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        rep, size, chunk = (frame[c].to_numpy() for c in ("rep", "size", "chunk"))
        ids, adds, roots = [], [], []
        for s, e in zip(starts[:-1], starts[1:]):
            if e - s < 2:
                continue
            table = int(frame["tbl"].iat[s])
            i, j = int(frame["i"].iat[s]), int(frame["j"].iat[s])
            kind = np.float64 if frame["is_double"].iat[s] else np.float32
            try:
                v = np.frombuffer(b"".join(frame["vector"].iloc[s:e]), dtype=kind).reshape(e - s, -1).astype(np.float64)
            except ValueError:  # two lengths met in one bucket by a collision of keys: compare each length apart
                v = None
            length = frame["vector"].iloc[s:e].map(len).to_numpy()
            own = np.frombuffer(b"".join(frame["keys"].iloc[s:e]), dtype=np.int32).reshape(e - s, -1)
            if v is None or len(np.unique(length)) > 1:
                v = np.zeros((e - s, length.max() // np.dtype(kind).itemsize))
                for r, raw in enumerate(frame["vector"].iloc[s:e]):
                    v[r, : len(raw) // np.dtype(kind).itemsize] = np.frombuffer(raw, dtype=kind)
            v /= np.abs(v).max(axis=1, keepdims=True)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            label, add = np.arange(e - s), np.zeros(e - s, dtype=np.int64)
            order = np.arange(e - s)
            step = max(1, 2_000_000 // (e - s))
            for lo in range(0, e - s, step):
                hi = min(lo + step, e - s)
                near = (v[lo:hi] @ v.T >= threshold) & (order[lo:hi, None] < order)
                near &= length[lo:hi, None] == length
                if i != j:
                    near &= chunk[s + lo : s + hi, None] != chunk[s:e]
                a, b = np.nonzero(near)
                if not len(a):
                    continue
                a += lo
                first = ~(own[a, :table] == own[b, :table]).any(axis=1)  # a pair counts in its first common table only
                a, b = a[first], b[first]
                np.add.at(add, a, size[s + b])
                np.add.at(add, b, size[s + a])
                label = merged(label, a, b)
            hit = np.flatnonzero(add)
            ids.append(rep[s + hit])
            adds.append(add[hit])
            roots.append(rep[s + label[hit]])
        if ids:
            yield pd.DataFrame({"rep": np.concatenate(ids), "links": np.concatenate(adds), "root": np.concatenate(roots)})

    return run


def embedding_near_dedup(vectors: DataFrame, *, threshold: float = 0.95, tables: int = 24, projections: int = 12, width: float = 2.0, seed: int = 7, group_limit: int = 4000) -> DataFrame:
    """Links vectors of cosine `threshold` or more and names the group of each.

    Equal vectors form a class that is compared once. Every class's unit
    vector is hashed in `tables` tables by `projections` quantised Gaussian
    projections of the given width; within a bucket all pairs have their
    cosine computed in double precision, in the first table where they meet. At the
    threshold's distance (0.316 for 0.95) one table catches a pair with
    probability 0.198, 24 tables with 0.995; closer pairs are surer. A bucket
    of more than group_limit classes is cut into chunks, of which every two
    meet; no pair is dropped.

    vectors needs vec_id and embedding; other columns are ignored. A vector
    that is null, empty, zero, or has null or non-finite parts links with
    nothing, and vectors of different lengths never link. Returns vec_id,
    n_links (other rows linked directly), component_id (smallest vec_id
    reachable), kept, one row per row of vectors. A null vec_id is never
    chosen while the group has another; where all are null, component_id is
    null and all say kept.
    """
    base = vectors.select("vec_id", "embedding")
    parts = F.col("embedding")
    valid = F.coalesce(F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(parts, lambda x: x != 0), F.lit(False))
    # zeros of either sign are equal numbers
    clean = F.transform(parts, lambda x: F.when(x == 0, F.abs(x)).otherwise(x)).alias("embedding")
    good = base.where(valid).select("vec_id", clean)
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("size"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "embedding_classes")  # classes have numbers of their own: an id may be null

    schema = "tbl int, key int, keys binary, rep long, size long, vector binary, is_double boolean"
    rows = classes.select("rep", "size", "embedding").mapInPandas(_hashed(tables, projections, width, seed), schema)
    rows = split_large(rows, ["tbl", "key"], group_limit, F.col("rep"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("other")
    rows = rows.select("*", other).withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    found = map_groups(rows.drop("other", "n_chunks"), ["tbl", "key", "i", "j"], _compared(threshold), "rep long, links long, root long")
    found = stored(found, "embedding_links")

    names = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.join(links, "rep", "left").join(names.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("component_id", "rep")).drop("component_id")
    named = stored(named, "embedding_rooted")
    roots = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(named.join(roots, "root").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"), "embedding_named")
    linked = good.join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = base.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
