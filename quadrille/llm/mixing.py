"""Operator 6: mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import documents, map_groups, merged, numbered, stored, word_count


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], max_repeats: int) -> dict[str | None, float]:
    """Each source's share of all words by weight, at most max_repeats times its size; the excess goes to the others by weight."""
    total, out, left = float(sum(sizes.values())), {}, list(sizes)
    while left:
        room = total - sum(out.values())
        share = sum(weights[s] for s in left)
        over = [s for s in left if share and room * weights[s] / share > max_repeats * sizes[s]]
        if not over:
            return out | {s: room * weights[s] / share if share else 0.0 for s in left}
        out |= {s: float(max_repeats * sizes[s]) for s in over}
        left = [s for s in left if s not in set(over)]
    return out


def route(capacity: list[int], members: list[list[int]], quota: list[float], max_repeats: int) -> np.ndarray:
    """Words that each membership pattern gives to each source: a min-cost flow, as an array [pattern, source].

    A pattern's words can be taken max_repeats times; the k-th time costs k a
    word, so that the cost is convex and repeats spread over patterns. Flow is
    sent along cheapest residual paths, found by Bellman-Ford over patterns
    and sources, until quotas are met or no path is left. Every path carries
    more than eps, so that it ends.
    """
    flow = np.zeros((len(capacity), len(quota)))
    used, got = np.zeros(len(capacity)), np.zeros(len(quota))
    eps = 1e-6 * max(1.0, sum(quota))
    while True:
        # cheapest way into each pattern: fresh words at the pattern's present level, or words freed from it by way of a source
        level = np.array([np.floor((u + eps) / c) if c else max_repeats for u, c in zip(used, capacity)])
        cost = np.where(level < max_repeats, level + 1.0, np.inf)
        before: list[tuple[int, int] | None] = [None] * len(capacity)
        via, reach = [-1] * len(quota), np.full(len(quota), np.inf)
        changed = True
        while changed:
            changed = False
            for p, own in enumerate(members):
                for s in own:
                    if cost[p] < reach[s] - 1e-12:
                        reach[s], via[s], changed = cost[p], p, True
            for p, own in enumerate(members):
                for s in own:
                    if flow[p, s] > eps and reach[s] < cost[p] - 1e-12 and via[s] != p:
                        cost[p], before[p], changed = reach[s], (via[s], s), True
        short = [s for s in range(len(quota)) if quota[s] - got[s] > eps and np.isfinite(reach[s])]
        if not short:
            return flow
        end = min(short, key=lambda s: (reach[s], s))
        path, s, amount = [], end, quota[end] - got[end]
        while True:
            p = via[s]
            path.append((p, s))
            if before[p] is None:
                amount = min(amount, capacity[p] * (level[p] + 1) - used[p])
                break
            _, s = before[p]
            amount = min(amount, flow[p, s])
            path.append((p, s))
        for k, (p, s) in enumerate(path):
            flow[p, s] += amount if k % 2 == 0 else -amount
        used[path[-1][0]] += amount
        got[end] += amount


def routed(capacity: list[int], members: list[list[int]], quota: list[float], max_repeats: int) -> np.ndarray:
    """Words that each pattern gives, over all its sources: a flow for each part of the sources that no pattern joins to the rest, as nothing can flow between parts."""
    label = np.arange(len(quota))
    label = merged(label, np.array([own[0] for own in members for _ in own], dtype=np.int64), np.array([s for own in members for s in own], dtype=np.int64)) if members else label
    parts: dict[int, list[int]] = {}
    for p, own in enumerate(members):
        parts.setdefault(int(label[own[0]]), []).append(p)
    given = np.zeros(len(capacity))
    for patterns in parts.values():
        names = sorted({s for p in patterns for s in members[p]})
        at = {s: k for k, s in enumerate(names)}
        given[patterns] = route([capacity[p] for p in patterns], [[at[s] for s in members[p]] for p in patterns], [quota[s] for s in names], max_repeats).sum(axis=1)
    return given


def _filled(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
    """Takes documents in seeded order as long as they fit in what is left of the group's words; larger ones are passed over.

    Then, while words are left, the exchange of one taken document for one not
    taken that leaves the fewest: for each size taken, the largest size not
    taken that fits in its place is looked up among the sorted ones.
    """
    chosen = np.zeros(len(frame), dtype=bool)
    size, room = frame["size"].to_numpy(), frame["room"].to_numpy()
    for s, e in zip(starts[:-1], starts[1:]):
        left = room[s]
        for i in range(s, e):
            if size[i] <= left:
                chosen[i], left = True, left - size[i]
        for _ in range(4):
            own, other = np.flatnonzero(chosen[s:e]) + s, np.flatnonzero(~chosen[s:e]) + s
            if not left or not len(own) or not len(other):
                break
            other = other[np.argsort(size[other], kind="stable")]
            fits = np.searchsorted(size[other], size[own] + left, side="right") - 1
            gain = np.where(fits >= 0, size[other[fits]] - size[own], 0)
            a = int(gain.argmax())
            if gain[a] <= 0:
                break
            chosen[own[a]], chosen[other[fits[a]]], left = False, True, left - gain[a]
    yield frame[["file", "at"]][chosen]


def mix_sources(docs: DataFrame, *, sources: Column | None = None, size: Column | None = None, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 11, bucket_rows: int = 200, max_buckets: int = 1_000_000, broadcast_rows: int = 100_000, row: str | None = None, keep_columns: bool = False) -> DataFrame:
    """Mixes documents so that sources come near target weights.

    sources is an array of a document's sources (default: the column source
    alone); size defaults to the number of words of text. Sources by code
    point, null last, weigh `weights` in turn. Their targets share 100 % of all
    words, none above max_repeats times its source's words. Documents are added
    up by membership pattern; a min-cost flow routes the patterns' words, which
    cost more each time they are repeated, to the targets. A pattern's words
    are then whole passes over all its documents and one pass over a seeded
    part: documents in the order of a seeded hash until the words run out.
    That order is cut into buckets of about bucket_rows documents (at most
    max_buckets), so that only sums of buckets are ordered as a whole, and only
    the one bucket where words run out is walked through document by document.

    Patterns, not documents, come to the driver, and all go through the flow,
    sources that no pattern joins apart from each other. What is joined to the documents,
    one row a pattern, a bucket or a document at the edge, goes to all
    executors up to broadcast_rows rows and by a shuffle beyond. docs needs doc_id, text and source (or what the given columns use);
    other columns are ignored. Documents without words (null or empty texts)
    take 0; a null source is a source of its own, an empty or null array counts
    as [null]. Rows that repeat a doc_id are documents of their own. The same
    rows give the same mix. Returns doc_id, sources, size, source_size, target
    (the sums over the document's sources) and taken (words, repeats counted);
    row names a column that tells the rows of docs apart, as numbered() has it
    (one is made where there is none); with keep_columns also the other columns
    of docs, but for those of these names, which the result's own replace.
    """
    members = F.array("source") if sources is None else F.when(F.size(sources) > 0, F.array_sort(F.array_distinct(sources))).otherwise(F.array(F.lit(None).cast("string")))
    own = {"doc_id", row, "row_id", "sources", "size", "draw", "source_size", "target", "taken", "passes", "rest", "n_buckets", "bucket", "whole", "room", "part"}
    carried = [c for c in docs.columns if c not in own] if keep_columns else []
    docs = docs if row else numbered(docs, "row_id", "mixing_rows")
    base = docs.select("doc_id", *carried, F.col(row or "row_id").alias("row_id"), members.alias("sources"), (word_count(F.col("text")) if size is None else size).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"))
    whole, base = base, stored(base.select("row_id", "sources", "size", "draw"), "mixing")  # texts are read once more for the result, rather than written
    sums = base.groupBy("sources").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sums.sort(key=lambda r: [(s is None, s or "") for s in r["sources"]])
    names = sorted({s for r in sums for s in r["sources"]}, key=lambda s: (s is None, s or ""))
    sizes = dict.fromkeys(names, 0)
    for r in sums:
        for s in r["sources"]:
            sizes[s] += r["size"]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = sum(r["size"] for r in sums)
    goal = targets(sizes, weight, max_repeats) if total else {s: 0.0 for s in names}
    if total and sum(goal.values()) > total:  # where sources overlap their sizes add up to more than all words
        goal = {s: g * total / sum(goal.values()) for s, g in goal.items()}
    place = {s: k for k, s in enumerate(names)}
    given = routed([r["size"] for r in sums], [[place[s] for s in r["sources"]] for r in sums], [goal[s] for s in names], max_repeats)

    plan = []
    for r, words in zip(sums, given.tolist()):
        passes = min(max_repeats, int((words + 1e-6 * total) // r["size"])) if r["size"] else 0
        rest = max(0, round(words - passes * r["size"])) if passes < max_repeats else 0
        plan.append((r["sources"], passes, rest, max(1, min(max_buckets, -(-r["n"] // bucket_rows))), sum(sizes[s] for s in r["sources"]), float(sum(goal[s] for s in r["sources"]))))
    spark = docs.sparkSession

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.limit(broadcast_rows + 1).count() <= broadcast_rows else df

    plan = sent(spark.createDataFrame(plan, "p_sources array<string>, passes long, rest long, n_buckets long, source_size long, target double"))
    same = F.col("sources").eqNullSafe(F.col("p_sources"))

    def planned(df: DataFrame) -> DataFrame:
        return df.join(plan, same).drop("p_sources").withColumn("bucket", F.pmod("draw", "n_buckets"))

    rows = planned(base)
    cut = rows.where("rest > 0").groupBy("sources", "rest", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = cut.selectExpr("sources", "rest", "bucket", "in_bucket", "sum(in_bucket) OVER (PARTITION BY sources ORDER BY bucket ROWS UNBOUNDED PRECEDING) - in_bucket AS before")
    before = stored(before.selectExpr("sources AS b_sources", "bucket AS b_bucket", "before + in_bucket <= rest AS whole", "CASE WHEN before < rest AND before + in_bucket > rest THEN rest - before END AS room"), "mixing_buckets")
    before = sent(before)

    def placed(df: DataFrame) -> DataFrame:
        return df.join(before, F.col("sources").eqNullSafe(F.col("b_sources")) & (F.col("bucket") == F.col("b_bucket")), "left").drop("b_sources", "b_bucket")

    edge = placed(rows).where("room IS NOT NULL").select(F.to_json(F.struct("sources")).alias("pattern"), "draw", "row_id.file", "row_id.at", "size", "room")
    some = stored(map_groups(edge, ["pattern"], _filled, "file long, at long", sort=("draw", "file", "at")), "mixing_edge").select(F.struct("file", "at").alias("row_id"))
    rows = placed(planned(whole))
    some = sent(some.withColumn("part", F.lit(True)))
    if some.limit(broadcast_rows + 1).count() <= broadcast_rows:
        rows = rows.join(some, "row_id", "left")
    else:  # only rows at the edge are shuffled
        rows = rows.where("room IS NULL").withColumn("part", F.lit(None).cast("boolean")).unionByName(rows.where("room IS NOT NULL").join(some, "row_id", "left"))
    taken = F.col("size") * (F.col("passes") + F.coalesce(F.col("whole"), F.lit(False)).cast("long") + F.coalesce(F.col("part"), F.lit(False)).cast("long"))
    return rows.select("doc_id", *carried, "sources", "size", "source_size", "target", taken.alias("taken"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
