"""Operator 8: repeated word windows by Rabin-Karp hashes counted in Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import Words, documents, numbers, released, text_bytes, text_groups, with_fields

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of every `width` consecutive word hashes, by doubling the length."""
    out, length, done = None, 1, words
    rest = width
    while True:
        if rest & 1:
            if out is None:
                out, have = done, length
            else:  # the longer part comes first
                n = len(words) - have - length + 1
                out, have = done[:n] * np.uint64(pow(base, have, 1 << 64)) + out[length : length + n], have + length
        rest >>= 1
        if not rest:
            return out[: len(words) - width + 1]
        n = len(done) - length
        done, length = done[:n] * np.uint64(pow(base, length, 1 << 64)) + done[length : length + n], 2 * length


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class _Group:
    """The windows of a group of documents, the same whenever it is made from the same rows."""

    def __init__(self, frame: pa.Table, width: int) -> None:
        self.width = width
        ids = numbers(frame.column("doc_id"))
        texts = pc.fill_null(frame.column("text"), "")
        order = np.lexsort((np.asarray(pc.rank(texts, tiebreaker="dense")), np.asarray(frame.column("doc_id").is_valid()), ids))
        self.frame, self.ids = frame.take(pa.array(order)), ids[order]
        self.words = Words(self.frame.column("text"))
        self.sizes, self.ends = self.words.sizes, self.words.ends
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words.listed()), dtype=np.uint64, count=len(self.words.names))[self.words.of]
        if len(self.hashes) < width:
            self.starts = np.zeros(0, dtype=np.int64)
            window = np.zeros(0, dtype=np.uint64)
        else:
            last = np.zeros(len(self.hashes) + 1, dtype=np.int64)  # of every place, whether a window of its document begins there
            some = self.sizes >= width
            last[(self.ends - self.sizes)[some]] += 1
            last[(self.ends - width + 1)[some]] -= 1
            self.starts = np.flatnonzero(np.cumsum(last)[:-1])
            window = _mixed(rolling(self.hashes, width, _BASES[0])[self.starts])
        #: Distinct windows in order of their hash; the first start of each; the distinct window of each start.
        self.window, self.first, self.of = np.unique(window, return_index=True, return_inverse=True)

    def cuts(self, bits: int) -> np.ndarray:
        """Where the buckets of 2**bits begin among the distinct windows."""
        return np.append(np.searchsorted(self.window, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(self.window))

    def short(self, bits: int) -> np.ndarray:
        """The 32 bits below those that name the bucket."""
        return ((self.window << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def _planes(values: np.ndarray) -> bytes:
    """Gaps between ascending numbers, by byte plane: the high plane is nearly all zeros and compresses away."""
    return np.diff(values, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)


def _counted(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: which windows of which groups are short-hash repeats of another group's."""
    parts = [_unplaned(x) for x in frame["windows"]]
    every = np.sort(np.concatenate(parts))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    if not len(twice):
        return pd.DataFrame({"gid": [], "bucket": [], "seen": []})
    flags = []
    for p in parts:
        at = np.minimum(np.searchsorted(twice, p), len(twice) - 1)
        flags.append(_planes(np.flatnonzero(twice[at] == p).astype(np.uint32)))
    keep = [i for i, f in enumerate(flags) if f]
    return pd.DataFrame({"gid": frame["gid"].to_numpy()[keep], "bucket": frame["bucket"].to_numpy()[keep], "seen": [flags[i] for i in keep]})


_RECORD = np.dtype([("hash", "<u8"), ("check", "<u4"), ("doc", "<i8"), ("at", "<u4")])


def _later(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the windows whose words start earlier in another group, by their index in their own group."""
    frame = frame.sort_values("gid")
    parts = [np.frombuffer(x, dtype=_RECORD) for x in frame["records"]]
    every = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.lexsort((every["doc"], every["check"], every["hash"]))
    h, c = every["hash"][order], every["check"][order]
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    late = np.sort(order[again])
    gids, rows = frame["gid"].to_numpy(), []
    cuts = np.searchsorted(owner[late], np.arange(len(parts) + 1))
    for i in range(len(parts)):
        if cuts[i] < cuts[i + 1]:
            rows.append((gids[i], _planes(np.sort(every["at"][late[cuts[i] : cuts[i + 1]]]))))
    return pd.DataFrame(rows, columns=["gid", "late"])


def substring_dedup(docs: DataFrame, *, width: int = 50, group_bytes: int = 4 << 20, bucket_windows: int = 8_000_000) -> DataFrame:
    """Removes the words of every window of `width` words that starts earlier somewhere in docs.

    Every window gets a Rabin-Karp hash. Documents are dealt into groups of
    about group_bytes; a group sends the 32 + b leading bits of its distinct
    windows' hashes to 2**b buckets, where Spark brings all groups together and
    windows that several groups have are found. Only these send their 96-bit
    hash and place, once a group however common they are, to find out which
    starts first: the smallest doc_id, then the earliest start. Overlapping
    windows merge into maximal intervals, and their words go. Windows are
    judged on the input, not on what is left. Documents are dealt by id and
    text, and words are kept as Arrow arrays, so that neither an id that many
    rows have nor a text of many MB makes a group that doesn't fit.

    docs needs doc_id and text; other columns are ignored. Null, empty and
    short texts have no windows and lose nothing. A null doc_id sorts first;
    of rows that repeat a doc_id with other texts, the first to have a window
    is the one whose group and text come first. Rows equal in doc_id and text
    count as one document and all get its result. Returns doc_id, n_words, n_removed, kept
    (the remaining words joined by one space), removed (array of [start, end)
    word intervals), one row per row of docs.
    """
    total = text_bytes(docs)
    bits = max(8, (total // 5 // bucket_windows).bit_length())
    groups = text_groups(docs.select("doc_id", "text"), total, group_bytes)

    out_type = with_fields(docs.select("doc_id"), "n_words long, n_removed long, kept string, removed array<array<long>>, n long")

    def hashed(frame: pa.Table) -> pa.Table:
        g = _Group(frame, width)
        cuts, short, gid = g.cuts(bits), g.short(bits), frame.column("gid")[0].as_py()
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        return pa.table({"bucket": pa.array(full, pa.int32()), "gid": pa.array(np.full(len(full), gid), pa.int64()), "windows": pa.array([_planes(short[cuts[b] : cuts[b + 1]]) for b in full], pa.binary())})

    def placed(frame: pa.Table, seen: pa.Table) -> pa.Table:
        rows: list[tuple[int, bytes]] = []
        if frame.num_rows and seen.num_rows:
            g = _Group(frame, width)
            check = (_mixed(rolling(g.hashes, width, _BASES[1])[g.starts[g.first]]) >> np.uint64(32)).astype(np.uint32)
            record = np.empty(len(g.window), dtype=_RECORD)
            record["hash"], record["check"], record["at"] = g.window, check, np.arange(len(g.window))
            record["doc"] = g.ids[np.searchsorted(g.ends, g.starts[g.first], side="right")]
            cuts = g.cuts(bits)
            rows = [(b, record[cuts[b] + _unplaned(s)].tobytes()) for b, s in zip(seen.column("bucket").to_pylist(), seen.column("seen").to_pylist())]
        gid = frame.column("gid")[0].as_py() if frame.num_rows else 0
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "gid": pa.array([gid] * len(rows), pa.int64()), "records": pa.array([r for _, r in rows], pa.binary())})

    def cleaned(frame: pa.Table, late: pa.Table) -> pa.Table:
        g = _Group(frame, width)
        gone = np.ones(len(g.starts), dtype=bool)
        gone[g.first] = False
        elsewhere = np.zeros(len(g.window), dtype=bool)
        for raw in late.column("late").to_pylist():
            elsewhere[_unplaned(raw)] = True
        gone |= elsewhere[g.of]
        edge = np.zeros(len(g.hashes) + width + 1, dtype=np.int64)
        np.add.at(edge, g.starts[gone], 1)
        np.add.at(edge, g.starts[gone] + width, -1)
        covered = np.cumsum(edge)[: len(g.hashes)] > 0
        total = np.append(0, np.cumsum(covered))
        n_removed = total[g.ends] - total[g.ends - g.sizes]
        # what stays, word by word, joined by blanks for each document
        stays = np.flatnonzero(~covered)
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, g.ends) - total[np.append(0, g.ends)], pa.int64()), g.words.names.take(pa.array(g.words.of[stays])))
        kept = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
        step = np.diff(np.concatenate([[0], covered, [0]]).astype(np.int8)) if len(covered) else np.zeros(0, dtype=np.int8)
        begin = np.flatnonzero(step == 1)
        edges = np.unique(np.concatenate([begin, (g.ends - g.sizes)[n_removed > 0]]))  # intervals end with their document
        edges = edges[covered[edges]] if len(edges) else edges
        doc = np.searchsorted(g.ends, edges, side="right")
        stop = np.minimum(np.flatnonzero(step == -1)[np.searchsorted(begin, edges, side="right") - 1], g.ends[doc]) if len(edges) else edges
        base = (g.ends - g.sizes)[doc]
        spans = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(edges) + 1, 2), pa.int32()), pa.array(np.stack([edges - base, stop - base], axis=1).ravel().astype(np.int64)))
        removed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=len(g.sizes)))), pa.int32()), spans)
        out = [g.frame.column("doc_id").combine_chunks(), pa.array(g.sizes, pa.int64()), pa.array(n_removed, pa.int64()), kept, removed, g.frame.column("n").combine_chunks()]
        released()
        return pa.table(out, names=["doc_id", "n_words", "n_removed", "kept", "removed", "n"])

    windows = groups.groupBy("gid").applyInArrow(hashed, "bucket int, gid long, windows binary")
    seen = windows.groupBy("bucket").applyInPandas(_counted, "gid long, bucket int, seen binary")
    records = groups.groupBy("gid").cogroup(seen.groupBy("gid")).applyInArrow(placed, "bucket int, gid long, records binary")
    late = records.groupBy("bucket").applyInPandas(_later, "gid long, late binary")
    out = groups.groupBy("gid").cogroup(late.groupBy("gid")).applyInArrow(cleaned, out_type)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n", "_copy")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir), width=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM w),
h AS (SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS k FROM s),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM h),
c AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + 20)))) AS gone FROM r WHERE n > 1 GROUP BY doc_id),
k AS (SELECT w.doc_id, w.w, coalesce(len(c.gone), 0) AS n_removed,
  CASE WHEN c.gone IS NULL THEN w.w ELSE list_select(w.w, list_sort(list_filter(range(1, len(w.w) + 1), lambda i : NOT list_contains(c.gone, i)))) END AS kept
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
