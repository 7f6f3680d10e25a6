"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words are runs of anything but ASCII white space; bytes.split() and Arrow's ascii_split_whitespace cut UTF-8 at the same places.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of text that a Python worker works on at once.
SLICE_ROWS, SLICE_BYTES = 2000, 2 << 20

_LEAST = np.iinfo(np.int64).min


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(col: Column) -> Column:
    """Lower-cases A-Z only; other letters stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % folds


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null: a word starts wherever a non-space follows the start or a space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _shared_base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quadrille-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which driver and executors share. Only where all is one machine, as in tests, may it be unset."""
    return f"{_shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    _shared_base(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it back: computed once, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, row: str, name: str) -> DataFrame:
    """The rows with what tells them apart, be they equal in all else, in the column row: their file and their place in it.

    Rows that don't come straight from files are stored first, with numbers.
    """
    try:
        return df.withColumn(row, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    except AnalysisException:
        return stored(df.withColumn(row, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), name)


def without(docs: DataFrame, gone: DataFrame, row: str, broadcast_rows: int = 200_000) -> DataFrame:
    """Leaves out rows by their numbers, which are written and counted first: up to broadcast_rows go to all executors, more are joined by a shuffle."""
    gone = stored(gone.select(row), "gone")
    few = gone.limit(broadcast_rows + 1).count() <= broadcast_rows
    return docs.join(F.broadcast(gone) if few else gone, row, "left_anti")


@contextlib.contextmanager
def _meanwhile(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession, size: str = "8m") -> contextlib.AbstractContextManager[None]:
    """While it lasts, jobs hand Python workers Arrow batches of at most this many bytes (Spark's own limit is 64 MB), and then the session is as it was."""
    return _meanwhile(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def shuffles_dropped(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """While it lasts, what a query shuffled goes from the disks when the query ends. Spark otherwise keeps it until the driver
    happens to collect its garbage, so that many queries in a row, whose rows are on the driver or stored, add up."""
    return _meanwhile(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def with_fields(df: DataFrame, fields: str) -> StructType:
    """A table's schema with more fields behind."""
    return StructType([*df.schema.fields, *StructType.fromDDL(fields).fields])


def released() -> None:
    """Gives freed memory back: workers wait for their next task, and what they hold meanwhile counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batch: pa.RecordBatch | pa.Table, text: str = "text", rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Parts of at most so many rows and, where there are several rows, about so many bytes of text."""
    length = pc.fill_null(pc.binary_length(batch.column(text)), 0)
    total = np.cumsum(np.asarray(length.to_numpy(zero_copy_only=False) if isinstance(length, pa.Array) else length.to_numpy(), dtype=np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        before = total[at - 1] if at else 0
        end = min(at + rows, n, max(at + 1, int(np.searchsorted(total, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def map_texts(docs: DataFrame, fn: Callable[[pa.Array], dict], schema: str, carried: tuple[str, ...] | list[str] = ("doc_id",), rows: int = SLICE_ROWS, size: int = SLICE_BYTES, start: Callable[[], object] | None = None) -> DataFrame:
    """fn's columns for the texts of each slice, next to the carried columns.

    fn gets an Arrow array of texts (and what start made, once a task) and
    returns columns by name, as schema names them. Carried columns stay in
    Arrow from end to end, so that ids keep all their digits and their nulls.
    """
    out, n_kept = with_fields(docs.select(*carried), schema), len(carried)
    names = out.names[n_kept:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = () if start is None else (start(),)
        try:
            for batch in batches:
                for part in slices(batch, "_text", rows, size):
                    found = fn(part.column("_text"), *extra)
                    yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], *(pa.array(found[c]) for c in names)], names=[*part.schema.names[:n_kept], *names])
        finally:
            extra = None
            released()

    return docs.select(*[F.col(c) for c in carried], F.col("text").alias("_text")).mapInArrow(run, out)


def plain_texts(texts: pa.Array) -> list[str]:
    """Texts as Python strings; null counts as empty."""
    return [t or "" for t in texts.to_pylist()]


class Words:
    """The words of an array of texts: names has the distinct ones, of each word's number among them, sizes the number of words of each text."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> None:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        flat = lists.flatten()
        full = np.asarray(pc.not_equal(pc.binary_length(flat), 0))
        cuts = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        self.sizes = np.diff(np.append(0, np.cumsum(full))[cuts])
        coded = flat.filter(pa.array(full)).dictionary_encode()
        self.names = coded.dictionary
        self.of = np.asarray(coded.indices)
        self.ends = np.cumsum(self.sizes)

    def listed(self) -> list[bytes]:
        return self.names.cast(pa.large_binary()).to_pylist()


def numbers(ids: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as 64-bit numbers for ordering; null comes first."""
    return np.asarray(pc.fill_null(ids.cast(pa.int64()), int(_LEAST)), dtype=np.int64)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame, np.ndarray], Iterator[pd.DataFrame]], schema: str, sort: tuple[str, ...] = ()) -> DataFrame:
    """Deals rows by keys and hands fn whole groups, many at a time.

    fn gets a frame sorted by the keys and the offsets at which its groups
    start (with the frame's length last). Far cheaper than one call a group
    where groups are many and small. A group must fit in memory: callers split
    large ones first. No column may be null.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def groups(frame: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, np.ndarray, pd.DataFrame]:
            changed = np.zeros(len(frame), dtype=bool)
            changed[0] = True
            for k in keys:
                v = frame[k].to_numpy()
                changed[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(changed)
            end = len(frame) if last else starts[-1]
            return frame.iloc[:end], np.append(starts[starts < end], end), frame.iloc[end:]

        try:
            for batch in batches:
                if not len(batch):
                    continue
                if held and all(batch[k].iloc[-1] == held[-1][k].iloc[-1] for k in keys):
                    held.append(batch)
                    continue
                whole, starts, rest = groups(pd.concat([*held, batch], ignore_index=True), last=False)
                held = [rest]
                if len(whole):
                    yield from fn(whole.reset_index(drop=True), starts)
            if held:
                whole, starts, _ = groups(pd.concat(held, ignore_index=True), last=True)
                yield from fn(whole, starts)
        finally:
            held.clear()
            released()

    return df.repartition(*keys).sortWithinPartitions(*keys, *sort).mapInPandas(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component_id), the smallest id that each node reaches.

    Alternates the large-star and small-star steps until the edges no longer
    change; the number of rounds grows with the logarithm of the longest chain.
    Only nodes with an edge to another node come back. Every round is a join
    against one row per node, so a hub of any degree is dealt out by AQE.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.groupBy("u").agg(F.min("v").alias("component_id")).select(F.col("u").alias("id"), "component_id").unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = cut(small)


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each position's root, the smallest position that it is joined to) after joining positions a to b."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return label
        label = label.copy()
        np.minimum.at(label, high[apart], low[apart])
        while not np.array_equal(up := label[label], label):
            label = up


def split_large(df: DataFrame, keys: list[str], limit: int, by: Column) -> DataFrame:
    """Adds the columns chunk and n_chunks: groups of more than limit rows are cut into chunks of about limit rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    counts = cut(counts.withColumn("n_chunks", F.ceil(F.col("_n") / limit).cast("int")).drop("_n"))
    if counts.isEmpty():
        return df.withColumns({"n_chunks": F.lit(1), "chunk": F.lit(0)})
    out = df.join(counts, keys, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(1)))
    return out.withColumn("chunk", F.pmod(F.xxhash64(by), F.col("n_chunks").cast("long")).cast("int"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: what sizes groups and buckets."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def text_groups(docs: DataFrame, total_bytes: int, group_bytes: int) -> DataFrame:
    """Deals docs into groups gid of about group_bytes of text, by id and text: rows equal in all columns become one, with their number n.

    An id that many rows have, or none, is dealt out with the texts. Equal rows
    meet in one task and are added up as they stream through it, so that a
    group never holds more than one of them. The same frame read several times
    in a query is shuffled once: Spark reuses the exchange.
    """
    groups = max(1, -(-total_bytes // group_bytes))
    gid = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups).cast("long"))
    dealt = docs.select(gid.alias("gid"), "*").repartition("gid")
    return dealt.groupBy("gid", *docs.columns).agg(F.count("*").alias("n"))


class Memo(dict):
    """A function's results by argument."""

    def __init__(self, fn: Callable) -> None:
        self.fn = fn

    def __missing__(self, key):
        value = self[key] = self.fn(key)
        return value
