"""Operator 10: stateful streaming exact deduplication, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import documents, lower_ascii, shared_dir, stored

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": _PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # an open store holds 4 MB of disk however small it is
}


def sha256(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _keyed_state(rows: DataFrame, path: str, folder: str, bytes_per_batch: int, rows_per_state: int) -> DataFrame:
    """Streams the stored (digest, doc_id, locator) through a keyed state in RocksDB and reads that state.

    The state never expires. For a digest it holds the row with the largest
    doc_id, with its locator, and the number of rows seen. The stream runs in a
    session of its own, so that its settings are nobody else's.
    """
    spark = rows.sparkSession
    # every partition of the state has files of its own, so that small ones cost more than what they hold
    parts = max(8, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_state)))
    own = spark.newSession()
    for k, v in (_STREAM_CONF | {"spark.sql.shuffle.partitions": str(parts)}).items():
        own.conf.set(k, v)
    stream = own.readStream.schema(rows.schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(path)
    seen = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count("*").alias("group_size"))
    query = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    state = spark.read.format("statestore").load(f"{folder}/state")
    return state.select(F.col("key.digest").alias("digest"), F.col("value.max").alias("keeper"), F.col("value.count").alias("group_size"))


def exact_dedup(docs: DataFrame, *, row: str | None = None, normalise: Callable[[Column], Column] = lower_ascii, digest: Callable[[Column], Column] = sha256, bytes_per_batch: int = 64 << 30, rows_per_state: int = 100_000, broadcast_rows: int = 200_000) -> DataFrame:
    """Groups documents with equal normalised texts; the row with the largest doc_id stays.

    Rows are written once with their text and its digest; a row's number there
    is its content locator (with row, the texts stay where they are, and row is
    the locator). Digests then go through a streaming aggregation whose state, on disk in
    RocksDB and checkpointed in the shared folder, keeps for every digest the
    keeper's stable id (doc_id), its content locator and the group's size.
    State grows with the number of distinct texts and never expires. Every
    hit, a row whose digest another row has too, is held against the bytes
    found at the keeper's locator; rows that share a digest but not the text
    are grouped anew by their text, so that a collision can't drop a document.

    docs needs doc_id and text; other columns are ignored. A null text counts
    as empty. Returns doc_id, keep_id, group_size, kept, text_sha256, one row
    per row of docs. A null doc_id sorts below all others and has a null
    keep_id only where its whole group has null ids. Rows that repeat a doc_id
    are each counted; all rows of the kept id say kept. row names a column
    that numbers the rows of docs: it comes back too, it is the locator, and
    then of rows that repeat the kept id only the last says kept. An empty
    table gives an empty result.

    bytes_per_batch bounds a micro-batch; the state has a partition for every
    rows_per_state rows, and no more than spark.sql.shuffle.partitions. Up to
    broadcast_rows digests (or places) of hits go to all executors; more are
    joined by a shuffle.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "exact_dedup")
    text = normalise(F.coalesce(F.col("text"), F.lit("")))
    locator = F.monotonically_increasing_id() if row is None else F.col(row)
    content = docs.select("doc_id", locator.alias("locator"), text.alias("_text"))
    coded = content.withColumn("digest", digest(F.col("_text")))
    if digest is not sha256:
        coded = coded.withColumn("text_digest", sha256(F.col("_text")))
    if row is None:
        coded.write.parquet(f"{folder}/content")
        content = coded = spark.read.schema(coded.schema).parquet(f"{folder}/content")
        rows = content.drop("_text")
    else:
        rows = stored(coded.drop("_text"), "exact_dedup_rows")
    plain = rows.select("digest", "doc_id", "locator")
    plain.write.parquet(f"{folder}/rows")
    state = _keyed_state(spark.read.schema(plain.schema).parquet(f"{folder}/rows"), f"{folder}/rows", folder, bytes_per_batch, rows_per_state)

    groups = stored(state.select("digest", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.locator").alias("keep_at"), "group_size"), "exact_dedup_groups")
    hits = groups.where("group_size > 1").select("digest", "keep_at")

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.limit(broadcast_rows + 1).count() <= broadcast_rows else df

    if row is None:
        seen = content.select("digest", "locator", "_text").join(sent(hits), "digest")
    else:
        seen = content.select("locator", "_text").join(sent(stored(rows.join(hits, "digest").select("digest", "locator", "keep_at"), "exact_dedup_places")), "locator")
    seen = stored(seen, "exact_dedup_hits")
    keeper = seen.where("locator = keep_at").select("digest", F.col("_text").alias("_kept_text"))
    # nothing but a filter stands above the join, so that AQE can split a digest with many hits
    differs = stored(seen.where("locator <> keep_at").join(keeper, "digest").where("_text <> _kept_text").select("digest"), "exact_dedup_collisions").distinct()

    out = rows.join(groups, "digest")
    if digest is sha256:
        out = out.withColumn("text_digest", F.col("digest"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) if row is None else F.col("locator") == F.col("keep_at")
    if not differs.isEmpty():
        clash = coded.join(differs, "digest")
        by_text = clash.groupBy("digest", "_text").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count("*").alias("group_size"))
        by_text = by_text.select("digest", "_text", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.locator").alias("keep_at"), "group_size")
        apart = clash.join(by_text, ["digest", "_text"]).drop("_text")
        out = out.join(differs, "digest", "left_anti").unionByName(apart, allowMissingColumns=True)
    return out.select(*([] if row is None else [F.col("locator").alias(row)]), "doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("text_digest")).alias("text_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH t AS (SELECT doc_id, {_LOWER} AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
FROM t JOIN g ON t.x = g.x
"""
