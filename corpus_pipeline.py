"""Corpus pipeline: quality filter, exact dedup, SimHash dedup, source mixing, SentencePiece.

STAGES lists (name, function) pairs. A function takes (spark, docs, sf_dir)
and returns a DataFrame; each stage's result is written as Parquet in the
shared folder and read back as the docs of the next. All but the last return
the columns of documents, whatever else docs has. Decisions are about rows, not
ids: all but the last stage tell rows apart by file and place, so that rows
with a null doc_id, or one that others have too, stand for themselves. An
empty table of documents passes through all stages. Python workers get small
batches, which is a setting of the session while a stage's jobs run: what they
make is written before the stage returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import documents, numbered, shared_dir, small_batches, stored, without
from quadrille.llm.exact_dedup import exact_dedup
from quadrille.llm.mixing import mix_sources
from quadrille.llm.quality import score_quality
from quadrille.llm.sentencepiece_codec import encode
from quadrille.llm.simhash import simhash_near_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ROW = "row_in_stage"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, taught by all labels, rejects. Rows with a null doc_id are scored like others."""
    docs = numbered(docs, ROW, "pipeline_quality")
    with small_batches(spark):
        scored = stored(score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), row=ROW), "pipeline_scores")
    return without(docs, scored.where("predicted = 0"), ROW).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of those with equal texts, A-Z lower-cased: the one with the largest doc_id, of equal ids the last."""
    docs = numbered(docs, ROW, "pipeline_exact")
    return without(docs, exact_dedup(docs, row=ROW).where("NOT kept"), ROW).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that with the smallest doc_id (of equal ids the first), of each group of near duplicates.

    The rule is that of the SimHash query: four words, four of 64 bits. It
    catches texts whose shingles are nearly all the same (about 0.95 and more).
    """
    docs = numbered(docs, ROW, "pipeline_near")
    with small_batches(spark):
        gone = simhash_near_dedup(docs, row=ROW, words=4).where("NOT kept")
    return without(docs, gone, ROW).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the mix does: not at all, once, or up to three times, as rows."""
    mixed = mix_sources(numbered(docs, ROW, "pipeline_mixing").select(*COLUMNS, ROW), row=ROW, keep_columns=True)
    rows = mixed.select(*COLUMNS, F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int").alias("_times")).where("_times > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document's whole text: doc_id, ids, n_pieces."""
    with small_batches(spark):
        return stored(encode(docs).withColumn("n_pieces", F.size("ids")), "pipeline_ids")


STAGES = [("quality", quality), ("exact_dedup", exact), ("simhash_dedup", near), ("mixing", mixing), ("sentencepiece", tokens)]

#: No SQL: training and tokenising can't be said in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents, each on what the one before wrote."""
    docs, folder = documents(spark, sf_dir), shared_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
