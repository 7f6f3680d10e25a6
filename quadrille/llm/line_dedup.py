"""Operator 9: repeated windows of consecutive lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import documents, released, slices, stored, with_fields


def line_dedup(docs: DataFrame, *, width: int = 3) -> DataFrame:
    """Removes lines that lie in a window of `width` consecutive lines found earlier in docs.

    Lines are what a newline separates, unchanged. All overlapping windows of
    every document are hashed (128 bits); of equal windows the one in the
    smallest doc_id, then at the smallest position, is the first. The positions
    that the others cover are merged and their lines removed. Windows are
    judged on the input, not on what is left.

    docs needs doc_id and text; other columns are ignored. A null text counts
    as empty, an empty text is one empty line, and texts of fewer lines than a
    window lose nothing. A null doc_id sorts first. Rows equal in doc_id and
    text count as one document, so neither loses lines to the other. Returns
    doc_id, n_lines, n_removed, kept (the remaining lines joined by newlines),
    one row per row of docs.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    lines = F.split("text", "\n")
    starts = F.when(F.size("lines") >= width, F.sequence(F.lit(1), F.size("lines") - (width - 1)))
    windows = F.transform(starts, lambda i: F.unhex(F.md5(F.concat_ws("\n", F.slice("lines", i, width)))))
    place = base.withColumn("lines", lines).select(F.struct("doc_id", "text_key").alias("doc"), F.posexplode(windows).alias("at", "hash"))
    place = stored(place, "line_windows")
    first = place.groupBy("hash").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    first = stored(first, "line_firsts")
    late = place.join(first, "hash").where(F.struct("doc", "at") != F.col("first"))
    late = late.groupBy("doc").agg(F.collect_set("at").alias("late")).select("doc.*", "late")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sizes, gone, kept = [], [], []
                for text, late in zip(part.column("text").to_pylist(), part.column("late")):
                    lines = text.split("\n")
                    keep = np.ones(len(lines), dtype=bool)
                    if late.is_valid:
                        keep[(late.values.to_numpy()[:, None] + np.arange(width)).ravel()] = False
                        text = "\n".join([lines[i] for i in np.flatnonzero(keep)])
                    sizes.append(len(lines))
                    gone.append(len(lines) - int(keep.sum()))
                    kept.append(text)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_removed", "kept"])
        released()

    joined = base.join(late, base["doc_id"].eqNullSafe(late["doc_id"]) & (base["text_key"] == late["text_key"]), "left").select(base["doc_id"], base["text"], "late")
    schema = with_fields(docs.select("doc_id"), "n_lines long, n_removed long, kept string")
    return joined.mapInArrow(cleaned, schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
s AS (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM d WHERE len(l) >= 3),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY l[p], l[p + 1], l[p + 2] ORDER BY doc_id, p) AS n FROM s),
c AS (SELECT doc_id, list_distinct(flatten(list([p, p + 1, p + 2]))) AS gone FROM r WHERE n > 1 GROUP BY doc_id),
k AS (SELECT d.doc_id, d.l, coalesce(len(c.gone), 0) AS n_removed,
  CASE WHEN c.gone IS NULL THEN d.l ELSE list_select(d.l, list_filter(range(1, len(d.l) + 1), lambda i : NOT list_contains(c.gone, i))) END AS kept
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
"""
