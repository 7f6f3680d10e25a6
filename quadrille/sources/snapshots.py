"""States of several tables that change by whole commits.

Rows of a table are dealt by a hash of its key into buckets, each a folder of
Parquet files that is written once. A commit is one small JSON file that names
the folder of every bucket of every table, and for every feed the last batch
that it has. A commit takes over the buckets that it doesn't change. What a
killed writer leaves behind is named by no commit and so never read. One writer
commits at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadrille.sources.storage import written

_ROWS = "kind string, name string, bucket int, value string"
BUCKET = "bucket_of_key"
#: Bytes of files from which on rows are no longer moved for the sake of fewer files.
LARGE = 16 << 20


@dataclass(frozen=True)
class Commit:
    """A commit's number, its folders by table and bucket, the tables' schemas as JSON, and the last batch of each feed."""

    number: int = -1
    folders: Mapping[str, Mapping[int, str]] = field(default_factory=dict)
    schemas: Mapping[str, str] = field(default_factory=dict)
    batches: Mapping[str, int] = field(default_factory=dict)


class Snapshots:
    """The tables below path. keys has the key expressions of each table; equal keys share a bucket."""

    def __init__(self, spark: SparkSession, path: str, keys: Mapping[str, Iterable[str]], buckets: int = 16) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), {k: list(v) for k, v in keys.items()}, buckets

    def _bucket(self, *keys: Column) -> Column:
        return F.pmod(F.xxhash64(*[k.cast("string") for k in keys]), F.lit(self.buckets)).cast("int")

    def bucket(self, table: str) -> Column:
        return self._bucket(*[F.expr(k) for k in self.keys[table]])

    def last(self) -> Commit:
        """The commit with the largest number; one whose file isn't there whole is none."""
        try:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.json").load(f"{self.path}/_commits").select("path").collect()
        except AnalysisException:  # nothing has been committed
            return Commit()
        numbers = [int(f["path"].rsplit("number=", 1)[1].split("/", 1)[0]) for f in files]
        return self.at(max(numbers)) if numbers else Commit()

    def at(self, number: int) -> Commit:
        folders, schemas, batches = {k: {} for k in self.keys}, {}, {}
        for r in self.spark.read.schema(_ROWS).json(f"{self.path}/_commits/number={number}").collect():  # tables by buckets
            if r["kind"] == "bucket":
                folders[r["name"]][r["bucket"]] = r["value"]
            elif r["kind"] == "schema":
                schemas[r["name"]] = r["value"]
            else:
                batches[r["name"]] = int(r["value"])
        return Commit(number, folders, schemas, batches)

    def read(self, table: str, commit: Commit | None = None, only: Iterable[int] | None = None, without: Iterable[int] = ()) -> DataFrame:
        """A table as of a commit (the last one), or some of its buckets."""
        commit = commit or self.last()
        schema = StructType.fromJson(json.loads(commit.schemas[table]))
        skip, keep = set(without), None if only is None else set(only)
        paths = [p for b, p in sorted(commit.folders[table].items()) if b not in skip and (keep is None or b in keep)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, table: str, keys: DataFrame) -> list[int]:
        """The buckets of keys, whose columns are those of the table's key in order."""
        return sorted(r[0] for r in keys.select(self._bucket(*[F.col(f"`{c}`") for c in keys.columns])).distinct().collect())

    def _digests(self, df: DataFrame, table: str) -> dict[int, tuple]:
        h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        rows = df.groupBy(self.bucket(table).alias("b")).agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h))
        return {r[0]: tuple(r[1:]) for r in rows.collect()}  # a row a bucket

    def changed(self, table: str, new: DataFrame, commit: Commit) -> list[int]:
        """Buckets whose rows aren't those of the commit: by numbers and hashes of rows, so that no row is moved."""
        if not commit.schemas.get(table):
            return list(range(self.buckets))
        old = self._digests(self.read(table, commit).select(*new.columns), table)
        now = self._digests(new, table)
        return sorted(b for b in old.keys() | now.keys() if old.get(b) != now.get(b))

    def _large(self, table: str, commit: Commit, only: Iterable[int]) -> bool:
        """Whether a table that is written for the first time, or buckets of it by what they were, are too large to be moved."""
        if table not in commit.schemas:
            return True
        paths = [p for b, p in commit.folders[table].items() if b in set(only)]
        return bool(paths) and (self.spark.read.format("binaryFile").load(paths).agg(F.sum("length")).first()[0] or 0) >= LARGE

    def _write(self, df: DataFrame, table: str, number: int, only: Iterable[int], large: bool) -> dict[int, str]:
        """Writes the buckets of df that are in only; where each one lies. Of large ones every task writes its rows to all buckets, so that no row is moved."""
        where = f"{self.path}/{table}/commit={number}-{uuid.uuid4().hex}"
        dealt = df.withColumn(BUCKET, self.bucket(table)).where(F.col(BUCKET).isin(list(only))) if len(set(only)) < self.buckets else df.withColumn(BUCKET, self.bucket(table))
        written(dealt if large else dealt.hint("rebalance", BUCKET), where, BUCKET)
        try:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(where).select("path").collect()
        except AnalysisException:
            files = []
        found = {f["path"].rsplit(f"{BUCKET}=", 1)[1].split("/", 1)[0] for f in files if f"{BUCKET}=" in f["path"]}
        return {int(b): f"{where}/{BUCKET}={b}" for b in found}

    def done(self, feed: str, batch: int, commit: Commit | None = None) -> bool:
        """Whether this batch of a feed, or a later one, has been committed."""
        return (commit or self.last()).batches.get(feed, -1) >= batch

    def commit(self, new: Mapping[str, DataFrame], *, parts: Mapping[str, Iterable[int]] | None = None, feed: str | None = None, batch: int | None = None, base: Commit | None = None) -> Commit:
        """Commits tables as the successors of base (the last commit).

        Of the tables in parts, new has all rows of the given buckets and no
        others; the other tables in new are whole, and their changed buckets are
        found. A batch of a feed that has been committed changes nothing. Data
        is written first; the commit's file makes it visible, all at once.
        """
        base = base or self.last()
        if feed is not None and self.done(feed, batch, base):
            return base
        number, parts = base.number + 1, {k: sorted(set(v)) for k, v in (parts or {}).items()}
        folders = {k: dict(base.folders.get(k, {})) for k in self.keys}
        schemas = dict(base.schemas)
        for table, df in new.items():
            only = parts[table] if table in parts else self.changed(table, df, base)
            if table not in schemas:
                schemas[table] = df.schema.json().replace(":false", ":true")  # files hold nulls wherever they like
            if not only:
                continue
            old = StructType.fromJson(json.loads(schemas[table]))
            written = self._write(df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in old.fields]), table, number, only, self._large(table, base, only))
            for b in only:
                folders[table].pop(b, None)
            folders[table] |= written
        batches = dict(base.batches) | ({feed: batch} if feed is not None else {})
        self._publish(Commit(number, folders, schemas, batches))
        return self.at(number)

    def _publish(self, commit: Commit) -> None:
        rows = [("bucket", t, b, p) for t, of in commit.folders.items() for b, p in sorted(of.items())]
        rows += [("schema", t, None, s) for t, s in commit.schemas.items()] + [("batch", f, None, str(b)) for f, b in commit.batches.items()]
        self.spark.createDataFrame(rows, _ROWS).coalesce(1).write.mode("overwrite").json(f"{self.path}/_commits/number={commit.number}")
