"""Keyed tables in hash buckets, with versions that a manifest publishes.

Rows lie in the bucket of a hash of their key, a folder each. A merge reads and writes the
buckets that its rows fall into, and no others; then a new manifest names the folder of every
bucket. Readers follow the newest manifest, so what a failed job has written is never seen, and
of two writers of one version the second fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources.tables import upsert

MANIFEST = "bucket int, folder string, buckets int, keys string, ddl string"


@dataclass(frozen=True)
class Version:
    """A published state: the folder of each bucket that has one."""

    number: int
    folders: dict[int, str]
    buckets: int
    keys: tuple[str, ...]
    ddl: str


class BucketTable:
    """A table below ``base``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, base: str, keys: Sequence[str], buckets: int = 256) -> BucketTable:
        """Write the first version; ``buckets`` holds for the life of the table."""
        table = cls(rows.sparkSession, base)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        empty = Version(-1, {}, buckets, tuple(keys), ddl)
        table.publish(empty, table.write(rows, empty))
        return table

    def versions(self) -> list[int]:
        return [r.version for r in self.spark.read.parquet(f"{self.base}/manifest").select("version").distinct().orderBy("version").collect()]

    def version(self, number: int | None = None) -> Version:
        """A published version, the newest unless a number is given; as many rows as buckets."""
        number = self.versions()[-1] if number is None else number
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.base}/manifest/version={number}").collect()
        folders = {r.bucket: r.folder for r in rows if r.folder is not None}
        return Version(number, folders, rows[0].buckets, tuple(rows[0].keys.split("\n")), rows[0].ddl)

    def read(self, number: int | None = None) -> DataFrame:
        return self.rows_of(self.version(number))

    def rows_of(self, version: Version, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of some buckets; the folders of others are not opened."""
        folders = [f for b, f in sorted(version.folders.items()) if buckets is None or b in set(buckets)]
        if not folders:
            return self.spark.createDataFrame([], version.ddl)
        return self.spark.read.schema(version.ddl).parquet(*folders)

    def bucket(self, version: Version) -> Column:
        return F.pmod(F.xxhash64(*version.keys), F.lit(version.buckets)).cast("int")

    def write(self, rows: DataFrame, version: Version) -> str:
        """Write rows into new bucket folders that no manifest names yet."""
        target = f"{self.base}/data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self.bucket(version))
        dealt.repartition(version.buckets, "_bucket").write.partitionBy("_bucket").parquet(target)
        return target

    def publish(self, old: Version, target: str, touched: Sequence[int] | None = None) -> Version:
        """Name the new folders in the next manifest; buckets that were not touched keep theirs."""
        new = {}
        if touched is None or touched:
            # Which buckets got rows, from the names of the folders alone.
            found = self.spark.read.schema("_bucket int").parquet(target).select("_bucket").distinct().collect()
            new = {r._bucket: f"{target}/_bucket={r._bucket}" for r in found}
        kept = {b: f for b, f in old.folders.items() if touched is not None and b not in set(touched)}
        folders = {**kept, **new}
        shared = (old.buckets, "\n".join(old.keys), old.ddl)
        rows = [(b, f, *shared) for b, f in sorted(folders.items())] or [(None, None, *shared)]
        path = f"{self.base}/manifest/version={old.number + 1}"
        # One file, which the commit of the job moves into place at once.
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(path)
        return Version(old.number + 1, folders, old.buckets, old.keys, old.ddl)

    def merge(self, incoming: DataFrame, order: Sequence[str] = ()) -> Version:
        """Rows of ``incoming`` replace those with the same key; of equal keys the last by ``order`` stays.

        ``incoming`` has the table's columns, and may have further ones to order by. Keys hold
        no nulls.
        """
        old = self.version()
        # At most as many numbers as the table has buckets.
        touched = sorted(r[0] for r in incoming.select(self.bucket(old)).distinct().collect())
        if not touched:
            return old
        before = self.rows_of(old, touched)
        merged = upsert(before, incoming, old.keys, order).select(*before.columns)
        return self.publish(old, self.write(merged, old), touched)
