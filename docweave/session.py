"""Session helpers: sensible defaults, lineage cutting and size checks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "docweave", cores: str | int = "*") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    partitions = os.cpu_count() if str(cores) == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Custom stream processors keep their state here.
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only local runs get their own.

    A folder of one machine is no place for what executors share, so a cluster without
    the setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not shared and not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))


#: Shuffle files of a job go when it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Unlike a checkpoint the stored table keeps column pruning and filter pushdown. The
    table stands for the lineage, so the shuffle files of the writing job are removed.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir().rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.parquet(path)


def store_bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """``store`` with the rows dealt by ``key``, so that joins and sums on it need no shuffle.

    One file a bucket, as many buckets as the session has shuffle partitions unless a number is
    given. A join on more columns than ``key`` also stays in place (``co_located``).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir().rstrip("/")
    unique = f"{name}_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        dealt = df.repartition(buckets, key)
        writer = dealt.write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd")
        writer.option("path", f"{base}/tables/{unique}").saveAsTable(unique)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.table(unique)


#: Bytes of a stored table that every executor may hold next to its tasks.
FEW_BYTES = 128 << 20


def few(rows: DataFrame) -> DataFrame:
    """``rows``, a stored table, sent to all tasks if it is small; so what it meets is not moved.

    Its size is counted with the content of its strings; a larger table is left to the optimizer.
    """
    strings = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in rows.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    width = sum(strings, F.lit(32 + 16 * len(rows.columns)))
    return F.broadcast(rows) if (rows.agg(F.sum(width)).first()[0] or 0) <= FEW_BYTES else rows


@contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """Jobs inside may join on several columns where both sides are dealt by one of them."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def store_inside(spark: SparkSession, rows: Callable[[], DataFrame], name: str) -> DataFrame:
    """``store`` of rows that are planned and written with ``co_located``."""
    with co_located(spark):
        return store(rows(), name)


class StoredTables(Mapping):
    """Tables by name, each built when it is read first, with ``co_located``, and stored."""

    def __init__(self, spark: SparkSession, builders: Mapping[str, Callable[[], DataFrame]]):
        self.spark, self.builders, self.built = spark, dict(builders), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.built:
            self.built[name] = store_inside(self.spark, self.builders[name], name)
        return self.built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.builders)

    def __len__(self) -> int:
        return len(self.builders)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Give per-row work every core when the input came in fewer splits than cores.

    Large inputs have enough splits and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
