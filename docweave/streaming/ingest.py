"""Incremental ingest: arriving files become documents and chunks exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.operators.chunking import chunk_documents
from docweave.sources.files import decode_text, doc_type_of, in_skipped_folder, relative_path

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def document_stream(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """Text and Markdown files below ``root`` as they arrive."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(_FILES)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(root)
    )
    kind = doc_type_of(F.col("path"))
    listed = files.where(kind.isin("text", "markdown")).select(
        relative_path(root).alias("document_id"),
        F.col("path").alias("source_path"),
        kind.alias("doc_type"),
        decode_text(F.col("content")).alias("raw_text"),
    )
    return listed.where(~in_skipped_folder("document_id"))


def ingest_stream(
    documents: DataFrame,
    sink: Callable[[DataFrame, DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Chunk every micro-batch and hand ``(documents, chunks, batch_id)`` to ``sink``.

    The stream checkpoint gives each file to one batch; ``sink`` must be idempotent in
    ``batch_id`` (``batch_writer`` is), which together is exactly once.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        sink(batch.drop("raw_text"), chunk_documents(batch), batch_id)

    return (
        documents.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def batch_writer(base: str) -> Callable[[DataFrame, DataFrame, int], None]:
    """A sink that keeps one folder per batch, so a repeated batch replaces itself."""

    def write(documents: DataFrame, chunks: DataFrame, batch_id: int) -> None:
        documents.write.mode("overwrite").parquet(f"{base}/documents/batch={batch_id}")
        chunks.write.mode("overwrite").parquet(f"{base}/chunks/batch={batch_id}")

    return write


def latest_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Chunks of the newest batch of each document: a later file version replaces an earlier one."""
    chunks = spark.read.parquet(f"{base}/chunks")
    documents = spark.read.parquet(f"{base}/documents")
    newest = documents.groupBy("document_id").agg(F.max("batch").alias("batch"))
    return chunks.join(newest, ["document_id", "batch"], "left_semi")
