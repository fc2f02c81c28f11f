"""Keyed merges, deletes and lookups over the document-graph tables.

Every function returns new DataFrames; ``write_version`` stores them under a new path,
so a table is never overwritten while it is being read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import location_string
from docweave.operators.ordering import stack_counters


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the last by ``order``; equal ones are told apart by their content."""
    content = F.xxhash64(*[F.col(c) for c in rows.columns])
    last = F.max_by(F.struct(*rows.columns), F.struct(*order, content.alias("_content")))
    return rows.groupBy(*keys).agg(last.alias("_row")).select("_row.*")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Idempotent keyed merge: incoming rows replace rows with the same key.

    Of incoming rows with equal keys the last by ``order`` stays.
    """
    kept = existing.join(incoming.select(*keys), list(keys), "left_anti")
    return kept.unionByName(latest(incoming, keys, order), allowMissingColumns=True)


def upsert_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming, ["document_id"])


def check_embeddings(chunks: DataFrame, dim: int) -> DataFrame:
    """Fail the job when a chunk has no vector of the expected size."""
    size = F.size("embedding")
    message = F.concat(F.lit(f"embedding size is not {dim}: "), F.col("chunk_id"))
    good = F.when(F.col("embedding").isNotNull() & (size == dim), F.col("embedding"))
    return chunks.withColumn("embedding", F.coalesce(good, F.raise_error(message).cast("array<float>")))


def upsert_chunks(
    existing: DataFrame, incoming: DataFrame, dim: int | None = None, replace_document: bool = False
) -> DataFrame:
    """Merge chunks by id; ``replace_document`` also drops stale chunks of the document."""
    checked = incoming if dim is None else check_embeddings(incoming, dim)
    if replace_document:
        documents = incoming.select("document_id").distinct()
        existing = existing.join(documents, "document_id", "left_anti")
    return upsert(existing, checked, ["chunk_id"])


def _of_known(rows: DataFrame, column: str, old: DataFrame, new: DataFrame, own: Sequence[str]) -> DataFrame:
    """Rows whose entity is in the old or in the new table; a merge holds the keys of both."""
    key = [*own, column]
    marks = []
    for flag, known in (("_old", old), ("_new", new)):
        ids = known.select(*own, F.col("entity_id").alias(column)).distinct()
        marks.append(ids.withColumn(flag, F.lit(True)))
    marked = rows.join(marks[0], key, "left").join(marks[1], key, "left")
    return marked.where("_old OR _new").select(*rows.columns)


def upsert_graph(
    tables: Mapping[str, DataFrame], entities: DataFrame, mentions: DataFrame, relations: DataFrame, inside: bool = False
) -> dict[str, DataFrame]:
    """Merge extracted facts; mentions and relations need existing ends.

    ``tables`` holds ``chunks``, ``entities``, ``mentions`` and ``relations``. The result
    has the merged tables and a one-row ``counts``. ``inside`` says that every row, old and new,
    carries the ``document_id`` of the chunk and of the entities that it names; then all that
    meets lies in one document, and tables that are dealt by it are not moved (``co_located``).
    """
    own = ["document_id"] if inside else []
    chunked = mentions.groupBy(*own, "entity_id", "chunk_id").agg(F.lit(1).alias("_one"))
    counted = chunked.groupBy(*own, "entity_id").agg(F.count("chunk_id").cast("int").alias("_n"))
    sized = (
        entities.join(counted, [*own, "entity_id"], "left")
        .withColumn("mention_count", F.coalesce("_n", F.lit(0)))
        .drop("_n")
    )
    merged = upsert(tables["entities"], sized, [*own, "entity_id"])
    live = mentions.select(*own, "chunk_id", "entity_id").distinct()
    live = live.join(tables["chunks"].select(*own, "chunk_id"), [*own, "chunk_id"], "left_semi")
    live = _of_known(live, "entity_id", tables["entities"], entities, own)
    ends = _of_known(relations, "source_id", tables["entities"], entities, own)
    ends = _of_known(ends, "target_id", tables["entities"], entities, own)
    counts = stack_counters(
        [
            sized.agg(F.count(F.lit(1)).alias("entities")),
            live.agg(F.count(F.lit(1)).alias("mentions")),
            ends.agg(F.count(F.lit(1)).alias("relations")),
        ]
    )
    return {
        "entities": merged,
        "mentions": upsert(tables["mentions"], live, [*own, "chunk_id", "entity_id"]),
        "relations": upsert(
            tables["relations"], ends, [*own, "source_id", "target_id", "type", "evidence_chunk_id"]
        ),
        "counts": counts,
    }


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; empty when the constraint holds."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def list_documents(docs: DataFrame) -> DataFrame:
    shown = docs.select(
        "document_id",
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("doc_type", F.lit("")).alias("doc_type"),
        F.coalesce("parse_status", F.lit("pending")).alias("parse_status"),
        F.coalesce("index_status", F.lit("pending")).alias("index_status"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
    )
    return shown.orderBy("name", "document_id")


def get_document(docs: DataFrame, document_id: str) -> DataFrame:
    return list_documents(docs.where(F.col("document_id") == document_id))


def lookup_chunks(chunks: DataFrame, docs: DataFrame, ids: DataFrame | Sequence[str], inside: bool = False) -> DataFrame:
    """Source path, readable location and text of the requested chunks.

    ``inside``: ids carry the document of their chunk; tables dealt by it are not moved (``co_located``).
    """
    if isinstance(ids, DataFrame):
        keys = ["document_id", "chunk_id"] if inside else ["chunk_id"]
        wanted = chunks.join(ids.select(*keys), keys, "left_semi")
    else:
        wanted = chunks.where(F.col("chunk_id").isin(list(ids)))
    return wanted.join(docs.select("document_id", "source_path"), "document_id").select(
        "chunk_id",
        F.col("source_path").alias("document_name"),
        location_string().alias("location"),
        "text",
    )


def delete_documents(tables: Mapping[str, DataFrame], ids: DataFrame, inside: bool = False) -> dict[str, DataFrame]:
    """Remove documents with everything that hangs on them.

    Canonical entities go only when a removed resolution pointed at them and no
    other resolution does. ``ids`` has one column ``document_id``. ``inside`` says that every
    row carries the document of the chunk and of the entities that it names (resolutions as
    ``source_document_id``); tables that are dealt by it are not moved then (``co_located``).
    """
    ids = ids.select("document_id").distinct()
    own, source = (["document_id"], ["source_document_id"]) if inside else ([], [])
    gone_chunks = tables["chunks"].join(ids, "document_id", "left_semi").select(*own, "chunk_id")
    gone = tables["entities"].join(ids, "document_id", "left_semi").select(*own, "entity_id")
    resolved = gone.toDF(*source, "entity_id")
    resolutions = tables["resolutions"]
    affected = resolutions.join(resolved, [*source, "entity_id"], "left_semi").select("canonical_id").distinct()
    left = resolutions.join(resolved, [*source, "entity_id"], "left_anti")
    orphans = affected.join(left.select("canonical_id").distinct(), "canonical_id", "left_anti")
    relations = tables["relations"]
    for end in ("source_id", "target_id"):
        relations = relations.join(gone.withColumnRenamed("entity_id", end), [*own, end], "left_anti")
    return {
        **tables,
        "documents": tables["documents"].join(ids, "document_id", "left_anti"),
        "chunks": tables["chunks"].join(ids, "document_id", "left_anti"),
        "entities": tables["entities"].join(ids, "document_id", "left_anti"),
        "mentions": tables["mentions"]
        .join(gone_chunks, [*own, "chunk_id"], "left_anti")
        .join(gone, [*own, "entity_id"], "left_anti"),
        "relations": relations,
        "resolutions": left,
        "canonicals": tables["canonicals"].join(orphans, "canonical_id", "left_anti"),
    }


def purge_prefix(tables: Mapping[str, DataFrame], prefix: str) -> dict[str, DataFrame]:
    """Drop rows whose document or entity id starts with ``prefix``."""

    def keep(df: DataFrame) -> DataFrame:
        for column in ("document_id", "entity_id", "source_id", "target_id", "chunk_id"):
            if column in df.columns:
                df = df.where(~F.coalesce(F.col(column), F.lit("")).startswith(prefix))
        return df

    return {name: keep(df) for name, df in tables.items()}


def write_version(df: DataFrame, base: str, version: int, partition_by: Sequence[str] = ()) -> str:
    """Write a table version to its own folder and return the path."""
    path = f"{base.rstrip('/')}/version={version}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def read_version(spark: SparkSession, base: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/version={version}")

