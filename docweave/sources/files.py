"""Reading documents, page texts and line-delimited JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.text import py_strip

# Accepted extensions, skipped folders.
DOC_TYPES = {"txt": "text", "md": "markdown", "markdown": "markdown", "pdf": "pdf"}
SKIPPED_FOLDERS = (".git", "node_modules", "__pycache__", ".venv")
#: Page numbers that share a window partition.
PAGE_BUCKET = 512
#: Bucket of pages without a number, before all others.
UNNUMBERED = -(1 << 40)


def doc_type_of(path):
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    mapping = F.create_map(*[F.lit(v) for pair in DOC_TYPES.items() for v in pair])
    return F.try_element_at(mapping, extension)


def decode_text(content):
    """UTF-8 with replacement characters and universal newlines."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def _plain_path(path):
    """Path without scheme and percent signs."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^[a-z0-9]+:/*", "/")


def relative_path(root: str):
    """Path of a listed file below ``root``: unique within a recursive scan."""
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), r"^file:/*", "/")
    return F.replace(_plain_path(F.col("path")), base, F.lit(""))


def in_skipped_folder(relative: str):
    skip = "|".join(f.replace(".", r"\.") for f in SKIPPED_FOLDERS)
    return F.col(relative).rlike(f"(^|/)({skip})/")


def scan_documents(
    spark: SparkSession, root: str, max_bytes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Recursive scan: ``(documents, rejects)``.

    Unsupported extensions and tool folders are left out; page-based files come as a
    page table instead (``assemble_pages``) and are listed among the rejects, like
    files above ``max_bytes``.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    )
    listed = files.select(
        F.col("path").alias("source_path"),
        relative_path(root).alias("document_id"),
        doc_type_of(_plain_path(F.col("path"))).alias("doc_type"),
        "length",
        "content",
    )
    listed = listed.where(F.col("doc_type").isNotNull() & ~in_skipped_folder("document_id"))
    reason = F.when(F.col("doc_type") == "pdf", "page text required")
    if max_bytes is not None:
        reason = F.when(F.col("length") > max_bytes, "file too large").otherwise(reason)
    judged = listed.withColumn("reason", reason)
    documents = judged.where(F.col("reason").isNull()).select(
        "document_id", "source_path", "doc_type",
        F.element_at(F.split("document_id", "/"), -1).alias("name"),
        decode_text(F.col("content")).alias("raw_text"),
    )
    rejects = judged.where(F.col("reason").isNotNull()).select("document_id", "doc_type", "reason")
    return documents, rejects


def place_pages(pages: DataFrame, max_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``pages(document_id, page, text)`` with start offsets, and rejected documents.

    Only a caller's ``max_pages`` rejects documents. Offsets are running sums within buckets
    of ``PAGE_BUCKET`` page numbers, moved by the sums of earlier buckets, so the pages of a
    long document are spread over many window partitions. Pages without a number come first;
    pages of one number are in order of their texts.
    """
    counts = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"))
    rejects = counts.where(F.lit(False) if max_pages is None else F.col("page_count") > max_pages)
    kept = pages if max_pages is None else pages.join(rejects, "document_id", "left_anti")
    kept = kept.withColumn("_bucket", F.coalesce(F.floor(F.col("page") / PAGE_BUCKET), F.lit(UNNUMBERED)))
    size = F.length("text") + 1  # a missing text takes no part in the joined text either
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = kept.groupBy("document_id", "_bucket").agg(F.sum(size).alias("_size"))
    moved = F.sum("_size").over(before.partitionBy("document_id").orderBy("_bucket"))
    shifts = sums.select("document_id", "_bucket", F.coalesce(moved, F.lit(0)).alias("_shift"))
    inner = F.sum(size).over(before.partitionBy("document_id", "_bucket").orderBy("page", "text"))
    placed = (
        kept.withColumn("_inner", F.coalesce(inner, F.lit(0)))
        .join(shifts, ["document_id", "_bucket"])
        .withColumn("page_start", (F.col("_inner") + F.col("_shift")).cast("int"))
        .withColumn("blank", F.length(py_strip("text")) == 0)
    )
    return placed.select(*pages.columns, "page_start", "blank"), rejects


def assemble_pages(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """One document per page set, page texts joined by one newline."""
    placed, _ = place_pages(pages, max_pages)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])
    return placed.groupBy("document_id").agg(
        F.array_join(texts, "\n").alias("raw_text"),
        F.count(F.lit(1)).alias("page_count"),
        F.count_if("blank").alias("blank_pages"),
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line, text)`` of all lines of text files, blank ones included, from 1.

    Files are read in splits. Lines of a split have consecutive running numbers, so a line's
    number is its distance to the first one of its split plus the lines of the splits before;
    only the table of splits is aggregated.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"),
    )
    splits = lines.groupBy("path", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.select("path", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.col("_id") - F.col("_first") + F.col("_before") + 1
    return lines.join(placed, ["path", "_start"]).select("path", number.alias("line"), "text")


CORRUPT = "_corrupt_record"


def _parsed(text: str, schema: T.StructType):
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return F.from_json(text, whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def jsonl_errors(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """``(path, line, text)`` of the lines that do not fit the schema; blank lines are none, but count."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = numbered_lines(spark, path)
    bad = _parsed("text", schema)[CORRUPT].isNotNull()
    return lines.where((F.length(py_strip("text")) > 0) & bad)


def read_jsonl(
    spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True
) -> DataFrame:
    """JSON lines with a declared schema; blank lines are ignored.

    ``strict`` looks at all lines first and raises an error with path and number of the
    first malformed ones; otherwise such a line is kept in ``_corrupt_record`` next to null
    fields.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if strict:
        bad = jsonl_errors(spark, path, schema).orderBy("path", "line").limit(5).collect()
        if bad:
            raise ValueError("; ".join(f"{r.path} line {r.line}: malformed JSON record" for r in bad))
        return spark.read.option("mode", "FAILFAST").schema(schema).json(path)
    schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).json(path)
