"""Queries over texts: blocks, chunks, pages, sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import chunking as C
from docweave.operators import metrics as Q
from docweave.plans import derived as D
from docweave.sources import files as S


def chunk_split(spark, sf_dir):
    """Every text cut into overlapping windows."""
    docs = D.text_documents(spark, sf_dir)
    blocks = C.split_blocks(docs)
    return C.split_oversized(blocks).select("document_id", "block_pos", "char_start", "char_end", F.md5("text").alias("text_md5"))


def chunk_documents(spark, sf_dir):
    chunks = C.chunk_documents(D.text_documents(spark, sf_dir))
    return chunks.select("chunk_id", "document_id", "chunk_index", "char_start", "char_end", "char_count", F.md5("text").alias("text_md5"))


def chunk_pack(spark, sf_dir):
    """The same chunks through the block table: split, pack, attach text."""
    docs = D.text_documents(spark, sf_dir)
    packed = C.pack_chunks(C.split_oversized(C.split_blocks(docs)))
    chunks = C.with_chunk_ids(C.with_chunk_text(packed, docs))
    return chunks.select("chunk_id", "document_id", "chunk_index", "char_start", "char_end", "char_count", F.md5("text").alias("text_md5"))


def offset_violations(spark, sf_dir):
    parts = []
    for name, docs in (("text", D.text_documents(spark, sf_dir)), ("markdown", D.markdown_documents(spark, sf_dir))):
        bad = C.check_offsets(C.chunk_documents(docs), docs)
        parts.append(bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("doc_type"), "violations"))
    return parts[0].unionByName(parts[1])


def block_kinds(spark, sf_dir):
    blocks = C.split_blocks(D.markdown_documents(spark, sf_dir))
    return blocks.groupBy(
        "content_kind", "language", "extraction_policy", F.array_join("heading_path", "/").alias("heading_path")
    ).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars"))


def markdown_chunks(spark, sf_dir):
    chunks = C.chunk_documents(D.markdown_documents(spark, sf_dir))
    return chunks.groupBy("content_kind", "extraction_policy").agg(F.count(F.lit(1)).alias("chunks"), F.sum("char_count").alias("chars"))


def _unnumbered(spark, sf_dir):
    """Every eighth page has lost its number."""
    return _pages(spark, sf_dir).withColumn("page", F.when(F.col("page") % 8 != 5, F.col("page")))


def page_offsets(spark, sf_dir):
    placed, _ = S.place_pages(_unnumbered(spark, sf_dir))
    return placed.select("document_id", "page", "page_start", "blank")


def _pages(spark, sf_dir):
    return D.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("page"), "text"
    )


def assembled_pages(spark, sf_dir):
    docs = S.assemble_pages(_unnumbered(spark, sf_dir))
    return docs.select("document_id", F.md5("raw_text").alias("text_md5"), "page_count", "blank_pages")


def page_blocks(spark, sf_dir):
    placed, _ = S.place_pages(_pages(spark, sf_dir))
    blocks = C.split_page_blocks(placed)
    return blocks.select("document_id", "page", "local_pos", "char_start", "char_end", F.md5("text").alias("text_md5"))


def contextual_texts(spark, sf_dir):
    docs = D.text_documents(spark, sf_dir)
    texts = C.contextual_text(C.chunk_documents(docs), docs)
    return texts.select("chunk_id", F.md5("context_text").alias("text_md5"))


def extraction_progress(spark, sf_dir):
    """Markdown chunks that need a model; those without a config or log block are done."""
    chunks = C.chunk_documents(D.markdown_documents(spark, sf_dir))
    return C.extraction_progress(chunks, chunks.where("content_kind = 'prose'"))


def assertion_rate(spark, sf_dir):
    """Assertion sentences per text and the share without a citation marker."""
    docs = D.text_documents(spark, sf_dir).select(F.col("document_id").alias("query_id"), F.col("raw_text").alias("text"))
    return Q.hallucination_rates(docs)


PIECES_SQL = r"""
WITH RECURSIVE blocks AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t,
         length(text) - length(regexp_replace(text, '^\s+', '')) AS base
  FROM documents
), pieces AS (
  SELECT document_id, t, base, 0 AS pos, CASE WHEN length(t) <= 800 THEN length(t) ELSE
    1 + CASE WHEN contains(substr(t, 2, 799), '。') THEN 799 - instr(reverse(substr(t, 2, 799)), '。') + 1
             WHEN contains(substr(t, 2, 799), '.') THEN 799 - instr(reverse(substr(t, 2, 799)), '.') + 1
             WHEN contains(substr(t, 2, 799), chr(10)) THEN 799 - instr(reverse(substr(t, 2, 799)), chr(10)) + 1
             WHEN contains(substr(t, 2, 799), ' ') THEN 799 - instr(reverse(substr(t, 2, 799)), ' ') + 1
             ELSE 799 END END AS cut, 0 AS nth
  FROM blocks WHERE t <> ''
  UNION ALL
  SELECT document_id, t, base, p, CASE WHEN length(t) - p <= 800 THEN length(t) ELSE
    p + 1 + CASE WHEN contains(w, '。') THEN 799 - instr(reverse(w), '。') + 1
             WHEN contains(w, '.') THEN 799 - instr(reverse(w), '.') + 1
             WHEN contains(w, chr(10)) THEN 799 - instr(reverse(w), chr(10)) + 1
             WHEN contains(w, ' ') THEN 799 - instr(reverse(w), ' ') + 1
             ELSE 799 END END, nth + 1
  FROM (SELECT *, greatest(cut - 150, pos + 1) AS p, substr(t, greatest(cut - 150, pos + 1) + 2, 799) AS w FROM pieces WHERE cut < length(t))
)
"""
PACKED_SQL = PIECES_SQL + """
, packed AS (
  SELECT document_id, nth, pos AS first, cut AS last, cut - pos AS total, 0 AS chunk_index, base FROM pieces WHERE nth = 0
  UNION ALL
  SELECT p.document_id, p.nth, CASE WHEN k.total + p.cut - p.pos <= 800 THEN k.first ELSE p.pos END, p.cut,
         CASE WHEN k.total + p.cut - p.pos <= 800 THEN k.total + p.cut - p.pos ELSE p.cut - p.pos END,
         CASE WHEN k.total + p.cut - p.pos <= 800 THEN k.chunk_index ELSE k.chunk_index + 1 END, k.base
  FROM packed k JOIN pieces p ON p.document_id = k.document_id AND p.nth = k.nth + 1
), chunks AS (
  SELECT document_id, chunk_index, min(first) AS first, max(last) AS last, any_value(base) AS base FROM packed GROUP BY ALL
), shown AS (
  SELECT document_id || '#' || chunk_index AS chunk_id, c.document_id, chunk_index, CAST(first + c.base AS INTEGER) AS char_start,
         CAST(last + c.base AS INTEGER) AS char_end, CAST(last - first AS INTEGER) AS char_count,
         substr(t, first + 1, last - first) AS text, source
  FROM chunks c JOIN blocks b USING (document_id)
)
"""
_CHUNKS = PACKED_SQL + "SELECT chunk_id, document_id, chunk_index, char_start, char_end, char_count, md5(text) AS text_md5 FROM shown"
_PAGES_SQL = """
WITH pages_t AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn AS INTEGER) AS page, text FROM conversations),
placed AS (
  SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY page NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS page_start,
         regexp_replace(text, '\\s', '', 'g') = '' AS blank FROM pages_t
)
"""
_UNNUMBERED_SQL = _PAGES_SQL.replace("CAST(turn AS INTEGER) AS page", "CASE WHEN turn % 8 <> 5 THEN CAST(turn AS INTEGER) END AS page")

QUERIES = {
    "chunk_split": (
        chunk_split,
        PIECES_SQL
        + """SELECT document_id, 0 AS block_pos, CAST(pos + base AS INTEGER) AS char_start, CAST(cut + base AS INTEGER) AS char_end,
        md5(substr(t, pos + 1, cut - pos)) AS text_md5 FROM pieces""",
    ),
    "chunk_documents": (chunk_documents, _CHUNKS),
    "chunk_pack": (chunk_pack, _CHUNKS),
    "offset_violations": (offset_violations, "SELECT 'text' AS doc_type, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'markdown', 0"),
    "block_kinds": (
        block_kinds,
        r"""SELECT kind AS content_kind, lang AS language, policy AS extraction_policy, path AS heading_path,
        count(*) AS blocks, CAST(sum(n) AS BIGINT) AS chars FROM (
          SELECT unnest([
            {kind: 'prose', lang: NULL, policy: 'normal', path: '', n: 2 + length(role)},
            {kind: 'prose', lang: NULL, policy: 'normal', path: role, n: length(regexp_replace(text, '^\s+|\s+$', '', 'g'))},
            {kind: 'config', lang: 'json', policy: 'skip', path: role, n: 23},
            {kind: 'list', lang: NULL, policy: 'normal', path: role, n: 11},
            {kind: 'table', lang: NULL, policy: 'normal', path: role, n: 29}], recursive := true)
          FROM conversations) GROUP BY ALL""",
    ),
    "markdown_chunks": (markdown_chunks, None),
    "page_offsets": (page_offsets, _UNNUMBERED_SQL + "SELECT document_id, page, page_start, blank FROM placed"),
    "assembled_pages": (
        assembled_pages,
        _UNNUMBERED_SQL
        + "SELECT document_id, md5(string_agg(text, chr(10) ORDER BY page NULLS FIRST, text)) AS text_md5, count(*) AS page_count, count(*) FILTER (blank) AS blank_pages FROM placed GROUP BY document_id",
    ),
    "page_blocks": (
        page_blocks,
        _PAGES_SQL
        + r"""SELECT document_id, page, 0 AS local_pos,
        CAST(page_start + length(text) - length(regexp_replace(text, '^\s+', '')) AS INTEGER) AS char_start,
        CAST(page_start + length(regexp_replace(text, '\s+$', '')) AS INTEGER) AS char_end,
        md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text_md5 FROM placed WHERE NOT blank""",
    ),
    "contextual_texts": (
        contextual_texts,
        PACKED_SQL + "SELECT chunk_id, md5(concat_ws(chr(10) || chr(10), nullif(trim(source), ''), text)) AS text_md5 FROM shown",
    ),
    "extraction_progress": (extraction_progress, None),
    "assertion_rate": (assertion_rate, None),
}
