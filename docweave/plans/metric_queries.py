"""Queries over quality measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import metrics as Q
from docweave.plans import derived as D
from docweave.plans.extraction_queries import CANDIDATE_SQL, Candidates


def _reviewed(spark, sf_dir):
    """Texts as candidates and their labels as human review; unlabelled texts are unreviewed."""
    docs, labels = D.table(spark, sf_dir, "documents"), D.table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("sample_id"),
        F.format_string("d%08d", "doc_id").alias("entity_id"),
        (F.col("n_chars") >= 500).alias("accepted"),
        (F.col("lang") == "en").alias("matched_gold"),
        (F.col("quality") == 1).alias("reviewed_correct"),
        (F.col("toxic") == 0).alias("semantically_correct"),
        F.col("text").contains(".").alias("evidence_present"),
    )


def review_precision(spark, sf_dir):
    c = _reviewed(spark, sf_dir)
    parts = [
        Q.entity_precision(c).withColumn("metric", F.lit("entity precision")),
        Q.relation_precision(c).withColumn("metric", F.lit("relation precision")),
        Q.provenance_completeness(c, c).withColumn("metric", F.lit("provenance")),
        Q.review_coverage(
            c, "reviewed_correct", c.groupBy("sample_id").agg(F.count(F.lit(1)).alias("population")), "population"
        ).withColumn("metric", F.lit("review coverage")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("rate", F.round("rate", 6))


def review_candidates(spark, sf_dir):
    return Q.review_candidates(_reviewed(spark, sf_dir), "entity_id", "reviewed_correct")


def fixture_problems(spark, sf_dir):
    """Every text as a fixture with one candidate; only English texts declare a population."""
    c = _reviewed(spark, sf_dir)
    relation = "array<struct<relation_id:string,source_entity_id:string,target_entity_id:string,accepted:boolean>>"
    fixtures = c.select(
        F.col("entity_id").alias("sample_id"),
        F.array(F.struct("entity_id", "accepted")).alias("candidate_entities"),
        F.array().cast(relation).alias("candidate_relations"),
        F.struct(
            F.col("matched_gold").cast("int").alias("accepted_entity_population"),
            F.lit(0).alias("accepted_relation_population"),
        ).alias("review_scope"),
    )
    return Q.check_fixtures(fixtures)


def _words(spark, sf_dir):
    docs = D.text_documents(spark, sf_dir)
    return docs.select("document_id", F.explode(F.split("raw_text", r"\s+")).alias("name"))


def _recall(spark, sf_dir):
    """Words with a capital are gold, words with an e are extracted; German texts failed."""
    words = _words(spark, sf_dir)
    documents = D.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), (F.col("lang") == "de").alias("failed")
    )
    gold = words.where(F.col("name").rlike("^[A-Z]"))
    return Q.entity_recall(documents, gold, words.where(F.col("name").contains("e")))


def keyword_recall(spark, sf_dir):
    return _recall(spark, sf_dir)


def recall_summary(spark, sf_dir):
    found = Q.recall_summary(_recall(spark, sf_dir))
    return found.select(F.round("pooled", 6).alias("pooled"), F.round("macro", 6).alias("macro"))


def unmatched_extracted(spark, sf_dir):
    words = _words(spark, sf_dir)
    left = Q.unmatched_extracted(words.where(F.col("name").contains("e")), words.where(F.col("name").rlike("^[A-Z]")))
    return left.groupBy("document_id").agg(F.count(F.lit(1)).alias("unmatched"))


def citation_hit(spark, sf_dir):
    """Chat replies against two keywords; every second turn has a citation."""
    rows = D.table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text",
        F.array(F.lit("THE"), F.lit("ment")).alias("keywords"), (F.col("turn") % 2).alias("citation_count"),
    )
    return Q.answer_scores(rows).select("query_id", "answer_accuracy", "citation_hit_rate")


def usable_relations(spark, sf_dir):
    """Merged over raw relations per document."""
    c = Candidates(spark, sf_dir)
    raw = c.relations.groupBy("document_id").agg(F.count(F.lit(1)).alias("raw"))
    merged = c.merged_relations().groupBy("document_id").agg(F.count(F.lit(1)).alias("merged"))
    counts = c.tables["documents"].select("document_id").join(raw.join(merged, "document_id", "left"), "document_id", "left").na.fill(0)
    return Q.relation_usable_rate(counts).select("document_id", "merged", "raw", F.round("usable_rate", 6).alias("usable_rate"))


def parse_success(spark, sf_dir):
    docs = D.text_documents(spark, sf_dir).select("document_id", (F.length(F.trim("raw_text")) > 0).alias("ok"))
    return Q.parse_success_rate(docs)


_REVIEWED = """
WITH c AS (
  SELECT source AS sample_id, 'd' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS entity_id, n_chars >= 500 AS accepted, lang = 'en' AS matched,
         quality = 1 AS good, toxic = 0 AS clean, contains(text, '.') AS evidence
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)
"""
_WORDS = r"""
WITH words AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, name, lower(name) AS key FROM (
    SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS name FROM documents)
), gold AS (SELECT DISTINCT document_id, key FROM words WHERE regexp_matches(name, '^[A-Z]')),
found AS (SELECT DISTINCT document_id, key FROM words WHERE contains(name, 'e')),
counts AS (
  SELECT document_id, count(*) AS gold_count, count(*) FILTER (f.key IS NOT NULL) AS hits FROM gold LEFT JOIN found f USING (document_id, key) GROUP BY 1
), per AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(CASE WHEN lang = 'de' THEN 0 ELSE coalesce(hits, 0) END AS BIGINT) AS hit_count, coalesce(gold_count, 0) AS gold_count
  FROM documents LEFT JOIN counts ON document_id = CAST(doc_id AS VARCHAR)
)
"""

QUERIES = {
    "review_precision": (
        review_precision,
        _REVIEWED
        + """SELECT metric, numerator, denominator, round(numerator / nullif(denominator, 0), 6) AS rate FROM (
        SELECT 'entity precision' AS metric, count(*) FILTER (accepted AND good) AS numerator, count(*) FILTER (accepted AND good IS NOT NULL) AS denominator FROM c
        UNION ALL SELECT 'relation precision', count(*) FILTER (accepted AND clean), count(*) FILTER (accepted AND clean IS NOT NULL) FROM c
        UNION ALL SELECT 'provenance', 2 * count(*) FILTER (accepted AND evidence), 2 * count(*) FILTER (accepted) FROM c
        UNION ALL SELECT 'review coverage', count(*) FILTER (accepted AND good IS NOT NULL), count(*) FROM c)""",
    ),
    "review_candidates": (
        review_candidates,
        _REVIEWED + "SELECT entity_id FROM c WHERE accepted AND NOT matched AND good IS NULL",
    ),
    "fixture_problems": (
        fixture_problems,
        _REVIEWED
        + """SELECT entity_id AS sample_id, 'declared entity population is too small' AS problem, '1' AS item
        FROM c WHERE accepted AND NOT matched""",
    ),
    "keyword_recall": (keyword_recall, _WORDS + "SELECT * FROM per"),
    "recall_summary": (
        recall_summary,
        _WORDS + "SELECT round(sum(hit_count) / sum(gold_count), 6) AS pooled, round(avg(CASE WHEN gold_count = 0 THEN 0 ELSE hit_count / gold_count END), 6) AS macro FROM per",
    ),
    "unmatched_extracted": (
        unmatched_extracted,
        _WORDS
        + """SELECT document_id, count(*) AS unmatched FROM words w WHERE contains(name, 'e')
        AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.document_id = w.document_id AND g.key = w.key) GROUP BY document_id""",
    ),
    "citation_hit": (
        citation_hit,
        """SELECT conv_id || '-' || turn AS query_id, a AS answer_accuracy, CASE WHEN turn % 2 > 0 THEN a ELSE 0.0::DOUBLE END AS citation_hit_rate FROM (
        SELECT *, (CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'ment') AS INTEGER)) / 2 AS a FROM conversations)""",
    ),
    "usable_relations": (
        usable_relations,
        CANDIDATE_SQL
        + """SELECT document_id, coalesce(m, 0) AS merged, coalesce(r, 0) AS raw, CASE WHEN coalesce(r, 0) = 0 THEN 1.0::DOUBLE ELSE round(coalesce(m, 0) / r, 6) END AS usable_rate
        FROM documents_g LEFT JOIN (SELECT document_id, count(*) AS r FROM lines GROUP BY 1) USING (document_id)
        LEFT JOIN (SELECT document_id, count(*) AS m FROM merged_rel GROUP BY 1) USING (document_id)""",
    ),
    "parse_success": (parse_success, "SELECT avg(CASE WHEN trim(text) <> '' THEN 1.0 ELSE 0.0 END) AS parse_success_rate FROM documents"),
}
