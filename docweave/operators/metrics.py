"""Quality measures as aggregations over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.markdown import assertions
from docweave.functions.text import py_strip
from docweave.operators.answers import NO_EVIDENCE_ANSWER
from docweave.operators.graph import component_labels
from docweave.operators.ordering import stack_counters

REFUSAL = NO_EVIDENCE_ANSWER.rstrip("。")


def ratio_metric(numerator: Column, denominator: Column) -> list[Column]:
    """numerator, denominator and rate; the rate is null without a denominator."""
    return [
        numerator.cast("bigint").alias("numerator"),
        denominator.cast("bigint").alias("denominator"),
        F.try_divide(numerator.cast("double"), denominator.cast("double")).alias("rate"),
    ]


def _label_key(name: Column | str) -> Column:
    return py_strip(F.lower(F.col(name) if isinstance(name, str) else name))


# --- reviewed samples ---------------------------------------------------------------------


def candidates_of(quality: DataFrame, kind: str) -> DataFrame:
    """Candidate rows (``kind`` is ``entities`` or ``relations``) of nested fixtures."""
    return quality.select("sample_id", F.explode(f"candidate_{kind}").alias("c")).select("sample_id", "c.*")


def label_precision(candidates: DataFrame, label: str) -> DataFrame:
    """Share of true labels among accepted and reviewed candidates."""
    reviewed = F.col("accepted") & F.col(label).isNotNull()
    return candidates.agg(*ratio_metric(F.count_if(reviewed & F.col(label)), F.count_if(reviewed)))


def entity_precision(entities: DataFrame) -> DataFrame:
    return label_precision(entities, "reviewed_correct")


def relation_precision(relations: DataFrame) -> DataFrame:
    return label_precision(relations, "semantically_correct")


def provenance_completeness(entities: DataFrame, relations: DataFrame) -> DataFrame:
    both = entities.select("accepted", "evidence_present").unionByName(relations.select("accepted", "evidence_present"))
    taken = F.col("accepted")
    return both.agg(*ratio_metric(F.count_if(taken & F.col("evidence_present")), F.count_if(taken)))


def review_coverage(candidates: DataFrame, label: str, scopes: DataFrame, population: str) -> DataFrame:
    """Reviewed accepted candidates over the declared population."""
    done = candidates.agg(F.count_if(F.col("accepted") & F.col(label).isNotNull()).alias("reviewed"))
    declared = scopes.agg(F.sum(population).alias("population"))
    return stack_counters([done, declared]).select(*ratio_metric(F.col("reviewed"), F.col("population")))


def review_candidates(candidates: DataFrame, id_column: str, label: str) -> DataFrame:
    """Accepted candidates that match no gold row and have no label yet."""
    waiting = F.col("accepted") & ~F.col("matched_gold") & F.col(label).isNull()
    return candidates.where(waiting).select(id_column).orderBy(id_column)


def check_fixtures(quality: DataFrame) -> DataFrame:
    """``(sample_id, problem, item)`` rows of fixtures that contradict themselves."""
    entities, relations = candidates_of(quality, "entities"), candidates_of(quality, "relations")
    problems = []
    for df, ident, name in ((entities, "entity_id", "entity"), (relations, "relation_id", "relation")):
        copies = df.groupBy("sample_id", ident).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        problems.append(copies.select("sample_id", F.lit(f"duplicate {name} id").alias("problem"), F.col(ident).alias("item")))
        shared = df.where("accepted").groupBy(ident).agg(
            F.countDistinct("sample_id").alias("n"), F.min("sample_id").alias("sample_id")
        )
        problems.append(
            shared.where("n > 1").select("sample_id", F.lit(f"accepted {name} id is not unique").alias("problem"), F.col(ident).alias("item"))
        )
        declared = quality.select("sample_id", F.col(f"review_scope.accepted_{name}_population").alias("declared"))
        counted = df.where("accepted").groupBy("sample_id").agg(F.countDistinct(ident).alias("n"))
        small = declared.join(counted, "sample_id").where("declared < n")
        problems.append(small.select("sample_id", F.lit(f"declared {name} population is too small").alias("problem"), F.col("n").cast("string").alias("item")))
    ends = relations.select(
        "sample_id", "relation_id", "accepted", F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id")
    )
    unknown = ends.join(entities.select("sample_id", "entity_id"), ["sample_id", "entity_id"], "left_anti")
    loose = ends.where("accepted").join(
        entities.where("accepted").select("sample_id", "entity_id"), ["sample_id", "entity_id"], "left_anti"
    )
    for df, text in ((unknown, "relation references an unknown entity"), (loose, "accepted relation must use accepted entities")):
        problems.append(df.select("sample_id", F.lit(text).alias("problem"), F.col("relation_id").alias("item")).distinct())
    out = problems[0]
    for part in problems[1:]:
        out = out.unionByName(part)
    return out


# --- recall -------------------------------------------------------------------------------


def entity_recall(documents: DataFrame, gold: DataFrame, extracted: DataFrame) -> DataFrame:
    """Hits and gold names per document: ``documents(document_id, failed)``.

    Names are compared lower-cased and stripped, once each. A failed document has no hits.
    """
    wanted = gold.select("document_id", _label_key("name").alias("key")).distinct()
    found = extracted.select("document_id", _label_key("name").alias("key")).distinct().withColumn("_hit", F.lit(True))
    counts = wanted.join(found, ["document_id", "key"], "left").groupBy("document_id").agg(
        F.count_if("_hit").alias("_hits"), F.count(F.lit(1)).alias("_gold")
    )
    joined = documents.join(counts, "document_id", "left").na.fill(0, ["_hits", "_gold"])
    return joined.select(
        "document_id",
        F.when(F.col("failed"), 0).otherwise(F.col("_hits")).cast("bigint").alias("hit_count"),
        F.col("_gold").alias("gold_count"),
    )


def recall_summary(per_document: DataFrame) -> DataFrame:
    """Pooled and macro recall; zero when there is nothing to recall."""
    rate = F.coalesce(F.try_divide("hit_count", "gold_count"), F.lit(0.0))
    return per_document.agg(
        F.coalesce(F.try_divide(F.sum("hit_count"), F.sum("gold_count")), F.lit(0.0)).alias("pooled"),
        F.coalesce(F.avg(rate), F.lit(0.0)).alias("macro"),
    )


def unmatched_extracted(extracted: DataFrame, gold: DataFrame) -> DataFrame:
    """Extracted names without a gold row: a review list, not errors."""
    keyed = extracted.withColumn("_key", _label_key("name"))
    wanted = gold.select("document_id", _label_key("name").alias("_key")).distinct()
    return keyed.join(wanted, ["document_id", "_key"], "left_anti").select(*extracted.columns)


def relation_usable_rate(counts: DataFrame) -> DataFrame:
    """``counts(document_id, merged, raw)``: merged/raw, 1 for a document without raw relations."""
    rate = F.when(F.col("raw") == 0, 1.0).otherwise(F.col("merged") / F.col("raw"))
    return counts.withColumn("usable_rate", rate)


def overall_usable_rate(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.try_divide(F.sum("merged"), F.sum("raw")), F.lit(0.0)).alias("usable_rate"))


def parse_success_rate(parsed: DataFrame) -> DataFrame:
    """``parsed(document_id, ok)``: share of parsed documents."""
    return parsed.agg(F.coalesce(F.avg(F.col("ok").cast("double")), F.lit(0.0)).alias("parse_success_rate"))


# --- answers ------------------------------------------------------------------------------


def answer_scores(answers: DataFrame) -> DataFrame:
    """Per answer: keyword accuracy and citation hit.

    ``answers(query_id, text, keywords, citation_count)``.
    """
    text = F.lower("text")
    hits = F.filter("keywords", lambda k: F.contains(text, F.lower(k)))
    none = F.coalesce(F.size("keywords"), F.lit(0)) <= 0
    accuracy = F.when(none, 1.0).otherwise(F.size(hits) / F.size("keywords"))
    return answers.withColumn("answer_accuracy", accuracy).withColumn(
        "citation_hit_rate", F.when(F.col("citation_count") > 0, F.col("answer_accuracy")).otherwise(0.0)
    )


def hallucination_rates(answers: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """Share of assertion sentences without a marker; 0 for refusals and empty answers."""
    parts = assertions(answers.select(key, F.col(text).alias("text")), "text")
    bare = ~F.col("sentence").rlike(r"\[[0-9]+\]")
    counted = parts.groupBy(key).agg(F.count(F.lit(1)).alias("sentences"), F.count_if(bare).alias("uncited"))
    joined = answers.select(key, F.col(text).alias("_text")).join(counted, key, "left").na.fill(0, ["sentences", "uncited"])
    refused = F.coalesce(F.col("_text").contains(REFUSAL), F.lit(False))
    rate = F.when(refused | (F.col("sentences") == 0), 0.0).otherwise(F.col("uncited") / F.col("sentences"))
    return joined.withColumn("hallucination_rate", rate).drop("_text")


def library_summary(documents: DataFrame) -> DataFrame:
    return documents.agg(
        F.count(F.lit(1)).alias("document_count"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunk_count")
    )


# --- structure ------------------------------------------------------------------------------


def structure_diagnostics(
    entities: DataFrame,
    relations: DataFrame,
    low_confidence: float = 0.6,
    generic_names: Sequence[str] = (),
    hub_degree: int = 3,
) -> dict[str, DataFrame]:
    """Shape of the accepted graph.

    ``entities(sample_id, entity_id, name)`` and ``relations(relation_id, source_entity_id,
    target_entity_id, confidence)``; degree counts distinct neighbours, a self relation
    makes an entity its own neighbour.
    """
    ends = relations.select(F.col("source_entity_id").alias("a"), F.col("target_entity_id").alias("b"))
    near = ends.union(ends.select("b", "a")).distinct()
    degree = near.groupBy(F.col("a").alias("entity_id")).agg(F.count(F.lit(1)).alias("degree"))
    sized = entities.join(degree, "entity_id", "left").na.fill(0, ["degree"])
    key = _label_key("name")
    generic = [n.lower().strip() for n in generic_names]
    names = entities.select(key.alias("name_key"), "sample_id").distinct()
    labels = component_labels(entities.select(F.col("entity_id").alias("id")), near)
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return {
        "isolated": sized.where("degree = 0").select("entity_id"),
        "degree_one": sized.where("degree = 1").select("entity_id"),
        "low_confidence": relations.where(F.col("confidence") < low_confidence).select("relation_id"),
        "duplicate_names": names.groupBy("name_key").agg(F.count(F.lit(1)).alias("documents")).where("documents > 1"),
        "component_sizes": sizes.groupBy("size").agg(F.count(F.lit(1)).alias("components")),
        "generic_hubs": sized.where(key.isin(generic) & (F.col("degree") >= hub_degree)).select("entity_id", "degree"),
    }
