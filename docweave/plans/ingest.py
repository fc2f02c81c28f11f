"""From documents to a resolved graph, as one composition of operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.models import embed_column, extract_candidates
from docweave.operators import chunking, merging, resolution, validation
from docweave.operators.projection import live_mentions
from docweave.session import cut, store
from docweave.sources.tables import upsert_chunks, upsert_documents, upsert_graph


def extract_graph(
    chunks: DataFrame,
    chat: Callable[[list[dict]], str],
    entity_types: Sequence[str] = validation.ENTITY_TYPES,
    relation_types: Sequence[str] | None = validation.RELATION_TYPES,
    **options,
) -> dict[str, DataFrame]:
    """Model output of the chunks to merged entities, mentions, relations and diagnostics."""
    raw = cut(extract_candidates(chunks, chat, **options))
    broken = raw.where("error IS NOT NULL").select("document_id", "chunk_id", "pos", F.col("error").alias("reason"))
    judged = store(validation.judge_payloads(raw.where("error IS NULL")), "payloads")
    parsed, malformed = validation.split_payloads(judged)
    entities = cut(validation.gate_entities(validation.entity_candidates(parsed), entity_types))
    taken = validation.accepted(entities)
    relations = cut(
        validation.gate_relations(validation.relation_candidates(parsed), taken, relation_types)
    )
    merged = merging.merge_entities(taken)
    resolved = merging.resolve_endpoints(validation.accepted(relations), merged)
    return {
        "entities": merged,
        "mentions": merging.entity_mentions(taken).select("chunk_id", "entity_id"),
        "relations": merging.merge_relations(resolved),
        "failures": broken.unionByName(malformed),
        "diagnostics": validation.rejection_diagnostics(entities, relations),
    }


def ingest_documents(
    tables: Mapping[str, DataFrame],
    documents: DataFrame,
    embed: Callable[[list[str]], list[list[float]]],
    chat: Callable[[list[dict]], str],
    dim: int,
    entity_types: Sequence[str] = validation.ENTITY_TYPES,
    relation_types: Sequence[str] | None = validation.RELATION_TYPES,
    **options,
) -> dict[str, DataFrame]:
    """Chunk, embed, extract, merge, store and resolve ``documents(document_id, name, doc_type, raw_text)``.

    Model calls are materialised once. The result is the new set of tables.
    """
    chunks = chunking.chunk_documents(documents)
    prepared = chunking.contextual_text(chunks, documents)
    embedded = cut(embed_column(prepared, "context_text", embed, dim).drop("context_text"))
    found = extract_graph(embedded, chat, entity_types, relation_types, **options)
    counted = embedded.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    stored = documents.drop("raw_text").join(counted, "document_id", "left").na.fill(0, ["chunk_count"])
    merged = {
        **tables,
        "documents": upsert_documents(tables["documents"], stored),
        "chunks": upsert_chunks(tables["chunks"], embedded, dim),
    }
    facts = upsert_graph(
        merged,
        found["entities"].withColumn("resolution_status", F.lit(None).cast("string")),
        found["mentions"],
        found["relations"].drop("document_id"),
    )
    merged.update({name: cut(facts[name]) for name in ("entities", "mentions", "relations")})
    live = live_mentions(merged["mentions"], merged["chunks"], merged["documents"])
    scope = found["entities"].select("entity_id")
    written, outcome = resolution.run_resolution(merged, live, scope=scope)
    return {**written, "decisions": outcome.decisions, "failures": found["failures"], "diagnostics": found["diagnostics"]}
