"""Read-time canonical graph: only accepted, evidence-backed facts count.

All evidence checks are semi-joins on full keys, so no row is multiplied, and all
per-edge lists are pruned inside the tasks before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property, partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import edge_id, pack_canonical, unpack_canonical
from docweave.operators.ordering import bounded_list, distinct_count, stack_counters
from docweave.session import co_located, store, store_bucketed

ALIAS_LIMIT = 20
EVIDENCE_LIMIT = 20
MIN_CONFIDENCE = 0.5


def live_mentions(mentions: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``(document_id, chunk_id, entity_id)`` of mentions inside existing documents.

    Mentions that carry their ``document_id`` meet the chunks inside of documents.
    """
    owned = chunks.select("chunk_id", "document_id").join(
        documents.select("document_id"), "document_id", "left_semi"
    )
    keys = ["document_id", "chunk_id"] if "document_id" in mentions.columns else ["chunk_id"]
    return mentions.select(*keys, "entity_id").join(owned, keys)


def accepted_resolutions(
    entities: DataFrame, resolutions: DataFrame, mentions: DataFrame, document_id: str | None = None
) -> DataFrame:
    """Links whose evidence chunk lies in the entity's document and mentions the entity.

    ``mentions`` is the output of ``live_mentions``.
    """
    sources = entities.select("entity_id", "document_id", "name", "entity_type", "mention_count", "resolution_status")
    if document_id is not None:
        sources = sources.where(F.col("document_id") == document_id)
    linked = sources.join(
        resolutions.select(
            "entity_id", "canonical_id", F.col("source_document_id").alias("document_id"),
            F.col("evidence_chunk_id").alias("chunk_id"),
        ),
        ["entity_id", "document_id"],
    )
    return linked.join(
        mentions.select("document_id", "chunk_id", "entity_id"),
        ["document_id", "chunk_id", "entity_id"],
        "left_semi",
    ).withColumnRenamed("chunk_id", "evidence_chunk_id")


def eligible_relations(
    accepted: DataFrame,
    relations: DataFrame,
    mentions: DataFrame,
    min_confidence: float | None = MIN_CONFIDENCE,
) -> DataFrame:
    """Relations between accepted ends of one document, evidenced for both ends.

    Self relations of a canonical are kept; ``canonical_edges`` drops them and
    ``coverage`` counts them.
    """
    facts = relations if min_confidence is None else confident(relations, min_confidence)
    # Relations that carry their document meet their ends inside of it.
    own = [c for c in ("document_id",) if c in facts.columns]
    facts = facts.select("source_id", "target_id", "type", "confidence", "evidence_chunk_id", *own)
    side = accepted.select("entity_id", "document_id", "canonical_id")
    source = side.toDF("source_id", "document_id", "source_canonical_id")
    target = side.toDF("target_id", "document_id", "target_canonical_id")
    ended = facts.join(source, ["source_id", *own]).join(target, ["target_id", "document_id"])
    for end in ("source_id", "target_id"):
        proof = mentions.select(
            "document_id",
            F.col("chunk_id").alias("evidence_chunk_id"),
            F.col("entity_id").alias(end),
        )
        ended = ended.join(proof, ["document_id", "evidence_chunk_id", end], "left_semi")
    return ended.select(
        "source_canonical_id", "target_canonical_id", "type", "confidence", "document_id",
        F.col("evidence_chunk_id").alias("chunk_id"),
        F.col("source_id").alias("source_entity_id"),
        F.col("target_id").alias("target_entity_id"),
    )


class EvidenceViews:
    """The projection: ``live``, ``accepted`` and ``facts`` dealt by document, and the ``nodes`` and
    ``edges`` that come from them. ``facts`` have no confidence floor.

    Each is built by its function when it is asked for first, so a reader pays for what it reads.
    """

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]], canonicals: DataFrame, min_confidence: float = MIN_CONFIDENCE, keep: Callable[[DataFrame, str], DataFrame] | None = None):
        self.builders, self.canonicals, self.min_confidence = builders, canonicals, min_confidence
        self.keep = keep or (lambda rows, name: rows)

    @cached_property
    def live(self) -> DataFrame:
        return self.builders["live"]()

    @cached_property
    def accepted(self) -> DataFrame:
        return self.builders["accepted"]()

    @cached_property
    def facts(self) -> DataFrame:
        return self.builders["facts"]()

    @cached_property
    def nodes(self) -> DataFrame:
        return self.keep(canonical_nodes(self.accepted, self.canonicals), "nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return self.keep(canonical_edges(self.facts_from(self.min_confidence)), "edges")

    def facts_from(self, min_confidence: float | None = MIN_CONFIDENCE) -> DataFrame:
        return self.facts if min_confidence is None else confident(self.facts, min_confidence)

    def scoped(self, documents: DataFrame | str) -> EvidenceViews:
        """The projection of some documents only: an id, or ``documents(document_id)``.

        Nodes, edges, their counts and lists then rest on the evidence of these documents.
        """
        builders = {name: partial(lambda n: in_documents(getattr(self, n), documents), name) for name in ("live", "accepted", "facts")}
        return EvidenceViews(builders, self.canonicals, self.min_confidence)


def in_documents(rows: DataFrame, documents: DataFrame | str | None) -> DataFrame:
    """Rows of one document or of a table of them; all rows without a scope."""
    if documents is None:
        return rows
    if isinstance(documents, str):
        return rows.where(F.col("document_id") == documents)
    return rows.join(documents.select("document_id"), "document_id", "left_semi")


def confident(facts: DataFrame, min_confidence: float) -> DataFrame:
    return facts.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)


def store_views(
    tables: Mapping[str, DataFrame], min_confidence: float = MIN_CONFIDENCE, buckets: int | None = None
) -> EvidenceViews:
    """Views that check all evidence once and store what is read; to be renewed with every version of the tables.

    Everything that is joined lies in one document, so the views are bucketed by document and
    their joins with each other, on whatever further columns, move no rows. Tables that carry
    their document and are dealt by it into as many ``buckets`` are not moved either.
    """

    def mentions() -> DataFrame:
        return live_mentions(tables["mentions"], tables["chunks"], tables["documents"])

    def dealt(name: str, rows: Callable[[], DataFrame]) -> DataFrame:
        spark = tables["documents"].sparkSession
        with co_located(spark):
            return store_bucketed(rows(), name, "document_id", buckets)

    views = EvidenceViews(
        {
            "live": lambda: dealt("live", mentions),
            "accepted": lambda: dealt("accepted", lambda: accepted_resolutions(tables["entities"], tables["resolutions"], mentions())),
            "facts": lambda: dealt("facts", lambda: eligible_relations(views.accepted, tables["relations"], mentions(), None)),
        },
        tables["canonicals"], min_confidence, store,
    )
    return views


def canonical_nodes(accepted: DataFrame, canonicals: DataFrame, alias_limit: int = ALIAS_LIMIT) -> DataFrame:
    """One row per canonical with counts and its first aliases in name order.

    The full document list of a node is ``node_documents``: rows, not an array, because
    one canonical may occur in a large share of all documents.
    """
    totals = accepted.groupBy("canonical_id").agg(
        F.count(F.lit(1)).alias("source_entity_count"),
        F.sum(F.coalesce("mention_count", F.lit(0))).cast("bigint").alias("mention_count"),
    )
    documents = distinct_count(accepted, ["canonical_id"], "document_id", "document_count")
    names = alias_summary(accepted, alias_limit)
    return (
        totals.join(documents, "canonical_id")
        .join(names, "canonical_id", "left")
        .join(canonicals.select("canonical_id", "canonical_name", "entity_type"), "canonical_id")
        .select(
            "canonical_id",
            F.coalesce("canonical_name", F.lit("")).alias("canonical_name"),
            F.coalesce("entity_type", F.lit("")).alias("entity_type"),
            "document_count", "source_entity_count", "mention_count",
            F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
            F.coalesce("alias_count", F.lit(0)).alias("alias_count"),
            (F.coalesce("alias_count", F.lit(0)) > alias_limit).alias("aliases_truncated"),
        )
    )


def alias_summary(accepted: DataFrame, limit: int = ALIAS_LIMIT) -> DataFrame:
    """First ``limit`` distinct non-blank source names per canonical and their number."""
    names = (
        accepted.where(F.length(F.trim(F.coalesce("name", F.lit("")))) > 0)
        .select("canonical_id", "name")
        .distinct()
    )
    shown = bounded_list(names, ["canonical_id"], ["name"], ["name"], limit, "_items")
    counted = names.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("alias_count"))
    return shown.join(counted, "canonical_id").select(
        "canonical_id", F.transform("_items", lambda i: i["name"]).alias("aliases"), "alias_count"
    )


def node_documents(accepted: DataFrame) -> DataFrame:
    return accepted.select("canonical_id", "document_id").distinct()


def node_names(accepted: DataFrame) -> DataFrame:
    return accepted.select("canonical_id", "name").distinct()


_EVIDENCE = ["document_id", "chunk_id", "source_entity_id", "target_entity_id", "confidence"]
_EDGE = ["source_canonical_id", "target_canonical_id", "type"]


def _evidence_order() -> list[Column]:
    return [*[F.col(c) for c in _EVIDENCE[:-1]], F.coalesce("confidence", F.lit(-1.0))]


def _packed(facts: DataFrame) -> DataFrame:
    """Facts with their canonicals in half the bytes, which is most of what edges move."""
    return facts.withColumns({end: pack_canonical(end) for end in _EDGE[:2]})


def canonical_edges(facts: DataFrame, evidence_limit: int | None = None) -> DataFrame:
    """Facts grouped by (source, target, type), identical evidence counted once.

    With ``evidence_limit`` the first evidence rows are attached in evidence order.
    """
    proofs = (
        _packed(facts.where(F.col("source_canonical_id") != F.col("target_canonical_id")))
        .withColumn("type", F.coalesce("type", F.lit("")))
        .select(*_EDGE, *_EVIDENCE)
        .distinct()
    )
    edges = proofs.groupBy(*_EDGE).agg(
        F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("support_count")
    )
    if evidence_limit is not None:
        lists = bounded_list(proofs, _EDGE, _evidence_order(), _EVIDENCE, evidence_limit, "evidence")
        edges = edges.join(lists, _EDGE).withColumn(
            "evidence_truncated", F.col("support_count") > evidence_limit
        )
    for end in _EDGE[:2]:
        edges = edges.withColumn(end, unpack_canonical(end))
    return edges.withColumn("edge_id", edge_id(*_EDGE))


def coverage(
    entities: DataFrame,
    resolutions: DataFrame,
    relations: DataFrame,
    mentions: DataFrame | None,
    document_id: DataFrame | str | None = None,
    min_confidence: float = MIN_CONFIDENCE,
    by_document: bool = False,
    views: EvidenceViews | None = None,
) -> DataFrame:
    """The eight coverage counters, over everything or per document.

    ``document_id`` limits them to one document or to a table of documents.

    With stored ``views`` of these tables the evidence is not checked again.
    """
    entities = in_documents(entities, document_id)
    group = ["document_id"] if by_document else []
    own = F.col("resolution_status")
    sources = entities.groupBy(*group).agg(
        F.count(F.lit(1)).alias("source_entity_count"),
        F.count_if(own == "review").alias("review_source_entity_count"),
        F.count_if(own == "unresolved").alias("unresolved_source_entity_count"),
    )
    accepted = accepted_resolutions(entities, resolutions, mentions) if views is None else in_documents(views.accepted, document_id)
    linked = accepted.groupBy(*group).agg(F.count(F.lit(1)).alias("accepted_source_entity_count"))
    owner = entities.select(F.col("entity_id").alias("source_id"), "document_id")
    keys = ["source_id", *(c for c in ("document_id",) if c in relations.columns)]
    total = relations.join(owner, keys).groupBy(*group).agg(
        F.count(F.lit(1)).alias("source_relation_count")
    )
    facts = eligible_relations(accepted, relations, mentions, min_confidence) if views is None else in_documents(views.facts_from(min_confidence), document_id)
    eligible = facts.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_eligible"),
        F.count_if(F.col("source_canonical_id") == F.col("target_canonical_id")).alias(
            "collapsed_self_relation_count"
        ),
    )
    out = sources
    if by_document:
        # Links and facts lie in documents with entities; tables dealt by document meet in place.
        for part in (linked, total, eligible):
            out = out.join(part, "document_id", "left")
        out = out.na.fill(0)
    else:
        out = stack_counters([sources, linked, total, eligible])
    return out.select(
        *group,
        "source_entity_count", "accepted_source_entity_count", "review_source_entity_count",
        "unresolved_source_entity_count", "source_relation_count",
        (F.col("_eligible") - F.col("collapsed_self_relation_count")).alias("projected_source_relation_count"),
        (F.col("source_relation_count") - F.col("_eligible")).alias("excluded_relation_count"),
        "collapsed_self_relation_count",
    )


def coverage_of(counters: DataFrame, documents: DataFrame | str | None = None) -> DataFrame:
    """The counters of all documents in scope, from those per document (``by_document``).

    An entity, its links and the relations it begins lie in one document, so they add up.
    """
    names = [c for c in counters.columns if c != "document_id"]
    return in_documents(counters, documents).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in names])


def check_coverage_partition(counters: DataFrame) -> DataFrame:
    """Coverage rows whose relation counters do not add up; empty when sound."""
    parts = (
        F.col("projected_source_relation_count")
        + F.col("excluded_relation_count")
        + F.col("collapsed_self_relation_count")
    )
    return counters.where(parts != F.col("source_relation_count"))


def bounded_snapshot(
    nodes: DataFrame,
    edges: DataFrame,
    node_limit: int,
    edge_limit: int,
    preferred: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, totals)`` cut to the display limits.

    Nodes by (preferred first, id); edges among the kept nodes by (-support, id); node
    degree counts kept edges. Totals are exact. The kept node ids are at most
    ``node_limit`` rows, which is what the broadcast of the semi-joins relies on.
    """
    order = [F.col("canonical_id")]
    if preferred is not None:
        order.insert(0, F.col("canonical_id") != preferred)
    kept = nodes.orderBy(*order).limit(node_limit)
    ids = kept.select("canonical_id")
    among = edges
    for end in ("source_canonical_id", "target_canonical_id"):
        among = among.join(F.broadcast(ids.toDF(end)), end, "left_semi")
    shown = among.orderBy(F.desc("support_count"), "edge_id").limit(edge_limit)
    ends = shown.select(F.explode(F.array("source_canonical_id", "target_canonical_id")).alias("canonical_id"))
    degrees = ends.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("degree"))
    ranked = kept.join(F.broadcast(degrees), "canonical_id", "left").na.fill(0, ["degree"])
    totals = stack_counters(
        [
            nodes.agg(F.count(F.lit(1)).alias("total_node_count")),
            among.agg(F.count(F.lit(1)).alias("total_edge_count")),
            shown.agg(F.sum("support_count").alias("evidence_count")),
        ]
    )
    totals = totals.withColumn("node_truncated", F.col("total_node_count") > node_limit).withColumn(
        "edge_truncated", F.col("total_edge_count") > edge_limit
    )
    return ranked, shown, totals


def canonical_degrees(facts: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Distinct (source, target, type) edges at each canonical."""
    apart = facts.where(F.col("source_canonical_id") != F.col("target_canonical_id"))
    edges = _packed(apart).select(*_EDGE).distinct()
    ends = edges.select(F.explode(F.array("source_canonical_id", "target_canonical_id")).alias("canonical_id"))
    counted = ends.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("degree"))
    counted = counted.withColumn("canonical_id", unpack_canonical("canonical_id"))
    return counted if ids is None else counted.join(ids.select("canonical_id"), "canonical_id", "left_semi")


def canonical_search(
    accepted: DataFrame, canonicals: DataFrame, facts: DataFrame, query: str, limit: int
) -> DataFrame:
    """Canonicals whose name or any accepted source name contains ``query``."""
    needle = query.lower()
    by_name = canonicals.where(F.lower("canonical_name").contains(needle)).select("canonical_id")
    by_source = accepted.where(F.lower("name").contains(needle)).select("canonical_id")
    live = accepted.select("canonical_id").distinct()
    hits = by_name.unionByName(by_source).distinct().join(live, "canonical_id", "left_semi")
    found = hits.orderBy("canonical_id").limit(limit)
    kept = accepted.join(F.broadcast(found), "canonical_id", "left_semi")
    nodes = canonical_nodes(kept, canonicals)
    degrees = canonical_degrees(facts, found)
    return nodes.join(degrees, "canonical_id", "left").na.fill(0, ["degree"]).orderBy("canonical_id")
