"""Registered queries over the derived document graph, each with its SQL twin."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from docweave.operators import graph as N
from docweave.operators import projection as P
from docweave.operators.ordering import stack_counters
from docweave.plans.derived import graph_coverage, graph_tables, graph_views

GRAPH_SQL = """
WITH lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS document_id,
         l_orderkey || '#' || l_linenumber || '.' || l_partkey || '.' || l_suppkey || '.' || CAST(l_quantity AS INTEGER) AS chunk_id,
         CAST(l_linenumber AS BIGINT) * 288230376151711744 + l_partkey * 1073741824 + l_suppkey * 64 + CAST(l_quantity AS BIGINT) AS pos,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate,
         l_orderkey || '::' || lower(s_name) AS source_id,
         l_orderkey || '::' || lower(p_name) AS target_id,
         p_name, p_type, s_name, l_returnflag AS type, round(1 - 8 * l_discount, 2) AS confidence
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
), documents_g AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS document_id, 'orders/' || o_orderkey AS source_path,
         'text' AS doc_type, o_orderpriority AS name, o_orderstatus AS parse_status
  FROM orders
), chunks AS (
  SELECT chunk_id, document_id, pos FROM lines
), ends AS (
  SELECT document_id, chunk_id, pos, source_id AS entity_id, s_name AS name, 'SUPPLIER' AS entity_type FROM lines
  UNION ALL
  SELECT document_id, chunk_id, pos, target_id, p_name, p_type FROM lines
), mentions AS (
  SELECT DISTINCT chunk_id, entity_id FROM ends
), entities AS (
  SELECT *, trim(regexp_replace(regexp_replace(lower(name), '[!-#%-*,-/:;?@\\[-\\]_{}]', '', 'g'), '\\s+', ' ', 'g')) AS normalized_name,
         CASE substr(md5(entity_id), 1, 1) WHEN '0' THEN 'review' WHEN '1' THEN 'unresolved' END AS resolution_status
  FROM (
    SELECT entity_id, document_id, min(name) AS name, min(entity_type) AS entity_type,
           CAST(count(*) AS INTEGER) AS mention_count, arg_min(chunk_id, pos) AS first_chunk
    FROM ends GROUP BY entity_id, document_id)
), canonicals AS (
  SELECT normalized_name, min(name) AS canonical_name, min(entity_type) AS entity_type,
         'canonical:v1:' || sha256(normalized_name) AS canonical_id
  FROM entities GROUP BY normalized_name
), resolutions AS (
  SELECT entity_id, 'canonical:v1:' || sha256(normalized_name) AS canonical_id, document_id AS source_document_id,
         CASE WHEN substr(md5(entity_id), 1, 1) = '2' THEN 'forged-' || first_chunk ELSE first_chunk END AS evidence_chunk_id
  FROM entities WHERE resolution_status IS NULL
), relations AS (
  SELECT DISTINCT source_id, target_id, type, confidence, chunk_id AS evidence_chunk_id FROM lines
), live AS (
  SELECT m.chunk_id, m.entity_id, c.document_id FROM mentions m JOIN chunks c USING (chunk_id)
  WHERE c.document_id IN (SELECT document_id FROM documents_g)
), accepted AS (
  SELECT e.entity_id, e.document_id, e.name, e.entity_type, e.mention_count, r.canonical_id, r.evidence_chunk_id
  FROM entities e JOIN resolutions r ON r.entity_id = e.entity_id AND r.source_document_id = e.document_id
  WHERE EXISTS (SELECT 1 FROM live l WHERE l.entity_id = e.entity_id AND l.document_id = e.document_id
                AND l.chunk_id = r.evidence_chunk_id)
), all_facts AS (
  SELECT s.canonical_id AS source_canonical_id, t.canonical_id AS target_canonical_id, r.type, r.confidence,
         s.document_id, r.evidence_chunk_id AS chunk_id, s.entity_id AS source_entity_id, t.entity_id AS target_entity_id
  FROM relations r JOIN accepted s ON s.entity_id = r.source_id
  JOIN accepted t ON t.entity_id = r.target_id AND t.document_id = s.document_id
  WHERE EXISTS (SELECT 1 FROM live l WHERE l.entity_id = s.entity_id AND l.document_id = s.document_id AND l.chunk_id = r.evidence_chunk_id)
    AND EXISTS (SELECT 1 FROM live l WHERE l.entity_id = t.entity_id AND l.document_id = s.document_id AND l.chunk_id = r.evidence_chunk_id)
), facts AS (
  SELECT * FROM all_facts WHERE coalesce(confidence, 0) >= 0.5
), proofs AS (
  SELECT DISTINCT source_canonical_id, target_canonical_id, type, document_id, chunk_id, source_entity_id, target_entity_id, confidence
  FROM facts WHERE source_canonical_id <> target_canonical_id
), edges AS (
  SELECT source_canonical_id, target_canonical_id, type, max(confidence) AS confidence, count(*) AS support_count,
         'canonical-edge:v1:' || sha256(CAST(to_json([source_canonical_id, target_canonical_id, type]) AS VARCHAR)) AS edge_id
  FROM proofs GROUP BY source_canonical_id, target_canonical_id, type
)
"""


def canonical_id_of(key: str) -> str:
    return "canonical:v1:" + hashlib.sha256(key.encode()).hexdigest()


class Graph:
    """The derived tables and the shared views over them."""

    def __init__(self, spark, sf_dir):
        self.t = graph_tables(spark, sf_dir)
        self.source = spark, sf_dir

    @property
    def views(self):
        return graph_views(*self.source)

    @property
    def live(self):
        return self.views.live

    @property
    def accepted(self):
        return self.views.accepted

    def facts(self, min_confidence=P.MIN_CONFIDENCE):
        return self.views.facts_from(min_confidence)

    def edges(self, evidence_limit=None):
        return self.views.edges if evidence_limit is None else P.canonical_edges(self.facts(), evidence_limit)

    def nodes(self):
        return self.views.nodes


def canonical_edges_top(spark, sf_dir):
    """The 100 best supported canonical relations with readable names."""
    g = Graph(spark, sf_dir)
    top = g.edges().orderBy(F.desc("support_count"), "edge_id").limit(100)
    names = g.t["canonicals"].select("canonical_id", "canonical_name")
    return (
        top.join(names.toDF("source_canonical_id", "source_name"), "source_canonical_id")
        .join(names.toDF("target_canonical_id", "target_name"), "target_canonical_id")
        .select("edge_id", "source_name", "target_name", "type", "confidence", "support_count")
    )


def canonical_edges(spark, sf_dir):
    edges = Graph(spark, sf_dir).edges(evidence_limit=3)
    shown = F.transform("evidence", lambda e: F.concat_ws("/", e["chunk_id"], e["confidence"].cast("string")))
    return edges.select(
        "edge_id", "source_canonical_id", "target_canonical_id", "type", "confidence", "support_count",
        F.array_join(shown, " ").alias("evidence"), "evidence_truncated",
    )


def canonical_nodes(spark, sf_dir):
    nodes = Graph(spark, sf_dir).nodes()
    return nodes.withColumn("aliases", F.array_join("aliases", ","))


def node_documents(spark, sf_dir):
    return P.node_documents(Graph(spark, sf_dir).accepted)


def projection_coverage(spark, sf_dir):
    return P.coverage_of(graph_coverage(spark, sf_dir))


def coverage_by_document(spark, sf_dir):
    return graph_coverage(spark, sf_dir)


def coverage_violations(spark, sf_dir):
    bad = P.check_coverage_partition(coverage_by_document(spark, sf_dir))
    return bad.agg(F.count(F.lit(1)).alias("violations"))


def bounded_snapshot_nodes(spark, sf_dir):
    g = Graph(spark, sf_dir)
    nodes, _, _ = P.bounded_snapshot(g.nodes(), g.edges(), 200, 400)
    return nodes.select("canonical_id", "canonical_name", "source_entity_count", "degree")


def bounded_snapshot_totals(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return P.bounded_snapshot(g.nodes(), g.edges(), 200, 400)[2]


def canonical_search(spark, sf_dir):
    g = Graph(spark, sf_dir)
    found = P.canonical_search(g.accepted, g.t["canonicals"], g.facts(), "RING", 5)
    return found.select(
        "canonical_id", "canonical_name", "entity_type", "document_count", "source_entity_count",
        "mention_count", "degree",
    )


def _urgent(g):
    return g.t["documents"].where("name = '1-URGENT'").select("document_id")


def scoped_search(spark, sf_dir):
    """Search over the evidence of urgent orders only."""
    g = Graph(spark, sf_dir)
    v = g.views.scoped(_urgent(g))
    found = P.canonical_search(v.accepted, g.t["canonicals"], v.facts_from(), "RING", 5)
    return found.select("canonical_id", "canonical_name", "document_count", "source_entity_count", "mention_count", "degree")


def scoped_snapshot_totals(spark, sf_dir):
    g = Graph(spark, sf_dir)
    v = g.views.scoped(_urgent(g))
    return P.bounded_snapshot(v.nodes, v.edges, 200, 400)[2]


def scoped_coverage(spark, sf_dir):
    """Coverage counters next to the subgraph of a canonical, within urgent orders."""
    g = Graph(spark, sf_dir)
    by_document = graph_coverage(spark, sf_dir)
    members, edges, _, counters = N.covered_subgraph(g.views, g.t, canonical_id_of("cold ring"), 1, 20, 30, _urgent(g), by_document)
    sizes = stack_counters([members.agg(F.count(F.lit(1)).alias("members")), edges.agg(F.sum("support_count").alias("support"))])
    return stack_counters([counters, sizes])


def canonical_degrees(spark, sf_dir):
    return P.canonical_degrees(Graph(spark, sf_dir).facts())


_COVERAGE = """
, by_doc AS (
  SELECT e.document_id, count(*) AS source_entity_count,
         count(*) FILTER (e.entity_id IN (SELECT entity_id FROM accepted)) AS accepted_source_entity_count,
         count(*) FILTER (resolution_status = 'review') AS review_source_entity_count,
         count(*) FILTER (resolution_status = 'unresolved') AS unresolved_source_entity_count
  FROM entities e GROUP BY e.document_id
), by_rel AS (
  SELECT s.document_id, count(*) AS source_relation_count
  FROM relations r JOIN entities s ON s.entity_id = r.source_id GROUP BY s.document_id
), by_fact AS (
  SELECT document_id, count(*) AS eligible, count(*) FILTER (source_canonical_id = target_canonical_id) AS collapsed
  FROM facts GROUP BY document_id
), cover AS (
  SELECT d.document_id, source_entity_count, accepted_source_entity_count, review_source_entity_count,
         unresolved_source_entity_count, coalesce(source_relation_count, 0) AS source_relation_count,
         coalesce(eligible, 0) - coalesce(collapsed, 0) AS projected_source_relation_count,
         coalesce(source_relation_count, 0) - coalesce(eligible, 0) AS excluded_relation_count,
         coalesce(collapsed, 0) AS collapsed_self_relation_count
  FROM by_doc d LEFT JOIN by_rel USING (document_id) LEFT JOIN by_fact USING (document_id)
)
"""
_COUNTERS = [
    "source_entity_count", "accepted_source_entity_count", "review_source_entity_count",
    "unresolved_source_entity_count", "source_relation_count", "projected_source_relation_count",
    "excluded_relation_count", "collapsed_self_relation_count",
]
_SNAPSHOT = """
, kept AS (
  SELECT canonical_id FROM accepted GROUP BY canonical_id ORDER BY canonical_id LIMIT 200
), among AS (
  SELECT * FROM edges WHERE source_canonical_id IN (SELECT canonical_id FROM kept)
    AND target_canonical_id IN (SELECT canonical_id FROM kept)
), shown AS (
  SELECT * FROM among ORDER BY support_count DESC, edge_id LIMIT 400
)
"""
_ENDS = "SELECT source_canonical_id AS canonical_id FROM {0} UNION ALL SELECT target_canonical_id FROM {0}"
_DEGREES = """
, keys AS (
  SELECT DISTINCT source_canonical_id, target_canonical_id, type FROM facts WHERE source_canonical_id <> target_canonical_id
), degrees AS (
  SELECT canonical_id, count(*) AS degree FROM (""" + _ENDS.format("keys") + """) GROUP BY canonical_id
)
"""
_SCOPED = """
, urgent AS (SELECT document_id FROM documents_g WHERE name = '1-URGENT'),
center AS (SELECT 'canonical:v1:' || sha256('cold ring') AS id),
in_scope AS (SELECT * FROM accepted WHERE document_id IN (SELECT document_id FROM urgent)),
scoped_edges AS (
  SELECT source_canonical_id, target_canonical_id, type, count(*) AS support_count,
         'canonical-edge:v1:' || sha256(CAST(to_json([source_canonical_id, target_canonical_id, type]) AS VARCHAR)) AS edge_id
  FROM proofs WHERE document_id IN (SELECT document_id FROM urgent) GROUP BY source_canonical_id, target_canonical_id, type
)
"""

QUERIES = {
    "canonical_edges_top": (
        canonical_edges_top,
        GRAPH_SQL
        + """SELECT edge_id, s.canonical_name AS source_name, t.canonical_name AS target_name, type, confidence, support_count
        FROM (SELECT * FROM edges ORDER BY support_count DESC, edge_id LIMIT 100) e
        JOIN canonicals s ON s.canonical_id = source_canonical_id
        JOIN canonicals t ON t.canonical_id = target_canonical_id""",
    ),
    "canonical_edges": (
        canonical_edges,
        GRAPH_SQL
        + """, ranked AS (
          SELECT *, row_number() OVER (PARTITION BY source_canonical_id, target_canonical_id, type
            ORDER BY document_id, chunk_id, source_entity_id, target_entity_id, coalesce(confidence, -1)) AS rn FROM proofs
        ), lists AS (
          SELECT source_canonical_id, target_canonical_id, type,
                 string_agg(chunk_id || '/' || CAST(confidence AS VARCHAR), ' ' ORDER BY rn) AS evidence
          FROM ranked WHERE rn <= 3 GROUP BY ALL
        )
        SELECT edge_id, source_canonical_id, target_canonical_id, type, confidence, support_count, evidence,
               support_count > 3 AS evidence_truncated
        FROM edges JOIN lists USING (source_canonical_id, target_canonical_id, type)""",
    ),
    "canonical_nodes": (
        canonical_nodes,
        GRAPH_SQL
        + """, names AS (
          SELECT canonical_id, name, row_number() OVER (PARTITION BY canonical_id ORDER BY name) AS rn
          FROM (SELECT DISTINCT canonical_id, name FROM accepted WHERE trim(name) <> '')
        )
        SELECT a.canonical_id, c.canonical_name, c.entity_type, document_count, source_entity_count, mention_count,
               aliases, alias_count, alias_count > 20 AS aliases_truncated
        FROM (SELECT canonical_id, count(DISTINCT document_id) AS document_count, count(*) AS source_entity_count,
                     CAST(sum(coalesce(mention_count, 0)) AS BIGINT) AS mention_count FROM accepted GROUP BY canonical_id) a
        JOIN (SELECT canonical_id, string_agg(name, ',' ORDER BY rn) FILTER (rn <= 20) AS aliases, count(*) AS alias_count
              FROM names GROUP BY canonical_id) n USING (canonical_id)
        JOIN canonicals c USING (canonical_id)""",
    ),
    "node_documents": (node_documents, GRAPH_SQL + "SELECT DISTINCT canonical_id, document_id FROM accepted"),
    "projection_coverage": (
        projection_coverage,
        GRAPH_SQL + _COVERAGE + "SELECT " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _COUNTERS) + " FROM cover",
    ),
    "coverage_by_document": (coverage_by_document, GRAPH_SQL + _COVERAGE + "SELECT * FROM cover"),
    "coverage_violations": (
        coverage_violations,
        GRAPH_SQL + _COVERAGE
        + "SELECT count(*) AS violations FROM cover WHERE projected_source_relation_count + excluded_relation_count"
        + " + collapsed_self_relation_count <> source_relation_count",
    ),
    "bounded_snapshot_nodes": (
        bounded_snapshot_nodes,
        GRAPH_SQL + _SNAPSHOT
        + """SELECT canonical_id, canonical_name, source_entity_count, coalesce(degree, 0) AS degree
        FROM kept JOIN canonicals USING (canonical_id)
        JOIN (SELECT canonical_id, count(*) AS source_entity_count FROM accepted GROUP BY canonical_id) USING (canonical_id)
        LEFT JOIN (SELECT canonical_id, count(*) AS degree FROM (""" + _ENDS.format("shown") + """) GROUP BY canonical_id)
        USING (canonical_id)""",
    ),
    "bounded_snapshot_totals": (
        bounded_snapshot_totals,
        GRAPH_SQL + _SNAPSHOT
        + """SELECT *, total_node_count > 200 AS node_truncated, total_edge_count > 400 AS edge_truncated FROM (
          SELECT (SELECT count(DISTINCT canonical_id) FROM accepted) AS total_node_count,
                 (SELECT count(*) FROM among) AS total_edge_count,
                 (SELECT CAST(coalesce(sum(support_count), 0) AS BIGINT) FROM shown) AS evidence_count)""",
    ),
    "canonical_search": (
        canonical_search,
        GRAPH_SQL + _DEGREES
        + """, hits AS (
          SELECT canonical_id FROM canonicals c WHERE canonical_id IN (SELECT canonical_id FROM accepted)
            AND (contains(lower(canonical_name), 'ring')
                 OR EXISTS (SELECT 1 FROM accepted a WHERE a.canonical_id = c.canonical_id AND contains(lower(a.name), 'ring')))
          ORDER BY canonical_id LIMIT 5
        )
        SELECT canonical_id, canonical_name, c.entity_type, count(DISTINCT document_id) AS document_count,
               count(*) AS source_entity_count, CAST(sum(coalesce(mention_count, 0)) AS BIGINT) AS mention_count,
               coalesce(any_value(degree), 0) AS degree
        FROM hits JOIN accepted USING (canonical_id) JOIN canonicals c USING (canonical_id) LEFT JOIN degrees USING (canonical_id)
        GROUP BY ALL""",
    ),
    "scoped_search": (
        scoped_search,
        GRAPH_SQL + _SCOPED
        + """, hits AS (
          SELECT canonical_id FROM canonicals c WHERE canonical_id IN (SELECT canonical_id FROM in_scope)
            AND (contains(lower(canonical_name), 'ring')
                 OR EXISTS (SELECT 1 FROM in_scope a WHERE a.canonical_id = c.canonical_id AND contains(lower(a.name), 'ring')))
          ORDER BY canonical_id LIMIT 5
        ), degrees AS (
          SELECT canonical_id, count(*) AS degree FROM (SELECT source_canonical_id AS canonical_id FROM scoped_edges UNION ALL SELECT target_canonical_id FROM scoped_edges) GROUP BY 1
        )
        SELECT canonical_id, canonical_name, count(DISTINCT document_id) AS document_count, count(*) AS source_entity_count,
               CAST(sum(coalesce(mention_count, 0)) AS BIGINT) AS mention_count, coalesce(any_value(degree), 0) AS degree
        FROM hits JOIN in_scope USING (canonical_id) JOIN canonicals c USING (canonical_id) LEFT JOIN degrees USING (canonical_id) GROUP BY ALL""",
    ),
    "scoped_snapshot_totals": (
        scoped_snapshot_totals,
        GRAPH_SQL + _SCOPED
        + """, kept AS (SELECT canonical_id FROM in_scope GROUP BY canonical_id ORDER BY canonical_id LIMIT 200
        ), among AS (
          SELECT * FROM scoped_edges WHERE source_canonical_id IN (SELECT canonical_id FROM kept) AND target_canonical_id IN (SELECT canonical_id FROM kept)
        ), shown AS (SELECT * FROM among ORDER BY support_count DESC, edge_id LIMIT 400)
        SELECT *, total_node_count > 200 AS node_truncated, total_edge_count > 400 AS edge_truncated FROM (
          SELECT (SELECT count(DISTINCT canonical_id) FROM in_scope) AS total_node_count, (SELECT count(*) FROM among) AS total_edge_count,
                 (SELECT CAST(coalesce(sum(support_count), 0) AS BIGINT) FROM shown) AS evidence_count)""",
    ),
    "scoped_coverage": (
        scoped_coverage,
        GRAPH_SQL + _SCOPED + _COVERAGE
        + """, near AS (
          SELECT id FROM (SELECT target_canonical_id AS id FROM scoped_edges WHERE source_canonical_id = (SELECT id FROM center)
            UNION SELECT source_canonical_id FROM scoped_edges WHERE target_canonical_id = (SELECT id FROM center)) ORDER BY id LIMIT 19
        ), members AS (SELECT id FROM near UNION SELECT id FROM center),
        inside AS (SELECT support_count, edge_id FROM scoped_edges WHERE source_canonical_id IN (SELECT id FROM members) AND target_canonical_id IN (SELECT id FROM members)
          ORDER BY support_count DESC, edge_id LIMIT 30)
        SELECT """ + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _COUNTERS)
        + """, (SELECT count(*) FROM members) AS members, (SELECT CAST(coalesce(sum(support_count), 0) AS BIGINT) FROM inside) AS support
        FROM cover WHERE document_id IN (SELECT document_id FROM urgent)""",
    ),
    "canonical_degrees": (canonical_degrees, GRAPH_SQL + _DEGREES + "SELECT * FROM degrees"),
}
