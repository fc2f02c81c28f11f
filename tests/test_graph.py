"""Graph operators against brute force on random graphs."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docweave.operators import graph as G
from docweave.operators import projection as P

EDGES = "source_canonical_id string, target_canonical_id string, type string, support_count int, edge_id string"


def random_edges(n, m, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)]
    return [(a, b, "t", rng.randint(1, 4), f"e{i:03d}") for i, (a, b) in enumerate(pairs) if a != b]


def test_components(spark):
    edges = random_edges(60, 45, 5)
    root = {f"n{i:02d}": f"n{i:02d}" for i in range(60)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, *_ in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    nodes = spark.createDataFrame([(n,) for n in root], "id string")
    pairs = spark.createDataFrame([(a, b) for a, b, *_ in edges], "a string, b string")
    assert {r.id: r.component for r in G.component_labels(nodes, pairs).collect()} == {n: find(n) for n in root}
    chain = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(70)], "a string, b string")
    ends = spark.createDataFrame([(f"{i:03d}",) for i in range(71)], "id string")
    assert {r.component for r in G.component_labels(ends, chain).collect()} == {"000"}


def bfs_model(near, center, depth, limit):
    chosen, frontier, cut = [center], [center], False
    for _ in range(depth):
        fresh = sorted({m for n in frontier for m in near.get(n, ())} - set(chosen))
        room = max(limit - len(chosen), 0)
        cut = cut or len(fresh) > room
        frontier = fresh[:room]
        chosen += frontier
        if not frontier:
            break
        if len(chosen) >= limit:
            cut = cut or any(m not in chosen for n in frontier for m in near.get(n, ()))
            break
    return set(chosen), cut


@pytest.mark.parametrize("depth, limit", [(1, 3), (2, 4), (3, 100)])
def test_bounded_bfs(spark, depth, limit):
    edges = random_edges(40, 50, 8)
    near = {}
    for a, b, *_ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    names = [f"n{i:02d}" for i in range(40)]
    nodes = spark.createDataFrame([(n,) for n in names], "canonical_id string")
    centers = spark.createDataFrame([(n,) for n in [*names, "missing"]], "center string")
    members, kept, summary = G.bounded_bfs(nodes, spark.createDataFrame(edges, EDGES), centers, depth, limit, 2)
    got = {}
    for row in members.collect():
        got.setdefault(row.center, set()).add(row.canonical_id)
    flags = {r.center: r.truncated for r in summary.collect()}
    shown = {}
    for row in kept.collect():
        shown.setdefault(row.center, []).append((-row.support_count, row.edge_id))
    assert set(got) == set(names)
    for name in names:
        chosen, cut = bfs_model(near, name, depth, limit)
        inside = sorted((-s, i) for a, b, _, s, i in edges if a in chosen and b in chosen)
        assert got[name] == chosen
        assert flags[name] == (cut or len(inside) > 2)
        assert sorted(shown.get(name, [])) == inside[:2]


def trails(relations, center, depth, wanted):
    """Every path that uses a relation once; node -> whether a wanted type was met."""
    found = {}

    def walk(node, used, hit, left):
        if node != center:
            found[node] = found.get(node, False) or hit
        if left:
            for index, (s, t, kind, _c, _e) in enumerate(relations):
                if index not in used and node in (s, t):
                    walk(t if node == s else s, used | {index}, hit or kind == wanted, left - 1)

    walk(center, frozenset(), False, depth)
    return found


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_local_subgraph_with_type(spark, depth):
    rng = random.Random(4)
    names = [f"e{i}" for i in range(9)]
    relations = []
    for i in range(11):
        a, b = rng.sample(names, 2)
        relations.append((a, b, rng.choice(["x", "y"]), rng.random(), f"c{i}"))
    entities = spark.createDataFrame([(n, n, "T", "d") for n in names], "entity_id string, name string, entity_type string, document_id string")
    facts = spark.createDataFrame(relations, "source_id string, target_id string, type string, confidence double, evidence_chunk_id string")
    for wanted in ("x", None):
        nodes, edges, summary = G.local_subgraph(entities, facts, "e0", depth, 50, type=wanted)
        found = trails(relations, "e0", depth, wanted)
        want = {n for n, hit in found.items() if hit or wanted is None} | {"e0"}
        assert {r.entity_id for r in nodes.collect()} == want
        inside = [r for r in relations if r[0] in want and r[1] in want and (wanted is None or r[2] == wanted)]
        assert edges.count() == len(inside) and not summary.first().truncated
    nodes, _, summary = G.local_subgraph(entities, facts, "e0", 4, 2)
    assert nodes.count() == 2 and summary.first().truncated


def community_model(edges):
    """The rounds restated over plain dictionaries: (labels, rounds, modularity)."""
    w = defaultdict(Counter)
    for a, b, _, s, _i in edges:
        if a != b:
            w[a][b] += s
            w[b][a] += s
    own = {n: sum(w[n].values()) for n in w}
    whole = sum(own.values())

    def loads(label):
        load = Counter()
        for n in w:
            load[label[n]] += own[n]
        return load

    def quality(label):
        inside = sum(x for n in w for m, x in w[n].items() if label[n] == label[m])
        return inside * whole - sum(x * x for x in loads(label).values())

    label, turn = {n: n for n in w}, 0
    while True:
        load, moves = loads(label), {}
        for n in w:
            pull = Counter({label[n]: 0})
            for m, x in w[n].items():
                pull[label[m]] += x
            score = {o: x * whole - (load[o] - (own[n] if o == label[n] else 0)) * own[n] for o, x in pull.items()}
            choice = min(score, key=lambda o: (-score[o], o))
            if score[choice] > score[label[n]]:
                moves[n] = (choice, score[choice] - score[label[n]])
        if not moves:
            return label, turn, quality(label) / whole**2
        half = {n: moves[n][0] if n in moves and hashlib.md5(f"{n}:{turn}".encode()).hexdigest() < "8" else label[n] for n in w}
        if quality(half) > quality(label):
            label = half
        else:
            first = {}
            for n, (choice, gain) in sorted(moves.items(), key=lambda m: (-m[1][1], m[0])):
                first.setdefault(label[n], n)
                first.setdefault(choice, n)
            after = {n: moves[n][0] if n in moves and first[label[n]] == n == first[moves[n][0]] else label[n] for n in w}
            assert quality(after) > quality(label)
            label = after
        turn += 1


def test_communities_match_the_rounds(spark):
    edges = [e for part in range(4) for e in [(f"{part}{a}", f"{part}{b}", t, s, f"{part}{i}") for a, b, t, s, i in random_edges(14, 22, part)]]
    names = sorted({n for e in edges for n in e[:2]})
    nodes = spark.createDataFrame([(n, n, 1) for n in names], "canonical_id string, canonical_name string, source_entity_count int")
    found = G.find_communities(nodes, spark.createDataFrame(edges, EDGES))
    label, rounds, modularity = community_model(edges)
    assert {r.canonical_id: r.label for r in found.members.collect()} == label
    assert found.rounds == rounds and abs(found.modularity - modularity) < 1e-12 and modularity > 0.3


def test_long_chain_comes_to_rest(spark):
    """A chain of 60 nodes: no round bound cuts the search off, and no single move would still gain."""
    edges = [(f"n{i:02d}", f"n{i + 1:02d}", "t", 1, f"e{i}") for i in range(59)]
    nodes = spark.createDataFrame([(f"n{i:02d}", "x", 1) for i in range(60)], "canonical_id string, canonical_name string, source_entity_count int")
    found = G.find_communities(nodes, spark.createDataFrame(edges, EDGES))
    label, rounds, _ = community_model(edges)
    assert {r.canonical_id: r.label for r in found.members.collect()} == label and found.rounds == rounds


def test_small_graphs_move_in_one_task(spark, monkeypatch):
    """The rounds on arrays and those of joins take the same steps; on arrays no round writes a table."""
    edges = [e for part in range(3) for e in [(f"{part}{a}", f"{part}{b}", t, s, f"{part}{i}") for a, b, t, s, i in random_edges(9, 14, part + 7)]]
    names = sorted({n for e in edges for n in e[:2]})
    nodes = spark.createDataFrame([(n, n, 1) for n in names], "canonical_id string, canonical_name string, source_entity_count int")
    stored, ends = [], []
    real = G.store
    monkeypatch.setattr(G, "store", lambda df, name: stored.append(name) or real(df, name))
    for most in (G.ONE_TASK_PAIRS, 0):
        monkeypatch.setattr(G, "ONE_TASK_PAIRS", most)
        found = G.find_communities(nodes, spark.createDataFrame(edges, EDGES))
        ends.append((sorted(map(tuple, found.members.collect())), found.rounds, found.modularity))
        if most:
            assert stored == ["pairs", "labels"]
    assert ends[0] == ends[1] and ends[0][1] > 1


def test_communities_of_no_edges(spark):
    nodes = spark.createDataFrame([("a", "A", 1)], "canonical_id string, canonical_name string, source_entity_count int")
    members, summary = G.topic_communities(nodes, spark.createDataFrame([], EDGES), 20)
    assert members.count() == 0 and summary.count() == 0


def test_bridge_graph_has_two_communities(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")]
    edges = spark.createDataFrame([(a, b, "t", 1 if (a, b) == ("c", "x") else 3, a + b) for a, b in pairs], EDGES)
    nodes = spark.createDataFrame([(c, c, 1) for c in "abcxyzq"], "canonical_id string, canonical_name string, source_entity_count int")
    members, summary = G.topic_communities(nodes, edges, 20)
    rows = summary.collect()
    assert [(r.node_count, r.edge_count, r.total_support, r.representative_id) for r in rows] in (
        [(3, 3, 9, "c"), (3, 3, 9, "x")], [(3, 3, 9, "x"), (3, 3, 9, "c")],
    )
    assert members.where("canonical_id = 'q'").count() == 0


def test_self_edges_and_isolated(spark):
    edges = spark.createDataFrame([("a", "a", "t", 1, "aa"), ("a", "b", "t", 1, "ab")], EDGES)
    nodes = spark.createDataFrame([("a", "A", 1), ("b", "B", 2), ("c", "C", 3)], "canonical_id string, canonical_name string, source_entity_count int")
    assert sorted((r.other_id, r.direction) for r in G.node_relations(edges, nodes, "a").collect()) == [
        ("a", "incoming"), ("a", "outgoing"), ("b", "outgoing"),
    ]
    assert [r.canonical_id for r in G.rank_nodes(nodes, edges).collect()] == ["a", "b", "c"]
    shown, _ = G.hide_isolated(nodes, edges)
    assert {r.canonical_id for r in shown.collect()} == {"a", "b"}


# --- projection --------------------------------------------------------------------


def support_graph(spark):
    """Two documents that support one edge, and rows the evidence gates must drop."""
    t = {
        "documents": spark.createDataFrame([("a",), ("b",)], "document_id string"),
        "chunks": spark.createDataFrame([("a#0", "a"), ("b#0", "b"), ("b#1", "b")], "chunk_id string, document_id string"),
        "entities": spark.createDataFrame(
            [
                ("a::s", "a", "Alpha", "T", 1, None), ("a::t", "a", "Beta", "T", 1, None),
                ("b::s", "b", "A-Prime", "T", 1, None), ("b::t", "b", "Beta", "T", 1, None),
                ("b::r", "b", "Review", "T", 1, "review"), ("b::f", "b", "Forged", "T", 1, None),
            ],
            "entity_id string, document_id string, name string, entity_type string, mention_count int, resolution_status string",
        ),
        "mentions": spark.createDataFrame(
            [("a#0", "a::s"), ("a#0", "a::t"), ("b#0", "b::s"), ("b#0", "b::t"), ("b#1", "b::s"), ("b#0", "b::r"), ("b#0", "b::f")],
            "chunk_id string, entity_id string",
        ),
        "canonicals": spark.createDataFrame([("A", "Alpha", "T"), ("B", "Beta", "T"), ("F", "Forged", "T")], "canonical_id string, canonical_name string, entity_type string"),
        "resolutions": spark.createDataFrame(
            [("a::s", "A", "a", "a#0"), ("a::t", "B", "a", "a#0"), ("b::s", "A", "b", "b#0"), ("b::t", "B", "b", "b#0"), ("b::f", "F", "b", "a#0")],
            "entity_id string, canonical_id string, source_document_id string, evidence_chunk_id string",
        ),
        "relations": spark.createDataFrame(
            [
                ("a::s", "a::t", "使用", 0.9, "a#0"), ("b::s", "b::t", "使用", 0.7, "b#0"), ("b::s", "b::t", "使用", 0.7, "b#1"),
                ("b::s", "b::t", "使用", 0.2, "b#0"), ("b::s", "b::t", "使用", None, "b#0"), ("b::r", "b::t", "使用", 0.9, "b#0"),
                ("b::f", "b::t", "使用", 0.9, "b#0"), ("a::s", "b::t", "使用", 0.9, "a#0"), ("b::s", "b::s", "属于", 0.9, "b#0"),
            ],
            "source_id string, target_id string, type string, confidence double, evidence_chunk_id string",
        ),
    }
    return t, P.live_mentions(t["mentions"], t["chunks"], t["documents"])


def test_projection_counts_only_evidenced_facts(spark):
    t, live = support_graph(spark)
    accepted = P.accepted_resolutions(t["entities"], t["resolutions"], live)
    assert {r.entity_id for r in accepted.collect()} == {"a::s", "a::t", "b::s", "b::t"}
    facts = P.eligible_relations(accepted, t["relations"], live)
    edge = P.canonical_edges(facts, evidence_limit=1).collect()
    assert [(e.source_canonical_id, e.target_canonical_id, e.support_count, e.confidence, e.evidence_truncated) for e in edge] == [
        ("A", "B", 2, 0.9, True)
    ]
    assert edge[0].evidence[0].chunk_id == "a#0"
    counters = P.coverage(t["entities"], t["resolutions"], t["relations"], live)
    row = counters.first().asDict()
    assert row == {
        "source_entity_count": 6, "accepted_source_entity_count": 4, "review_source_entity_count": 1,
        "unresolved_source_entity_count": 0, "source_relation_count": 9, "projected_source_relation_count": 2,
        "excluded_relation_count": 6, "collapsed_self_relation_count": 1,
    }
    assert P.check_coverage_partition(counters).count() == 0
    nodes = {r.canonical_id: r for r in P.canonical_nodes(accepted, t["canonicals"], alias_limit=1).collect()}
    assert (nodes["A"].source_entity_count, nodes["A"].document_count, nodes["A"].aliases, nodes["A"].alias_count) == (2, 2, ["A-Prime"], 2)
    assert nodes["A"].aliases_truncated and not nodes["B"].aliases_truncated


def test_snapshot_prefers_the_centre(spark):
    t, live = support_graph(spark)
    accepted = P.accepted_resolutions(t["entities"], t["resolutions"], live)
    edges = P.canonical_edges(P.eligible_relations(accepted, t["relations"], live))
    nodes = P.canonical_nodes(accepted, t["canonicals"])
    kept, shown, totals = P.bounded_snapshot(nodes, edges, 1, 5, preferred="B")
    assert [r.canonical_id for r in kept.collect()] == ["B"] and shown.count() == 0
    assert totals.first().total_node_count == 2 and totals.first().node_truncated


def test_components_of_a_long_chain(spark):
    n = 2000
    nodes = spark.range(n)
    edges = spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b")
    assert G.component_labels(nodes, edges).select("component").distinct().count() == 1
