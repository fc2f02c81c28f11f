"""Vector recall, reranking, paths and answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import answers as A
from docweave.operators import neighbors as N
from docweave.operators import retrieval as R
from test_graph import support_graph
from docweave.operators import projection as P


def vectors(spark, n, dim, seed, column):
    data = np.random.default_rng(seed).normal(size=(n, dim)).round(1)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(data)]
    return data, spark.createDataFrame(rows, f"{column} bigint, embedding array<float>")


def best_by_hand(q, c, k):
    def unit(m):
        m = m.astype("float32").astype("float64")
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    scores = np.round(unit(q) @ unit(c).T, 12)
    return {(i, j): r for i in range(len(q)) for r, j in enumerate(sorted(range(len(c)), key=lambda j: (-scores[i, j], j))[:k], 1)}


@pytest.mark.parametrize("cell_rows, block_floats, query_rows", [(1000, 1 << 20, 1024), (6, 1 << 20, 3), (6, 1, 1024)])
def test_exact_topk_by_cells(spark, monkeypatch, cell_rows, block_floats, query_rows):
    """One cell, many cells, and cells in blocks give the same rows, ties and zero vectors included."""
    monkeypatch.setattr(N, "BLOCK_FLOATS", block_floats)
    monkeypatch.setattr(N, "QUERY_ROWS", query_rows)
    q, queries = vectors(spark, 9, 3, 1, "query_id")
    c, chunks = vectors(spark, 300, 3, 2, "chunk_id")
    c[7], c[8], c[20:60] = 0, c[9], c[61]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(c)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>").repartition(5)
    got = R.vector_topk(queries, chunks, 4, cell_rows=cell_rows).collect()
    assert {(r.query_id, r.chunk_id): r["rank"] for r in got} == best_by_hand(q, c, 4)


def test_exact_search_opens_few_cells(spark):
    """Clustered vectors: bounds refuse most blocks, and probing a few cells finds nearly all."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(24, 16)) * 4
    data = centers[rng.integers(0, 24, 3000)] + rng.normal(size=(3000, 16)) * 0.3
    chunks = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], "chunk_id bigint, embedding array<float>")
    queries = chunks.where("chunk_id % 30 = 0").withColumnRenamed("chunk_id", "query_id")
    index = N.build_index(chunks, 16, 64)
    assert len(index.cells.centroids) == 46 and int(index.cells.sizes.sum()) == 3000
    exact = N.search_index(queries, index, 5)
    assert {(r.query_id // 30, r.chunk_id): r["rank"] for r in exact.collect()} == best_by_hand(data[::30], data, 5)
    least = exact.where("rank = 5").select("query_id", F.col("score").alias("least"))
    opened = N._opened(queries.join(least, "query_id").select("query_id", "embedding", "least"), index.cells, 2, 5, True)
    assert opened.count() < 0.2 * 100 * int((index.cells.parts > 0).sum())
    recall = N.measured_recall(N.search_index(queries, index, 5, probes=4, exact=False), exact).first().recall
    assert recall >= 0.95


def test_unsound_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [1.0, 1.0, 0.0]), (8, [0.0, 2.0]), (None, [3.0, 4.0]), (9, [1e38, 1e38])]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0, 5.0]), (3, [nan]), (4, None)], "query_id bigint, embedding array<float>")
    got = {(r.query_id, r.chunk_id): round(r.score, 6) for r in R.vector_topk(queries, chunks, 9).collect()}
    assert got == {(1, 1): 1.0, (1, 8): 0.0, (1, 9): 0.707107, (2, 7): 0.0}
    assert R.vector_topk(queries.limit(0), chunks, 3).count() == 0 == R.vector_topk(queries, chunks.limit(0), 3).count()


def test_paths_of_a_context(spark):
    """Limited contexts hold the first of the ranked lines; the rows hold all of them."""
    rows = [("q", f"p{i:03d}", f"s{i}", "uses", "t", 1 + i * 7 % 40) for i in range(200)] + [("z", "p", "a", "b", "c", 3)]
    paths = spark.createDataFrame(rows, "query_id string, path_id string, source_name string, type string, target_name string, support_count bigint")
    hits = spark.createDataFrame([("q", 1, "c", "d", "text", 0, 4, None, [])], "query_id string, citation_index int, chunk_id string, document_id string, text string, char_start int, char_end int, page int, heading_path array<string>")
    want = [f"{r[2]} -[uses]-> t" for r in sorted(rows[:-1], key=lambda r: (-r[5], r[1]))]
    ranked = {r.path_rank: r.line for r in A.ranked_paths(paths).where("query_id = 'q'").collect()}
    assert [ranked[i] for i in range(1, 201)] == want
    for limit, lines in ((None, want), (7, want[:7])):
        context = A.build_context(hits, paths, limit).first().context
        assert context.partition(A.PATH_HEAD + "\n")[2].split("\n") == lines


def test_rerank_falls_back(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("p", "a", 1), ("p", "b", 2)], "query_id string, chunk_id string, rank int")
    scored = spark.createDataFrame([("q", "a", 0.1), ("q", "b", 0.9), ("p", "a", None), ("p", "b", 0.9)], "query_id string, chunk_id string, relevance double")
    rows = R.number_evidence(R.rerank(hits, scored, 1)).collect()
    assert {(r.query_id, r.chunk_id) for r in rows} == {("q", "b"), ("p", "a")}


def test_expansion_and_merge(spark):
    t, live = support_graph(spark)
    accepted = P.accepted_resolutions(t["entities"], t["resolutions"], live)
    facts = P.eligible_relations(accepted, t["relations"], live, min_confidence=None)
    usable = R.expandable_facts(facts, accepted, t["canonicals"])
    seeds = R.expand_seed_canonicals(spark.createDataFrame([("q", "b#1"), ("z", "nope")], "query_id string, chunk_id string"), accepted, live)
    assert [(r.query_id, r.canonical_id) for r in seeds.collect()] == [("q", "A")]
    paths = R.expand_relations(seeds, usable)
    row = paths.first()
    # Low and missing confidence count here: one proof per chunk and entity pair.
    assert (row.source_name, row.target_name, row.support_count, row.evidence_chunk_id) == ("Alpha", "Beta", 2, "a#0")
    assert row.provenance[1].confidence == 0.7
    merged = R.merge_paths(paths.unionByName(paths)).first()
    assert (merged.path_id, merged.support_count, merged.provenance_truncated) == (row.path_id, 2, False)


def test_context_and_finalize(spark):
    hits = spark.createDataFrame(
        [("q", 1, "c1", "d", "text one", 0, 8, None, []), ("q", 2, "c2", "d", "y" * 200, 0, 200, 3, ["A"])],
        "query_id string, citation_index int, chunk_id string, document_id string, text string, char_start int, char_end int, page int, heading_path array<string>",
    )
    paths = spark.createDataFrame([("q", "p", "S", "uses", "T", 2)], "query_id string, path_id string, source_name string, type string, target_name string, support_count int")
    row = A.build_context(hits, paths).first()
    assert row.context == "【文档片段】\n[1] text one\n[2] " + "y" * 200 + "\n\n【相关实体关系】\nS -[uses]-> T"
    assert row.citations[1].location == "第3页 · A · 字符 0-200" and len(row.citations[1].snippet) == 120
    texts = [("a", "x [2] y [1][01]"), ("b", "x [2]"), ("c", "x [1] [9]"), ("d", "x [9]"), ("e", None)]
    answers = spark.createDataFrame(texts, "query_id string, text string").crossJoin(A.build_context(hits).select("citations"))
    rows = {r.query_id: r for r in A.finalize_answers(answers).collect()}
    assert {k: (r.confidence, [c["index"] for c in r.citations]) for k, r in rows.items()} == {
        "a": ("high", [1, 2]), "b": ("medium", [2]), "c": ("medium", [1]), "d": ("low", []), "e": ("low", []),
    }
    assert rows["d"].text == A.NO_EVIDENCE_ANSWER and rows["c"].text == "x [1] "
    usage = {(r.query_id, r.marker): r.valid for r in A.marker_usage(answers).collect()}
    assert usage[("c", "9")] is False and usage[("a", "1")] is True


def test_pool_keeps_first_position_and_last_content(spark):
    hits = spark.createDataFrame([("q", "a", 1, "old"), ("q", "b", 2, "b"), ("q", "a", 3, "new")], "query_id string, chunk_id string, pos int, text string")
    pool = R.evidence_pool(hits)
    assert sorted((r.chunk_id, r.pos, r.text) for r in pool.collect()) == [("a", 1, "new"), ("b", 2, "b")]
    asked = spark.createDataFrame([("q", " a "), ("q", "x"), ("q", " ")], "query_id string, chunk_id string")
    valid, counts = R.valid_expansion_ids(asked, pool)
    assert [r.chunk_id for r in valid.collect()] == ["a"] and counts.first().ignored_count == 1


def test_prompts(spark):
    rows = spark.createDataFrame(
        [("a", "q", "ctx", None, None), ("b", "q", "ctx", "standalone", [("user", "hi")])],
        "query_id string, question string, context string, retrieval_question string, history array<struct<role:string,content:string>>",
    )
    built = {r.query_id: r.messages for r in A.build_prompts(rows).collect()}
    assert [m.role for m in built["a"]] == ["system", "user"] and [m.role for m in built["b"]] == ["system", "user", "user"]
    assert "standalone" in built["b"][2].content and A.HISTORY_GUARD in built["b"][0].content


def test_vectors_without_clusters_are_sent_by_slabs(spark):
    """A query goes to each slab once, however many cells and bands it opens there (F14, F39)."""
    rng = np.random.default_rng(5)
    data = rng.normal(size=(6000, 16)).round(2)
    chunks = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], "chunk_id bigint, embedding array<float>")
    queries = chunks.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    index = N.build_index(chunks, 16, 64)
    exact = N.search_index(queries, index, 5).collect()
    assert {(r.query_id // 20, r.chunk_id): r["rank"] for r in exact} == best_by_hand(data[::20], data, 5)
    opened = N._opened(queries.withColumn("least", F.lit(-4.0)), index.cells, 2, 5, True)
    assert opened.count() <= 2 * 300
