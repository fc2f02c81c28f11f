"""Injected models, whole pipelines, metrics and stored tables."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docweave.functions import models as M
from docweave.operators import metrics as Q
from docweave.plans.answering import answer_questions
from docweave.plans.ingest import ingest_documents
from docweave.sources import tables as S

TYPES = ("技术",)
# The fakes below run on the workers, which cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def embed(texts):
    return [[float(len(t)), 1.0, float(t.count("React"))] for t in texts]


def chat(messages):
    body = messages[-1]["content"]
    if body.startswith("chunk_id"):
        chunk = body.split('"')[1]
        proof = {"chunk_id": chunk, "text": "t"}
        names = [n for n in ("React", "Vue") if n in body]
        entities = [{"name": n, "type": "技术", "evidence": proof} for n in names]
        relations = [{"source": "React", "target": "Vue", "type": "对比", "confidence": 0.8, "evidence": proof}] if len(names) == 2 else []
        return json.dumps({"entities": entities, "relations": relations})
    return "React beats Vue [1]. Nothing [7]." if "React" in body else "no"


def empty_tables(spark):
    return {
        "documents": spark.createDataFrame([], "document_id string, name string, doc_type string, chunk_count int"),
        "chunks": spark.createDataFrame([], "chunk_id string, document_id string, embedding array<float>"),
        "entities": spark.createDataFrame([], "entity_id string, document_id string, name string, entity_type string, normalized_name string, description string, mention_count int, resolution_status string"),
        "mentions": spark.createDataFrame([], "chunk_id string, entity_id string"),
        "relations": spark.createDataFrame([], "source_id string, target_id string, type string, confidence double, evidence_chunk_id string"),
        "resolutions": spark.createDataFrame([], "entity_id string, canonical_id string, method string, score double, reason string, source_document_id string, evidence_chunk_id string"),
        "canonicals": spark.createDataFrame([], "canonical_id string, canonical_name string, normalized_name string, entity_type string, resolution_version string"),
    }


def test_ingest_and_answer(spark):
    docs = spark.createDataFrame(
        [("d1", "one.md", "markdown", "# T\n\nReact and Vue.\n\n```json\n{}\n```"), ("d2", "two.txt", "text", "Only React here.")],
        "document_id string, name string, doc_type string, raw_text string",
    )
    t = ingest_documents(empty_tables(spark), docs, embed, chat, 3, TYPES, base_delay=0.0)
    assert {r.entity_id for r in t["entities"].collect()} == {"d1::react", "d1::vue", "d2::react"}
    assert t["canonicals"].count() == 2 and t["relations"].count() == 1 and t["failures"].count() == 0
    assert {r.method for r in t["decisions"].collect()} == {"bootstrap", "exact"}
    questions = spark.createDataFrame([("q", "How does React compare?")], "query_id string, question string")
    rows = answer_questions(questions, t, embed, lambda q, texts: [float("Vue" in x) for x in texts], chat, 3).collect()
    assert rows[0].text == "React beats Vue [1]. Nothing ." and rows[0].confidence == "medium"
    assert [c.document_id for c in rows[0].citations] == ["d1"]


def test_model_failures_are_rows(spark):
    chunks = spark.createDataFrame(
        [("d", "d#0", 0, "ok", "normal", None), ("d", "d#1", 1, "bad", "normal", None), ("d", "d#2", 2, "skip", "skip", None)],
        "document_id string, chunk_id string, chunk_index int, text string, extraction_policy string, language string",
    )

    def flaky(messages):
        if "bad" in messages[1]["content"]:
            raise ValueError("no service")
        return '{"entities": [], "relations": []}'

    rows = {r.chunk_id: r for r in M.extract_candidates(chunks, flaky, max_attempts=2, base_delay=0.0).collect()}
    assert set(rows) == {"d#0", "d#1"} and rows["d#0"].error is None and rows["d#1"].error == "ValueError: no service"
    with pytest.raises(Exception, match="embedding size"):
        M.embed_column(chunks, "text", embed, 4).collect()
    pairs = spark.createDataFrame([("q", "a", "x", "t1"), ("q", "b", "boom", "t2")], "query_id string, chunk_id string, question string, text string")

    def scorer(question, texts):
        if question == "boom":
            raise RuntimeError("down")
        return [0.5] * len(texts)

    assert {r.chunk_id: r.relevance for r in M.score_pairs(pairs, scorer).collect()} == {"a": 0.5, "b": None}
    questions = spark.createDataFrame(
        [("a", "q1", []), ("b", "q2", [("user", "h")]), ("c", "q3", [("user", "fail")])],
        "query_id string, question string, history array<struct<role:string,content:string>>",
    )

    def rewrite(messages):
        if messages[1]["content"] == "fail":
            raise RuntimeError("down")
        return "  standalone "

    out = {r.query_id: r.retrieval_question for r in M.rewrite_questions(questions, rewrite).collect()}
    assert out == {"a": "q1", "b": "standalone", "c": "q3"}


def test_metrics(spark):
    nested = "array<struct<entity_id:string,name:string,accepted:boolean,matched_gold:boolean,reviewed_correct:boolean,evidence_present:boolean>>"
    rel = "array<struct<relation_id:string,source_entity_id:string,target_entity_id:string,accepted:boolean,matched_gold:boolean,semantically_correct:boolean,evidence_present:boolean,confidence:double>>"
    quality = spark.createDataFrame(
        [
            ("s1", (3, 1), [("hub", "系统", True, True, True, True), ("a", "Neo4j", True, False, None, True), ("b", "b", True, False, False, False), ("x", "x", False, False, None, True)],
             [("r1", "hub", "a", True, True, True, True, 0.9), ("r2", "hub", "b", True, True, None, True, 0.5)]),
            ("s2", (2, 2), [("c", " neo4j ", True, False, True, True), ("d", "d", True, True, None, True)], [("r3", "hub", "c", False, False, None, True, 0.9), ("r3", "c", "ghost", True, False, None, True, 0.1)]),
        ],
        f"sample_id string, review_scope struct<accepted_entity_population:int,accepted_relation_population:int>, candidate_entities {nested}, candidate_relations {rel}",
    )
    e, r = Q.candidates_of(quality, "entities"), Q.candidates_of(quality, "relations")
    assert tuple(Q.entity_precision(e).first())[:2] == (2, 3)
    assert tuple(Q.relation_precision(r).first()) == (1, 1, 1.0)
    assert tuple(Q.provenance_completeness(e, r).first())[:2] == (7, 8)
    assert tuple(Q.review_coverage(e, "reviewed_correct", quality.select("review_scope.*"), "accepted_entity_population").first())[:2] == (3, 5)
    assert [x.entity_id for x in Q.review_candidates(e, "entity_id", "reviewed_correct").collect()] == ["a"]
    problems = {(x.sample_id, x.problem) for x in Q.check_fixtures(quality).collect()}
    assert {("s2", "duplicate relation id"), ("s2", "relation references an unknown entity"), ("s1", "declared relation population is too small")} <= problems
    kept = r.where("accepted AND sample_id = 's1'")
    shape = Q.structure_diagnostics(e.where("accepted"), kept, 0.6, ["系统"], 2)
    assert {x.entity_id for x in shape["isolated"].collect()} == {"c", "d"}
    assert {x.entity_id for x in shape["degree_one"].collect()} == {"a", "b"}
    assert {x["size"]: x.components for x in shape["component_sizes"].collect()} == {3: 1, 1: 2}
    assert [x.name_key for x in shape["duplicate_names"].collect()] == ["neo4j"]
    assert [x.entity_id for x in shape["generic_hubs"].collect()] == ["hub"]
    nothing = Q.entity_precision(e.limit(0)).first()
    assert nothing.denominator == 0 and nothing.rate is None


def test_recall_and_answers(spark):
    docs = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "document_id string, failed boolean")
    gold = spark.createDataFrame([("a", "X "), ("a", "x"), ("a", "y"), ("b", "z")], "document_id string, name string")
    found = spark.createDataFrame([("a", "x"), ("b", "z"), ("a", "w")], "document_id string, name string")
    per = Q.entity_recall(docs, gold, found)
    assert {x.document_id: (x.hit_count, x.gold_count) for x in per.collect()} == {"a": (1, 2), "b": (0, 1), "c": (0, 0)}
    total = Q.recall_summary(per).first()
    assert (round(total.pooled, 6), round(total.macro, 6)) == (0.333333, 0.166667)
    assert tuple(Q.recall_summary(per.limit(0)).first()) == (0.0, 0.0)
    answers = spark.createDataFrame([("p", "One [1]. Two."), ("q", "根据现有资料无法回答。"), ("r", "")], "query_id string, text string")
    assert {x.query_id: x.hallucination_rate for x in Q.hallucination_rates(answers).collect()} == {"p": 0.5, "q": 0.0, "r": 0.0}


def test_stored_tables(spark, tmp_path):
    old = spark.createDataFrame([("d#0", "d", [1.0]), ("d#1", "d", [1.0]), ("e#0", "e", [1.0])], "chunk_id string, document_id string, embedding array<float>")
    new = spark.createDataFrame([("d#0", "d", [2.0])], old.schema)
    assert S.upsert_chunks(old, new, 1).count() == 3
    assert {x.chunk_id for x in S.upsert_chunks(old, new, 1, replace_document=True).collect()} == {"d#0", "e#0"}
    with pytest.raises(Exception, match="embedding size"):
        S.upsert_chunks(old, new, 2).collect()
    assert S.assert_unique(old.union(new), "chunk_id").first().chunk_id == "d#0"
    path = S.write_version(old, str(tmp_path / "chunks"), 1)
    assert path.endswith("version=1") and S.read_version(spark, str(tmp_path / "chunks"), 1).count() == 3
    assert old.where(F.col("document_id") == "d").count() == 2
