"""Queries over injected model callables, stored formats and table functions.

The callables stand in for a model service: plain functions of their input, some of which
fail or answer nonsense, so that retries, fallbacks and error rows have work.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from docweave.functions import models as M
from docweave.functions.tables import register_table_functions
from docweave.functions.text import CITATION_TYPE, format_citations, message_id, parse_citations
from docweave.operators import conversations as C
from docweave.operators import resolution as R
from docweave.operators import validation as V
from docweave.plans import derived as D
from docweave.plans.graph_queries import GRAPH_SQL, Graph
from docweave.plans.text_queries import PIECES_SQL
from docweave.session import ensure_checkpoint_dir, spread
from docweave.sources.files import jsonl_errors, read_jsonl


def _messages(spark, sf_dir):
    return spread(D.message_tables(spark, sf_dir)[1])


def message_ids(spark, sf_dir):
    """Ids of messages by conversation, run and role."""
    m = _messages(spark, sf_dir)
    return m.select(F.col("message_id").alias("source_id"), message_id("conversation_id", "run_id", "role").alias("message_id"))


def conversation_list(spark, sf_dir):
    conversations, _ = D.message_tables(spark, sf_dir)
    return C.list_conversations(conversations).select("conversation_id", "title", "created_at")


def citation_json(spark, sf_dir):
    """Citations of a message as stored JSON and read again; every third message has none."""
    one = lambda i: F.struct(F.lit(i).alias("index"), F.concat(F.lit(f"c{i}-"), "role").alias("chunk_id"), F.lit("d").alias("document_id"), F.lit('l"1').alias("location"), F.substring("text", 1, 10).alias("snippet"))
    both = F.array(one(1), one(2)).cast(CITATION_TYPE)
    none = F.array().cast(CITATION_TYPE)
    rows = _messages(spark, sf_dir).withColumn("citations", F.when(F.col("turn_index") % 3 == 0, none).otherwise(both))
    stored = rows.withColumn("stored", format_citations("citations"))
    back = parse_citations("stored")
    return stored.select(
        "message_id", F.md5("stored").alias("json_md5"), F.size(back).alias("citations"), (back == F.col("citations")).alias("same"),
    )


def _rewrite(messages):
    question = messages[-1]["content"].partition("\n")[2]
    if len(question) % 5 == 0:
        raise M.ModelError("no answer")
    return "  " if len(question) % 5 == 1 else f"  re: {question}"


def rewritten_questions(spark, sf_dir):
    """User messages rewritten with the two messages before them; some answers fail or are blank."""
    asked = C.prior_history(_messages(spark, sf_dir), 2).where("role = 'user'")
    rows = asked.select(F.col("message_id").alias("query_id"), F.col("text").alias("question"), "history")
    return M.rewrite_questions(rows, _rewrite).select("query_id", F.md5("retrieval_question").alias("question_md5"))


def _relevance(question, texts):
    if len(question) % 7 == 0:
        raise M.ModelError("scorer is down")
    return [len(t) / (1 + len(question)) for t in texts]


def scored_passages(spark, sf_dir):
    """Every message of a conversation scored against its first one; some scorers fail."""
    m = _messages(spark, sf_dir)
    first = m.where("turn_index = 0").select("conversation_id", F.col("message_id").alias("query_id"), F.col("text").alias("question"))
    pairs = m.join(first, "conversation_id").select("query_id", F.col("message_id").alias("chunk_id"), "question", "text")
    return M.score_pairs(pairs, _relevance).select("query_id", "chunk_id", F.round("relevance", 6).alias("relevance"))


def _embed(texts):
    return [[float(len(t)), float(t.count("e")), float(t.count(" "))] for t in texts]


def embedded_texts(spark, sf_dir):
    docs = D.text_documents(spark, sf_dir).select("document_id", "raw_text")
    e = M.embed_column(docs, "raw_text", _embed, 3)
    return e.select("document_id", *[F.col("embedding")[i].cast("bigint").alias(n) for i, n in enumerate(("chars", "letters_e", "blanks"))])


def _reply(messages):
    text = messages[-1]["content"]
    if len(text) % 4 == 0:
        raise M.ModelError("busy")
    return None if len(text) % 4 == 1 else text[:12]


def generated_replies(spark, sf_dir):
    """Replies to user messages; failures and answers that are no text become error rows."""
    prompt = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    rows = _messages(spark, sf_dir).where("role = 'user'").select("message_id", prompt.alias("messages"))
    return M.generate(rows, _reply).select("message_id", "reply", "error")


def _extract(messages):
    chunk, _, text = messages[-1]["content"].partition("\n")
    name = text.split(" ")[0]
    evidence = {"chunk_id": json.loads(chunk.partition(": ")[2]), "text": "" if len(text) % 4 == 2 else name}
    if len(text) % 4 == 0:
        raise M.ModelError("busy")
    payload = {"entities": [{"name": name, "type": "T", "evidence": evidence}], "relations": []}
    return "no JSON" if len(text) % 4 == 1 else json.dumps(payload, separators=(",", ":"))


def extracted_payloads(spark, sf_dir):
    """Part names as chunks; the model is down, answers no JSON or quotes nothing for some of them."""
    part = spread(D.table(spark, sf_dir, "part"))
    chunks = part.select(
        F.lit("parts").alias("document_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("chunk_id"), F.col("p_partkey").alias("chunk_index"),
        F.col("p_name").alias("text"), F.when(F.col("p_size") % 10 == 0, "skip").otherwise("normal").alias("extraction_policy"), F.lit(None).cast("string").alias("language"),
    )
    return M.extract_candidates(chunks, _extract, max_attempts=2, base_delay=0.0).select("chunk_id", "raw_json", "error")


def evidence_rules(spark, sf_dir):
    """Evidence of order lines, one shape for each remainder of the quantity."""
    q = F.col("l_quantity").cast("int") % 8
    text = F.when(q == 0, F.lit("x")).when(q == 1, F.lit(" 　")).when(q == 2, F.lit("x" * 501)).when(q == 3, F.lit("x" * 500)).when(q == 6, F.lit("x"))
    evidence = F.struct(
        F.when(q == 7, F.lit(" ")).otherwise(F.col("l_orderkey").cast("string")).alias("chunk_id"), text.alias("text"),
        F.when(q == 6, -1).when(q.isin(4, 5, 7), F.col("l_linenumber")).cast("int").alias("char_start"),
        F.when(q.isin(4, 7), F.col("l_linenumber") + 2).when(q == 5, F.col("l_linenumber")).cast("int").alias("char_end"),
    )
    rows = D.table(spark, sf_dir, "lineitem").select(q.alias("shape"), V.valid_evidence(evidence).alias("valid"))
    return rows.groupBy("shape", "valid").agg(F.count(F.lit(1)).alias("n"))


def unmentioned_sources(spark, sf_dir):
    """Sources whose mentions are gone for some entities; all names are known."""
    g = Graph(spark, sf_dir)
    sources = R.load_sources(g.t["entities"], g.live)
    lost = sources.withColumn("first_chunk_id", F.when(F.substring(F.md5("entity_id"), 1, 1) != "f", F.col("first_chunk_id")))
    found = R.resolve_sources(lost, g.t["canonicals"], fuzzy_threshold=1.0).decisions
    return found.groupBy("status", "method", "reason", "score").agg(F.count(F.lit(1)).alias("n"), F.count("canonical_id").alias("targets"))


def oversized_in_sql(spark, sf_dir):
    """Texts cut by the table function, called from SQL."""
    register_table_functions(spark)
    docs = D.text_documents(spark, sf_dir).select("document_id", F.regexp_replace("raw_text", r"^\s+|\s+$", "").alias("t"))
    docs.createOrReplaceTempView("oversized_texts")
    return spark.sql("SELECT document_id, char_start, char_end, md5(text) AS text_md5 FROM oversized_texts, LATERAL split_oversized(t, 800, 150)")


_LINE = "conversation_id string, turn int, text string"


def _json_lines(spark, sf_dir):
    """Messages as JSON lines in the shared folder; every seventh turn is damaged, every fifth blank."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/json-lines-{abs(hash(sf_dir))}"
    rows = _messages(spark, sf_dir).select("conversation_id", F.col("turn_index").alias("turn"), "text")
    line = F.to_json(F.struct("conversation_id", "turn", "text"))
    damaged = F.when(F.col("turn") % 7 == 6, F.substring(line, 1, 20)).when(F.col("turn") % 5 == 4, "  ").otherwise(line)
    rows.select(damaged.alias("value")).write.mode("overwrite").text(path)
    return path


def json_line_errors(spark, sf_dir):
    """Malformed lines with the sum of how far they are from their file's start."""
    bad = jsonl_errors(spark, _json_lines(spark, sf_dir), _LINE)
    return bad.groupBy("text").agg(F.count(F.lit(1)).alias("lines"), (F.min("line") >= 1).alias("numbered"))


def json_lines(spark, sf_dir):
    rows = read_jsonl(spark, _json_lines(spark, sf_dir), _LINE, strict=False)
    return rows.select("conversation_id", "turn", F.md5("text").alias("text_md5"), F.col("_corrupt_record").alias("damaged"))


_M = """WITH m AS (
  SELECT conv_id || '-' || turn AS message_id, CAST(conv_id AS VARCHAR) AS conversation_id, conv_id || '-' || CAST(floor(turn / 2) AS BIGINT) AS run_id,
         CAST(turn AS INTEGER) AS turn_index, CASE role WHEN 'assistant' THEN 'agent' ELSE role END AS role, text FROM conversations
)
"""
_JSON = _M + """, lines AS (
  SELECT *, CAST(to_json({conversation_id: conversation_id, turn: turn_index, text: text}) AS VARCHAR) AS line FROM m WHERE turn_index % 7 = 6 OR turn_index % 5 <> 4
)
"""

QUERIES = {
    "message_ids": (
        message_ids,
        _M
        + """SELECT message_id AS source_id, 'msg_' || substr(h, 1, 12) || '5' || substr(h, 14, 3) || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 15) AS message_id
        FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('docweave-message:' || conversation_id || ':' || run_id || ':' || role)) AS h FROM m)""",
    ),
    "conversation_list": (
        conversation_list,
        "SELECT CAST(conv_id AS VARCHAR) AS conversation_id, '新会话' AS title, 1700000000000 + conv_id * 1000 AS created_at FROM conversations GROUP BY conv_id",
    ),
    "citation_json": (
        citation_json,
        _M
        + """SELECT message_id, CASE WHEN turn_index % 3 <> 0 THEN md5(CAST(to_json([
          {index: 1, chunk_id: 'c1-' || role, document_id: 'd', location: 'l"1', snippet: substr(text, 1, 10)},
          {index: 2, chunk_id: 'c2-' || role, document_id: 'd', location: 'l"1', snippet: substr(text, 1, 10)}]) AS VARCHAR)) END AS json_md5,
        CASE WHEN turn_index % 3 = 0 THEN 0 ELSE 2 END AS citations, true AS same FROM m""",
    ),
    "rewritten_questions": (
        rewritten_questions,
        _M
        + r"""SELECT message_id AS query_id, md5(CASE WHEN rn = 1 OR length(text) % 5 < 2 THEN text ELSE substr(regexp_replace('re: ' || text, '\s+$', ''), 1, 1000) END) AS question_md5
        FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_index) AS rn FROM m) WHERE role = 'user'""",
    ),
    "scored_passages": (
        scored_passages,
        _M
        + """SELECT q.message_id AS query_id, m.message_id AS chunk_id, CASE WHEN length(q.text) % 7 <> 0 THEN round(length(m.text) / (1 + length(q.text)), 6) END AS relevance
        FROM m JOIN m q ON q.conversation_id = m.conversation_id AND q.turn_index = 0""",
    ),
    "embedded_texts": (
        embedded_texts,
        """SELECT CAST(doc_id AS VARCHAR) AS document_id, length(text) AS chars, length(text) - length(replace(text, 'e', '')) AS letters_e,
        length(text) - length(replace(text, ' ', '')) AS blanks FROM documents""",
    ),
    "generated_replies": (
        generated_replies,
        _M
        + """SELECT message_id, CASE WHEN length(text) % 4 > 1 THEN substr(text, 1, 12) END AS reply,
        CASE length(text) % 4 WHEN 0 THEN 'ModelError: busy' WHEN 1 THEN 'reply is not text' END AS error FROM m WHERE role = 'user'""",
    ),
    "extracted_payloads": (
        extracted_payloads,
        """SELECT 'p' || p_partkey AS chunk_id,
        CASE WHEN length(p_name) % 4 = 3 THEN CAST(to_json({entities: [{name: n, type: 'T', evidence: {chunk_id: 'p' || p_partkey, text: n}}], relations: []}) AS VARCHAR) END AS raw_json,
        CASE length(p_name) % 4 WHEN 0 THEN 'ModelError: busy' WHEN 1 THEN 'PayloadError: invalid JSON' WHEN 2 THEN 'PayloadError: invalid entity payload' END AS error
        FROM (SELECT *, split_part(p_name, ' ', 1) AS n FROM part) WHERE p_size % 10 <> 0""",
    ),
    "evidence_rules": (
        evidence_rules,
        """SELECT CAST(l_quantity AS INTEGER) % 8 AS shape, CAST(l_quantity AS INTEGER) % 8 IN (0, 3, 4) AS valid, count(*) AS n FROM lineitem GROUP BY ALL""",
    ),
    "unmentioned_sources": (
        unmentioned_sources,
        GRAPH_SQL
        + """SELECT CASE WHEN lost THEN 'unresolved' ELSE 'accepted' END AS status, CASE WHEN lost THEN 'fallback' ELSE 'exact' END AS method,
        CASE WHEN lost THEN 'missing mention provenance' ELSE 'normalized canonical key matches' END AS reason,
        CASE WHEN lost THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score, count(*) AS n, count(*) FILTER (NOT lost) AS targets
        FROM (SELECT substr(md5(entity_id), 1, 1) = 'f' AS lost FROM entities) GROUP BY lost""",
    ),
    "oversized_in_sql": (
        oversized_in_sql,
        PIECES_SQL + "SELECT document_id, CAST(pos AS INTEGER) AS char_start, CAST(cut AS INTEGER) AS char_end, md5(substr(t, pos + 1, cut - pos)) AS text_md5 FROM pieces",
    ),
    "json_line_errors": (
        json_line_errors,
        _JSON + "SELECT substr(line, 1, 20) AS text, count(*) AS lines, true AS numbered FROM lines WHERE turn_index % 7 = 6 GROUP BY ALL",
    ),
    "json_lines": (
        json_lines,
        _JSON
        + """SELECT CASE WHEN turn_index % 7 <> 6 THEN conversation_id END AS conversation_id, CASE WHEN turn_index % 7 <> 6 THEN turn_index END AS turn,
        CASE WHEN turn_index % 7 <> 6 THEN md5(text) END AS text_md5, CASE WHEN turn_index % 7 = 6 THEN substr(line, 1, 20) END AS damaged FROM lines""",
    ),
}
