"""Context, prompts and final answers with checked citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.markdown import sanitize_markers
from docweave.functions.text import CITATION_TYPE, location_string
from docweave.operators.ordering import bucketed_row_number, first_rows

# Refusal text, section heads and snippet length of a context.
NO_EVIDENCE_ANSWER = "根据现有资料无法回答。"
CHUNK_HEAD = "【文档片段】"
PATH_HEAD = "【相关实体关系】"
SNIPPET_LENGTH = 120

SYSTEM_PROMPT = (
    "Answer only from the numbered passages. Put the number of the supporting passage in "
    "square brackets after every claim, such as [1]. Say so when the passages do not suffice."
)
HISTORY_GUARD = " Earlier turns only explain the question; never cite them."


def ranked_paths(paths: DataFrame) -> DataFrame:
    """``(query_id, path_rank, line)``: the relation lines of each question as rows, in
    (-support, path_id) order. Ranks are counted by powers of two of the support, so a question
    with very many paths is spread over tasks."""
    line = F.concat("source_name", F.lit(" -["), "type", F.lit("]-> "), "target_name")
    rows = paths.select("query_id", "support_count", "path_id", line.alias("line"))
    numbered = bucketed_row_number(rows, ["query_id"], _path_order(), -F.length(F.bin("support_count")), "path_rank")
    return numbered.select("query_id", "path_rank", "line")


def _path_order() -> list[Column]:
    return [F.desc("support_count"), F.col("path_id")]


def build_context(hits: DataFrame, paths: DataFrame | None = None, path_limit: int | None = None) -> DataFrame:
    """``(query_id, context, citations)`` from numbered hits and relation paths.

    ``hits`` carry ``citation_index`` and their provenance columns; a question has at most
    the reranked few. Paths follow in (-support, path_id) order, with ``path_limit`` only the
    first ones, which are found in the tasks before the shuffle. Without it a question's lines
    have no bound, as its prompt has none (``ranked_paths`` gives them as rows).
    """
    line = F.concat(F.lit("["), F.col("citation_index").cast("string"), F.lit("] "), F.col("text"))
    citation = F.struct(
        F.col("citation_index").cast("int").alias("index"),
        "chunk_id", "document_id",
        location_string().alias("location"),
        F.substring("text", 1, SNIPPET_LENGTH).alias("snippet"),
    )
    rows = F.sort_array(F.collect_list(F.struct("citation_index", line.alias("line"), citation.alias("citation"))))
    context = hits.groupBy("query_id").agg(rows.alias("_rows")).select(
        "query_id",
        F.array_join(F.concat(F.array(F.lit(CHUNK_HEAD)), F.transform("_rows", lambda r: r["line"])), "\n").alias("context"),
        F.transform("_rows", lambda r: r["citation"]).cast(CITATION_TYPE).alias("citations"),
    )
    if paths is None:
        return context
    if path_limit is not None:
        paths = first_rows(paths, ["query_id"], _path_order(), path_limit).drop("_rank")
    arrow = F.concat("source_name", F.lit(" -["), "type", F.lit("]-> "), "target_name")
    listed = paths.groupBy("query_id").agg(
        F.sort_array(
            F.collect_list(F.struct((-F.col("support_count")).alias("s"), "path_id", arrow.alias("line")))
        ).alias("_paths")
    )
    tail = F.concat(
        F.lit(f"\n\n{PATH_HEAD}\n"), F.array_join(F.transform("_paths", lambda p: p["line"]), "\n")
    )
    return context.join(listed, "query_id", "left").select(
        "query_id", F.concat("context", F.coalesce(tail, F.lit(""))).alias("context"), "citations"
    )


def finalize_answers(answers: DataFrame) -> DataFrame:
    """Check the markers of ``answers(query_id, text, citations)``.

    No valid marker: refusal, low confidence, no citations. Two or more valid markers:
    high; any invalid marker: medium.
    """
    stored = F.coalesce("citations", F.array().cast(CITATION_TYPE))
    checked = answers.withColumn("citations", stored).withColumn(
        "_c", sanitize_markers(F.coalesce("text", F.lit("")), F.transform("citations", lambda c: c["index"]))
    )
    numbers = F.transform(
        F.filter("citations", lambda c: c["index"] > 0), lambda c: c["index"].cast("string")
    )
    used = F.array_intersect(numbers, F.col("_c.written"))
    judged = checked.withColumn("_used", used)
    cited = F.filter(
        "citations",
        lambda c, i: F.array_contains(F.col("_used"), c["index"].cast("string"))
        & (F.array_position(F.transform("citations", lambda d: d["index"]), c["index"]) == i + 1),
    )
    none = F.size("_used") == 0
    confidence = (
        F.when(none, "low").when(F.col("_c.dropped"), "medium").when(F.size("_used") >= 2, "high").otherwise("medium")
    )
    return judged.select(
        *[c for c in answers.columns if c not in ("text", "citations")],
        F.when(none, NO_EVIDENCE_ANSWER).otherwise(F.col("_c.text")).alias("text"),
        confidence.alias("confidence"),
        F.when(none, F.array().cast(CITATION_TYPE)).otherwise(cited).alias("citations"),
    )


def marker_usage(answers: DataFrame) -> DataFrame:
    """``(query_id, marker, valid)``: every marker number written outside code."""
    checked = answers.withColumn(
        "_c", sanitize_markers(F.coalesce("text", F.lit("")), F.transform("citations", lambda c: c["index"]))
    )
    known = F.transform("citations", lambda c: c["index"].cast("string"))
    return checked.select(
        "query_id", F.explode("_c.written").alias("marker"), known.alias("_known")
    ).select(
        "query_id", "marker", (F.array_contains("_known", F.col("marker")) & (F.col("marker") != "0")).alias("valid")
    )


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


MESSAGES_TYPE = "array<struct<role:string,content:string>>"


def build_prompts(questions: DataFrame) -> DataFrame:
    """Add ``messages`` to ``questions(query_id, question, context[, retrieval_question, history])``."""
    columns = questions.columns
    history = (
        F.coalesce(F.col("history").cast(MESSAGES_TYPE), F.array().cast(MESSAGES_TYPE))
        if "history" in columns
        else F.array().cast(MESSAGES_TYPE)
    )
    rewritten = F.col("retrieval_question") if "retrieval_question" in columns else F.lit(None).cast("string")
    plain = F.concat("context", F.lit("\n\nQuestion:\n"), "question")
    both = F.concat(
        "context", F.lit("\n\nOriginal question:\n"), "question", F.lit("\n\nStandalone question:\n"), rewritten,
        F.lit("\n\nAnswer the original question."),
    )
    system = F.when(F.size(history) > 0, SYSTEM_PROMPT + HISTORY_GUARD).otherwise(SYSTEM_PROMPT)
    messages = F.concat(
        F.array(_message("system", system)),
        history,
        F.array(_message("user", F.when(rewritten.isNull(), plain).otherwise(both))),
    )
    return questions.withColumn("messages", messages.cast(MESSAGES_TYPE))
