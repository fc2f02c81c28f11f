"""Injected model callables, run partition by partition on Arrow batches.

A callable is any picklable function; the library ships no network client. Failures that
the caller wants isolated are raised as ``ModelError`` (or listed in ``recover``).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.payloads import read_payload
from docweave.functions.text import rewrite_fallback

EMBED_BATCH = 64
MAX_ATTEMPTS = 3


class ModelError(Exception):
    """A failure of the model service that must not fail the job."""


def embed_column(
    df: DataFrame, column: str, fn: Callable[[list[str]], list[list[float]]], dim: int,
    batch: int = EMBED_BATCH, out: str = "embedding",
) -> DataFrame:
    """Embed a text column in order-preserving batches; a wrong size fails the job."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            vectors: list = []
            values = series.tolist()
            for start in range(0, len(values), batch):
                vectors.extend(fn(values[start : start + batch]))
            for vector in vectors:
                if len(vector) != dim:
                    raise ValueError(f"embedding size {len(vector)} is not {dim}")
            yield pd.Series(vectors, index=series.index, dtype=object)

    return df.withColumn(out, embed(F.col(column)))


EXTRACTION_SYSTEM = (
    "Extract named entities and their relations from the passage. Return a JSON object with the "
    "arrays entities (name, type, description, evidence) and relations (source, target, type, "
    "confidence, evidence). Every evidence names the chunk_id and quotes the text."
)
SPECIALIZED_NOTE = " The passage is code or configuration: only take explicitly named tools and components."


def extraction_prompt(text: str, chunk_id: str, policy: str | None, language: str | None) -> list[dict]:
    system = EXTRACTION_SYSTEM + (SPECIALIZED_NOTE if policy == "specialized" else "")
    hint = f"\nLanguage: {language}" if language else ""
    user = f'chunk_id: "{chunk_id}"\n{text}{hint}'
    return [{"role": "system", "content": system}, {"role": "user", "content": user}]


def extract_candidates(
    chunks: DataFrame,
    fn: Callable[[list[dict]], str],
    max_attempts: int = MAX_ATTEMPTS,
    base_delay: float = 1.0,
    recover: tuple[type[Exception], ...] = (ModelError, TypeError, ValueError),
) -> DataFrame:
    """``(document_id, chunk_id, pos, raw_json, error)`` for every extractable chunk.

    Retries back off exponentially; a chunk that keeps failing becomes an error row, any
    other exception fails the task. An answer that ``parse_extractions`` would turn down counts
    as a failed attempt, with its reason as the error.
    """
    def attempt(row) -> str:
        raw = fn(extraction_prompt(row.text, row.chunk_id, row.extraction_policy, row.language))
        read_payload(raw)
        return raw

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                raw, error = None, None
                for number in range(max_attempts):
                    try:
                        raw, error = attempt(row), None
                        break
                    except recover as exc:
                        error = f"{type(exc).__name__}: {exc}"
                        if number + 1 < max_attempts:
                            time.sleep(base_delay * 2**number)
                rows.append((row.document_id, row.chunk_id, row.pos, raw, error))
            yield pd.DataFrame(rows, columns=["document_id", "chunk_id", "pos", "raw_json", "error"])

    usable = chunks.where(F.col("extraction_policy") != "skip").select(
        "document_id", "chunk_id", F.col("chunk_index").cast("bigint").alias("pos"), "text", "extraction_policy", "language"
    )
    return usable.mapInPandas(run, "document_id string, chunk_id string, pos bigint, raw_json string, error string")


def score_pairs(pairs: DataFrame, fn: Callable[[str, list[str]], list[float]]) -> DataFrame:
    """Add ``relevance`` to ``pairs(query_id, chunk_id, question, text)``; null when the scorer fails."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, texts in batches:
            out = pd.Series([None] * len(questions), index=questions.index, dtype="float64")
            for question, rows in texts.groupby(questions, sort=False):
                try:
                    out.loc[rows.index] = [float(v) for v in fn(question, rows.tolist())]
                except Exception:  # noqa: BLE001 - the reranker falls back to vector order
                    continue
            yield out

    return pairs.withColumn("relevance", score("question", "text"))


def _reply_column(df: DataFrame, column: str, fn: Callable, out: str, error: str | None) -> DataFrame:
    """``fn(messages) -> text`` over an array of role/content structs; failures give null."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    if error:
        schema = schema.add(error, T.StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies, errors = [], []
            for messages in batch[column]:
                try:
                    reply = fn([{"role": m["role"], "content": m["content"]} for m in messages])
                    replies.append(reply if isinstance(reply, str) else None)
                    errors.append(None if isinstance(reply, str) else "reply is not text")
                except Exception as exc:  # noqa: BLE001 - a failed reply is a row, not a failed job
                    replies.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            batch = batch.assign(**{out: replies})
            yield batch.assign(**{error: errors}) if error else batch

    return df.mapInPandas(run, schema)


def generate(prompts: DataFrame, fn: Callable[[list[dict]], str]) -> DataFrame:
    """Add ``reply`` and ``error`` to ``prompts(..., messages)``."""
    return _reply_column(prompts, "messages", fn, "reply", "error")


REWRITE_SYSTEM = (
    "Rewrite the last question so that it can be understood without the conversation. Keep its "
    "intent, add no facts, do not answer it, and return only the question."
)


def rewrite_questions(questions: DataFrame, fn: Callable[[list[dict]], str]) -> DataFrame:
    """Add ``retrieval_question`` to ``questions(query_id, question, history)``.

    Without history the question stays as it is and the model is not called.
    """
    empty = F.coalesce(F.size("history"), F.lit(0)) <= 0
    alone = questions.where(empty).withColumn("retrieval_question", F.col("question"))
    item = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.concat(
        F.array(item("system", F.lit(REWRITE_SYSTEM))),
        F.col("history").cast("array<struct<role:string,content:string>>"),
        F.array(item("user", F.concat(F.lit("Rewrite this question:\n"), "question"))),
    )
    asked = _reply_column(questions.where(~empty).withColumn("_messages", messages), "_messages", fn, "_reply", None)
    rewritten = asked.withColumn("retrieval_question", rewrite_fallback("_reply", "question")).drop("_messages", "_reply")
    return alone.unionByName(rewritten)
