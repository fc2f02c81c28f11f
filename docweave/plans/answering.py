"""A table of questions to a table of cited answers."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.models import embed_column, generate, score_pairs
from docweave.operators import answers as A
from docweave.operators import projection as P
from docweave.operators import retrieval as R
from docweave.session import cut


def retrieve_paths(hits: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Relation paths that start at the canonicals mentioned by the hit chunks."""
    live = P.live_mentions(tables["mentions"], tables["chunks"], tables["documents"])
    accepted = cut(P.accepted_resolutions(tables["entities"], tables["resolutions"], live))
    facts = P.eligible_relations(accepted, tables["relations"], live, min_confidence=None)
    usable = R.expandable_facts(facts, accepted, tables["canonicals"])
    seeds = R.expand_seed_canonicals(hits, accepted, live)
    return R.expand_relations(seeds, usable)


def answer_questions(
    questions: DataFrame,
    tables: Mapping[str, DataFrame],
    embed: Callable[[list[str]], list[list[float]]],
    scorer: Callable[[str, list[str]], list[float]],
    chat: Callable[[list[dict]], str],
    dim: int,
    top_k: int = R.TOP_K,
    top_n: int = R.RERANK_TOP_N,
) -> DataFrame:
    """Recall, rerank, expand, generate and check ``questions(query_id, question[, retrieval_question, history])``.

    Search uses the standalone question, the prompt keeps the original one. Questions
    without hits get the refusal. Model output is materialised before it is used twice.
    """
    asked = questions if "retrieval_question" in questions.columns else questions.withColumn(
        "retrieval_question", F.lit(None).cast("string")
    )
    search = F.coalesce("retrieval_question", "question")
    vectors = cut(embed_column(asked.withColumn("_search", search), "_search", embed, dim))
    hits = R.with_chunk_columns(R.vector_topk(vectors.select("query_id", "embedding"), tables["chunks"], top_k), tables["chunks"])
    pairs = hits.join(vectors.select("query_id", F.col("_search").alias("question")), "query_id")
    scored = cut(score_pairs(pairs, scorer))
    kept = cut(R.number_evidence(R.rerank(scored.drop("relevance", "question"), scored, top_n)))
    context = A.build_context(kept, retrieve_paths(kept, tables))
    prompts = A.build_prompts(asked.join(context, "query_id"))
    replies = cut(generate(prompts, chat)).select("query_id", F.col("reply").alias("text"), "citations")
    silent = asked.select("query_id").join(replies.select("query_id"), "query_id", "left_anti")
    whole = replies.unionByName(
        silent.select("query_id", F.lit("").alias("text"), F.array().cast(A.CITATION_TYPE).alias("citations"))
    )
    return A.finalize_answers(whole)
