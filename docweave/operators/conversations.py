"""Conversation tables: history windows, atomic turns, titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import DEFAULT_TITLE, derive_title, history_item, message_id
from docweave.operators.ordering import bucketed_row_number, first_rows

HISTORY_MESSAGES = 6
# Width of the order buckets that spread a very long conversation over tasks.
TURN_BUCKET = 4096


def history_window(messages: DataFrame, n: int | None = HISTORY_MESSAGES) -> DataFrame:
    """The last ``n`` messages of every conversation; all of them when ``n`` is None."""
    if n is None:
        return messages
    return first_rows(messages, ["conversation_id"], [F.desc("turn_index")], n).drop("_rank")


def _halo(bucketed: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages before every (conversation, bucket), placed into that bucket.

    Buckets may hold fewer than ``n`` messages, so a message may be sent on to up to ``n``
    later ones. Which buckets need how many follows from the counts of the buckets alone.
    """
    keys = ["conversation_id", "_bucket"]
    ordered = Window.partitionBy("conversation_id").orderBy("_bucket")
    ahead = F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    counts = bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_ahead", F.coalesce(ahead, F.lit(0)))
    earlier = F.collect_list(F.struct(F.col("_bucket").alias("bucket"), (F.col("_ahead") + F.col("_n")).alias("end")))
    listed = counts.withColumn("_earlier", earlier.over(ordered.rowsBetween(-n, -1)))
    wanted = listed.select("conversation_id", F.col("_bucket").alias("_target"), "_ahead", F.explode("_earlier").alias("e")).select("conversation_id", F.col("e.bucket").alias("_bucket"), "_target", (n - F.col("_ahead") + F.col("e.end")).alias("_need"))
    tails = first_rows(bucketed, keys, [F.desc("turn_index")], n)
    sent = tails.join(wanted, keys).where(F.col("_rank") <= F.col("_need"))
    return sent.drop("_bucket", "_rank", "_need").withColumnRenamed("_target", "_bucket")


def prior_history(messages: DataFrame, n: int = HISTORY_MESSAGES) -> DataFrame:
    """Every message with the ``n`` messages before it as a role/content array.

    Messages are dealt by conversation and bucket of turns, once; a bucket also gets the
    ``n`` messages before it, so a window inside of the bucket sees all it needs.
    """
    empty = F.array().cast("array<struct<role:string,content:string>>")
    if n < 1:
        return messages.withColumn("history", empty)
    bucketed = messages.withColumn("_bucket", F.floor(F.col("turn_index") / TURN_BUCKET))
    rows = bucketed.withColumn("_own", F.lit(True)).unionByName(_halo(bucketed, n).withColumn("_own", F.lit(False)))
    before = Window.partitionBy("conversation_id", "_bucket").orderBy("turn_index").rowsBetween(-n, -1)
    listed = rows.withColumn("history", F.collect_list(history_item("role", "text")).over(before))
    return listed.where("_own").select(*messages.columns, F.col("history").cast("array<struct<role:string,content:string>>").alias("history"))


def append_turns(
    conversations: DataFrame, messages: DataFrame, turns: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Append user/agent pairs: ``(messages, conversations, rejects)``.

    ``turns(conversation_id, run_id, pos, user_text, agent_text, citations, confidence,
    created_at)``; ``pos`` is the arrival order. A run that is already stored, or comes
    twice, keeps its first pair. Both messages of a pair are written or none; turns of
    unknown conversations are rejected.
    """
    rejects = turns.join(conversations.select("conversation_id"), "conversation_id", "left_anti")
    known = turns.join(conversations.select("conversation_id"), "conversation_id", "left_semi")
    stored = messages.select("conversation_id", "run_id")
    fresh = known.join(stored, ["conversation_id", "run_id"], "left_anti")
    payload = [c for c in fresh.columns if c not in ("conversation_id", "run_id")]
    single = fresh.groupBy("conversation_id", "run_id").agg(
        F.min_by(F.struct(*payload), "pos").alias("t")
    ).select("conversation_id", "run_id", "t.*")
    numbered = bucketed_row_number(
        single, ["conversation_id"], ["pos", "run_id"], F.floor(F.col("pos") / TURN_BUCKET), "nth"
    )
    start = conversations.select(
        "conversation_id", F.coalesce("turn_counter", "message_count", F.lit(0)).alias("_start")
    )
    placed = numbered.join(start, "conversation_id").withColumn(
        "user_turn", (F.col("_start") + 2 * F.col("nth") - 1).cast("int")
    )
    pair = F.array(
        F.struct(
            F.lit("user").alias("role"), F.col("user_text").alias("text"),
            F.lit(None).cast("string").alias("citations"), F.lit(None).cast("string").alias("confidence"),
        ),
        F.struct(F.lit("agent").alias("role"), F.col("agent_text").alias("text"), "citations", "confidence"),
    )
    rows = placed.select(
        "conversation_id", "run_id", "user_turn", "created_at", F.posexplode(pair).alias("offset", "m")
    ).select(
        message_id("conversation_id", "run_id", "m.role").alias("message_id"),
        "conversation_id", "run_id",
        (F.col("user_turn") + F.col("offset")).alias("turn_index"),
        "m.role", "m.text", "m.citations", "m.confidence", "created_at",
    )
    added = rows.groupBy("conversation_id").agg(
        F.count(F.lit(1)).cast("int").alias("_added"), F.max("turn_index").alias("_last")
    )
    updated = (
        conversations.join(added, "conversation_id", "left")
        .withColumn("message_count", F.coalesce("message_count", F.lit(0)) + F.coalesce("_added", F.lit(0)))
        .withColumn("turn_counter", F.coalesce("_last", "turn_counter"))
        .drop("_added", "_last")
    )
    return messages.unionByName(rows, allowMissingColumns=True), updated, rejects


def check_turn_pairs(messages: DataFrame) -> DataFrame:
    """Runs whose messages are not exactly a user and the agent right after; empty when sound."""
    runs = messages.groupBy("conversation_id", "run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("role", "turn_index").alias("first_role"),
        F.max_by("role", "turn_index").alias("last_role"),
        (F.max("turn_index") - F.min("turn_index")).alias("gap"),
    )
    sound = (F.col("n") == 2) & (F.col("first_role") == "user") & (F.col("last_role") == "agent") & (F.col("gap") == 1)
    return runs.where(~sound)


def title_conversations(
    conversations: DataFrame, messages: DataFrame, default: str = DEFAULT_TITLE
) -> DataFrame:
    """Default titles become the first user message; counters are recomputed."""
    facts = messages.groupBy("conversation_id").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn_index"))).alias("_question"),
        F.count_if(F.col("role") == "user").alias("_asked"),
        F.count(F.lit(1)).cast("int").alias("_n"),
        F.max("turn_index").alias("_last"),
    )
    joined = conversations.join(facts, "conversation_id", "left")
    untitled = (F.col("title") == default) & (F.coalesce("_asked", F.lit(0)) > 0)
    return (
        joined.withColumn("title", F.when(untitled, derive_title("_question", default)).otherwise(F.col("title")))
        .withColumn("message_count", F.coalesce("_n", F.lit(0)))
        .withColumn("turn_counter", F.coalesce("_last", F.lit(0)))
        .drop("_question", "_asked", "_n", "_last")
    )


def list_conversations(conversations: DataFrame) -> DataFrame:
    return conversations.orderBy(F.desc("created_at"), "conversation_id")


def conversation_detail(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversation columns next to each of its messages, in turn order."""
    head = conversations.select("conversation_id", "title", "message_count")
    return head.join(messages, "conversation_id").orderBy("conversation_id", "turn_index")


def delete_conversations(
    conversations: DataFrame, messages: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("conversation_id").distinct()
    return (
        conversations.join(gone, "conversation_id", "left_anti"),
        messages.join(gone, "conversation_id", "left_anti"),
    )
