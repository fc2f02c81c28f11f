"""Queries over conversations and run events."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import conversations as C
from docweave.operators import runs as E
from docweave.plans import derived as D


def history_window(spark, sf_dir):
    _, messages = D.message_tables(spark, sf_dir)
    return C.history_window(messages, 6).select("conversation_id", "turn_index", "role", F.md5("text").alias("text_md5"))


def prior_history(spark, sf_dir):
    _, messages = D.message_tables(spark, sf_dir)
    rows = C.prior_history(messages, 2)
    shown = F.array_join(F.transform("history", lambda h: F.concat(h["role"], F.lit(":"), F.length(h["content"]).cast("string"))), " ")
    return rows.select("message_id", shown.alias("history"))


def turn_pairs(spark, sf_dir):
    _, messages = D.message_tables(spark, sf_dir)
    return C.check_turn_pairs(messages).select("conversation_id", "run_id", "n", "first_role", "last_role")


def conversation_titles(spark, sf_dir):
    conversations, messages = D.message_tables(spark, sf_dir)
    return C.title_conversations(conversations, messages).select("conversation_id", "title", "message_count", "turn_counter")


def conversation_details(spark, sf_dir):
    conversations, messages = D.message_tables(spark, sf_dir)
    rows = C.conversation_detail(conversations, messages)
    return rows.select("conversation_id", "title", "turn_index", "role", F.length("text").alias("chars"))


def delete_conversations(spark, sf_dir):
    """Conversations with a system message are deleted with everything they hold."""
    conversations, messages = D.message_tables(spark, sf_dir)
    gone = messages.where("role = 'system'").select("conversation_id")
    left, kept = C.delete_conversations(conversations, messages, gone)
    return left.join(kept.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("messages")), "conversation_id").select(
        "conversation_id", "messages"
    )


def _appended(spark, sf_dir):
    """The first two messages are stored; later user/assistant pairs arrive as turns."""
    conversations, messages = D.message_tables(spark, sf_dir)
    stored = messages.where("turn_index < 2")
    counted = stored.groupBy("conversation_id").agg(
        F.count(F.lit(1)).cast("int").alias("message_count"), (F.max("turn_index") + 1).alias("turn_counter")
    )
    conversations = conversations.drop("message_count", "turn_counter").join(counted, "conversation_id")
    asked = messages.where("role = 'user' AND turn_index >= 2")
    replies = messages.where("role = 'agent'").select(
        "conversation_id", (F.col("turn_index") - 1).alias("turn_index"), F.col("text").alias("agent_text")
    )
    turns = asked.join(replies, ["conversation_id", "turn_index"]).select(
        "conversation_id",
        F.concat(F.lit("run-"), "message_id").alias("run_id"),
        F.col("turn_index").cast("bigint").alias("pos"),
        F.col("text").alias("user_text"),
        "agent_text",
        F.lit(None).cast("string").alias("citations"),
        F.lit("high").alias("confidence"),
        "created_at",
    )
    # Every turn arrives twice, as after a lost acknowledgement.
    return C.append_turns(conversations, stored, turns.unionByName(turns))


def append_turns(spark, sf_dir):
    messages, _, _ = _appended(spark, sf_dir)
    added = messages.where("run_id LIKE 'run-%'")
    return added.select("conversation_id", "run_id", "turn_index", "role", F.md5("text").alias("text_md5"))


def appended_counters(spark, sf_dir):
    return _appended(spark, sf_dir)[1].select("conversation_id", "message_count", "turn_counter")


# --- runs ---------------------------------------------------------------------------------


def _sequenced(spark, sf_dir):
    return E.event_seq(D.run_events(spark, sf_dir))


def event_seq(spark, sf_dir):
    return _sequenced(spark, sf_dir).select("run_id", "event_id", "seq")


def run_state(spark, sf_dir):
    return E.run_state(_sequenced(spark, sf_dir))


def run_dedup(spark, sf_dir):
    """The feed is delivered twice; state and counts must not change."""
    events = _sequenced(spark, sf_dir)
    return E.run_state(E.dedup_replay(events.unionByName(events)))


def run_expiry(spark, sf_dir):
    """Runs left one day after the first event of the feed; the clock is a fixed instant."""
    return E.expire_runs(E.run_state(_sequenced(spark, sf_dir)), 1_705_276_800_000).select("run_id", "status")


def terminal_events(spark, sf_dir):
    return E.terminal_events(_sequenced(spark, sf_dir)).select("run_id", "event_id", "seq", "status", "answer")


def open_stream(spark, sf_dir):
    events = E.open_stream(_sequenced(spark, sf_dir))
    return events.groupBy("run_id").agg(F.count(F.lit(1)).alias("events"), F.max("seq").alias("last_seq"))


def run_progress(spark, sf_dir):
    """Sequence number as completed counter, events of the run as total."""
    events = _sequenced(spark, sf_dir)
    totals = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))
    return E.progress(events.withColumnRenamed("seq", "completed").join(totals, "run_id"))


_MESSAGES = """
WITH m AS (
  SELECT conv_id || '-' || turn AS message_id, CAST(conv_id AS VARCHAR) AS conversation_id,
         conv_id || '-' || CAST(floor(turn / 2) AS BIGINT) AS run_id, CAST(turn AS INTEGER) AS turn_index,
         CASE role WHEN 'assistant' THEN 'agent' ELSE role END AS role, text FROM conversations
)
"""
_TITLES = _MESSAGES + r"""
, facts AS (
  SELECT conversation_id, arg_min(text, turn_index) FILTER (role = 'user') AS question,
         CAST(count(*) AS INTEGER) AS message_count, max(turn_index) AS turn_counter FROM m GROUP BY conversation_id
)
"""
_APPENDED = _MESSAGES + """
, start AS (
  SELECT conversation_id, CAST(count(*) AS INTEGER) AS message_count, max(turn_index) + 1 AS turn_counter FROM m WHERE turn_index < 2 GROUP BY 1
), turns AS (
  SELECT u.conversation_id, 'run-' || u.message_id AS run_id, u.text AS user_text, a.text AS agent_text,
         row_number() OVER (PARTITION BY u.conversation_id ORDER BY u.turn_index) AS nth
  FROM m u JOIN m a ON a.conversation_id = u.conversation_id AND a.turn_index = u.turn_index + 1 AND a.role = 'agent'
  JOIN start s ON s.conversation_id = u.conversation_id WHERE u.role = 'user' AND u.turn_index >= 2
)
"""
_EVENTS = """
WITH ev AS (
  SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS run_id, event_id, event_type AS stage, value AS answer,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'running' END AS status,
         epoch_us(ts) // 1000 AS timestamp_ms FROM events
), s AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY timestamp_ms, event_id) AS INTEGER) AS seq FROM ev
), state AS (
  SELECT run_id, coalesce(arg_max(status, seq) FILTER (status <> 'running'), 'running') AS status, arg_max(stage, seq) AS current_stage,
         count(*) AS event_count, min(timestamp_ms) AS created_at FROM s GROUP BY run_id
), ended AS (
  SELECT run_id, min(seq) AS last_seq FROM s WHERE status <> 'running' GROUP BY run_id
)
"""

QUERIES = {
    "history_window": (
        history_window,
        _MESSAGES
        + """SELECT conversation_id, turn_index, role, md5(text) AS text_md5 FROM m
        QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY turn_index DESC) <= 6""",
    ),
    "prior_history": (
        prior_history,
        _MESSAGES
        + """SELECT message_id, coalesce(string_agg(x, ' ') OVER (PARTITION BY conversation_id ORDER BY turn_index ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS history
        FROM (SELECT *, CASE role WHEN 'agent' THEN 'assistant' ELSE role END || ':' || length(text) AS x FROM m)""",
    ),
    "turn_pairs": (
        turn_pairs,
        _MESSAGES
        + """SELECT conversation_id, run_id, count(*) AS n, arg_min(role, turn_index) AS first_role, arg_max(role, turn_index) AS last_role FROM m
        GROUP BY ALL HAVING NOT (n = 2 AND first_role = 'user' AND last_role = 'agent' AND max(turn_index) - min(turn_index) = 1)""",
    ),
    "conversation_titles": (
        conversation_titles,
        _TITLES
        + r"""SELECT conversation_id, CASE WHEN question IS NULL THEN '新会话' ELSE coalesce(nullif(substr(trim(regexp_replace(question, '\s+', ' ', 'g')), 1, 20), ''), '新会话') END AS title,
        message_count, turn_counter FROM facts""",
    ),
    "conversation_details": (
        conversation_details,
        _MESSAGES + "SELECT conversation_id, '新会话' AS title, turn_index, role, CAST(length(text) AS INTEGER) AS chars FROM m",
    ),
    "delete_conversations": (
        delete_conversations,
        _MESSAGES + "SELECT conversation_id, count(*) AS messages FROM m GROUP BY conversation_id HAVING count(*) FILTER (role = 'system') = 0",
    ),
    "append_turns": (
        append_turns,
        _APPENDED
        + """SELECT conversation_id, run_id, CAST(turn_counter + 2 * nth - 1 + k AS INTEGER) AS turn_index, CASE k WHEN 0 THEN 'user' ELSE 'agent' END AS role,
        md5(CASE k WHEN 0 THEN user_text ELSE agent_text END) AS text_md5 FROM turns JOIN start USING (conversation_id), (VALUES (0), (1)) v(k)""",
    ),
    "appended_counters": (
        appended_counters,
        _APPENDED
        + """SELECT conversation_id, CAST(message_count + 2 * coalesce(n, 0) AS INTEGER) AS message_count, CAST(turn_counter + 2 * coalesce(n, 0) AS INTEGER) AS turn_counter
        FROM start LEFT JOIN (SELECT conversation_id, count(*) AS n FROM turns GROUP BY 1) USING (conversation_id)""",
    ),
    "event_seq": (event_seq, _EVENTS + "SELECT run_id, event_id, seq FROM s"),
    "run_state": (run_state, _EVENTS + "SELECT * FROM state"),
    "run_dedup": (run_dedup, _EVENTS + "SELECT * FROM state"),
    "run_expiry": (
        run_expiry,
        _EVENTS + "SELECT run_id, status FROM state WHERE NOT (status <> 'running' AND 1705276800000 - created_at > 600000)",
    ),
    "terminal_events": (
        terminal_events,
        _EVENTS + "SELECT run_id, event_id, seq, status, answer FROM s JOIN ended USING (run_id) WHERE seq = last_seq",
    ),
    "open_stream": (
        open_stream,
        _EVENTS + "SELECT run_id, count(*) AS events, max(seq) AS last_seq FROM s LEFT JOIN ended e USING (run_id) WHERE e.last_seq IS NULL OR seq <= e.last_seq GROUP BY run_id",
    ),
    "run_progress": (
        run_progress,
        _EVENTS + "SELECT run_id, max(seq) AS completed, count(*) AS total FROM s GROUP BY run_id",
    ),
}
