"""Conversations, run events and their streams."""

import random
import time

import pytest

from docweave.operators import conversations as C
from docweave.operators import runs as E
from docweave.streaming import ingest as I
from docweave.streaming import runs as S

MESSAGE = "message_id string, conversation_id string, run_id string, turn_index int, role string, text string, citations string, confidence string, created_at bigint"
TURN = "conversation_id string, run_id string, pos bigint, user_text string, agent_text string, citations string, confidence string, created_at bigint"
EVENT = "run_id string, seq int, stage string, status string, timestamp_ms bigint"
EVENTS = [
    ("r1", 1, "parsing", "running", 1000), ("r1", 2, "writing", "running", 2000), ("r1", 3, "idle", "succeeded", 3000),
    ("r2", 1, "parsing", "running", 1500), ("r3", 1, "error", "failed", 900), ("r3", 2, "idle", "succeeded", 950),
]


def test_append_is_atomic_and_idempotent(spark):
    conversations = spark.createDataFrame([("c", "新会话", 0, 0)], "conversation_id string, title string, message_count int, turn_counter int")
    turns = spark.createDataFrame(
        [("c", "r1", 1, "hello  there", "hi", None, "high", 1), ("c", "r1", 2, "again", "x", None, "low", 2), ("c", "r2", 3, "more", "ok", None, None, 3), ("ghost", "r3", 4, "a", "b", None, None, 4)],
        TURN,
    )
    messages, updated, rejects = C.append_turns(conversations, spark.createDataFrame([], MESSAGE), turns)
    rows = [(r.turn_index, r.role, r.text) for r in messages.orderBy("turn_index").collect()]
    assert rows == [(1, "user", "hello  there"), (2, "agent", "hi"), (3, "user", "more"), (4, "agent", "ok")]
    assert [r.conversation_id for r in rejects.collect()] == ["ghost"]
    assert updated.first().message_count == 4 and updated.first().turn_counter == 4
    assert C.check_turn_pairs(messages).count() == 0
    again, same, _ = C.append_turns(updated, messages, turns)
    assert again.count() == 4 and same.first().turn_counter == 4
    assert C.title_conversations(conversations, messages).first().title == "hello there"
    assert [r.turn_index for r in C.history_window(messages, 1).collect()] == [4]
    history = {r.turn_index: [h.role for h in r.history] for r in C.prior_history(messages, 2).collect()}
    assert history == {1: [], 2: ["user"], 3: ["user", "assistant"], 4: ["assistant", "user"]}


@pytest.mark.parametrize("bucket", [1, 3, 4096])
def test_history_over_sparse_buckets(spark, monkeypatch, bucket):
    """Buckets with fewer messages than the window send each other as many as are missing."""
    monkeypatch.setattr(C, "TURN_BUCKET", bucket)
    rng = random.Random(bucket)
    turns = {c: sorted(rng.sample(range(60), rng.choice((1, 7, 40)))) for c in "abcd"}
    rows = [(f"{c}{t}", c, "r", t, rng.choice(("user", "agent")), f"{c}-{t}", None, None, t) for c, ts in turns.items() for t in ts]
    for n in (0, 1, 4):
        got = {(r.conversation_id, r.turn_index): [h.content for h in r.history] for r in C.prior_history(spark.createDataFrame(rows, MESSAGE), n).collect()}
        assert got == {(c, t): [f"{c}-{x}" for x in ts[max(0, i - n) : i]] for c, ts in turns.items() for i, t in enumerate(ts)}


def test_run_rules(spark):
    events = spark.createDataFrame(EVENTS, EVENT)
    runs = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",)], "run_id string")
    state = {r.run_id: (r.status, r.current_stage, r.event_count) for r in E.run_state(events, runs).collect()}
    assert state == {"r1": ("succeeded", "idle", 3), "r2": ("running", "parsing", 1), "r3": ("succeeded", "idle", 2), "r4": ("running", "idle", 0)}
    left = E.expire_runs(E.run_state(events), now_ms=601_000)
    assert {r.run_id for r in left.collect()} == {"r1", "r2"}
    assert {(r.run_id, r.seq) for r in E.terminal_events(events).collect()} == {("r1", 3), ("r3", 1)}
    assert E.open_stream(events).where("run_id = 'r3'").count() == 1


def source(spark, tmp_path, rows):
    path = str(tmp_path / "events")
    for row in rows:
        spark.createDataFrame([row], EVENT).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 4).parquet(path)


def drain(spark, df, name, mode, tmp_path):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    stream = source(spark, tmp_path, EVENTS + EVENTS[:2])
    once = drain(spark, S.dedup_replay_stream(stream), "once", "append", tmp_path)
    assert sorted((r.run_id, r.seq) for r in once.collect()) == sorted((e[0], e[1]) for e in EVENTS)
    deduped = spark.createDataFrame(EVENTS, EVENT)
    live = drain(spark, S.run_state_stream(stream), "live", "update", tmp_path)
    last = {r.run_id: r for r in live.collect()}  # rows of a run come in order
    batch = E.run_state(deduped.union(spark.createDataFrame(EVENTS[:2], EVENT)))
    keep = ["run_id", "status", "current_stage", "event_count", "created_at"]
    assert sorted(tuple(r[c] for c in keep) for r in last.values()) == sorted(map(tuple, batch.select(keep).collect()))
    assert not any(r.evicted for r in last.values())


def test_nothing_follows_the_first_terminal_event(spark, tmp_path):
    """Over several micro-batches and a restart; equal to the batch operators."""
    rows = [
        ("a", 1, "x", "running", 1000), ("a", 2, "x", "succeeded", 1100), ("a", 3, "x", "failed", 1200), ("b", 1, "x", "running", 1300),
        ("a", 4, "x", "succeeded", 1400), ("b", 2, "x", "running", 1450), ("c", 2, "x", "failed", 1500), ("c", 1, "x", "running", 1460),
    ]
    more = [("a", 5, "x", "running", 1600), ("b", 3, "x", "failed", 1700), ("b", 4, "x", "succeeded", 1800), ("c", 3, "x", "succeeded", 1900)]
    source(spark, tmp_path, rows)
    names, found = ("terminal", "open"), {}
    for part in (rows, more):
        if part is more:
            source(spark, tmp_path, more)
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "events"))
        for name, df in zip(names, (S.terminal_stream(stream), S.open_events_stream(stream))):
            # The memory sink starts anew after a restart, the state does not.
            out = tmp_path / f"out_{name}"
            query = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            found[name] = sorted(tuple(r[c] for c in ("run_id", "seq", "status")) for r in spark.read.schema(EVENT).parquet(str(out)).collect())
    batch = spark.createDataFrame(rows + more, EVENT)
    want = {"terminal": E.terminal_events(batch), "open": E.open_stream(batch)}
    assert found == {n: sorted(tuple(r) for r in df.select("run_id", "seq", "status").collect()) for n, df in want.items()}


def test_state_stays_flat(spark, tmp_path):
    """A hundred micro-batches of new runs: idle and closed runs leave, and say so."""
    path = str(tmp_path / "events")
    schema = EVENT + ", completed bigint, total bigint"
    for i in range(100):
        rows = [(f"r{i}", 1, "x", "running", 10**12 + 1000 * i, i, 9), (f"r{i}", 2, "y", "succeeded", 10**12 + 1000 * i + 1, i, None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        streams = {"state": S.run_state_stream(stream, 5000), "done": S.terminal_stream(stream, 5000), "steps": S.progress_stream(stream, 5000)}
        queries = {
            name: df.writeStream.format("memory").queryName(f"flat_{name}").outputMode("append" if name == "done" else "update")
            .option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
            for name, df in streams.items()
        }
        for query in queries.values():
            query.awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for name, query in queries.items():
        sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        assert len(sizes) >= 90 and max(sizes) <= 60 and max(sizes[50:]) <= max(sizes[:50]), (name, sizes)
    rows = spark.table("flat_state").collect()
    gone = [r.run_id for r in rows if r.evicted]
    assert len(gone) == len(set(gone)) > 80
    assert [r for r in rows if (r.status, r.event_count) != ("succeeded", 2)] == []
    assert sorted(r.run_id for r in spark.table("flat_done").collect()) == sorted(f"r{i}" for i in range(100))
    assert {(r.run_id, r.completed, r.total) for r in spark.table("flat_steps").collect()} == {(f"r{i}", i, 9) for i in range(100)}


def test_finished_runs_expire_on_the_stream(spark, tmp_path):
    now = int(time.time() * 1000)
    rows = [("a", 1, "x", "running", now), ("a", 2, "x", "succeeded", now), ("b", 1, "x", "running", now)]
    stream = source(spark, tmp_path, rows)
    query = (
        S.expire_runs_stream(stream, ttl_ms=1500).writeStream.format("memory").queryName("expiry").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    )
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("expiry").where("expired").count() == 0:
            time.sleep(1)
    finally:
        query.stop()
    gone = spark.table("expiry").where("expired").collect()
    assert [(r.run_id, r.status) for r in gone] == [("a", "succeeded")]
    assert spark.table("expiry").where("run_id = 'b' AND status <> 'running'").count() == 0


def test_ingest_stream(spark, tmp_path):
    inbox, base = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "a.md").write_text("# A\n\nbody")
    (inbox / "b.bin").write_text("x")

    def run():
        docs = I.document_stream(spark, str(inbox))
        I.ingest_stream(docs, I.batch_writer(base), str(tmp_path / "cp")).awaitTermination(120)
        return {(r.document_id, r.text) for r in I.latest_chunks(spark, base).collect()}

    assert run() == {("a.md", "# A"), ("a.md", "body")}
    for folder, text in (("sub dir", "other"), (".git", "skipped")):
        (inbox / folder).mkdir()
        (inbox / folder / "a.md").write_text(text)
    (inbox / "c.txt").write_text("plain")
    assert run() == {("a.md", "# A"), ("a.md", "body"), ("c.txt", "plain"), ("sub dir/a.md", "other")}
