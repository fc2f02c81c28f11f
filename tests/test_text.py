"""Blocks, chunks, names and ids."""

import random
import re
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.functions.markdown import checked_markers, sentences_of
from docweave.functions.tables import register_table_functions
from docweave.operators import chunking as C
from docweave.operators.fuzzy import similarity_ratio
from docweave.sources import files as S
from docweave.sources import tables
from docweave.sources.buckets import BucketTable


def docs_of(spark, texts, kind="markdown"):
    rows = [(f"d{i}", kind, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "document_id string, doc_type string, raw_text string")


def path_by_prefix(text, upto):
    """The rule restated: stack of all headings visible in the prefix."""
    stack = []
    for m in re.finditer(r"^(#{1,6})\s+(.*)$", text[:upto], re.MULTILINE):
        while stack and stack[-1][0] >= len(m[1]):
            stack.pop()
        stack.append((len(m[1]), m[2].strip()))
    return [t for _, t in stack]


def test_heading_paths(spark):
    rows = C.split_blocks(docs_of(spark, ["# A\n\nx\n\n## B\n\ny", "## 1\n\nx\n\n## 2\n\ny"])).collect()
    found = {(r.document_id, r.text): list(r.heading_path) for r in rows}
    assert found[("d0", "y")] == ["A", "B"]
    assert found[("d0", "## B")] == ["A"]
    assert found[("d1", "y")] == ["2"]


def test_spans_match_the_prefix_rule_on_random_markdown():
    rng = random.Random(7)
    parts = ["# a", "## b", "#", "###### c", "####### d", "x y", "", " ", "\t", "```", "~~~~", "   ```py", "- i", "# ", "```  ", "é。", " z"]
    for _ in range(400):
        text = "\n".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        last = 0
        for body, start, end, path, _info in C.markdown_spans(text):
            assert text[start:end] == body
            assert start >= last
            last = end
            assert path == path_by_prefix(text, start + 1)
        covered = sum(len(b.replace(" ", "")) for b, *_ in C.markdown_spans(text))
        assert covered <= len(text)


def test_fences():
    text = "a\n\n```json\n{}\n\n{}\n```\n\nb\n~~~\nopen"
    kinds = [(b, info) for b, _, _, _, info in C.markdown_spans(text)]
    assert kinds == [("a", None), ("```json\n{}\n\n{}\n```", "json"), ("b", None), ("~~~\nopen", "")]
    assert [i for *_, i in C.markdown_spans("```\na\n~~~\n``\n````\nb")] == ["", None]


def test_classification(spark):
    texts = [
        "```json\n{}\n```", "```\nx\n```", "```Py x\n1\n```", "- a\n* b\n1. c", "| a | b |\n|---|---|\n| 1 | 2 |",
        "2024-01-01 00:00:00 up\n[12:00:00] down", "plain\n- not a list", "a|b\nno rule",
    ]
    rows = C.split_blocks(docs_of(spark, texts)).orderBy(F.expr("int(substr(document_id, 2))")).collect()
    assert [(r.content_kind, r.language, r.extraction_policy) for r in rows] == [
        ("config", "json", "skip"), ("code", None, "specialized"), ("code", "py", "specialized"),
        ("list", None, "normal"), ("table", None, "normal"), ("log", None, "skip"),
        ("prose", None, "normal"), ("prose", None, "normal"),
    ]


def test_cut_points():
    assert list(C.cut_points("abc", 10, 2)) == [(0, 3)]
    text = "aaa。bbb ccc ddd"
    assert list(C.cut_points(text, 8, 2))[0] == (0, 4)
    hard = list(C.cut_points("x" * 25, 10, 3))
    assert hard[0] == (0, 10) and hard[1][0] == 7 and hard[-1][1] == 25
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab。. \n") for _ in range(rng.randint(1, 80)))
        spans = list(C.cut_points(text, rng.randint(1, 12), rng.randint(0, 5)))
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(b[0] > a[0] and b[0] <= a[1] for a, b in zip(spans, spans[1:]))


def test_both_chunk_routes_agree(spark):
    rng = random.Random(3)
    words = ["alpha", "beta.", "# head", "\n\n", "\n", "。", "- x", "😀", "```\ncode\n```", "longword" * 20]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n\n"]) for _ in range(rng.randint(0, 80))) for _ in range(30)] + ["", "   "]
    docs = docs_of(spark, texts)
    columns = ["document_id", "chunk_index", "char_start", "char_end", "text", "heading_path", "content_kind", "extraction_policy"]
    narrow = C.chunk_documents(docs, 120, 20)
    packed = C.with_chunk_text(C.pack_chunks(C.split_oversized(C.split_blocks(docs), 120, 20), 120), docs)
    key = lambda r: (r.document_id, r.chunk_index)
    assert sorted(narrow.select(columns).collect(), key=key) == sorted(packed.select(columns).collect(), key=key)
    assert C.check_offsets(narrow, docs).count() == 0


def test_packing_rules():
    same = lambda *sizes: [(s, "k") for s in sizes]
    assert list(C.pack_runs(same(300, 300, 200, 1), 800)) == [(0, 2), (3, 3)]
    assert list(C.pack_runs([(10, "a"), (10, "b"), (10, "b")], 800)) == [(0, 0), (1, 2)]
    assert list(C.pack_runs([], 800)) == []
    assert list(C.pack_runs(same(900), 800)) == [(0, 0)]


def test_page_assembly(spark):
    rows = [("a", 1, "ab"), ("a", 2, " "), ("a", 3, "c\n\nc"), ("b", 1, "x"), ("b", 2, "y"), ("b", 3, "z"), ("b", 4, "w")]
    pages = spark.createDataFrame(rows, "document_id string, page int, text string")
    placed, rejects = S.place_pages(pages, max_pages=3)
    assert [r.document_id for r in rejects.collect()] == ["b"]
    doc = S.assemble_pages(pages, max_pages=3).collect()[0]
    assert doc.raw_text == "ab\n \nc\n\nc" and doc.blank_pages == 1
    blocks = C.split_page_blocks(placed).collect()
    assert len({b.char_start for b in blocks}) == 3
    assert all(doc.raw_text[b.char_start : b.char_end] == b.text for b in blocks)


def test_long_documents_keep_all_pages(spark):
    n = S.PAGE_BUCKET * 2 + 7
    pages = spark.createDataFrame([("a", i, "x" * (i % 5)) for i in range(n)], "document_id string, page int, text string")
    placed, rejects = S.place_pages(pages)
    text = S.assemble_pages(pages).first()
    assert text.page_count == n and rejects.count() == 0
    for r in placed.collect():
        assert text.raw_text[r.page_start : r.page_start + len(r.text)] == r.text
    starts = [r.page_start for r in placed.orderBy("page").collect()]
    assert starts == [sum(i % 5 + 1 for i in range(k)) for k in range(n)]


def test_bucket_table_merges_touch_few_buckets(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(3000)], "k int, v string")
    table = BucketTable.create(rows, str(tmp_path), ["k"], 64)
    first = table.version()
    assert first.number == 0 and len(first.folders) == 64 and table.read().count() == 3000
    # Two replaced keys, one of them twice, and a new one.
    incoming = spark.createDataFrame([(5, "old", 1), (5, "new", 2), (77, "x", 1), (9000, "y", 1)], "k int, v string, t int")
    second = table.merge(incoming, ["t"])
    changed = {b for b in range(64) if first.folders.get(b) != second.folders.get(b)}
    assert second.number == 1 and 1 <= len(changed) <= 3
    opened = set(table.rows_of(first, changed).inputFiles())
    assert len(opened) <= 3 < len(table.read(0).inputFiles())
    got = {r.k: r.v for r in table.read().collect()}
    assert len(got) == 3001 and (got[5], got[77], got[9000], got[6]) == ("new", "x", "y", "v6")
    assert {r.k: r.v for r in table.read(0).collect()} == {i: f"v{i}" for i in range(3000)}
    # A job that ends between writing and publishing leaves the old version; a second writer of a version fails.
    table.write(incoming.select("k", "v"), second)
    assert table.version().number == 1 and table.read().count() == 3001
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        table.publish(first, table.write(incoming.select("k", "v"), first), [1])
    assert table.merge(incoming.limit(0)).number == 1


def test_empty_bucket_table(spark, tmp_path):
    rows = spark.createDataFrame([], "k int, v string")
    table = BucketTable.create(rows, str(tmp_path), ["k"], 8)
    assert table.read().count() == 0 and table.version().folders == {}
    table.merge(spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string"))
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "b")]


def test_merge_keeps_the_last_of_equal_keys(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "y", 2), (2, "x", 1), (3, "z", 1), (3, "z", 1)], old.schema)
    rows = tables.upsert(old, new, ["k"], ["t"]).collect()
    assert sorted(map(tuple, rows)) == [(1, "a", 0), (2, "y", 2), (3, "z", 1)]


def test_names(spark):
    names = ["Ｆａｓｔ　ＡＰＩ！", "Straße", "A-b_c  d\t", "x$y", "ﬁ", "", "!!", "İ", "a\x1fb"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(
        "n", X.normalize_name("n").alias("key"), X.merge_key("n").alias("merge")
    )
    for r in rows.collect():
        folded = unicodedata.normalize("NFKC", r.n).casefold()
        kept = "".join(c for c in folded if not unicodedata.category(c).startswith("P"))
        assert r.key == " ".join(kept.split())
        assert r["merge"] == r.n.casefold().strip()


def test_ids_and_displays(spark):
    row = spark.range(1).select(
        X.message_id(F.lit("c"), F.lit("r"), F.lit("user")).alias("message"),
        X.location_string(F.lit(2), F.array(F.lit("A"), F.lit("B")), F.lit(3), F.lit(9)).alias("where"),
        X.location_string(F.lit(None).cast("int"), F.array().cast("array<string>"), F.lit(0), F.lit(1)).alias("short"),
        X.derive_title(F.lit("  a \n b　" + "c" * 30)).alias("title"),
        X.derive_title(F.lit(" \n ")).alias("empty"),
        X.rewrite_fallback(F.lit("  "), F.lit("q")).alias("fallback"),
        X.rewrite_fallback(F.lit(" x "), F.lit("q")).alias("rewritten"),
        X.confidence_class(F.lit(None)).alias("none"), X.confidence_class(F.lit(0.5)).alias("mid"),
        X.degree_tier(F.lit(6)).alias("tier"),
        F.size(X.parse_citations(F.lit(None).cast("string"))).alias("citations"),
    ).first()
    assert row.message == "msg_" + uuid.uuid5(uuid.NAMESPACE_URL, "docweave-message:c:r:user").hex
    assert row["where"] == "第2页 · A > B · 字符 3-9" and row.short == "字符 0-1"
    assert row.title == "a b " + "c" * 16 and row.empty == "新会话"
    assert (row.fallback, row.rewritten, row.none, row.mid, row.tier, row.citations) == ("q", "x", "unknown", "medium", "hi", 0)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("", []),
        ("One [1]. Two.", ["One [1].", "Two."]),
        ("- v1.2 works [1][2]\n1) next!", ["v1.2 works [1][2]", "next!"]),
        ("See https://a.b/c?x=1[1]. End", ["See https://a.b/c?x=1[1].", "End"]),
        ("```\ncode. more.\n```\n---\n## \nok。[3] 好", ["ok。[3]", "好"]),
        ("[1]", []),
    ],
)
def test_sentences(text, expected):
    assert sentences_of(text) == expected


@pytest.mark.parametrize(
    "text, available, clean, written, dropped",
    [
        ("a [1] [1]", {1}, "a [1] [1]", ["1"], False),
        ("a [0] [3] [02]", {2}, "a   [02]", ["0", "2", "3"], True),
        ("`[9]` ``[8] ` [7]`` [1]", {1}, "`[9]` ``[8] ` [7]`` [1]", ["1"], False),
        ("\\`[9]` [1]", {1}, "\\`` [1]", ["1", "9"], True),
        ("```\n[9]\n```\n[1]", {1}, "```\n[9]\n```\n[1]", ["1"], False),
        ("    [9]\n\nx [1]", {1}, "    [9]\n\nx [1]", ["1"], False),
        ("- a\n\n    [9]", {1}, "- a\n\n    ", ["9"], True),
        ("text\n    [9]", {1}, "text\n    ", ["9"], True),
        ("[99999999999999999999]", {1}, "", ["99999999999999999999"], True),
        ("~~~\n[9]\n```\n[8]", {1}, "~~~\n[9]\n```\n[8]", [], False),
        ("`multi\nline [9]` [1]", {1}, "`multi\nline [9]` [1]", ["1"], False),
    ],
)
def test_markers(text, available, clean, written, dropped):
    assert checked_markers(text, available) == (clean, written, dropped)


def test_similarity_is_directed(spark):
    from difflib import SequenceMatcher

    pairs = [("tide", "diet"), ("diet", "tide"), ("abc", "abc"), ("", "a")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity_ratio()("a", "b").alias("r"))
    assert all(r.r == SequenceMatcher(None, r.a, r.b).ratio() for r in rows.collect())


def test_table_functions(spark):
    register_table_functions(spark)
    found = spark.sql("SELECT s.sentence FROM VALUES ('A [1]. B.') t(x), LATERAL split_assertions(t.x) s").collect()
    assert [r.sentence for r in found] == ["A [1].", "B."]
    cut = spark.sql("SELECT * FROM split_oversized('aa bb cc', 4, 0)").collect()
    assert "".join(r.text for r in cut) == "aa bb cc"


def test_scan_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "sub" / "a b.MD").write_bytes(b"# t\r\n\r\nbad \xff byte\rz")
    (tmp_path / "n.txt").write_text("hello")
    (tmp_path / "skip.bin").write_text("x")
    (tmp_path / "p.pdf").write_text("x")
    (tmp_path / "node_modules" / "m.md").write_text("x")
    documents, rejects = S.scan_documents(spark, str(tmp_path))
    rows = {r.document_id: r for r in documents.collect()}
    assert set(rows) == {"sub/a b.MD", "n.txt"}
    assert rows["sub/a b.MD"].raw_text == "# t\n\nbad � byte\nz" and rows["sub/a b.MD"].doc_type == "markdown"
    assert [r.document_id for r in rejects.collect()] == ["p.pdf"]
    assert {r.reason for r in S.scan_documents(spark, str(tmp_path), 3)[1].collect()} >= {"file too large"}


def test_read_jsonl(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\n{"a": "x"}\n')
    loose = S.read_jsonl(spark, str(path), "a int", strict=False).collect()
    assert sorted((r.a for r in loose), key=str) == [1, 2, None]
    with pytest.raises(Exception, match="Malformed|MALFORMED|FAILFAST|malformed"):
        S.read_jsonl(spark, str(path), "a int").collect()


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_bad_lines_are_named(spark, tmp_path, ending):
    """Line numbers over many splits of several files, blank lines counted."""
    want = {}
    for name in ("a", "b", "c"):
        lines = []
        for i in range(1, 400):
            bad = i % 97 == 0 or (name == "b" and i == 1)
            lines.append("{broken" if bad else "  " if i % 5 == 0 else '{"a": %d, "text": "%s"}' % (i, "é" * (i % 31)))
            if bad:
                want[name, i] = "{broken"
        (tmp_path / f"{name}.jsonl").write_bytes(ending.join(lines).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        lines = S.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 20
        rows = S.jsonl_errors(spark, str(tmp_path), "a int, text string").collect()
        with pytest.raises(ValueError, match=r"a.jsonl line 97: malformed.*a.jsonl line 194"):
            S.read_jsonl(spark, str(tmp_path), "a int, text string")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {(r.path.rsplit("/", 1)[-1][0], r.line): r.text for r in rows} == want
    loose = S.read_jsonl(spark, str(tmp_path), "a int, text string", strict=False).collect()
    assert sum(r._corrupt_record is None for r in loose) == 3 * (399 - 79 - 4) - 1


def test_pages_without_numbers(spark):
    rows = [("a", 1, "one"), ("a", None, "zz"), ("a", 2, "two"), ("a", None, "yy"), ("a", 2, "twin"), ("b", None, None), ("b", 700, "far")]
    pages = spark.createDataFrame(rows, "document_id string, page int, text string")
    placed = {(r.document_id, r.text): r.page_start for r in S.place_pages(pages)[0].collect()}
    assert placed == {("a", "yy"): 0, ("a", "zz"): 3, ("a", "one"): 6, ("a", "twin"): 10, ("a", "two"): 15, ("b", None): 0, ("b", "far"): 0}
    assert {r.document_id: r.raw_text for r in S.assemble_pages(pages).collect()} == {"a": "yy\nzz\none\ntwin\ntwo", "b": "far"}
