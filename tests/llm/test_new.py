"""Token alignment, importance resampling and decontamination against plain versions."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import pytest

from docweave.llm import alignment, decontamination, queries, resampling

needs_models = pytest.mark.skipif(not os.path.exists(queries.BYTE_BPE), reason="vocabulary files are absent")
SF = "/root/testdata/sf0.001"


def files():
    return [open(p, "rb").read() for p in (queries.BYTE_BPE, queries.PIECE_MODEL)]


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def ranges(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute_alignment(texts, block_links=None):
    """Rows of the alignment, byte by byte and pair by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(queries.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    a.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    docs = []
    for text in texts:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        of_x = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in x]
        pieces = [b.id_to_piece(i) for i in y]
        of_y = [bytes.fromhex(p[3:5]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        want = (" " + text).encode() if text else b""
        if b"".join(of_x) != want or b"".join(of_y) != want:
            x, y, of_x, of_y = [], [], [], []
        ra, rb = ranges(of_x), ranges(of_y)
        cuts = sorted({e for _, e in ra} & {e for _, e in rb})
        groups = []
        for low, high in zip([0, *cuts], cuts):
            groups.append(([i for i, (s, e) in zip(x, ra) if low <= s < high], [i for i, (s, e) in zip(y, rb) if low <= s < high]))
        links = [(i, j) for i, (s, e) in zip(x, ra) for j, (t, f) in zip(y, rb) if s < f and t < e]
        docs.append((len(x), len(y), groups, links))
    count = collections.Counter(p for *_, links in docs for p in links)
    top = collections.defaultdict(int)
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    out = []
    for n_a, n_b, groups, links in docs:
        listed = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(listed.encode()).hexdigest() if listed else ""
        out.append((n_a, n_b, len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), digest))
    return out


ODD = [None, "", " ", "a", "▁x", "<s> <|endoftext|> <0x0A> <unk>", "é漢字\x00\n\n  tail ", "½ﬁ ＡＢ", "🙂🙂 é", "the the the", "a" * 3000, "x\r\n\ty"]


@needs_models
@pytest.mark.parametrize("block_links", [1 << 20, 1])
def test_alignment_equals_brute_force(spark, block_links):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab é漢\n<>|▁0🙂") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["same words here"] * 5
    rows = [(i if i % 7 else None, t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, pair string").repartition(3)
    got = alignment.align(docs, *files(), block_links=block_links).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = collections.Counter((r[0], *v) for r, v in zip(rows, brute_alignment(texts)))
    assert collections.Counter((r.doc_id, *(r[n] for n in names)) for r in got) == want


@needs_models
def test_alignment_detail_and_no_rows(spark, no_docs, odd_docs):
    assert alignment.align(no_docs, *files()).count() == 0
    assert alignment.align(odd_docs, *files()).count() == odd_docs.count()
    row = alignment.align(spark.createDataFrame([(1, "hello, unalignable wörld")], "doc_id long, text string"), *files(), detail=True).first()
    assert sum(row.a_in_group) == len(row.a_ids) == row.n_a and sum(row.b_in_group) == row.n_b and len(row.a_in_group) == row.n_groups
    listed, i, j = [], 0, 0
    for a, b in zip(row.a_in_group, row.b_in_group):
        listed.append(",".join(map(str, row.a_ids[i : i + a])) + "|" + ",".join(map(str, row.b_ids[j : j + b])))
        i, j = i + a, j + b
    assert hashlib.sha256(";".join(listed).encode()).hexdigest() == row.groups_sha256


@needs_models
def test_alignment_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in rows if len(r.text) < 3000}  # the plain version compares all pairs
    docs = spark.createDataFrame(list(rows.values()), "doc_id long, text string")
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = {r.doc_id: tuple(r[n] for n in names) for r in alignment.align(docs, *files()).collect()}
    assert got == dict(zip(rows, brute_alignment([r.text for r in rows.values()])))


def brute_resample(docs, target, n, buckets, percent, least):
    def grams(text):
        w = words_of(text)
        return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    def bucket(g):
        return zlib.crc32(g.encode()) % buckets

    s = collections.Counter(bucket(g) for _, t in docs for g in grams(t))
    t = collections.Counter(bucket(g) for x in target for g in grams(x))
    total, aim = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (aim + buckets)))) for b in s}
    rows = []
    for i, text in docs:
        g = grams(text)
        weight = sum(gain[bucket(x)] for x in g)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(able[: len(able) * percent // 100])]
    rest = [(*r[:4], None) for r in able[len(drawn) :]] + [(*r[:4], None) for r in rows if not r[4]]
    return collections.Counter(drawn + rest)


@pytest.mark.parametrize("n,head_size", [(1, 50), (2, 30), (3, 30), (3, 0)])
def test_resampling_equals_brute_force(spark, n, head_size):
    rng = random.Random(n)
    vocabulary = ["The", "the", "é", "x9", "漢字", *(f"w{i}" for i in range(60))]
    docs = [(i, " -".join(rng.choice(vocabulary[: rng.choice((5, 65))]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(None, docs[3][1]), (None, None), (7, docs[7][1]), (301, ""), (302, "word " * 9000)]
    target = ["the é the x9 w1 w2", None, "", "w3 w4 " * 30]
    frame = spark.createDataFrame([(*d, "x", 5) for d in docs], "doc_id long, text string, bucket string, n_words int").repartition(4)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    head = resampling.head_vocabulary(frame, n, head_size, head_size)
    got = resampling.resample(frame, aim, n, 97, 30, 20, head=head).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_resample(docs, target, n, 97, 30, 20)
    assert len(head.index) == min(head_size, len({w for _, t in docs for w in words_of(t)}))


def test_resampling_of_odd_tables(spark, odd_docs, no_docs):
    aim = spark.createDataFrame([], "text string")
    assert resampling.resample(no_docs, aim).count() == 0
    rows = resampling.resample(odd_docs, aim, carry=("id", "text")).collect()
    assert len(rows) == odd_docs.count() and {r.id for r in rows} == {"x"}
    assert all((r.n_features, r.weight, r["rank"]) == (0, 0, None) for r in rows if not words_of(r.text))


def brute_leaks(docs, items, width):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add("null" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, found = words_of(text), set(), set()
        for size in {len(k) for k in windows}:
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in windows:
                    hit.update(range(p, p + size))
                    found |= windows[tuple(w[p : p + size])]
        out.append((i, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return collections.Counter(out)


def leak_tables(spark):
    rng = random.Random(11)
    vocabulary = [*(f"w{i}" for i in range(8)), "É", "é", "The", "漢"]
    items = [(i % 25, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))) for i in range(40)]
    items += [(None, "null item words"), (100, None), (101, " .,! "), (102, "w1"), (9, items[9][1]), (103, "w1-W1...w1_the")]
    docs = [(i, rng.choice((" ", ", ", "\n")).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80)))) for i in range(200)]
    docs += [(None, "a null item words b"), (None, None), (7, docs[7][1]), (300, ""), (301, "w5 w6 w7 " * 5000)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, items string, n_words int").repartition(3)
    return docs, items, frame, spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, window string")


@pytest.mark.parametrize("width,most", [(4, 500), (4, 20), (6, 1000), (1, 3)])
def test_contamination_equals_brute_force(spark, width, most):
    docs, items, frame, benchmark = leak_tables(spark)
    got = decontamination.find_contamination(frame, benchmark, width, most).collect()
    rows = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in got)
    assert rows == brute_leaks(docs, items, width)


def test_removal(spark, odd_docs, no_docs):
    docs, items, frame, benchmark = leak_tables(spark)
    spans = {(r.doc_id, r.n_words): r.spans for r in decontamination.find_contamination(frame, benchmark, 4).collect()}
    clean = decontamination.decontaminate(frame, benchmark, "spans", 4)
    assert clean.columns == frame.columns and clean.count() == len(docs)
    want = []
    for i, text in docs:
        data = (text or "").encode()
        for s in reversed(spans[i, len(words_of(text))]):
            assert words_of(data[s.first_byte : s.end_byte].decode()) == words_of(text)[s.first_word : s.end_word]
            data = data[: s.first_byte] + data[s.end_byte :]
        want.append((i, None if text is None else data.decode()))
    assert collections.Counter((r.doc_id, r.text) for r in clean.collect()) == collections.Counter(want)
    kept = decontamination.decontaminate(frame, benchmark, "documents", 4).collect()
    assert len(kept) == sum(n for r, n in brute_leaks(docs, items, 4).items() if not r[5])
    assert decontamination.find_contamination(no_docs, benchmark).count() == 0
    assert not decontamination.find_contamination(odd_docs, benchmark.limit(0)).where("contaminated").count()
    with pytest.raises(ValueError, match="remove"):
        decontamination.decontaminate(frame, benchmark, "all")
