"""WARC, top-k, mixing, outliers, near-duplicates and repeated passages."""

import collections
import gzip
import hashlib
import json
import random

import numpy as np
import pyarrow.fs as pafs
import pytest

import corpus_pipeline
from docweave.llm import chosen_path, mixing, outliers, substrings, topk, warc
from docweave.llm.common import text_key


def test_archive_round_trip(spark):
    big, small = "<p>" + "x" * 200, "<p>s"
    rows = [(1, "u\r\nX: y", big), (2, None, big), (3, "é", small), (4, "v", small), (None, "n", big), (5, "w", None), (6, "w", "é" * 60), (7, "w", "é" * 60), (7, "w", "é" * 60), (None, "n", "no id at all" * 20), (None, "m", "no id at all" * 20), (8, "q" * 9000, "z" * 300000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, path int").repartition(3)
    got = collections.Counter((r.page_id, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.archive_pages(pages).collect())
    least = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            least[p] = min(least.get(p, 1 << 62), i)
    want = collections.Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        first = least.get(p)
        want[(i, "response", None, p) if first in (None, i) else (i, "revisit", first, None)] += 1
    assert got == want
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_members_and_sidecar(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}" * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    records = warc.write_monolithic(pages, f"file://{tmp_path}/a", file_bytes=4000)
    assert records.select("path").distinct().count() > 3
    index = warc.normalise(warc.revisits(records), f"file://{tmp_path}/a", f"file://{tmp_path}/b").collect()
    assert len(index) == 40
    for r in index:
        with open(r.path, "rb") as f:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\nWARC-Type: response")
        side = [json.loads(x) for x in gzip.open(r.path + ".idx.gz")]
        assert (side[r.ordinal]["offset"], side[r.ordinal]["length"]) == (r.offset, r.length)


def test_truncated_archive_is_an_error(tmp_path):
    path = tmp_path / "x.gz"
    path.write_bytes(gzip.compress(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))
    stream = warc.Inflated(pafs.LocalFileSystem().open_input_stream(str(path), compression=None))
    head = stream.head()
    with pytest.raises(ValueError):
        list(stream.body(int(head["Content-Length"])))


@pytest.mark.parametrize("block", [37, 100000])
def test_top_k_equals_brute_force(spark, block):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(400, 24)) * rng.random((400, 1)) * 3).astype(np.float32)
    x[50:200] = x[50]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(7, x[7].tolist(), 0), (900, None, 0), (None, x[3].tolist(), 0), (901, [1.0, None], 0), (950, [float("nan")] * 24, 0), (1000, [1.0], 0)]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, b int"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5, block).collect())
    q = np.floor(256 * x.astype(float)).astype(np.int64)
    want = []
    for i in range(0, 400, 50):
        score = q @ q[i]
        order = [j for j in np.lexsort((np.arange(400), -score)) if j != i][:5]
        want += [(i, k + 1, int(j), int(score[j])) for k, j in enumerate(order)]
    assert got == want
    none = df.limit(0)
    assert topk.top_k(none, none).count() == 0


def test_large_vectors_and_long_ones(spark):
    """Products beyond doubles are summed exactly; a score beyond a long is an error."""
    rows = [(0, [3e6, 1.0, -7e5]), (50, [2e6, -3.0, 9e6]), (1, [float("inf"), 0.0, 0.0]), (2, None), (3, [1.0, None, 0.0]), (4, [-0.001, 5e6, 5e6])]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    ints = {r.vec_id: [int(v) for v in r.ints] for r in df.collect()}
    assert set(ints) == {0, 50, 4} and ints[4][0] == -1
    got = {(r.query_id, r["rank"], r.vec_id): r.score for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()}
    score = lambda a, b: sum(x * y for x, y in zip(ints[a], ints[b]))
    want = {}
    for a in (0, 50):
        for rank, b in enumerate(sorted((b for b in ints if b != a), key=lambda b: (-score(a, b), b)), 1):
            want[a, rank, b] = score(a, b)
    assert got == want
    huge = topk.quantised(spark.createDataFrame([(0, [1e9]), (50, [1e9])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="scale the vectors"):
        topk.top_k(huge, huge, 5).collect()
    long = topk.quantised(spark.createDataFrame([(i, [float(i % 7) - 3] * 5000 + [float(i)]) for i in range(30)], "vec_id long, embedding array<float>"))
    best = topk.top_k(long, long.where("vec_id = 6"), 1).collect()
    assert [(r.vec_id, r.score) for r in best] == [(27, 65536 * (9 * 5000 + 6 * 27))]


def test_bounds_are_upper_bounds_and_refuse_pairs():
    rng = np.random.default_rng(2)
    q, x = rng.integers(-300, 300, (20, 64)).astype(float), rng.integers(-300, 300, (50, 64)).astype(float)
    last = np.inf
    for s in topk.LEVELS:
        f, g = topk.segment_features(q, s), topk.segment_features(x, s)
        assert (f @ g.T >= q @ x.T - 1e-6).all() and (f @ g.T <= last + 1e-6).all()
        assert (topk.group_bounds(f, g.min(0)[None], g.max(0)[None])[:, 0] >= (f @ g.T).max(1) - 1e-6).all()
        last = f @ g.T
    # Vectors along a few smooth shapes: most pairs never get an exact score.
    shapes = np.cumsum(rng.normal(size=(8, 64)), axis=1)
    many = np.floor(256 * (shapes[rng.integers(0, 8, 6000)] * rng.uniform(0.2, 3, (6000, 1)) + rng.normal(size=(6000, 64)) * 0.05))
    stats = {}
    found = topk._search(np.arange(6000), many, np.arange(0, 6000, 60), many[::60], 5, stats)
    score = many.astype(np.int64) @ many[::60].astype(np.int64).T
    want = []
    for c, i in enumerate(range(0, 6000, 60)):
        order = [j for j in np.lexsort((np.arange(6000), -score[:, c]))[:6] if j != i][:5]
        want += [(i, int(j), int(score[j, c])) for j in order]
    assert found == want
    assert stats["exact"] < 0.25 * 6000 * 100, stats


def test_mix_targets(docs_of, odd_docs, no_docs):
    random.seed(2)
    rows = [(i, " ".join("w" * random.randint(1, 5) for _ in range(random.randint(0, 80))), "en", random.choice(["a"] * 6 + ["b", "c", "d", None])) for i in range(3000)]
    got = mixing.mix(docs_of(rows)).collect()
    again = mixing.mix(docs_of(rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == 3000
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and r.size == len(rows[r.doc_id][1].split())
    total, weights = sum(sizes.values()), dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    want, left, open_ = {}, total, set(weights)
    while open_:  # reshare what is above three times the size
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            want.update(share)
            break
        for s in full:
            want[s] = 3 * sizes[s]
            left -= want[s]
        open_ -= full
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 80
    assert mixing.mix(odd_docs).count() == 8 and mixing.mix(no_docs).count() == 0


def brute_statistics(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_statistics_equal_brute_force():
    random.seed(4)
    for _ in range(300):
        text = "".join(random.choices(["a", "b", "cc", " ", " ", "\n", "\t", "#", "é", " ", "\v", "🙂"], k=random.randint(0, 60)))
        assert outliers.statistics_of(text) == brute_statistics(text)


def test_outliers_are_rejected(docs_of, odd_docs, no_docs):
    random.seed(6)
    rows = [(i, " ".join("x" * random.randint(2, 8) + str(random.random()) for _ in range(random.randint(60, 200))), "en", "a") for i in range(300)]
    rows += [(1000 + i, " ".join("y#$" * 9 + str(random.random()) for _ in range(80)), "en", "a") for i in range(60)]
    got = {r.doc_id: r for r in outliers.reject_outliers(docs_of(rows)).collect()}
    assert all(got[i].kept for i in range(300)) and not any(got[1000 + i].kept for i in range(60))
    odd = outliers.reject_outliers(odd_docs).collect()
    assert len(odd) == 8 and all(r.base_failed for r in odd if r.doc_id != 4)
    assert outliers.reject_outliers(no_docs).count() == 0


def test_outliers_of_rare_sources(docs_of):
    """Rows of small groups and small languages are judged by the wider estimates."""
    random.seed(12)

    def text(word):
        return " ".join(word() + str(random.random()) for _ in range(random.randint(60, 200)))

    def plain():
        return "x" * random.randint(2, 8)

    rows = [(i, text(plain), "en", f"site{i % 60}") for i in range(300)]
    rows += [(1000 + i, text(lambda: "y#$" * 9), "en", f"site{i}") for i in range(20)]
    rows += [(2000, text(plain), "xx", "rare"), (2001, text(lambda: "y#$" * 9), "xx", "rare"), (2002, text(lambda: "y#$" * 9), None, None)]
    got = {r.doc_id: r for r in outliers.reject_outliers(docs_of(rows)).collect()}
    assert all(r.distance is not None for r in got.values())
    assert {i for i, r in got.items() if r.kept} == {*range(300), 2000}
    few = outliers.reject_outliers(docs_of(rows[:5])).collect()
    assert all(r.kept and r.distance is not None for r in few)


def brute_links(rows, limit=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = frozenset(tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))) if w else frozenset()
    links, parent = collections.Counter(), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= limit * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in sets}


def test_join_equals_brute_force(docs_of, monkeypatch, odd_docs, no_docs):
    random.seed(8)
    base = [[f"w{random.randint(0, 900)}" for _ in range(random.randint(5, 120))] for _ in range(40)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for _ in range(random.randint(0, 12)):
            w = list(b)
            for _ in range(random.randint(0, 3)):
                w[random.randrange(len(w))] = "new" + str(random.random())
            texts.append(" ".join(w))
    texts += ["a b", "a b", "a", "", " "]
    rows = list(enumerate(texts))
    df = docs_of([(i, t, "en", "s") for i, t in rows])
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.near_duplicates(df).collect()}
    assert got == brute_links(rows)
    # Buckets that stay large go down, blocks of one family meet in tiles.
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    monkeypatch.setattr(chosen_path, "BLOCK_ROWS", 3)
    assert {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.near_duplicates(df).collect()} == got
    odd = chosen_path.near_duplicates(odd_docs).collect()
    assert len(odd) == 8 and sorted(r.n_links for r in odd) == [0] * 6 + [1] * 2
    assert chosen_path.near_duplicates(no_docs).count() == 0


def test_large_bucket_loses_no_pair(spark, monkeypatch):
    """Near copies inside of a template: half of each sketch is common to all, no row leads the others."""
    monkeypatch.setattr(chosen_path, "SMALL", 16)
    rng = np.random.default_rng(5)
    common, rows = rng.integers(0, 256, 64), []
    for i in range(150):
        own = np.concatenate([common[:60], rng.integers(0, 256, 68)]).astype(np.uint8)
        near = own.copy()
        near[-20:] += 1
        rows += [(i, own.tobytes(), [7]), (1000 + i, near.tobytes(), [7])]
    prints = spark.createDataFrame([(i, bytearray(x), leaves) for i, x, leaves in rows], "id long, sketch binary, leaves array<long>")
    got = {frozenset((r.a, r.b)) for r in chosen_path.candidate_edges(prints).collect()}
    assert got == {frozenset((i, 1000 + i)) for i in range(150)}


def brute_repeats(rows, length=20):
    seen, out = set(), {}
    for i, t in rows:
        w = (t or "").encode().split()
        stay = [True] * len(w)
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            if k in seen:
                stay[p : p + length] = [False] * length
            seen.add(k)
        kept = b" ".join(x for x, s in zip(w, stay, strict=True) if s)
        out[i] = (len(w), stay.count(False), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [5, 10, 20])
def test_repeats_equal_brute_force(docs_of, length):
    random.seed(length)
    rows, pool = [], [[f"p{k}_{i}" for i in range(60)] for k in range(4)]
    for i in range(120):
        words = [random.choice("abcdefgh") + str(random.randint(0, 3)) for _ in range(random.randint(0, 60))]
        for _ in range(random.randint(0, 3)):
            p, a = random.choice(pool), random.randint(0, 30)
            words[random.randint(0, len(words)) : 0] = p[a : a + random.randint(5, 30)]
        rows.append((i, random.choice([" ", "\n", "  "]).join(words)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "z " * 100), (203, None)]
    df = docs_of([(i, t, "en", "s") for i, t in rows])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(df, length, 5).collect()}
    assert got == brute_repeats(rows, length)


def test_rows_that_share_an_id(docs_of):
    """Different texts with a null or repeated id are joined, kept and cut each by itself."""
    a, b, c, d, e = ([f"{x}{i}" for i in range(60)] for x in "abcde")
    near = " ".join([*a[:59], "new"])
    texts = [(None, " ".join(a)), (None, " ".join(b)), (None, near), (7, " ".join(c)), (7, " ".join(d)), (9, " ".join(c)), (9, " ".join(d)), (9, None), (9, "")]
    rows = docs_of([(i, t, "en", "s") for i, t in texts])
    got = collections.Counter(tuple(r) for r in chosen_path.near_duplicates(rows).collect())
    assert got == {(None, None, None, 1): 2, (None, None, None, 0): 1, (7, 7, 7, 1): 2, (9, 7, 7, 1): 2, (9, 9, 9, 0): 2}
    kept = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.near_copies(None, rows, None).collect())
    first = min(r.t for r in rows.where("doc_id IS NULL").select("text", text_key().alias("t")).collect() if r.text != " ".join(b))
    heads = {r.text for r in rows.where("doc_id IS NULL").select("text", text_key().alias("t")).where(f"t = {first}").collect()}
    assert kept == collections.Counter([(None, heads.pop()), (None, " ".join(b)), (7, " ".join(c)), (7, " ".join(d)), (9, None), (9, "")])
    # A window at two starts under one id goes at the later one only; copies under one id give no more rows.
    moved = [(3, " ".join(e)), (3, " ".join(["x", *e])), (4, " ".join(c)), (4, " ".join(d)), (5, " ".join(c)), (5, " ".join(d))]
    out = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(docs_of([(i, t, "en", "s") for i, t in moved])).collect())
    assert out == {(3, 60, 0): 1, (3, 61, 60): 1, (4, 60, 0): 2, (5, 60, 60): 2}


def test_repeats_odd_rows(odd_docs, no_docs):
    rows = substrings.remove_repeats(odd_docs, carry=("lang",), spaced=False).collect()
    assert len(rows) == 8 and all(r.n_removed == 0 for r in rows)
    assert substrings.remove_repeats(no_docs).count() == 0
