"""Pieces, notices, rendering and the classifier."""

import os
import random
import time

import pytest

from docweave.llm import classifier, notices, pieces, render

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="vocabulary file is absent")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary(MODEL)


def all_segmentations(marked, v):
    arcs, out = pieces._arcs(marked, v), []

    def back(j, score, path):
        if not j:
            out.append((score, pieces._ids(path, v)))
        for i, s, piece in arcs[j]:
            back(i, score + s, [piece, *path])

    back(len(marked), 0, [])
    return sorted(out, key=lambda x: -x[0])


def apply_changes(best, changes):
    out, shift = list(best), 0
    for at, replaced, ids in changes:
        out[at + shift : at + shift + replaced] = ids
        shift += len(ids) - replaced
    return tuple(out)


@needs_model
@pytest.mark.parametrize("text", ["the of re", "a². b", "é漢 x", "  hi,,yo", "aaaa", "a a a", "x\ny"])
def test_n_best_equals_brute_force(vocabulary, text):
    score, best, more = pieces.encode_text(text, vocabulary, 6)
    every = all_segmentations("▁" + text.replace(" ", "▁"), vocabulary)
    got = [(score, tuple(best.tolist()))] + [(s, apply_changes(best.tolist(), c)) for s, c in more]
    assert [g[0] for g in got] == [e[0] for e in every[:6]]
    assert set(got) <= set(every) and len(set(got)) == len(got)
    assert all(pieces.decode_ids(list(ids), vocabulary) == text for _, ids in got)


@needs_model
def test_memory_of_units_is_bounded(vocabulary):
    """Long words count by their characters; what is forgotten is found again, with the same ids."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    batches = [[" ".join(word(4000) for _ in range(40)) for _ in range(4)] for _ in range(10)]
    first = pieces.encode_batch(batches[0], vocabulary, 1)
    for batch in batches[1:]:
        pieces.encode_batch(batch, vocabulary, 1)
        held = pieces.worker_cache(f"pieces:{vocabulary.name}:1")["ids"]
        assert sum(map(len, held)) <= 4_000_000 + sum(map(len, batch))
    again = pieces.encode_batch(batches[0], vocabulary, 1)
    assert [(s, b.tolist()) for s, b, _ in again] == [(s, b.tolist()) for s, b, _ in first]


@needs_model
def test_encode_odd_rows(odd_docs, no_docs):
    rows = pieces.encode_n_best(odd_docs, MODEL, 3).collect()
    assert len(rows) == 8 and pieces.encode_n_best(no_docs, MODEL).count() == 0
    texts = {r.doc_id: r.text for r in odd_docs.select("doc_id", "text").collect()}
    for r in rows:
        want = (texts[r.doc_id] or "").replace("▁", " ")
        assert r.decoded == want and (r.ids == []) == (want == "")


def brute_places(text, phrase):
    import re

    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    n = phrase.split()
    return len(words), [i for i in range(len(words) - len(n) + 1) if words[i : i + len(n)] == n]


def test_base_places_equal_brute_force():
    random.seed(5)
    fuzzy = notices.FuzzyNotices(notices.NOTICES)
    base = {k.encode(): v for k, v in notices.BASE_PHRASES.items()}
    parts = ["cc", "by", "CC-BY", "general", "Public", "license", "all", "rights", "reserved", "é", "x.y", "\n", "{", "cc\x00by"]
    for _ in range(300):
        text = " ".join(random.choices(parts, k=random.randint(0, 25)))
        got = notices.scan_text(text, base, fuzzy)
        found = {p: brute_places(text, p)[1] for p in notices.BASE_PHRASES}
        starts = sorted(x for v in found.values() for x in v)
        assert got[0] == brute_places(text, "cc by")[0] and got[1] == len(starts)
        assert got[2:4] == ((starts[0], starts[-1]) if starts else (None, None))
        assert got[4] == ",".join(sorted(notices.BASE_PHRASES[p] for p, v in found.items() if v))
        assert set(filter(None, got[4].split(","))) <= set(got[5].split(","))


def test_pigeonhole_finds_all_edited_notices():
    """Every notice with as many random edits as allowed is found at its place."""
    random.seed(7)
    fuzzy = notices.FuzzyNotices(notices.NOTICES)
    for phrase, label in notices.NOTICES:
        errors = next(n[2] for n in fuzzy.notices if n[0] == phrase)
        for _ in range(10):
            chars = list(phrase)
            for _ in range(errors):
                chars[random.randrange(1, len(chars) - 1)] = random.choice("qxz")
            stream = " qq " + "".join(chars) + " qq "
            assert any(m[1] < 4 + len(phrase) and m[2] > 4 for m in fuzzy.matches(stream)), (phrase, chars)
            assert label


def least_edits(phrase, stream, start):
    """(edits, end) of the best match from ``start`` that ends between words."""
    row, best = list(range(len(phrase) + 1)), (99, 0)
    for at in range(start, min(len(stream), start + len(phrase) + 9)):
        new = [row[0] + 1]
        for i, c in enumerate(phrase):
            new.append(min(row[i] + (c != stream[at]), row[i + 1] + 1, new[i] + 1))
        row = new
        if stream[at] != " " and stream[at + 1 : at + 2] in ("", " "):
            best = min(best, (row[-1], at + 1))
    return best


def test_notices_edited_at_their_edges():
    random.seed(9)
    fuzzy = notices.FuzzyNotices(notices.NOTICES)
    for phrase, label, errors, _ in fuzzy.notices:
        for text in (phrase + "s", "x" + phrase, phrase[1:], phrase[:-1]):
            for stream, places in ((f" qq {text} qq ", 1), (f" {text} {text} ", 2), (f" {text} {phrase} qq {text} ", 3)):
                got = [m for m in fuzzy.matches(stream) if m[0] == label]
                if errors:
                    assert len(got) >= places, (stream, got)
        alone = notices.FuzzyNotices([(phrase, label)])
        for _ in range(20):
            chars = list(phrase)
            for _ in range(random.randint(0, errors + 1)):
                at = random.randrange(len(chars) + 1)
                chars[at : at + random.randint(0, 1)] = random.choice(["", "x", " ", "e"])
            stream = " " + " ".join(("qq " + "".join(chars) + " zz").split()) + " "
            found = [(least_edits(phrase, stream, s)[0], s) for s in range(1, len(stream)) if stream[s - 1] == " " and stream[s] != " "]
            got = alone.matches(stream)
            assert min([m[3] for m in got], default=None) == min([f[0] for f in found if f[0] <= errors], default=None), (phrase, stream, got)


def test_notices_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: r for r in notices.scan_licenses(odd_docs).collect()}
    assert rows[1].n_words == 0 and rows[1].labels == "" and rows[1].first_word is None and rows[1].score == 0
    assert notices.scan_licenses(no_docs).count() == 0


PAGE = """<!DOCTYPE html><title>x</title><style>p{}</style><body><h1>Head</h1><p>One <b>two</b>
 three<p>Four<br>five<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul><div hidden>no</div><div style="display: none">no</div>
<table><caption>Cap</caption><tr><th>Name<th>Value<tr><td>alpha<td>1<tr><td rowspan=2>b<td>22<tr><td>z</table>
<pre>
 keep  this
   that</pre><script>if (a<b) "</p>"</script>tail &amp; &lt;end"""
SHOWN = """Head

One two three

Four
five

- a
- b
  3. x
  4. y
- c

Cap
Name   Value
alpha  1
b      22
       z

 keep  this
   that

tail & <end"""


def test_render_layout():
    text, counts = render.render(PAGE)
    assert text == SHOWN
    assert counts["items"] == 5 and counts["cells"] == 7 and counts["tables"] == 1


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("a < b", "a < b"), ("</p></div>x", "x"), ("<p>a<p>b", "a\n\nb"), ("<b" * 50, "<b" * 50), ("<td>x", "x"), ('<a title="un closed>x', '<a title="un closed>x'[20:] or "x"),
    ("<!-- open <p>x", ""), ("<script>x", ""), ("<p hidden>a<p>b", "b"), ("a&nbsp;b&lt;", "a b<"), ("<ul><ul><li>q</ul></ul>", "- q"),
])
def test_render_broken(page, text):
    assert render.render(page)[0] == text


@pytest.mark.parametrize("page, text", [
    ("<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then", "If x=2 then"),
    ("<math><semantics><mi>y</mi><annotation>tex</annotation></semantics></math>!", "y!"),
    ("a<svg><title>no</title><title/><defs><text>no</text></defs><g>no<text x=1>one</text><path d='z'/><text>t<tspan>wo</tspan></text></g></svg>b", "a one two b"),
    ("<svg><rect style='display:none'/><text>x</text><foreignObject><div>in</div></foreignObject></svg>", "x\nin"),
    ("<svg><text>x<p>out", "x\n\nout"), ("<svg><a href=q/><text>x</text></a></svg>y", "x y"),
    ("a<select><option>one<option selected>two<option>three</select>b", "a two b"), ("<select><option>one<option>two</select>", "one"),
    ("<select multiple><optgroup label=g><option>one<option label=zwei>two</select>.", "g one zwei ."),
    ("<select><option>one<select>x", "one x"), ("<select><option>a</select><select><option>b</select>", "a b"),
    ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes <b>too</b></p>no</div>end", "yes too\n\nend"),
    ("<ul><li style='visibility:hidden'>no<li>b</ul>", "- b"), ("<div style='display:none'>no<p style='visibility:visible'>no", ""),
])
def test_render_shows_all_visible_text(page, text):
    assert render.render(page)[0] == text


def test_render_deep_and_rows(spark):
    deep = "<div>" * 50000 + "x"
    rows = spark.createDataFrame([(1, "u", deep), (None, None, None), (2, None, "<p>é</p>")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text) for r in render.render_pages(rows).collect()) == [(0, ""), (1, "x"), (2, "é")]


def test_labellers_recover_accuracies():
    import numpy as np

    rng = np.random.default_rng(3)
    bad = rng.random(20000) < 0.2
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.7])
    votes = np.where(rng.random((20000, 7)) < right, bad[:, None], ~bad[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = -1
    patterns = {}
    for v in votes:
        patterns[classifier._pattern(tuple(v))] = patterns.get(classifier._pattern(tuple(v)), 0) + 1
    q, prior, p = classifier.fit_labellers(patterns)
    assert abs(prior - 0.2) < 0.02
    assert np.abs(p[1, :, 2] / (p[1, :, 1] + p[1, :, 2]) - right).max() < 0.05
    guess = np.array([q[classifier._pattern(tuple(v))] > 0.5 for v in votes])
    assert (guess == bad).mean() > 0.95


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("test tables are absent")
    got = classifier.classify(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) > 0.97 * len(good)
    assert sum(not r.kept for r in bad) > 0.6 * len(bad)


def test_classifier_odd_rows(odd_docs, no_docs):
    rows = classifier.classify(odd_docs).collect()
    assert len(rows) == 8 and all(not r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert classifier.classify(no_docs).count() == 0 and classifier.keep_good(no_docs).count() == 0


def test_deep_and_open_markup_takes_linear_time():
    for source, want in (("<div>" * 50000 + "x", "x"), ("<a " * 50000, None), ("<div>" * 20000 + "</x>" * 20000 + "y", "y"), ("<i>" * 50000 + "<li>z" * 100, None)):
        begin = time.process_time()
        text, _ = render.render(source)
        assert time.process_time() - begin < 5, source[:20]
        assert want is None or text.strip() == want
    assert render.render("a <b")[0] == "a <b" and render.render("a <!-- b")[0].strip() == "a"


def test_wide_cells_keep_the_columns_aligned():
    long, word = "many words " * 12, "w" * 90
    text, _ = render.render(f"<table><tr><td>{long}<td>right<tr><td>short<td>below<tr><td>{word}<td>after<tr><td>a<td>b</table>")
    lines = text.split("\n")
    places = {w: next(x.index(w) for x in lines if w in x.split()) for w in ("right", "below", "after")}
    assert len(set(places.values())) == 1 and max(map(len, lines)) <= 90
    assert text.split().count("many") == 12 and word in lines and lines.index(word) < next(k for k, x in enumerate(lines) if "after" in x)


def test_every_visible_text_stands_once_in_order():
    """Random trees: what a plain walk calls visible is what the text holds, in this order."""
    rng = random.Random(4)

    def tree(depth):
        kind = rng.choice(["text"] * 3 + ["div", "span", "p", "ul", "table", "b", "blockquote", "hidden", "script"])
        if kind == "text" or depth > 5:
            word = f"w{rng.randrange(10**9)}"
            return f" {word} ", [word]
        if kind == "script":
            return f"<script>s{rng.randrange(99)} < </script>", []
        if kind == "table":
            rows = [[f"c{rng.randrange(10**9)}" for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))]
            return "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>", [c for r in rows for c in r]
        parts = [tree(depth + 1) for _ in range(rng.randint(0, 4))]
        inner, words = "".join(p[0] for p in parts), [w for p in parts for w in p[1]]
        if kind == "hidden":
            return f"<div style='display:none'>{inner}</div>", []
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{p[0]}" for p in parts) + "</ul>", words
        if kind in ("p", "span", "b"):  # blocks inside of them would end them early
            words = [f"t{rng.randrange(10**9)}"]
            return f"<{kind}>{words[0]}</{kind}> ", words
        return f"<{kind}>{inner}</{kind}>", words

    for _ in range(300):
        parts = [tree(0) for _ in range(5)]
        text, _ = render.render("".join(p[0] for p in parts))
        assert [w for w in text.split() if w != "-"] == [w for p in parts for w in p[1]]
