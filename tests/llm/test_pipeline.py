"""The pipeline against its stages run one by one on plain rows."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docweave.llm import classifier, mixing, pieces
from llm.test_wide import brute_links, brute_repeats

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = classifier.fit(docs)
    good = {i for i, r in rows.items() if classifier.judge_text(r.text, model, 0.5)[4]}
    one = corpus_pipeline.quality(spark, docs, SF)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == good
    texts = [(i, rows[i].text) for i in sorted(good)]
    stay = {i for i, (c, _) in brute_links(texts).items() if i == c}
    two = corpus_pipeline.near_copies(spark, one, SF)
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == stay
    want = brute_repeats([t for t in texts if t[0] in stay])
    three = corpus_pipeline.repeats(spark, two, SF)
    got = {r.doc_id: r for r in three.collect()}
    assert three.columns == docs.columns and {i: len(r.text.split()) for i, r in got.items()} == {i: n - k for i, (n, k, _) in want.items()}
    four = corpus_pipeline.mixture(spark, three, SF)
    counts = collections.Counter(r.doc_id for r in four.collect())
    assert four.columns == docs.columns and max(counts.values()) <= 3
    last = corpus_pipeline.pieces(spark, four, SF).collect()
    assert collections.Counter(r.doc_id for r in last) == counts
    assert all(r.decoded == got[r.doc_id].text for r in last)
    assert pieces


def test_pipeline_of_no_rows(spark, no_docs):
    docs = no_docs.drop("id")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.parametrize("k", range(4))
def test_stages_take_odd_rows(spark, odd_docs, k):
    assert corpus_pipeline.STAGES[k][1](spark, odd_docs, SF).columns == corpus_pipeline.COLUMNS


def test_mixture_tells_rows_of_one_id_apart(spark, docs_of):
    """Six texts share an id, others have none: the stage keeps what the mix takes of each."""
    rows = [(1 if i < 6 else None if i < 9 else i, f"text {i} " + "word " * (5 + 7 * (i % 5)), "en", "abc"[i % 3]) for i in range(60)]
    rows += [(9, rows[9][1], "en", "a")] * 3 + [(9, rows[9][1], "en", None)]
    docs = docs_of(rows).drop("id")
    taken = collections.Counter()
    for r in mixing.mix(docs, carry=(F.col("text").alias("words"),)).collect():
        taken[r.doc_id, r.words, r.source] += r.copies
    got = collections.Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.mixture(spark, docs, SF).collect())
    assert got == +taken and sum(got.values()) > 30


def test_training_is_bounded_by_rows_not_ids(spark, docs_of):
    """A repeated id trains with one row for each of its texts, up to the bound."""
    rows = [(5, f"{i} ! ! ! # # # {{}} $$$ %%% " * 5, "en", "a") for i in range(50)] * 2 + [(7, "the quick brown fox goes over the lazy dog and away " * 3, "en", "a")] * 40
    got = {}
    plain = classifier.fit_scorer
    try:
        classifier.fit_scorer = lambda rows: got.update(n=len(rows)) or plain(rows)
        for bound in (4000, 10):
            classifier.fit(docs_of(rows), bound)
            assert got["n"] == min(bound, 51)
    finally:
        classifier.fit_scorer = plain
