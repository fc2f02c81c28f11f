"""A corpus from raw documents to pieces, as stages that each rewrite the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.llm.chosen_path import near_classes
from docweave.llm.classifier import keep_good
from docweave.llm.common import WORD, id_key, text_key
from docweave.llm.mixing import mix
from docweave.llm.pieces import encode_n_best
from docweave.llm.queries import PIECE_MODEL
from docweave.llm.substrings import remove_repeats
from docweave.session import store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: EM, randomised joins and piece lattices are beyond SQL.
ORACLE_SQL = None


def quality(spark, docs, sf_dir):
    """Documents that the weak-label classifier rejects go."""
    return keep_good(docs.select(*COLUMNS))


def near_copies(spark, docs, sf_dir):
    """The row of the smallest id of each class of near-duplicates stays, once; a row only
    goes if its class has another one, so texts without words stay."""
    stay = near_classes(docs).where("stays").select(F.col("id").alias("key"), "t")
    rows = docs.select(*COLUMNS, id_key("doc_id").alias("key"), text_key().alias("t"))
    firsts = rows.join(stay, ["key", "t"], "left_semi").dropDuplicates(["key", "t"])
    wordless = rows.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return firsts.unionByName(wordless).select(*COLUMNS)


def repeats(spark, docs, sf_dir):
    """Words of repeated 20-word windows go; texts without any stay as they are."""
    kept = remove_repeats(docs, carry=("lang", "source"), spaced=False)
    text = F.col("kept_text")
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mixture(spark, docs, sf_dir):
    """Each document as often as the mix takes it.

    Rows are told apart by id, text and source; the copies of equal ones add up and are
    taken from one of them.
    """
    keys = ["key", "t", "s"]
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    chosen = (id_key("doc_id").alias("key"), text_key().alias("t"), source.alias("s"))
    copies = mix(docs, carry=chosen).where("copies > 0").groupBy(*keys).agg(F.sum("copies").cast("int").alias("copies"))
    rows = docs.select(*COLUMNS, *chosen).dropDuplicates(keys).join(copies, keys)
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*COLUMNS)


def pieces(spark, docs, sf_dir):
    """Piece ids of each text, with the next best segmentations."""
    return encode_n_best(docs, PIECE_MODEL, 4)


STAGES = [
    ("quality_classifier", quality),
    ("chosen_path_join", near_copies),
    ("substring_dedup", repeats),
    ("pareto_mix", mixture),
    ("piece_n_best", pieces),
]


def run(spark, sf_dir):
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
