"""Mixing sources to target weights by whole copies and Pareto order sampling.

Every document has an expected number of copies: its source's share of the target, spread
over the source's documents by a weight that grows with the logarithm of their size. The
whole part is taken for certain. The fraction p is an inclusion probability: documents are
ranked by (u / (1 - u)) / (p / (1 - p)) with u uniform from a hash of the id (Rosen 1997), and
the source's remaining words are taken in this order. All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import WORD
from docweave.session import store

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Ranks are cut into so many buckets for running sums of large sources.
BUCKETS = 4096
SEED = "mix"


def water_fill(df: DataFrame, part: list[str], need: str, cap: str, weight: str) -> DataFrame:
    """Add ``fill``: amounts min(cap, level * weight) that add up to ``need`` in each part.

    Rows go in the order of cap / weight; once those before are set apart as full, the rest
    share by weight, and the first row above its share fixes the level. A part has one row
    per source or size class.
    """
    order = Window.partitionBy(*part).orderBy(F.col(cap) / F.col(weight), "ord")
    full = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    leveled = df.withColumn("level", (F.col(need) - full) / rest)
    above = F.col(cap) / F.col(weight) > F.col("level")
    first = F.min(F.when(above, F.struct(F.col(cap) / F.col(weight), F.col("ord"), F.col("level")))).over(Window.partitionBy(*part))
    fill = F.least(F.col(cap).cast("double"), first["level"] * F.col(weight))
    return leveled.withColumn("fill", F.coalesce(fill, F.col(cap).cast("double"))).drop("level")


def sizes_of(docs: DataFrame, carry: tuple[Column, ...] = ()) -> DataFrame:
    kept = [F.struct(*carry).alias("_carried")] if carry else []
    return docs.select(*kept, "doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES, seed: str = SEED, carry: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, expected, copies, taken) of every document,
    after the columns ``carry``.

    Null texts have size 0; the null source is one source, ordered last; sources without
    words get target 0. Rows that share an id share their random number and are ordered by
    size; equal rows count one by one. An empty table gives no rows. Only per-source and
    per-bucket sums are ordered in one task; documents are spread over ``BUCKETS`` of ranks.
    """
    slim = store(sizes_of(docs, carry), "mix-sizes")
    return mix_sizes(slim, weights, most_copies, seed)


def mix_sizes(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """``mix`` over a table (doc_id, source, size), and a struct ``_carried`` that is spread out at the end."""
    carried = ["_carried"] if "_carried" in slim.columns else []
    # Weight of a document: 1 + the number of binary digits of its size, at most 64 classes.
    classed = slim.withColumn("class", F.length(F.bin("size")).cast("long") + 1)
    by_class = classed.groupBy("source", "class").agg(F.sum("size").alias("class_size"))
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").isNull(), "source")
    by_source = (
        by_class.groupBy("source").agg(F.sum("class_size").alias("source_size"))
        .withColumn("ord", F.row_number().over(order).cast("long"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("ord") - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("need", F.sum("source_size").over(every))
        .withColumn("cap", F.col("source_size") * most_copies)
        .withColumn("zero", F.lit(0))
    )
    # A row per source, and per source and size class: stored, so that what reads them does not plan them again.
    targets = store(water_fill(by_source, ["zero"], "need", "cap", "weight").select("source", "source_size", F.col("fill").alias("target")), "mix-targets")
    copies = (
        by_class.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
        .select("c.source", "class", "class_size", "source_size", "target")
        .withColumn("cap", F.col("class_size") * most_copies).withColumn("w", F.col("class_size") * F.col("class")).withColumn("ord", F.col("class"))
        .where("class_size > 0")
    )
    shares = water_fill(copies, ["source"], "target", "cap", "w").select("source", "class", (F.col("fill") / F.col("class_size")).alias("expected"))
    expected = store(shares, "mix-expected")
    known = expected.withColumnsRenamed({"source": "s", "class": "k"})
    totals = targets.withColumnRenamed("source", "ts")
    rows = (
        classed.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("k")), "left")
        .join(totals, F.col("source").eqNullSafe(F.col("ts")))
        .withColumn("expected", F.coalesce("expected", F.lit(0.0)))
        .withColumn("whole", F.floor("expected").cast("long"))
        .withColumn("p", F.col("expected") - F.col("whole"))
        .withColumn("u", (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48))
        .withColumn("odds", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
        .withColumn("bucket", F.when(F.col("p") > 0, F.floor(F.col("odds") / (1 + F.col("odds")) * BUCKETS).cast("long")))
    )
    sums = rows.groupBy("source", "bucket").agg(
        F.sum(F.col("size") * F.col("whole")).alias("certain"), F.sum("size").alias("sampled"), F.max("target").alias("target")
    )
    part = Window.partitionBy("source")
    ranked = sums.withColumn("left", F.col("target") - F.sum("certain").over(part)).where("bucket IS NOT NULL")
    before = F.coalesce(F.sum("sampled").over(part.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.withColumn("before", before).select(F.col("source").alias("bs"), F.col("bucket").alias("bb"), "left", "before", "sampled")
    rows = rows.join(ranked, F.col("source").eqNullSafe(F.col("bs")) & (F.col("bucket") == F.col("bb")), "left")
    crossing = (F.col("before") < F.col("left")) & (F.col("before") + F.col("sampled") > F.col("left"))
    # Documents of the bucket in which the target is met are ordered one by one.
    within = Window.partitionBy("bs", "bb").orderBy("odds", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.where(crossing).withColumn("upto", F.col("before") + F.sum("size").over(within))
    met = met.withColumn("extra", (F.col("upto") - F.col("size") / 2 <= F.col("left")).cast("long"))
    other = rows.where(~F.coalesce(crossing, F.lit(False))).withColumn("extra", F.coalesce((F.col("before") + F.col("sampled") <= F.col("left")) & (F.col("sampled") > 0), F.lit(False)).cast("long"))
    shown = [*carried, "doc_id", "source", "size", "source_size", "target", "expected", "whole", "extra"]
    both = met.select(*shown).unionByName(other.select(*shown)).withColumn("copies", F.col("whole") + F.col("extra"))
    return both.select(*[f"{c}.*" for c in carried], "doc_id", "source", "size", "source_size", "target", "expected", "copies", (F.col("size") * F.col("copies")).alias("taken"))
