"""Importance resampling towards a target: hashed n-gram weights and Gumbel top-k.

Each run of up to n words falls into the bucket of its CRC-32. The CRC states of frequent
words and the states of frequent word pairs are looked up in a broadcast head vocabulary of
fixed size; the tail takes direct CRCs. A pair's state goes on from its first word's, so head
and tail give the same buckets, and the size of the head changes speed only.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import lowered, slices
from docweave.session import store

BUCKETS, SEED = 10_000, 2024
#: Words, and pairs of them, whose CRC states are broadcast.
HEAD_WORDS, HEAD_PAIRS = 20_000, 100_000
#: Rows of one range of the ranking.
RANGE_ROWS = 500_000


class Head:
    """CRC states of frequent words and pairs. ``words`` in order; ``pairs`` as index pairs."""

    def __init__(self, words: list[bytes], pairs: list[tuple[int, int]]):
        self.index = {w: i for i, w in enumerate(words)}
        self.states = np.array([zlib.crc32(w) for w in words], np.uint32)
        # first word * number of words + second word, sorted, with the states of the pairs
        keys = np.array([a * len(words) + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_states = np.array([zlib.crc32(b" " + words[b], int(self.states[a])) for a, b in pairs], np.uint32)[order]

    def buckets(self, words: list[bytes], most: int, buckets: int) -> np.ndarray:
        """Bucket of each run of 1 to ``most`` words, in order of length and start."""
        get = self.index.get
        code = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        state = np.zeros(len(words), np.uint32)
        state[code >= 0] = self.states[code[code >= 0]]
        for i in np.flatnonzero(code < 0).tolist():
            state[i] = zlib.crc32(words[i])
        out = [state % np.uint32(buckets)]
        for length in range(2, min(most, len(words)) + 1):
            longer = np.zeros(len(words) - length + 1, np.uint32)
            open_ = np.ones(len(longer), bool)
            if length == 2 and len(self.pair_keys):
                a, b = code[:-1], code[1:]
                key = a * len(self.index) + b
                at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                known = (a >= 0) & (b >= 0) & (self.pair_keys[at] == key)
                longer[known], open_ = self.pair_states[at[known]], ~known
            for i in np.flatnonzero(open_).tolist():
                longer[i] = zlib.crc32(b" " + words[i + length - 1], int(state[i]))
            state = longer
            out.append(state % np.uint32(buckets))
        return np.concatenate(out)


def _texts(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, F.col("text").cast("string").alias("text"))


def _frequent(df: DataFrame, most: int) -> list[bytes]:
    """The ``most`` most frequent grams; ``df`` has (gram, n) with partial counts.

    A histogram of the counts by powers of two cuts off all grams that cannot be among them,
    so that tasks do not each send their own ``most`` to the driver.
    """
    if most < 1:
        return []
    counts = store(df.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    power = F.length(F.bin("n"))
    sizes = {r.power: r.grams for r in counts.groupBy(power.alias("power")).agg(F.count("*").alias("grams")).collect()}
    least, held = max(sizes, default=0), 0
    for p in sorted(sizes, reverse=True):
        least, held = p, held + sizes[p]
        if held >= most:
            break
    return [bytes(r.gram) for r in counts.where(power >= least).orderBy(F.desc("n"), "gram").limit(most).collect()]


def head_vocabulary(docs: DataFrame, n: int = 1, head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS) -> Head:
    """Frequent words of all texts by exact counts; with n > 1 also the frequent pairs of them."""
    texts = _texts(docs)

    def count_words(batches):
        for batch in slices(batches, 4000):
            seen = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(lowered(text).split())
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["gram", "n"])

    words = _frequent(texts.mapInArrow(count_words, "gram binary, n bigint"), head_words)
    if n < 2 or not words:
        return Head(words, [])
    index = {w: i for i, w in enumerate(words)}
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count_pairs(batches):
        get = shared.value.get
        for batch in slices(batches, 4000):
            seen = Counter()
            for text in batch.column(0).to_pylist():
                codes = [get(w) for w in lowered(text).split()]
                seen.update((a, b) for a, b in zip(codes, codes[1:], strict=False) if a is not None and b is not None)
            grams = pa.array([b"%d %d" % p for p in seen], pa.binary())
            yield pa.RecordBatch.from_arrays([grams, pa.array(seen.values(), pa.int64())], ["gram", "n"])

    pairs = _frequent(texts.mapInArrow(count_pairs, "gram binary, n bigint"), head_pairs)
    return Head(words, [tuple(map(int, p.split())) for p in pairs])


def _bucketed(df: DataFrame, head, n: int, buckets: int, carry: list[str]) -> DataFrame:
    """Each row with its number of words and its buckets; at the end of a task rows (bucket, total)."""
    texts = df.select(F.struct(*carry).alias("row"), F.col("text").cast("string").alias("text"))
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    names = ["row", "n_words", "buckets", "bucket", "total"]

    def run(batches):
        total, row_type = np.zeros(buckets, np.int64), None
        for batch in slices(batches):
            row_type = batch.column(0).type
            n_words, held = [], []
            for text in batch.column(1).to_pylist():
                words = lowered(text).split()
                found = head.value.buckets(words, n, buckets) if words else np.empty(0, np.uint32)
                total += np.bincount(found, minlength=buckets)
                n_words.append(len(words))
                held.append(found.astype(kind).tobytes())
            rest = [pa.nulls(len(held), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(held, pa.binary()), *rest], names)
        at = np.flatnonzero(total)
        if len(at):
            empty = [pa.nulls(len(at), t) for t in (row_type, pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names)

    row_type = texts.schema["row"].dataType.simpleString()
    return texts.mapInArrow(run, f"row {row_type}, n_words bigint, buckets binary, bucket bigint, total bigint")


def _totals(bucketed: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in bucketed.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("total").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the smoothed target share over the smoothed source share of each bucket."""
    n, m = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * n / ((s + 1) * m))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: str, seed: int) -> Column:
    """Thousandths of Gumbel noise from a digest of the id; a null id counts as the word null."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """``rank`` of the best ``percent`` of the rows with ``eligible``, null elsewhere.

    Rows are dealt into ranges of the order; a range's offset is the number of rows before
    it, so no task sees more than a range. Ties go to the smaller id, null ids last.
    """
    spark = scored.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    able = scored.where("eligible")
    n = able.count()
    parts = max(spark.sparkContext.defaultParallelism, -(-n // RANGE_ROWS))
    dealt = store(able.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    # As many numbers as there are ranges.
    sizes = {r._part: r.n for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    draw, before, last = n * percent // 100, 0, -1
    offsets = []
    for part in sorted(sizes):
        if before >= draw:
            break
        offsets.append((part, before))
        before, last = before + sizes[part], part
    known = F.broadcast(spark.createDataFrame(offsets, "_part int, _offset long"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_offset")
    first = dealt.where(F.col("_part") <= last).join(known, "_part").withColumn("rank", F.when(number <= draw, number)).drop("_offset")
    none = F.lit(None).cast("long").alias("rank")
    rest = dealt.where(F.col("_part") > last).select("*", none)
    return first.unionByName(rest).drop("_part").unionByName(scored.where(~F.col("eligible")).select("*", none)).drop("eligible")


def resample(
    docs: DataFrame,
    target: DataFrame,
    n: int = 1,
    buckets: int = BUCKETS,
    percent: int = 10,
    least_words: int = 20,
    seed: int = SEED,
    carry: tuple[str, ...] = (),
    head: Head | None = None,
) -> DataFrame:
    """Importance of every document for the ``target`` texts, and a draw without replacement.

    Returns (doc_id, n_features, weight, score, rank) and the columns named in ``carry``.
    ``weight`` sums the gains of a document's runs of 1 to ``n`` words, ``score`` adds Gumbel
    noise; of the documents with ``least_words`` words the best ``percent`` are drawn and
    ranked from 1.

    Null and empty texts have no features, weight 0 and no rank. A null ``doc_id`` stays and
    loses ties; repeated rows count, and may be drawn, as often as they stand. Texts have any
    length; columns not carried are ignored. An empty table gives no rows; an empty target
    gives the gains of zero counts.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(head if head is not None else head_vocabulary(docs, n))
    source = store(_bucketed(docs, known, n, buckets, ["doc_id", *carry]), "buckets")
    aim = _bucketed(target.select("text", F.lit(0).alias("none")), known, n, buckets, ["none"])
    worth = spark.sparkContext.broadcast(gains(_totals(source, buckets), _totals(aim, buckets)))
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    rows = source.where("bucket IS NULL").select("row", "n_words", "buckets")

    def weigh(batches):
        for batch in slices(batches):
            held = [np.frombuffer(x, kind) for x in batch.column(2).to_pylist()]
            sums = [int(worth.value[x].sum()) for x in held]
            arrays = [batch.column(0), batch.column(1), pa.array([len(x) for x in held], pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "n_words", "n_features", "weight"])

    row_type = rows.schema["row"].dataType.simpleString()
    weighed = rows.mapInArrow(weigh, f"row {row_type}, n_words bigint, n_features bigint, weight bigint")
    weighed = weighed.select(F.col("row.doc_id").cast("long").alias("doc_id"), *[F.col(f"row.`{c}`") for c in carry], "n_words", "n_features", "weight")
    scored = weighed.withColumn("score", F.col("weight") + gumbel("doc_id", seed)).withColumn("eligible", F.col("n_words") >= least_words)
    return ranked(store(scored.drop("n_words"), "scored"), percent).select("doc_id", *carry, "n_features", "weight", "score", "rank")
