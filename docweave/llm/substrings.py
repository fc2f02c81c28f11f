"""Substring dedup by level-wise doubling.

A word window of the full length can only repeat if its halves do, theirs too, and so on.
The first level takes, for every full window, its least base window by hash as a witness
(equal windows have equal witnesses) and keeps the witnesses that occur twice. Only full
windows around them go on: at each doubled length all of their parts must repeat, until the
asked length is reached or no candidate survives. The smallest place of each surviving window
stays, all others are removed. Inside of one document equal windows are one row, so a phrase
that fills a text is no hot key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import batch_hashes, flat_lists, id_back, id_key, mix, slices, split_words, text_key, window_hashes
from docweave.session import store

BASE, LENGTH = 10, 20
_LOW = np.uint64(0xFFFFFFFF)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of ``span`` values, by doubling."""
    width = 1
    while width * 2 <= span:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (span - width)], values[span - width :])


def witnesses(small: np.ndarray, base: int, length: int) -> np.ndarray:
    """For each full window the position of its least base window, the first of equal ones."""
    span = length - base + 1
    if len(small) < span:
        return np.empty(0, np.int64)
    place = np.arange(len(small), dtype=np.uint64)
    return (_least((mix(small) & ~_LOW) | place, span) & _LOW).astype(np.int64)


_ROWS = "h bigint, id bigint, t bigint, at int, n int"


def _distinct(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first place, number of places) of the windows of one document."""
    h, first, n = np.unique(h[at], return_index=True, return_counts=True)
    return h, at[first], n


def _emit(found: list[tuple]) -> pa.RecordBatch:
    ids, keys = (np.repeat(np.array([f[k] for f in found], np.int64), [len(f[2]) for f in found]) for k in (0, 1))
    h, at, n = (np.concatenate([f[k] for f in found]) for k in (2, 3, 4))
    arrays = [pa.array(h.view(np.int64)), pa.array(ids), pa.array(keys), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, ["h", "id", "t", "at", "n"])


def _repeated(rows: DataFrame) -> DataFrame:
    """(id, t, ats): first places in each document of the hashes that occur twice or more."""
    twice = rows.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    return rows.join(twice, "h", "left_semi").groupBy("id", "t").agg(F.collect_list("at").alias("ats"))


def _hashed(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    hashes, at = batch_hashes(batch.column(column).to_pylist())
    return [hashes[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, base: int = BASE, carry: tuple[str, ...] = (), spaced: bool = True, keep_text: bool = True
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of every document.

    A word goes if a window of ``length`` words covers it that starts earlier as well: in a
    document with a smaller id, or before in the same one. Windows are judged on the input.
    Whole copies of an earlier document go at once. Texts shorter than a window, null and
    empty ones lose nothing. A null ``doc_id`` comes before all others; rows that share an id
    are judged by themselves, none is earlier at equal starts; equal rows give equal results.
    Other columns are ignored; an empty table gives no rows. ``length`` is ``base`` times a
    power of two. ``kept_text`` has the kept words joined by one space; unless ``spaced``,
    texts that lose nothing stay as they are. Without ``keep_text`` it is null. String columns in ``carry`` are passed on.
    """
    if length % base or (length // base) & (length // base - 1):
        raise ValueError("length has to be base times a power of two")
    chosen = docs.select(id_key("doc_id").alias("id"), F.col("text").cast("string").alias("text"), text_key().alias("t"))
    passed = [f"carry{k}" for k in range(len(carry))]
    carried = docs.select(id_key("doc_id").alias("id"), F.col("text").cast("string").alias("text"), text_key().alias("t"), *(F.col(c).cast("string").alias(p) for c, p in zip(carry, passed, strict=True)))

    def first_level(batches):
        for batch in slices(batches, 500):
            found = []
            for doc, t, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _hashed(batch, 1), strict=True):
                if len(h) >= length:
                    small = window_hashes(h, base)
                    at = witnesses(small, base, length)
                    found.append((doc, t, *_distinct(small, at[np.concatenate([[True], at[1:] != at[:-1]])])))
            if found:
                yield _emit(found)

    def digest(batches):
        for batch in slices(batches):
            words = [split_words(t) for t in batch.column(1).to_pylist()]
            sums = [hashlib.sha256(b" ".join(w)).digest() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, words), pa.int64()), pa.array(sums, pa.binary()), batch.column(2)], ["id", "n_words", "sum", "t"])

    sums = store(chosen.mapInArrow(digest, "id bigint, n_words bigint, sum binary, t bigint").where(F.col("n_words") >= length), "digests")
    firsts = sums.groupBy("sum").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = sums.join(firsts, "sum").where("id <> first").select("id", "t", F.col("sum").alias("copy_sum")).distinct()
    places = _repeated(chosen.mapInArrow(first_level, _ROWS))
    marked = carried.join(places, ["id", "t"], "left").join(copies, ["id", "t"], "left").select("id", "text", "ats", "copy_sum", "t", *passed)
    names = ["id", "n_words", "n_removed", "kept_sha256", "kept_text", "text", "starts"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()))

    def settle(batches):
        """Results as if nothing repeated; whole copies are done, candidates keep their text."""
        for batch in slices(batches, 500):
            flat, offsets = flat_lists(batch.column(2))
            flat, rows = flat.to_numpy(), []
            for k, (doc, text, h, whole) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _hashed(batch, 1), batch.column(3).to_pylist(), strict=True)):
                joined = b" ".join(split_words(text))
                sha = hashlib.sha256(joined)
                if whole is not None and sha.digest() == whole:
                    rows.append((doc, len(h), len(h), hashlib.sha256(b"").hexdigest(), "" if keep_text else None, None, None))
                    continue
                starts, kept = None, flat[offsets[k] : offsets[k + 1]]
                if len(kept) and len(h) >= length:
                    small = window_hashes(h, base)
                    starts = np.flatnonzero(np.isin(small, small[kept[kept < len(small)]])[witnesses(small, base, length)]).astype(np.int32)
                    starts = starts if len(starts) else None
                plain = (joined.decode("utf-8", "surrogatepass") if spaced else text) if keep_text else None
                rows.append((doc, len(h), 0, sha.hexdigest(), plain, None if starts is None else text, starts))
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[4:]], [*names, "t", *passed])

    ddl = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string, text string, starts array<int>, t bigint" + "".join(f", {p} string" for p in passed)
    settled = store(marked.mapInArrow(settle, ddl), "settled")
    candidates = "id bigint, text string, starts array<int>, t bigint"
    open_docs = settled.where("text IS NOT NULL").select("id", "text", "starts", "t")

    def windows(width):
        """The windows of ``width`` words that full candidates consist of."""

        def run(batches):
            for batch in slices(batches, 500):
                flat, offsets = flat_lists(batch.column(2))
                flat, found = flat.to_numpy(), []
                for k, (doc, t, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), _hashed(batch, 1), strict=True)):
                    s = flat[offsets[k] : offsets[k + 1]]
                    at = np.unique(np.concatenate([s + j for j in range(0, length, width)])) if width < length else s
                    found.append((doc, t, *_distinct(window_hashes(h, width), at)))
                yield _emit(found)

        return run

    def narrow(width):
        """Candidates whose windows of ``width`` words all repeat."""

        def run(batches):
            for batch in slices(batches, 500):
                (s_flat, s_at), (p_flat, p_at) = flat_lists(batch.column(2)), flat_lists(batch.column(4))
                s_flat, p_flat, out = s_flat.to_numpy(), p_flat.to_numpy(), []
                for k, h in enumerate(_hashed(batch, 1)):
                    s, w = s_flat[s_at[k] : s_at[k + 1]], window_hashes(h, width)
                    known = p_flat[p_at[k] : p_at[k + 1]]
                    good = np.isin(w, w[known[known < len(w)]])
                    for j in range(0, length, width):
                        s = s[good[s + j]]
                    out.append(s)
                live = pa.array([len(s) > 0 for s in out], pa.bool_())
                full = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32())), batch.column(3)], ["id", "text", "starts", "t"])
                yield full.filter(live)

        return run

    width = base * 2
    while width < length:
        places = _repeated(open_docs.mapInArrow(windows(width), _ROWS))
        open_docs = store(open_docs.join(places, ["id", "t"]).select("id", "text", "starts", "t", "ats").mapInArrow(narrow(width), candidates), "level")
        width *= 2
    rows = open_docs.mapInArrow(windows(length), _ROWS)
    first = rows.groupBy("h").agg(F.min(F.struct("id", "at")).alias("first"), F.sum("n").alias("places")).where("places > 1")
    ahead = F.struct("id", "at") == F.col("first")
    later = rows.join(first, "h").where(~ahead | (F.col("n") > 1)).groupBy("id", "t").agg(F.collect_list(F.struct("h", ahead.alias("ahead"))).alias("gone"))

    def cut(batches):
        for batch in slices(batches, 500):
            flat, offsets = flat_lists(batch.column(2))
            gone, ahead, out = flat.field("h").to_numpy(), flat.field("ahead").to_numpy(zero_copy_only=False), []
            for k, (doc, text, t, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), _hashed(batch, 1), strict=True)):
                words, w = split_words(text), window_hashes(h, length).view(np.int64)
                part, lead = gone[offsets[k] : offsets[k + 1]], ahead[offsets[k] : offsets[k + 1]]
                goes = np.isin(w, part)
                own = np.flatnonzero(np.isin(w, part[lead]))  # the first place of these stays
                goes[own[np.unique(w[own], return_index=True)[1]]] = False
                at, cover = np.flatnonzero(goes), np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + length, -1)
                stay = np.cumsum(cover)[:-1] == 0
                joined = b" ".join([x for x, s in zip(words, stay.tolist(), strict=True) if s])
                kept = (joined.decode("utf-8", "surrogatepass") if spaced or not stay.all() else text) if keep_text else None
                out.append((doc, t, int((~stay).sum()), hashlib.sha256(joined).hexdigest(), kept))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["cut_id", "cut_t", "gone", "cut_sha", "cut_text"])

    cuts = open_docs.select("id", "text", "t").join(later, ["id", "t"]).select("id", "text", "gone", "t").mapInArrow(cut, "cut_id bigint, cut_t bigint, gone bigint, cut_sha string, cut_text string")
    cuts = cuts.dropDuplicates(["cut_id", "cut_t"])
    out = settled.drop("text", "starts").join(cuts, (F.col("id") == F.col("cut_id")) & (F.col("t") == F.col("cut_t")) & (F.col("n_removed") == 0), "left")
    return out.select(
        id_back("id").alias("doc_id"), "n_words", F.coalesce("gone", "n_removed").alias("n_removed"), F.coalesce("cut_sha", "kept_sha256").alias("kept_sha256"),
        F.when(F.col("cut_id").isNotNull(), F.col("cut_text")).otherwise(F.col("kept_text")).alias("kept_text"), *(F.col(p).alias(c) for c, p in zip(carry, passed, strict=True)),
    )
