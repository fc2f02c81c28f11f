"""Benchmark decontamination by a broadcast set of normalised n-grams.

Windows of consecutive words of the test items are hashed into a broadcast set; token windows
of the training texts are looked up in one narrow scan, and each hit is verified word by word.
Hit spans, or whole documents, can be removed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import batch_hashes, lowered, slices, window_hashes
from docweave.session import store

WIDTH = 10
#: At most about so many (window, item) rows are sent to the tasks at once; more go in several scans.
MOST_WINDOWS = 500_000
_WORD = re.compile(rb"[^ ]+")
_SPAN = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("first_byte", pa.int64()), ("end_byte", pa.int64())])
_SPAN_DDL = "array<struct<first_word:bigint,end_word:bigint,first_byte:bigint,end_byte:bigint>>"


def test_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct (window, item): windows of ``width`` words, or all words of a shorter item."""

    def cut(batches):
        for batch in slices(batches):
            windows, items = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = lowered(text).split()
                found = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else ()
                windows.extend(found)
                items.extend([item] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(items, pa.string())], ["window", "item"])

    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    return benchmark.select(item.alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "window binary, item string").distinct()


class WindowSet:
    """Test windows by number of words, as hashes to search and as words to verify."""

    def __init__(self, rows: list[tuple[bytes, str]]):
        self.items: dict[bytes, list[str]] = {}
        for window, item in rows:
            self.items.setdefault(window, []).append(item)
        by_length: dict[int, list[bytes]] = {}
        for window in self.items:
            by_length.setdefault(window.count(b" ") + 1, []).append(window)
        self.levels = []
        for length, windows in sorted(by_length.items()):
            hashes, at = batch_hashes([w.decode("utf-8", "surrogatepass") for w in windows])
            keys = np.unique(np.concatenate([window_hashes(hashes[i:j], length) for i, j in zip(at, at[1:], strict=False)]))
            # A bit for each key in a table of 16 times as many, so most windows cost one look.
            shift = np.uint64(64 - max(16, (16 * len(keys)).bit_length()))
            near = np.zeros(1 << (64 - int(shift)), bool)
            near[keys >> shift] = True
            self.levels.append((length, keys, near, shift))

    def hits(self, data: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """(number of words, hit windows as (first word, end), items) of each text of lowered bytes."""
        hashes, at = batch_hashes([d.decode("utf-8", "surrogatepass") for d in data])
        out = [(int(n), [], set()) for n in np.diff(at)]
        words: dict[int, list[bytes]] = {}
        for length, keys, near, shift in self.levels:
            keyed = window_hashes(hashes, length)
            maybe = np.flatnonzero(near[keyed >> shift])
            maybe = maybe[keys[np.minimum(np.searchsorted(keys, keyed[maybe]), len(keys) - 1)] == keyed[maybe]]
            owner = np.searchsorted(at, maybe, "right") - 1
            inside = maybe + length <= at[owner + 1]
            for doc, first in zip(owner[inside].tolist(), (maybe - at[owner])[inside].tolist(), strict=True):
                if doc not in words:
                    words[doc] = data[doc].split()
                found = self.items.get(b" ".join(words[doc][first : first + length]))
                if found is not None:  # verified word by word
                    out[doc][1].append((first, first + length))
                    out[doc][2].update(found)
        return out


def merged(spans: list[tuple]) -> list[tuple]:
    """Spans joined where they overlap or touch in words; each (first word, end, first byte, end)."""
    out: list[list] = []
    for span in sorted(spans):
        if out and span[0] <= out[-1][1]:
            if span[1] > out[-1][1]:
                out[-1][1], out[-1][3] = span[1], span[3]
        else:
            out.append(list(span))
    return [tuple(s) for s in out]


def _scan(docs: DataFrame, windows: list[tuple[bytes, str]]) -> DataFrame:
    """Adds the hits of a set of windows to those that ``docs`` (row, text, n_words, spans, items) has."""
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(windows))
    names = [f.name for f in _SPAN]

    def run(batches):
        for batch in slices(batches):
            data = [lowered(t) for t in batch.column(1).to_pylist()]
            counts, spans, items = [], [], []
            before = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            for text, (n, places, found), (old_spans, old_items) in zip(data, shared.value.hits(data), before, strict=True):
                held = [tuple(s.values()) for s in old_spans]
                if places:
                    edges = [m.span() for m in _WORD.finditer(text)]
                    held += [(i, j, edges[i][0], edges[j - 1][1]) for i, j, _, _ in merged([(i, j, 0, 0) for i, j in places])]
                counts.append(n)
                spans.append([dict(zip(names, s, strict=True)) for s in merged(held)])
                items.append(sorted(found.union(old_items)))
            arrays = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "text", "n_words", "spans", "items"])

    return docs.mapInArrow(run, docs.schema)


def _scanned(docs: DataFrame, benchmark: DataFrame, width: int, most: int) -> DataFrame:
    """(row, text, n_words, spans, items); ``row`` has all columns of ``docs``."""
    windows = store(test_windows(benchmark, width), "windows")
    parts = max(1, -(-windows.count() // most))
    part = F.pmod(F.xxhash64("window", "item"), F.lit(parts))
    text = F.col("text").cast("string")
    out = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), F.lit(None).cast("bigint").alias("n_words"),
        F.array().cast(_SPAN_DDL).alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    for i in range(parts):
        held = [(bytes(r.window), r.item) for r in windows.where(part == i).collect()]
        # Each scan sees one part of the windows; written results keep the parts out of each other's memory.
        out = _scan(out if i == 0 else store(out, "hits"), held)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = MOST_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, spans, items, contaminated) of every document.

    A window is ``width`` consecutive words of a ``benchmark`` item, or all words of a shorter
    one. ``spans`` are the merged stretches of words inside of occurring windows, with bytes of
    the text's UTF-8 form; ``items`` are the sorted ids of items with an occurring window.

    Null, empty and blank texts have no words and no hits. Items without words have no window;
    null item ids count as one item named null, repeated item ids as one item. A null
    ``doc_id`` stays, repeated rows give repeated results, other columns are ignored. Whole
    texts of any length are scanned. An empty table gives no rows, an empty benchmark no hits.
    """
    found = _scanned(docs.select("doc_id", "text"), benchmark, width, most)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end_word"] - s["first_word"])
    return found.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        "spans", "items", (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", width: int = WIDTH, most: int = MOST_WINDOWS) -> DataFrame:
    """``docs`` without hit spans (``remove="spans"``) or without contaminated documents
    (``"documents"``); columns and clean rows stay as they are. Hits as in ``find_contamination``."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is spans or documents, not {remove}")
    found = _scanned(docs, benchmark, width, most)
    columns = [F.col(f"row.`{c}`") for c in docs.columns]
    if remove == "documents":
        return found.where(F.size("spans") == 0).select(*columns)

    def cut(batches):
        for batch in slices(batches):
            texts = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if spans:
                    data, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
                    for span in spans:
                        kept.append(data[at : span["first_byte"]])
                        at = span["end_byte"]
                    text = b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    clean = found.mapInArrow(cut, f"row {found.schema['row'].dataType.simpleString()}, text string")
    return clean.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
