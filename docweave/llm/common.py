"""Helpers shared by the corpus operators: table access, word splitting, streamed groups."""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of other characters than these (ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id inside an operator, so that ids can be join keys.
NO_ID = -(1 << 63)
#: Rows of an Arrow batch that Python holds as objects at once.
SLICE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(column: str) -> Column:
    """The id as a long without nulls."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def text_key(column: str = "text") -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(F.col(column).cast("string"))


def id_back(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def split_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; null and blank texts have none.

    ``bytes.split`` divides at exactly the ASCII white space of ``WORD``.
    """
    return text.encode("utf-8", "surrogatepass").split() if text else []


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    release()


def release() -> None:
    """At the end of a task: give freed memory back, since Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not a GNU C library


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, over all its tasks."""
    caches = sys.__dict__.setdefault("_docweave_llm_caches", {})
    return caches.setdefault(name, {})


_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_BASE, _CHUNK = 0x9E3779B97F4A7C15, 1 << 20
_AFTER = re.compile(rb"[\x20\x09-\x0D]|\Z")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, and a random number for each byte."""
    held = worker_cache("powers")
    if len(held.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            held[name] = np.multiply.accumulate(steps)
        held["byte"] = mix(np.arange(1, 257, dtype=np.uint64))
    return held["up"], held["down"], held["byte"]


def batch_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts, offsets of each text's words).

    A word's polynomial over its bytes comes from running sums, so no word becomes a Python
    object. Long inputs go through in stretches that end between words.
    """
    data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    bounds = np.cumsum([0] + [len(d) + 1 for d in data])
    joined = b"\n".join(data)
    hashes, begins, at = [], [], 0
    while at < len(joined):
        end = _AFTER.search(joined, min(at + _CHUNK, len(joined))).start()
        part = np.frombuffer(joined, np.uint8, end - at, at)
        up, down, byte = _powers(max(len(part), _CHUNK))
        edge = np.diff(np.concatenate([[True], _SPACES[part], [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[part] * up[: len(part)])])
        hashes.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
        begins.append(first + at)
        at = end + 1
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), bounds)


def flat_lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(values of all lists, offsets); a null list is empty."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.concatenate([[0], np.cumsum(lengths)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out


def map_groups(
    df: DataFrame,
    keys: list[str],
    func: Callable[[tuple, pa.Table], tuple],
    schema: pa.Schema,
    ddl: str,
    rows: int = 4000,
    parts: int | None = None,
) -> DataFrame:
    """Apply ``func(key, rows)`` to the rows of each key, streamed from sorted partitions.

    ``func`` returns one list for each output column. ``parts`` fixes the number of tasks, for
    small rows that stand for much work. Keys hold no nulls. Only one group
    is held at a time, so callers bound their groups; thousands of small groups share a
    batch, which makes this cheaper than one Arrow stream for each group.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        out: list[list] = [[] for _ in schema]

        def close():
            for column, values in zip(out, func(last, pa.Table.from_batches(held)), strict=True):
                column.extend(values)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            new = np.zeros(n, bool)
            new[0] = True
            for c in columns:
                values = c.to_numpy(zero_copy_only=False)
                new[1:] |= values[1:] != values[:-1]
            starts = [*np.flatnonzero(new).tolist(), n]
            for i, j in zip(starts, starts[1:], strict=False):
                key = tuple(c[i].as_py() for c in columns)
                if key != last:
                    if held:
                        close()
                    held, last = [], key
                    if len(out[0]) >= rows:
                        yield to_batch(out, schema)
                        out = [[] for _ in schema]
                held.append(batch.slice(i, j - i))
        if held:
            close()
        if out[0]:
            yield to_batch(out, schema)
        held, out = [], []
        release()

    dealt = df.repartition(*keys) if parts is None else df.repartition(parts, *keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, ddl)


def to_batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


#: Bytes of UTF-8 texts: A-Z to lower case, other ASCII than letters and digits to blanks.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def lowered(text: str | None) -> bytes:
    """A text as bytes, byte by byte in lower case; words stand between blanks."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
