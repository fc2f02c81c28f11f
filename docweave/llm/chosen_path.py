"""Near-duplicate join on word shingles by chosen paths.

A run sends each set down a random tree: at a node, each of its shingles opens a branch with
probability 1 / (lambda * size of the set), by a hash of node and shingle. Two sets that share
lambda of the larger one keep one common branch a level on average, others soon part
(Christiani and Pagh 2017). All sets that end in one bucket are compared by sketches, large
buckets in tiles, and independent runs are repeated until a pair at the threshold is missed
with at most 1 - recall. Sketch matches form loose families; inside of a
family, links are then counted exactly on whole shingle sets, in bounded blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import batch_hashes, id_back, id_key, map_groups, mix, slices, text_key, window_hashes
from docweave.operators.graph import component_labels
from docweave.session import store

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
LEVELS = 3
#: Sketch bytes; sketches match from ``LOOSE`` on, and ``SURE`` stands for the leader's role.
SKETCH, LOOSE, SURE = 128, 0.55, 0.85
#: Rows of a bucket that are compared at once, and shingles of a block of a family.
SMALL, BLOCK, BLOCK_ROWS = 8192, 1_000_000, 512
_STEPS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text; one of fewer words is one shingle, one without
    words has none."""
    hashes, at = batch_hashes(texts)
    parts = [hashes[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
    return [np.unique(window_hashes(h, min(words, len(h)))) if len(h) else h for h in parts]


def runs_for(recall: float, levels: int = LEVELS) -> int:
    """Runs that find a pair at the threshold: each keeps a common path with the survival
    probability of a branching process with one child a level on average."""
    p = 1.0
    for _ in range(levels):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def paths(tokens: np.ndarray, similarity: float, runs: int, levels: int = LEVELS) -> np.ndarray:
    """Hashes of the leaves that a set reaches over all runs."""
    nodes = mix(np.arange(1, runs + 1, dtype=np.uint64))
    limit = np.uint64(min(2**64 - 1, int(2**64 / (similarity * len(tokens)))))
    for _ in range(levels):
        # Multiplying hashed tokens by odd numbers is a hash itself, and the cheapest one.
        drawn = (nodes | np.uint64(1))[:, None] * tokens[None, :]
        at, which = np.nonzero(drawn <= limit)
        nodes = mix(tokens[which] + nodes[at])
    return nodes


def sketch(tokens: np.ndarray) -> np.ndarray:
    """A byte of each of ``SKETCH`` minima of hashed tokens."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(tokens), 2048):
        least = np.minimum(least, (tokens[None, start : start + 2048] * _STEPS[:, None]).min(1))
    return mix(least).astype(np.uint8)


def fingerprints(docs: DataFrame, similarity: float, runs: int) -> DataFrame:
    """(id, t, n, signature, sketch, leaves) of all documents with words."""

    def run(batches):
        for batch in slices(batches, 500):
            rows = []
            for doc, t, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingles(batch.column(1).to_pylist()), strict=True):
                if len(s):
                    sign = np.array([len(s), mix(s).sum(), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64).tobytes()
                    rows.append((doc, t, len(s), sign, sketch(s).tobytes(), paths(s, similarity, runs).view(np.int64)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "t", "n", "signature", "sketch", "leaves"])

    return docs.mapInArrow(run, "id bigint, t bigint, n bigint, signature binary, sketch binary, leaves array<bigint>")


def _leaders(ids: np.ndarray, sketches: np.ndarray, first: int) -> list[tuple[int, int]]:
    """Edges (id, leader) among matching sketches of one bucket, led by its ``first`` rows.

    Each row that no leader is sure of becomes one and is compared with all rows. A row near
    to a leader needs no turn of its own: whatever lies within the threshold of it still
    matches the leader loosely.
    """
    out, todo, label = [], np.ones(len(ids), bool), np.arange(len(ids))
    for i in range(first):
        if todo[i]:
            alike = (sketches == sketches[i]).mean(1)
            todo[alike >= SURE] = False
            out.extend(_join(label, i, np.flatnonzero(alike >= LOOSE)))
    return [(int(ids[x]), int(ids[y])) for x, y in out]


def _join(label: np.ndarray, x: int, others: np.ndarray) -> list[tuple[int, int]]:
    """Edges from x to one row of each group among ``others`` that x is not yet part of."""
    groups, first = np.unique(label[others], return_index=True)
    new = groups != label[x]
    if new.any():
        label[np.isin(label, groups[new])] = label[x]
    return [(x, int(y)) for y in others[first[new]]]


def candidate_edges(prints: DataFrame) -> DataFrame:
    """Distinct edges (a, b) between documents whose sketches match in some bucket.

    A bucket above ``SMALL`` rows is cut into parts, and all pairs of parts are compared.
    """
    rows = prints.select("id", F.explode("leaves").alias("leaf"))
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("rows")).where("rows > 1")
    parts = F.ceil(F.col("rows") / SMALL)
    rows = store(rows.join(sizes, "leaf").select("leaf", "id", parts.alias("parts")), "buckets")
    some = rows.join(prints.select("id", "sketch"), "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("long"))
    small = some.where("parts = 1").select("leaf", F.col("part").alias("i"), F.col("part").alias("j"), "part", "id", "sketch")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    large = some.where("parts > 1").select("leaf", "part", "id", "sketch", other)
    large = large.select("leaf", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "sketch")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(key, table):
        ids, part = table["id"].to_numpy(), table["part"].to_numpy()
        raw = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        order = np.lexsort((ids, part))
        found = _leaders(ids[order], raw[order], int((part == key[1]).sum()))
        return [list(c) for c in zip(*found, strict=True)] if found else [[], []]

    return map_groups(small.unionByName(large), ["leaf", "i", "j"], compare, schema, "a bigint, b bigint").distinct()


def _count_links(key, table, similarity: float):
    """Links of the sets of two blocks: sums of the partners' copies, and edges to them."""
    ids, block, copies = table["id"].to_numpy(), table["block"].to_numpy(), table["copies"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
    size = np.array([len(s) for s in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(at) > 1
    column = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), size)[shared[at]]
    at = column[at[shared[at]]]
    width, n = int(shared.sum()), len(sets)
    links, label, edges = np.zeros(n, np.int64), np.arange(n), []
    left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
    for start in range(0, len(left), 512):
        some = left[start : start + 512]
        common = np.zeros((len(some), len(right)), np.float32)
        for low in range(0, width, 4096):  # a stretch of shared tokens at a time
            part = (at >= low) & (at < low + 4096)
            dense = np.zeros((n, min(4096, width - low)), np.float32)
            dense[row[part], at[part] - low] = 1
            common += dense[some] @ dense[right].T
        linked = common >= similarity * (size[some][:, None] + size[right][None, :] - common) - 1e-4
        linked &= some[:, None] != right[None, :]
        links[some] += linked @ copies[right]
        if key[1] != key[2]:
            links[right] += linked.T @ copies[some]
        for i, x in enumerate(some):
            edges.extend((int(ids[x]), int(ids[y])) for x, y in _join(label, x, right[linked[i]]))
    here = np.flatnonzero(links)
    rows = [(int(ids[i]), int(ids[i]), int(links[i])) for i in here] + [(a, b, 0) for a, b in edges]
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(id, t, copy_id, class_id, n_links, stays) of every distinct id and text with words.

    ``t`` is the ``text_key``. ``stays`` marks one row of each class, that of the smallest id
    and key, so that other rows with its id are told apart from it.
    """
    chosen = docs.select(id_key("doc_id").alias("id"), F.col("text").cast("string").alias("text"), text_key().alias("t"))
    prints = store(fingerprints(chosen, similarity, runs_for(recall)), "fingerprints")
    copies = prints.groupBy("signature").agg(F.min(F.struct("id", "t")).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"))
    # Sets get numbers of their own: an id can stand for several.
    copies = store(copies.select(F.monotonically_increasing_id().alias("node"), "signature", "rep.id", "rep.t", "copies", "n"), "copies")
    reps = prints.join(copies.select("id", "t", "signature", "node"), ["id", "t", "signature"]).dropDuplicates(["node"])
    edges = store(candidate_edges(reps.select(F.col("node").alias("id"), "sketch", "leaves")), "edges")
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    families = store(component_labels(nodes, edges).select(F.col("id").alias("node"), F.col("component").alias("family")), "families")
    members = families.join(copies.drop("signature"), "node")
    blocks = members.groupBy("family").agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / BLOCK_ROWS)).alias("blocks"))
    members = members.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long"))
    texts = chosen.join(members, ["id", "t"]).dropDuplicates(["node"])

    def tokens(batches):
        for batch in slices(batches, 500):
            sets = pa.array([s.tobytes() for s in shingles(batch.column(0).to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], sets], ["id", "family", "block", "blocks", "copies", "tokens"])

    sets = texts.select("text", "node", "family", "block", "blocks", "copies").mapInArrow(tokens, "id bigint, family bigint, block bigint, blocks bigint, copies bigint, tokens binary")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tiles = sets.select("id", "family", "block", "copies", "tokens", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
    found = store(map_groups(tiles, ["family", "i", "j"], lambda k, t: _count_links(k, t, similarity), schema, "a bigint, b bigint, links bigint"), "links")
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = found.where("a <> b").select("a", "b")
    ends = joined.select(F.col("a").alias("id")).union(joined.select("b")).distinct()
    labels = store(component_labels(ends, joined).select(F.col("id").alias("node"), "component"), "classes")
    least = labels.join(copies.select("node", "id", "t"), "node").groupBy("component").agg(F.min(F.struct("id", "t")).alias("head"))
    known = copies.join(links, "node", "left").join(labels.join(least, "component").select("node", "head"), "node", "left").select(
        "signature", F.col("id").alias("copy_id"), F.coalesce("head", F.struct("id", "t")).alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    rows = prints.select("id", "t", "signature").join(known, "signature")
    rows = rows.select("id", "t", "copy_id", F.col("head.id").alias("class_id"), "n_links", (F.struct("id", "t") == F.col("head")).alias("stays"))
    return rows.groupBy("id", "t").agg(*(F.max(c).alias(c) for c in ("copy_id", "class_id", "n_links", "stays")))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, copy_id, class_id, n_links) of every document.

    ``copy_id`` is the smallest id with an equal shingle set, ``class_id`` the smallest id
    that chains of links reach, ``n_links`` the number of other rows with a Jaccard
    similarity of at least ``similarity``. Texts under five words are one shingle; null,
    empty and blank texts have no links and are classes of their own. Rows that share an id
    are judged each by its own text. A null ``doc_id`` comes before all others; other columns
    are ignored; texts are read whole; an empty table gives no rows.
    """
    known = near_classes(docs, similarity, recall)
    out = docs.select(id_key("doc_id").alias("id"), text_key().alias("t")).join(known, ["id", "t"], "left").select(
        F.col("id").alias("doc_id"), F.coalesce("copy_id", "id").alias("copy_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    return out.withColumns({c: id_back(c) for c in ("doc_id", "copy_id", "class_id")})
