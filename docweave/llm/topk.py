"""Exact top-k by inner product with multi-resolution segment statistics.

For a segment of L components with means m and deviations s, the squared distance of two
vectors is at least L * ((m - m')^2 + (s - s')^2). Summed over segments, this bounds the
distance from below and so q.x = (|q|^2 + |x|^2 - d^2) / 2 from above. Bounds go from coarse
to fine, first for tiles of vectors with like statistics, then for pairs; only survivors get
exact integer scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import map_groups

#: Vectors of one block, vectors of a tile inside of it, and queries that meet a tile at once.
BLOCK, TILE, QUERIES = 32_768, 1_024, 256
LEVELS = (1, 4, 16)
#: Stands for no score yet, below all scores.
NONE = -((1 << 63) - 1)


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, ints): floor(256 * x) as whole doubles. Rows without an id, with null, empty or
    non-finite vectors take no part; repeated rows count once, and rows that share an id but
    not a vector stand beside each other."""
    scaled = lambda c: c.cast("double") * 256
    # Doubles of 2^52 and more are whole already; smaller ones pass through a long.
    x = F.transform("embedding", lambda c: F.when(F.abs(scaled(c)) < float(1 << 52), F.floor(scaled(c)).cast("double")).otherwise(scaled(c)))
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(scaled(c)) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & sound)
    return rows.select(F.col("vec_id").cast("long"), x.alias("ints")).distinct()


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of ``x`` from above.

    A segment of L components gives sqrt(L) times its mean and sqrt(L) times its deviation, so
    the product of two rows is the sum of L * (m * m' + s * s') over the segments. That equals
    (|q|^2 + |x|^2) / 2 less half of the lower bound of the squared distance.
    """
    parts = np.array_split(np.arange(x.shape[1]), segments)
    root = np.sqrt([len(p) for p in parts])
    means = np.stack([x[:, p].mean(1) for p in parts], 1) * root
    return np.concatenate([means, np.stack([x[:, p].std(1) for p in parts], 1) * root], 1)


def group_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bounds of products of each row of ``q`` with anything between each ``low`` and ``high``."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def _exact(q: np.ndarray, x: np.ndarray, peak: float) -> np.ndarray:
    """Integer inner products. ``peak`` bounds the product of the norms, and with it every
    partial sum: doubles are exact below 2^53; larger ones are summed as Python integers."""
    if peak < float(1 << 53):
        return (q @ x.T).astype(np.int64)
    to_int = np.frompyfunc(int, 1, 1)
    scores = to_int(q) @ to_int(x).T
    if any(abs(s) >= -NONE for s in scores.flat):
        raise OverflowError("a score is beyond 64 bits; scale the vectors")
    return scores.astype(np.int64)


def _search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, stats: dict | None = None) -> list[tuple[int, int, int]]:
    """The k best of one block for each query: (query, vector, score).

    Vectors are ordered by their coarsest statistics and cut into tiles; each tile has its
    statistics once, at all levels, and their ranges. For a group of queries the tiles go from
    the largest bound down. A query skips a tile whose bound is below its k-th score; in the
    others each level is one matrix product, and the pairs that stay get exact scores.
    ``stats`` counts the pairs that tiles and levels refuse.
    """
    def count(name, pairs):
        if stats is not None:
            stats[name] = stats.get(name, 0) + pairs

    levels = [s for s in LEVELS if s <= q.shape[1]]
    coarse = segment_features(x, 1)
    order = np.lexsort((ids, coarse[:, 1], np.round(coarse[:, 0] / (np.abs(coarse[:, 0]).max() / 8 + 1))))
    ids, x = ids[order], x[order]
    tiles = []
    for start in range(0, len(x), TILE):
        rows = x[start : start + TILE]
        features = [segment_features(rows, s) for s in levels]
        widest = features[-1]
        tiles.append((ids[start : start + TILE], rows, features, widest.min(0), widest.max(0)))
    low, high = np.stack([t[3] for t in tiles]), np.stack([t[4] for t in tiles])
    largest = np.linalg.norm(x, axis=1).max()
    found = []
    for first in range(0, len(q), QUERIES):
        asked, asked_ids = q[first : first + QUERIES], query_ids[first : first + QUERIES]
        norms = np.linalg.norm(asked, axis=1)
        margin = 0.5 + 1e-9 * norms * largest  # covers the rounding of bounds
        features = [segment_features(asked, s) for s in levels]
        reach = group_bounds(features[-1], low, high) + margin[:, None]
        scores, where = np.full((len(asked), k), NONE), np.full((len(asked), k), -1)
        for t in np.argsort(-reach.max(0), kind="stable"):
            tile_ids, rows, tile_features, _, _ = tiles[t]
            live, held = np.flatnonzero(reach[:, t] >= scores[:, -1]), np.arange(len(rows))
            count("tiles", (len(asked) - len(live)) * len(rows))
            for level, s in enumerate(levels):
                if not len(live) or not len(held) or scores[live, -1].max() == NONE:
                    break
                stay = features[level][live] @ tile_features[level][held].T + margin[live, None] >= scores[live, -1][:, None]
                left, kept = np.flatnonzero(stay.any(1)), np.flatnonzero(stay.any(0))
                count(s, len(live) * len(held) - len(left) * len(kept))
                live, held = live[left], held[kept]
            if not len(live) or not len(held):
                continue
            count("exact", len(live) * len(held))
            exact = _exact(asked[live], rows[held], norms.max() * largest)
            exact[asked_ids[live, None] == tile_ids[held]] = NONE
            floor = scores[live, -1]
            if len(held) > k:
                floor = np.maximum(floor, np.partition(exact, len(held) - k, axis=1)[:, len(held) - k])
            for row, at in enumerate(live):
                new = np.flatnonzero((exact[row] >= floor[row]) & (exact[row] > NONE))
                both, names = np.concatenate([scores[at], exact[row, new]]), np.concatenate([where[at], tile_ids[held[new]]])
                best = np.lexsort((names, -both))[:k]
                scores[at], where[at] = both[best], names[best]
        for i, query in enumerate(asked_ids.tolist()):
            found += [(query, int(w), int(s)) for s, w in zip(scores[i], where[i], strict=True) if s > NONE]
    return found


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each query, ties to the
    smaller id. ``vectors`` and ``queries`` are ``quantised``; lengths meet their like only. A
    repeated id stands once for each of its vectors, as a candidate and as a query, whose
    hits are then ranked together; null vectors are none. A score beyond 64 bits is an error.

    Vectors are dealt into blocks by a hash, queries go to every block, and each block keeps
    k rows a query, so no task holds more than a block and the queries it is given.
    """
    blocks = max(1, -(-vectors.count() // block), min(64, vectors.sparkSession.sparkContext.defaultParallelism))
    held = 4096  # queries that one task sees with a block
    parts = max(1, -(-queries.count() // held))
    one = vectors.select(F.pmod(F.xxhash64("vec_id", "ints"), F.lit(blocks)).cast("long").alias("b"), _each(parts).alias("p"), F.lit(0).alias("role"), "vec_id", "ints")
    two = queries.select(_each(blocks).alias("b"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("long").alias("p"), F.lit(1).alias("role"), "vec_id", "ints")
    both = one.unionByName(two).withColumn("size", F.size("ints").cast("long"))

    def search(key, rows):
        role = rows["role"].to_numpy()
        flat = rows["ints"].combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        ints, ids = flat.flatten().to_numpy().reshape(-1, key[2]), rows["vec_id"].to_numpy()
        found = _search(ids[role == 0], ints[role == 0], ids[role == 1], ints[role == 1], k) if 0 < role.sum() < len(role) else []
        return [list(c) for c in zip(*found, strict=True)] if found else [[], [], []]

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    local = map_groups(both, ["b", "p", "size"], search, schema, "query_id bigint, vec_id bigint, score bigint")
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
