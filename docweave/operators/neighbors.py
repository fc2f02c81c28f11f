"""Nearest neighbours by an inverted file of trained cells.

Centroids are trained on a bounded sample; every vector is then stored below its nearest
centroid, in bands of its distance to it. With unit query q, centroid c and a band whose
vectors are at most r away from c, no score in the band exceeds q.c + r. A search first
probes the cells closest to the query; the exact mode then opens every band whose bound
reaches the k-th score found, and no other.

Neighbouring cells are moved together, as slabs of bounded size, and so are the queries of
neighbouring cells. A query is sent once to a slab in which it opens a cell, a slab once to a
group of queries, and bounds decide inside of the task what is multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docweave.operators.ordering import first_rows
from docweave.session import store

#: Vectors per cell at which cells are planned, and bounds of what the driver trains on.
CELL_ROWS, MOST_CELLS, SAMPLE_ROWS, CENTROID_FLOATS = 1024, 8192, 262_144, 1 << 22
#: Bands of distance per cell; unit vectors are at most two apart.
BANDS = 16
#: Numbers held by one slab of cells or group of queries, and queries of a group; what is sent falls with both.
BLOCK_FLOATS, QUERY_ROWS = 1 << 22, 1 << 16
#: Slabs and groups into which fewer rows are cut, so that tasks have work, and rows that are not cut.
SHARES, WHOLE_ROWS = 8, 4096
#: Scores that a task holds at once.
TILE_SCORES = 1 << 21
#: Scores are rounded to 12 digits, so bounds give way by more than that.
SLACK = 1e-9


def sound(vector: str) -> Column:
    """Vectors that can be compared: present, not empty, all components finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & whole


def unit_rows(column: pa.Array) -> np.ndarray:
    """A list column as a float64 matrix of unit rows; zero vectors stay zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    peak = np.abs(rows).max(axis=1, keepdims=True)
    rows = np.divide(rows, peak, out=np.zeros_like(rows), where=peak > 0)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=rows, where=norms > 0)


def train_centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centroids of a sample by Lloyd's rounds from evenly taken rows; empty cells keep their place."""
    if not len(sample):
        return np.zeros((1, 1))
    centers = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        label = np.concatenate([_nearest(sample[i : i + 8192], centers)[0] for i in range(0, len(sample), 8192)])
        order = np.argsort(label, kind="stable")
        held, first = np.unique(label[order], return_index=True)
        means = np.add.reduceat(sample[order], first) / np.diff([*first, len(sample)])[:, None]
        if np.abs(centers[held] - means).max() < 1e-6:
            break
        centers[held] = means
    return centers


def _nearest(rows: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row and the distance to it."""
    label = np.argmin((centers * centers).sum(1) - 2 * rows @ centers.T, axis=1)
    return label, np.linalg.norm(rows - centers[label], axis=1)


def _shared_out(rows: int, dim: int) -> int:
    """Rows of a slab or group."""
    return max(256, min(BLOCK_FLOATS // dim, max(WHOLE_ROWS, -(-rows // SHARES))))


def _packed(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the first pack of each entry and how many it takes; small neighbours share one."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // limit))
    number, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            number, held = number + 1, 0
        first[i] = number
        if parts[i] > 1:
            number, held = number + int(parts[i]), 0
        else:
            held += size
    return first, parts


def _along(centers: np.ndarray) -> np.ndarray:
    """Cells in the order of their largest common direction, so that neighbours come together."""
    _, _, axes = np.linalg.svd(centers - centers.mean(0), full_matrices=False)
    return np.argsort(centers @ axes[0], kind="stable")


@dataclass(frozen=True)
class Cells:
    """What bounds a search; small enough for every task, since the number of cells is bounded.

    ``radius``, ``sizes`` and ``parts`` have a row per cell and a column per band: the largest
    distance (-1 for an empty band), the number of vectors and the number of slabs they lie in.
    ``first`` is the first slab of each cell.
    """

    dim: int
    centroids: np.ndarray
    radius: np.ndarray
    parts: np.ndarray
    sizes: np.ndarray
    first: np.ndarray

    def slabs(self) -> list[np.ndarray]:
        """The cells of every slab."""
        many = self.parts.max(1)
        cell = np.repeat(np.arange(len(many)), many)
        slab = np.repeat(self.first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        order = np.argsort(slab, kind="stable")
        edges = np.searchsorted(slab[order], np.arange(slab.max() + 2 if len(slab) else 1))
        return [cell[order][i:j] for i, j in zip(edges[:-1], edges[1:])]


@dataclass(frozen=True)
class CellIndex:
    """Stored ``rows(slab, cell, band, chunk_id, embedding)`` and their ``cells``."""

    rows: DataFrame
    cells: Cells


def build_index(chunks: DataFrame, dim: int, cell_rows: int = CELL_ROWS) -> CellIndex:
    """Index every sound vector of ``chunks(chunk_id, embedding)`` with ``dim`` components.

    The centroids come from at most ``SAMPLE_ROWS`` vectors, taken by a hash of the id.
    """
    spark = chunks.sparkSession
    rows = chunks.where(F.col("chunk_id").isNotNull() & sound("embedding") & (F.size("embedding") == dim)).select("chunk_id", "embedding")
    n = rows.count()
    cells = max(1, min(MOST_CELLS, CENTROID_FLOATS // dim, n // cell_rows))
    sample = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(min(SAMPLE_ROWS, 64 * cells)).select("embedding").toArrow()
    taken = unit_rows(sample.column(0).combine_chunks()) if sample.num_rows else np.zeros((0, dim))
    centers = train_centroids(taken, cells) if len(taken) else np.zeros((1, dim))
    shared = spark.sparkContext.broadcast(centers)
    names = ["chunk_id", "embedding", "cell", "band", "residual"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                cell, residual = _nearest(unit_rows(part.column(1)), shared.value)
                band = np.minimum((residual * (BANDS / 2)).astype(np.int32), BANDS - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(band, pa.int32()), pa.array(residual)], names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    placed = store(rows.mapInArrow(assign, f"chunk_id {kinds['chunk_id']}, embedding {kinds['embedding']}, cell int, band int, residual double"), "cells")
    radius, sizes = np.full((len(centers), BANDS), -1.0), np.zeros((len(centers), BANDS), np.int64)
    # One row per cell and band, so the bound of the cells bounds it.
    for r in placed.groupBy("cell", "band").agg(F.max("residual").alias("r"), F.count(F.lit(1)).alias("n")).collect():
        radius[r.cell, r.band], sizes[r.cell, r.band] = r.r, r.n
    order, held = _along(centers), sizes.sum(1)
    first, many = np.zeros(len(centers), np.int64), np.ones(len(centers), np.int64)
    first[order], many[order] = _packed(held[order], _shared_out(n, dim))
    places = spark.createDataFrame([(c, int(first[c]), int(many[c])) for c in range(len(centers))], "cell int, first int, many int")
    dealt = placed.join(F.broadcast(places), "cell")
    slab = (F.col("first") + F.pmod(F.xxhash64("chunk_id"), F.col("many"))).cast("int")
    known = Cells(dim, centers, radius, np.where(sizes > 0, many[:, None], 0), sizes, first)
    return CellIndex(dealt.select(slab.alias("slab"), "cell", "band", "chunk_id", "embedding"), known)


def hit_schema(queries: DataFrame, chunks: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _homes(queries: DataFrame, cells: Cells) -> np.ndarray:
    """Number of queries whose nearest cell begins in each slab."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                near = unit_rows(batch.slice(start, 1024).column(0)) @ known.centroids.T
                yield pa.RecordBatch.from_arrays([pa.array(known.first[near.argmax(1)])], ["home"])

    counts = np.zeros(int(cells.first.max()) + 1, np.int64)
    # One row per slab at most.
    for r in queries.select("embedding").mapInArrow(place, "home bigint").groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.home] = r.n
    return counts


def _opened(queries: DataFrame, cells: Cells, probes: int, k: int, rest: bool) -> DataFrame:
    """(slab, home, query_id, embedding, least, mask): a row per slab in which a query opens cells.

    Without ``rest`` these are its ``probes`` closest cells, and as many more as it takes to hold
    ``k`` vectors; with ``rest`` all cells with a band whose bound reaches the query's ``least``
    score. ``mask`` has a bit per cell of the slab.
    """
    shared = queries.sparkSession.sparkContext.broadcast(cells)
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held, reach, slabs = known.sizes.sum(1), known.radius.max(1), known.slabs()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                near = unit_rows(part.column(1)) @ known.centroids.T
                if rest:
                    least = part.column(2)
                    open_ = near + reach >= least.to_numpy(zero_copy_only=False)[:, None] - SLACK
                else:
                    least = pa.array(np.full(part.num_rows, -4.0))
                    # Cells in order of closeness; a query probes up to the one that fills its list.
                    order = np.argsort(-near + np.where(held > 0, 0, 8.0), axis=1, kind="stable")
                    before = np.cumsum(held[order], axis=1) - held[order]
                    open_ = np.zeros(near.shape, bool)
                    np.put_along_axis(open_, order, (np.arange(order.shape[1]) < probes) | (before < k), axis=1)
                open_ &= held > 0
                home = known.first[near.argmax(1)]
                for number, members in enumerate(slabs):
                    inside = open_[:, members]
                    some = np.flatnonzero(inside.any(1))
                    if len(some):
                        picked = part.take(pa.array(some))
                        mask = [row.tobytes() for row in np.packbits(inside[some], axis=1)]
                        columns = [pa.array(np.full(len(some), number, np.int32)), pa.array(home[some]), *picked.columns[:2], least.take(pa.array(some)), pa.array(mask, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["slab", "home", "query_id", "embedding", "least", "mask"])

    return queries.mapInArrow(choose, f"slab int, home bigint, query_id {kinds['query_id']}, embedding {kinds['embedding']}, least double, mask binary")


def _topk_of_slab(asked: pa.Table, stored: pa.Table, members: np.ndarray, known: Cells, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, stored row, score) of the best ``k`` vectors of a slab for every query; ties to the smaller id."""
    queries, least = unit_rows(asked.column("embedding").combine_chunks()), asked.column("least").to_numpy()
    bits = np.frombuffer(b"".join(asked.column("mask").to_pylist()), np.uint8).reshape(asked.num_rows, -1)
    wanted = np.unpackbits(bits, axis=1, count=len(members)).view(bool)
    # Rows in order of their ids, so that positions decide ties; then by cell and band.
    by_id = pc.sort_indices(stored, [("chunk_id", "ascending")]).to_numpy()
    code = (stored.column("cell").to_numpy().astype(np.int64) * BANDS + stored.column("band").to_numpy())[by_id]
    place = np.argsort(code, kind="stable")
    vectors, code = unit_rows(stored.column("embedding").combine_chunks())[by_id[place]], code[place]
    scores, places = np.full((len(queries), k), -np.inf), np.full((len(queries), k), len(by_id), np.int64)
    blocks, starts = np.unique(code, return_index=True)
    for block, start, end in zip(blocks, starts, [*starts[1:], len(code)]):
        cell, band = divmod(int(block), BANDS)
        rows = np.flatnonzero(wanted[:, np.searchsorted(members, cell)])
        rows = rows[queries[rows] @ known.centroids[cell] + known.radius[cell, band] >= least[rows] - SLACK]
        for a in range(start, end, WHOLE_ROWS):
            z = min(a + WHOLE_ROWS, end)
            step = max(1, TILE_SCORES // (z - a))
            for i in range(0, len(rows), step):
                _keep_best(rows[i : i + step], queries, vectors[a:z], place[a:z], least, scores, places)
    query, rank = np.nonzero(places < len(by_id))
    return query, by_id[places[query, rank]], scores[query, rank]


def _keep_best(some: np.ndarray, queries: np.ndarray, vectors: np.ndarray, at: np.ndarray, least: np.ndarray, scores: np.ndarray, places: np.ndarray) -> None:
    """Put ``vectors`` at places ``at`` into the best lists of ``some`` queries."""
    k, found = scores.shape[1], queries[some] @ vectors.T
    # Scores are rounded to 12 digits, so that equal vectors tie whatever block they were multiplied in.
    floor = np.maximum(scores[some, -1], least[some]) - 2e-12
    near = found >= floor[:, None]
    crowded = np.flatnonzero(near.sum(1) > 4 * k)
    if len(crowded):
        of = found[crowded]
        near[crowded] &= of >= np.partition(of, of.shape[1] - k, axis=1)[:, of.shape[1] - k, None] - 2e-12
    row, column = np.nonzero(near)
    if not len(row):
        return
    hit = np.unique(row)
    who = np.concatenate([some[row], np.repeat(some[hit], k)])
    score = np.concatenate([np.round(found[row, column], 12) + 0.0, scores[some[hit]].ravel()])
    place = np.concatenate([at[column], places[some[hit]].ravel()])
    order = np.lexsort((place, -score, who))
    who, score, place = who[order], score[order], place[order]
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    rank = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
    kept = rank < k
    scores[who[kept], rank[kept]], places[who[kept], rank[kept]] = score[kept], place[kept]


def _score(opened: DataFrame, index: CellIndex, homes: np.ndarray, k: int, schema: T.StructType) -> DataFrame:
    """The best ``k`` of each slab that a query opens; a task holds one slab and one group of queries."""
    target, spark = to_arrow_schema(schema), opened.sparkSession
    first, many = _packed(homes, min(QUERY_ROWS, _shared_out(int(homes.sum()), index.cells.dim)))
    groups = spark.createDataFrame([(h, int(first[h]), int(many[h])) for h in range(len(homes))], "home bigint, first int, many int")
    left = opened.join(F.broadcast(groups), "home").withColumn("part", (F.col("first") + F.pmod(F.xxhash64("query_id"), F.col("many"))).cast("int"))
    left = left.select("slab", "part", "query_id", "embedding", "least", "mask")
    # At most as many rows as there are slabs times groups, each of tens of thousands of vectors.
    wanted = left.select(F.col("slab").alias("_slab"), F.col("part").alias("_part")).distinct()
    right = index.rows.join(F.broadcast(wanted), F.col("slab") == F.col("_slab")).select("_slab", "_part", "cell", "band", "chunk_id", "embedding")
    shared = spark.sparkContext.broadcast(index.cells)

    def meet(asked: pa.Table, stored: pa.Table) -> pa.Table:
        if asked.num_rows == 0 or stored.num_rows == 0:
            return target.empty_table()
        known = shared.value
        members = known.slabs()[asked.column("slab")[0].as_py()]
        query, row, score = _topk_of_slab(asked, stored, members, known, k)
        columns = [asked.column("query_id").take(pa.array(query)), stored.column("chunk_id").take(pa.array(row)), pa.chunked_array([pa.array(score)])]
        return pa.Table.from_arrays(columns, schema=target)

    return left.groupBy("slab", "part").cogroup(right.groupBy("_slab", "_part")).applyInArrow(meet, schema)


def search_index(queries: DataFrame, index: CellIndex, k: int, probes: int = 2, exact: bool = True) -> DataFrame:
    """Top-k rows (query_id, chunk_id, score, rank) of ``queries(query_id, embedding)``.

    Ties go to the smaller chunk id. Without ``exact`` only the probed cells are searched.
    """
    schema = hit_schema(queries, index.rows)
    asked = queries.where(sound("embedding") & (F.size("embedding") == index.cells.dim)).select("query_id", "embedding")
    homes = _homes(asked, index.cells)
    best = [F.desc("score"), F.col("chunk_id")]
    hits = first_rows(_score(_opened(asked, index.cells, probes, k, False), index, homes, k, schema), ["query_id"], best, k, "rank")
    if not exact or probes >= len(index.cells.centroids):
        return hits  # nothing is left to open
    hits = store(hits, "probed")
    least = hits.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    with_least = asked.join(least, "query_id", "left").select("query_id", "embedding", F.coalesce("least", F.lit(-4.0)).alias("least"))
    # What was probed and reaches the least score is found again.
    found = _score(_opened(with_least, index.cells, probes, k, True), index, homes, k, schema)
    return first_rows(found, ["query_id"], best, k, "rank")


def dimensions(queries: DataFrame) -> list[int]:
    """Lengths of the query vectors; one for each model that made them."""
    return sorted(r[0] for r in queries.where(sound("embedding")).select(F.size("embedding")).distinct().collect())


def measured_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (recall): the share of the exact hits that were found."""
    keys = ["query_id", "chunk_id"]
    marked = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("hit")), keys, "left")
    return marked.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
