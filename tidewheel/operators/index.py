"""Inverted-file index over item vectors, for item sets beyond what an executor should hold.

Centroids come from a bounded sample of the items (Spark ML's k-means by cosine); every item is
assigned to its nearest one.  A user's vector visits the ``probes`` nearest cells and is
compared exactly with all items there, so only the choice of cells is approximate.  The number
of probes is found by measuring: users whose id is divisible by ``ASKED_EVERY`` are searched
both ways, and probes are doubled until the wanted share of the true items is found.

As in the exact search (``retrieval.top_items``, the default) user vectors move once, and item
vectors once per chunk of users or once per executor, whatever the number of probes; the index
spares the products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from tidewheel.functions import vectors
from tidewheel.operators.retrieval import SHUFFLED_BYTES, Best, SCORED, _unit_rows, item_tiles, pass_items, pass_tiles, task_count, top_items
from tidewheel.operators.tiles import Tiles
from tidewheel.session import cut_lineage

SAMPLE_ITEMS = 100_000
MAX_CELLS = 16_384
ASKED_EVERY = 100
TILE_ROWS = 50_000
TILE_BYTES = 8 * 1024 * 1024
CHUNK_ROWS = 30_000


@dataclass
class Index:
    """``items``: cell, movie_id, movie_embedding, stored; ``centroids``: a row per cell, in memory.

    ``tiles`` has the items in the order of their cells on the executors, once a search asked for it.
    """

    items: DataFrame
    centroids: np.ndarray
    tiles: Tiles | None = None
    size: int | None = None

    def count(self) -> int:
        if self.size is None:
            self.size = self.items.count()
        return self.size


def build(items: DataFrame, cells: int | None = None, sample_items: int = SAMPLE_ITEMS, iterations: int = 8, seed: int = 7) -> Index:
    """Assign all items of (movie_id, movie_embedding) to cells.

    The number of cells is the root of the number of items unless given, at most ``MAX_CELLS``.
    At most about ``sample_items`` items train the centroids.  Items without a vector, with one
    of length 0, or of another dimension than most, are left out.
    """
    rows = items.where(F.col("movie_embedding").isNotNull() & (vectors.norm("movie_embedding") > 0)).select("movie_id", "movie_embedding")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.mode(F.size("movie_embedding"), True).alias("dim")).first()
    if not size["n"]:
        return Index(rows.withColumn("cell", F.lit(0)).select("cell", "movie_id", "movie_embedding"), np.zeros((0, 0)))
    rows = rows.where(F.size("movie_embedding") == size["dim"])
    cells = max(1, min(cells or round(size["n"] ** 0.5), MAX_CELLS, size["n"]))
    if cells == 1:
        centroids = np.ones((1, size["dim"]))
    else:
        share = min(1.0, sample_items / size["n"])
        order = F.pmod(F.xxhash64("movie_id", F.lit(seed)), F.lit(1 << 30))
        sample = rows.where(order < int(share * (1 << 30)) + 1).select(array_to_vector(vectors.doubles("movie_embedding")).alias("features"))
        model = KMeans(k=cells, maxIter=iterations, seed=seed, distanceMeasure="cosine").fit(cut_lineage(sample))
        centroids = np.stack(model.clusterCenters())
    return Index(cut_lineage(_assigned(rows, centroids)), centroids)


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(_normal(centroids))

    def assign(batches):
        for batch in batches:
            cells = np.empty(batch.num_rows, np.int32)
            for at in range(0, batch.num_rows, 1024):
                near = _unit_rows(batch.column(1).slice(at, 1024), centroids.shape[1]) @ shared.value.T
                cells[at : at + 1024] = near.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cells), *batch.columns], ["cell", "movie_id", "movie_embedding"])

    kind = rows.schema["movie_embedding"].dataType.simpleString()
    return rows.select(F.col("movie_id").cast("long"), "movie_embedding").mapInArrow(assign, f"cell int, movie_id long, movie_embedding {kind}")


def _normal(matrix: np.ndarray) -> np.ndarray:
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + 1e-12)


def search(users: DataFrame, index: Index, k: int = 50, probes: int = 8, tile_rows: int = TILE_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """user_id, movie_id, score, rank of the best ``k`` items of each user's ``probes`` cells.

    A task holds at most ``chunk_rows`` users with the cells that they visit, and the items
    stream past them cell by cell, at most ``tile_rows`` at once.  So neither a crowded cell
    nor one that many users visit becomes one task, and no user vector moves more than once.
    """
    if len(index.centroids) == 0:
        return users.sparkSession.createDataFrame([], SCORED)
    dim, cells = index.centroids.shape[1], len(index.centroids)
    probes = min(probes, cells)
    shared = users.sparkSession.sparkContext.broadcast(_normal(index.centroids))
    asked = users.where(F.size("user_embedding") == dim).select("user_id", "user_embedding")
    pairs = max(1, index.count() * probes // cells)

    def begin(queries: np.ndarray) -> Best:
        """The chunk's users by the cells that they visit."""
        chosen = np.empty((len(queries), probes), np.int32)
        for at in range(0, len(queries), 1024):
            chosen[at : at + 1024] = np.argpartition(-(queries[at : at + 1024] @ shared.value.T), probes - 1, axis=1)[:, :probes]
        best, flat = Best(queries, k), chosen.ravel()
        order = np.argsort(flat, kind="stable")
        best.visitors, best.starts = (order // probes).astype(np.int32), np.searchsorted(flat[order], np.arange(cells + 1))
        return best

    def take(best: Best, ids: np.ndarray, matrix: np.ndarray, cells: pa.Array) -> None:
        at = np.asarray(cells.flatten())
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for first, last in zip(cuts, cuts[1:]):
            if first < last:
                rows = best.visitors[best.starts[at[first]] : best.starts[at[first] + 1]]
                best.take(ids[first:last], matrix[first:last], rows, min(Best.COLUMNS, tile_rows))

    placed = index.items.select("movie_id", "movie_embedding", F.array("cell").alias("cells"))
    chunks, row = task_count(asked, asked.count(), pairs, chunk_rows), (dim + 1) * 8
    if chunks * index.count() * row <= SHUFFLED_BYTES:
        return pass_items(asked, placed, dim, chunks, begin, take)
    if index.tiles is None:
        parts = -(-index.count() * row // SHUFFLED_BYTES)
        index.tiles = item_tiles(placed.repartitionByRange(parts, "cells", "movie_id").sortWithinPartitions("cells", "movie_id"), min(tile_rows, TILE_BYTES // row + 1))
    return pass_tiles(asked, index.tiles, dim, chunks, chunk_rows + chunk_rows // 4, begin, take)


def recall(users: DataFrame, items: DataFrame, index: Index, k: int, probes: int, truth: DataFrame | None = None) -> float:
    """Share of the true ``k`` nearest items that ``search`` finds for ``users``, all items considered."""
    truth = top_items(users, items, k) if truth is None else truth
    found = search(users, index, k, probes).select("user_id", "movie_id", F.lit(1).alias("hit"))
    row = truth.join(found, ["user_id", "movie_id"], "left").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("all")).first()
    return row["hits"] / row["all"] if row["all"] else 1.0


def measured_probes(users: DataFrame, items: DataFrame, index: Index, k: int = 10, wanted: float = 0.95, every: int = ASKED_EVERY) -> tuple[int, float]:
    """(probes, recall): probes doubled until the users divisible by ``every`` find enough."""
    asked = cut_lineage(users.where(F.col("user_id") % every == 0))
    truth = cut_lineage(top_items(asked, items, k))
    probes = 1
    while True:
        got = recall(asked, items, index, k, probes, truth)
        if got >= wanted or probes >= len(index.centroids):
            return probes, got
        probes *= 2
