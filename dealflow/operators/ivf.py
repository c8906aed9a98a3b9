"""Approximate nearest neighbours: an inverted-file index of k-means cells, opt-in next to the exact scan."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.operators.cells import Placed, assign_cells, cell_hits, nearest_cells
from dealflow.operators.knn import best_hits, collect_queries, scan_hits, usable_vectors
from dealflow.session import materialise

# Rows of a stored file, so that a large cell is several files and a small one is one.
FILE_ROWS = 1_000_000


def list_count(rows: int) -> int:
    """Cells for a corpus: the square root of its rows, so that a cell grows no faster than the number of cells."""
    return max(1, math.isqrt(rows))


@dataclass(frozen=True)
class IvfIndex:
    """A corpus stored by cell, with the cell centroids and the number of vectors per cell."""

    path: str
    centroids: np.ndarray
    sizes: dict[int, int]


def fit_centroids(corpus: DataFrame, lists: int, seed: int = 7) -> np.ndarray:
    """Unit k-means centroids, fitted on all vectors."""
    raw = corpus.select(array_to_vector("embedding").alias("raw"))
    unit = Normalizer(p=2.0, inputCol="raw", outputCol="features").transform(raw).select("features")
    unit = unit.persist()
    try:
        model = KMeans(k=lists, maxIter=10, seed=seed).fit(unit)
    finally:
        unit.unpersist()
    centroids = np.asarray(model.clusterCenters())
    sizes = np.linalg.norm(centroids, axis=1, keepdims=True)
    return (centroids / np.where(sizes > 0, sizes, 1.0))[sizes[:, 0] > 0]


def build_index(corpus: DataFrame, path: str, lists: int | None = None, seed: int = 7) -> IvfIndex:
    """Store ``id, embedding`` by nearest centroid; a search reads the probed cells only.

    There are ``list_count`` cells unless ``lists`` is given. Rows are shuffled by cell, a large cell in several parts,
    so there are about as many files as cells.
    """
    corpus = usable_vectors(corpus, "id")
    centroids = fit_centroids(corpus, lists or list_count(corpus.count()), seed)
    placed = materialise(assign_cells(corpus, centroids).drop("gap"), "placed")
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    parts = F.get(F.array(*[F.lit(1 + sizes.get(c, 0) // FILE_ROWS) for c in range(len(centroids))]), F.col("cell"))
    part = F.pmod(F.xxhash64("id"), parts)
    placed.repartition("cell", part).write.partitionBy("cell").parquet(path)
    return IvfIndex(path, centroids, sizes)


def ivf_nearest(
    spark: SparkSession, index: IvfIndex, queries: DataFrame, k: int, probes: int = 10, below: float | None = None
) -> DataFrame:
    """The nearest rows within the ``probes`` nearest cells of every query: ``query_id, id, distance, rank``."""
    queries = usable_vectors(queries, "query_id").drop("seq")
    rule = nearest_cells(index.centroids, probes)
    placed = spark.read.parquet(index.path)
    collected = collect_queries(queries)
    if collected is not None:
        # Few queries go to the rows: only the files of probed cells are read, and nothing of them is shuffled.
        reach = rule(collected[1])
        probed = [int(c) for c in np.flatnonzero(reach.any(axis=0))]
        hits = scan_hits(collected, placed.where(F.col("cell").isin(probed)), k, below, reach)
    else:
        stored = Placed(placed, index.centroids, index.sizes, np.empty(0), np.empty(0))
        hits = cell_hits(queries, stored, rule, k, below)
    return best_hits(hits, collected, k)
