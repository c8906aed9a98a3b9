"""Joining many query vectors with a corpus through cells, with both sides split into bounded blocks.

Every corpus vector belongs to the cell of its nearest pivot. A query is sent only to the cells it can have a match
in: either all cells that the triangle inequality cannot rule out (exact), or its few nearest cells (approximate).
Neighbouring cells make a region of bounded size. A query travels once to a region, with the list of the cells that it wants
there, so it is copied by the number of regions and not of cells. A cell holding much of the corpus is cut into blocks
by a hash of the id, and so are a region's queries, so no group grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealflow.operators.knn import HIT_SCHEMA, BestRows, first_copies, int_column, vectors_of
from dealflow.operators.topk import top_per_group
from dealflow.session import materialise

LEAST_PIVOTS, MOST_PIVOTS = 8, 4096
# Rows of a block, and the numbers that their vectors may have (for wide vectors fewer rows, but ``LEAST_ROWS``).
BLOCK_ROWS, BLOCK_VALUES, LEAST_ROWS = 32_768, 2_000_000, 4096
# Queries of a block that meet its rows at once, with their lists of cells and their best rows so far.
SLICE_QUERIES = 4096
# Numbers held at once where vectors meet pivots or are copied (8 MB of doubles).
PIECE_VALUES = 1_000_000
MOST_GROUPS = 4096
GROUP = ["region", "block", "query_block"]


def pivot_count(rows: int) -> int:
    """A cell per square root of the rows, within bounds that the driver and every task can hold."""
    return max(LEAST_PIVOTS, min(MOST_PIVOTS, math.isqrt(rows) // 2))


def sample_pivots(corpus: DataFrame, count: int) -> np.ndarray:
    """Unit vectors of a fixed pseudo-random choice of rows (a top-k of ``count`` rows), without copies."""
    rows = corpus.orderBy(F.xxhash64("id"), "id").select("embedding").limit(count).toArrow()
    if not rows.num_rows:
        return np.empty((0, 1))
    pivots = vectors_of(rows.column("embedding"))
    return np.unique(pivots[~np.isnan(pivots).any(axis=1)], axis=0)


def gaps(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Straight-line distances between unit vectors."""
    return np.sqrt(np.clip(2.0 - 2.0 * (vectors @ pivots.T), 0.0, None))


def _slices(rows: int, width: int) -> Iterator[slice]:
    """The rows in parts of a bounded number of values."""
    step = max(1, PIECE_VALUES // max(1, width))
    return (slice(at, at + step) for at in range(0, rows, step))


def assign_cells(corpus: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell`` (nearest pivot) and ``gap`` (distance to it); rows without a direction drop out."""
    shared = corpus.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = vectors_of(batch.column("embedding"))
            known = ~np.isnan(vectors).any(axis=1)
            vectors = vectors[known]
            cell, gap = np.empty(len(vectors), np.int64), np.empty(len(vectors))
            for part in _slices(len(vectors), len(shared.value)):
                distance = gaps(vectors[part], shared.value)
                cell[part], gap[part] = distance.argmin(axis=1), distance.min(axis=1)
            kept = batch.filter(pa.array(known))
            yield pa.RecordBatch.from_arrays(
                kept.columns + [pa.array(cell, pa.int32()), pa.array(gap)], names=kept.schema.names + ["cell", "gap"]
            )

    schema = T.StructType(
        corpus.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())]
    )
    return corpus.mapInArrow(assign, schema)


def within_reach(pivots: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Rule: the cells that may hold a vector at cosine distance up to ``far`` (one number per query)."""
    filled = np.isfinite(high)
    between = []  # made once per task

    def reach(vectors: np.ndarray, far: np.ndarray) -> np.ndarray:
        distance = gaps(vectors, pivots)
        nearest = distance.argmin(axis=1)
        # A vector of the cell lies between ``low`` and ``high`` from the pivot ...
        bound = np.maximum(distance - high[None, :], low[None, :] - distance)
        # ... and nearer to that pivot than to the query's own nearest pivot.
        if not between:
            between.append(gaps(pivots, pivots))
        apart = between[0][nearest]
        own = distance.min(axis=1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            beyond = np.where(apart > 1e-9, (distance**2 - own**2) / (2.0 * apart), 0.0)
        radius = np.sqrt(2.0 * far) + 1e-6
        return filled[None, :] & (np.maximum(bound, beyond) <= radius[:, None])

    reach.cells = len(pivots)
    return reach


def nearest_cells(pivots: np.ndarray, probes: int):
    """Rule: the ``probes`` cells whose pivots are nearest."""

    def reach(vectors: np.ndarray, far: np.ndarray | None = None) -> np.ndarray:
        distance = gaps(vectors, pivots)
        chosen = np.zeros(distance.shape, bool)
        np.put_along_axis(chosen, np.argsort(distance, axis=1, kind="stable")[:, :probes], True, axis=1)
        return chosen

    reach.cells = len(pivots)
    return reach


def nearest_region(pivots: np.ndarray, region: np.ndarray):
    """Rule: all cells of the region whose pivot is nearest."""

    def reach(vectors: np.ndarray, far: np.ndarray | None = None) -> np.ndarray:
        return region[gaps(vectors, pivots).argmin(axis=1)][:, None] == region[None, :]

    reach.cells = len(pivots)
    return reach


def block_rows(width: int) -> int:
    """Rows of a block of vectors so wide."""
    return min(BLOCK_ROWS, max(LEAST_ROWS, BLOCK_VALUES // max(1, width)))


def near_order(pivots: np.ndarray) -> list[int]:
    """The pivots in an order in which neighbours follow each other: halves along the widest dimension, again and again."""
    done, parts = [], [np.arange(len(pivots))]
    while parts:
        part = parts.pop()
        if len(part) <= 2:
            done.extend(part.tolist())
            continue
        along = pivots[part, pivots[part].var(axis=0).argmax()]
        part = part[np.argsort(along, kind="stable")]
        parts += [part[len(part) // 2 :], part[: len(part) // 2]]
    return done


def regions(pivots: np.ndarray, sizes: dict[int, int]) -> np.ndarray:
    """The region of every cell: neighbouring cells that together fill a block. A larger cell is a region of its own."""
    region, number, filled, most = np.zeros(len(pivots), np.int32), 0, 0, block_rows(pivots.shape[1])
    for cell in near_order(pivots):
        if filled and filled + sizes.get(cell, 0) > most:
            number, filled = number + 1, 0
        region[cell] = number
        filled += sizes.get(cell, 0)
    return region


def _reached(reach: Callable, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the batch and reachable cells, query after query, in parts of bounded size."""
    vectors = vectors_of(batch.column("embedding"))
    known = np.flatnonzero(~np.isnan(vectors).any(axis=1))
    far = np.full(batch.num_rows, np.inf)
    if "far" in batch.schema.names:
        given = batch.column("far").to_numpy(zero_copy_only=False).astype(np.float64)
        far = np.where(np.isnan(given), np.inf, given)
    for part in _slices(len(known), reach.cells):
        row, cell = np.nonzero(reach(vectors[known[part]], far[known[part]]))
        yield known[part][row], cell


def spread_queries(queries: DataFrame, reach: Callable, region: np.ndarray) -> DataFrame:
    """One row per query and region, with the ``cells`` there that the query can reach. A query may carry ``far``, beyond which
    it wants no row."""

    def spread(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            width = max(1, len(batch.column("embedding").flatten()) // batch.num_rows)
            for row, cell in _reached(reach, batch):
                order = np.lexsort((cell, region[cell], row))
                row, cell, of = row[order], cell[order], region[cell[order]]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (of[1:] != of[:-1])][: len(row)])
                ends = np.r_[new, len(row)]
                for part in _slices(len(new), width):
                    first, bounds = new[part], ends[part.start : part.stop + 1]
                    taken = batch.take(pa.array(row[first]))
                    cells = pa.ListArray.from_arrays(
                        pa.array(bounds - bounds[0], pa.int32()), pa.array(cell[bounds[0] : bounds[-1]], pa.int32())
                    )
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns, pa.array(of[first], pa.int32()), cells], names=[*taken.schema.names, "region", "cells"]
                    )

    fields = [T.StructField("region", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))]
    return queries.mapInArrow(spread, T.StructType([*queries.schema.fields, *fields]))


def _wanted(queries: DataFrame, reach: Callable, region: np.ndarray) -> dict[int, int]:
    """The number of queries that each region gets; regions without any are absent."""

    def count(batches):
        total = np.zeros(int(region.max(initial=0)) + 1, np.int64)
        for batch in batches:
            if batch.num_rows:
                for row, cell in _reached(reach, batch):
                    total += np.bincount(np.unique(np.stack([row, region[cell]]), axis=1)[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["region", "n"])

    counted = queries.mapInArrow(count, "region int, n long").groupBy("region").agg(F.sum("n").alias("n"))
    return {r["region"]: r["n"] for r in counted.collect()}  # one row per region


def _lookup(values, column: str) -> Column:
    """A number per cell or region, of which there are no more than pivots."""
    return F.get(F.array(*[F.lit(int(v)) for v in values]), F.col(column))


@dataclass(frozen=True)
class Placed:
    """A corpus by cell: ``rows`` (``id, embedding, cell, gap``, perhaps ``seq``), stored, and per cell the number of rows and the least and
    the largest distance from its pivot."""

    rows: DataFrame
    pivots: np.ndarray
    sizes: dict[int, int]
    low: np.ndarray
    high: np.ndarray

    def regions(self) -> np.ndarray:
        """The region of every cell."""
        return regions(self.pivots, self.sizes)


def place(corpus: DataFrame) -> Placed | None:
    """Put a corpus into cells; None if it is empty."""
    corpus = materialise(corpus, "corpus")
    pivots = sample_pivots(corpus, pivot_count(corpus.count()))
    if not len(pivots):
        return None
    # Read several times, computed once.
    rows = materialise(assign_cells(corpus, pivots), "placed")
    bounds = [F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high")]
    low, high, sizes = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), {}
    for r in rows.groupBy("cell").agg(*bounds).collect():
        sizes[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    return Placed(rows, pivots, sizes, low, high)


def _dealt(queries: DataFrame, placed: Placed, reach: Callable) -> tuple[DataFrame, DataFrame, int] | None:
    """The corpus and the queries by ``GROUP``, each as often as it meets a block of the other, and a number of partitions; None if no
    query reaches a cell."""
    region, most = placed.regions(), block_rows(placed.pivots.shape[1])
    wanted = _wanted(queries, reach, region)
    if not wanted:
        return None
    filled = np.bincount(region, [placed.sizes.get(c, 0) for c in range(len(region))])
    blocks = [max(1, -(-int(n) // most)) for n in filled]
    query_blocks = [max(1, -(-wanted.get(r, 0) // most)) for r in range(len(filled))]
    seq = ["seq"] if "seq" in placed.rows.columns else []
    rows = placed.rows.withColumn("region", _lookup(region, "cell")).where(F.col("region").isin(list(wanted)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), _lookup(blocks, "region")))
    rows = rows.withColumn("query_block", F.explode(F.sequence(F.lit(0), _lookup(query_blocks, "region") - 1)))
    asks = spread_queries(queries, reach, region)
    asks = asks.withColumn("query_block", F.pmod(F.xxhash64("query_id"), _lookup(query_blocks, "region")))
    asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0), _lookup(blocks, "region") - 1)))
    # A partition holds about one group, however many partitions the session shuffles into.
    parts = min(MOST_GROUPS, max(queries.sparkSession.sparkContext.defaultParallelism, sum(blocks[r] * query_blocks[r] for r in wanted)))
    far = ["far"] if "far" in queries.columns else []
    keys = [F.col(c).cast("long").alias(c) for c in GROUP]
    return rows.select(*keys, "id", "cell", "embedding", *seq), asks.select(*keys, "query_id", "cells", *far, "embedding", *seq), parts


def meet_in_blocks(queries: DataFrame, placed: Placed, reach: Callable, compare: Callable, schema: str) -> DataFrame:
    """``compare`` for every block of a region with every block of the queries sent there, as Arrow tables."""
    dealt = _dealt(queries, placed, reach)
    if dealt is None:
        return queries.sparkSession.createDataFrame([], schema)
    rows, asks = (side.repartition(dealt[2], *GROUP).groupBy(*GROUP) for side in dealt[:2])
    return rows.cogroup(asks).applyInArrow(compare, schema)


def list_in_blocks(queries: DataFrame, placed: Placed, reach: Callable, compare: Callable, schema: str) -> DataFrame:
    """The same for a ``compare`` that yields batches, for a bounded number of a block's queries at a time. Each batch leaves the task
    before the next is made, so a block may list all its pairs."""
    dealt = _dealt(queries, placed, reach)
    if dealt is None:
        return queries.sparkSession.createDataFrame([], schema)
    rows, asks, parts = dealt
    both = rows.withColumn("asks", F.lit(False)).unionByName(asks.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    kept = [[c for c in side.columns if c not in GROUP] for side in (rows, asks)]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = pa.Table.from_batches(list(batches))
        ours = met.column("asks")
        rows, asks = met.filter(pc.invert(ours)).select([*kept[0], "block"]), met.filter(ours).select(kept[1])
        if rows.num_rows:
            for at in range(0, asks.num_rows, SLICE_QUERIES):
                yield from compare(rows, asks.slice(at, SLICE_QUERIES))

    return both.repartition(parts, *GROUP).groupBy(*GROUP).applyInArrow(listed, schema)


def meetings(rows: pa.Table, asks: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cells of a block with the places of their rows and of the queries that want them."""
    home, lists = int_column(rows, "cell"), asks.column("cells").combine_chunks()
    asked = np.repeat(np.arange(asks.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    cell = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    asked, cell = asked[order], cell[order]
    for one in np.unique(home):
        which = asked[np.searchsorted(cell, one) : np.searchsorted(cell, one, "right")]
        if len(which):
            yield int(one), np.flatnonzero(home == one), which


def sides(rows: pa.Table, asks: pa.Table, k: int, below: float | None):
    """Ids, unit vectors and arrivals of a block's rows, and the best rows of its queries, none so far."""
    ordered = "seq" in rows.column_names
    seqs, arrival = (int_column(asks, "seq"), int_column(rows, "seq")) if ordered else (None, None)
    far = None
    if "far" in asks.column_names:
        far = asks.column("far").to_numpy().astype(np.float64)
        far = np.where(np.isnan(far), np.inf, far)
    best = BestRows(int_column(asks, "query_id"), vectors_of(asks.column("embedding")), seqs, k, below, far)
    return int_column(rows, "id"), vectors_of(rows.column("embedding")), arrival, best


def no_hits() -> pa.Table:
    return pa.Table.from_batches([BestRows(np.empty(0, np.int64), None, None, 1, None).batch()])


def in_slices(compare: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``compare`` for a bounded number of a block's queries at a time, so that it holds lists and best rows of these alone."""

    def compared(rows: pa.Table, asks: pa.Table) -> pa.Table:
        starts = range(0, max(1, asks.num_rows), SLICE_QUERIES)
        return pa.concat_tables([compare(rows, asks.slice(at, SLICE_QUERIES)) for at in starts])

    return compared


def cell_hits(queries: DataFrame, placed: Placed, reach: Callable, k: int, below: float | None) -> DataFrame:
    """Best rows per query in the cells that it can reach; only those leave a block."""

    def compare(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:
            return no_hits()
        ids, vectors, arrival, best = sides(rows, asks, k, below)
        for _, at, which in meetings(rows, asks):
            best.add(ids[at], vectors[at], None if arrival is None else arrival[at], which)
        return pa.Table.from_batches([best.batch()])

    return meet_in_blocks(queries, placed, reach, in_slices(compare), HIT_SCHEMA)


def bounded_hits(queries: DataFrame, corpus: DataFrame, k: int, below: float | None) -> DataFrame:
    """Exact hits for any number of queries: cells are skipped only when no row in them can qualify.

    With ``below``, the vectors' leading components rule out most pairs that are left (``operators.rotation``). Without it,
    a first look into each query's own region finds ``k`` rows there, and no row farther than the last of them can be
    among the nearest.
    """
    placed = place(first_copies(corpus, k))
    if placed is None:
        return queries.sparkSession.createDataFrame([], HIT_SCHEMA)
    if below is not None:
        from dealflow.operators import rotation

        width = placed.pivots.shape[1]
        directions = rotation.leading(rotation.second_moment(placed.rows), below) if width <= rotation.MOST_WIDTH else np.empty((width, 0))
        if directions.shape[1]:
            return rotation.threshold_join(queries, placed, k, below, directions).hits
        queries = queries.withColumn("far", F.lit(float(below)))
    else:
        first = cell_hits(queries, placed, nearest_region(placed.pivots, placed.regions()), k, None)
        best = top_per_group(first, "query_id", [F.col("distance").asc(), F.col("id").asc()], k)
        last = best.where(F.col("rank") == k).select("query_id", F.col("distance").alias("far"))
        queries = materialise(queries.join(last, "query_id", "left"), "bounded-queries")
    return cell_hits(queries, placed, within_reach(placed.pivots, placed.low, placed.high), k, below)
