"""All vectors below a cosine distance for any number of queries, by their leading components.

Vectors are rotated so that their first components hold most of what they vary in. The inner product of two unit vectors is
at most that of their heads plus the product of the norms of what the heads leave out, so pairs for which this is too
little are no match, whatever the rest is. Heads meet in the cells' blocks, and full vectors for the pairs that stay. Where
a query keeps many rows of one cell, as in a group of copies, it meets all of them. Only the best ``k`` rows of a
query leave a block, so what is shuffled does not depend on the number of pairs. All results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.operators.cells import Placed, in_slices, list_in_blocks, meet_in_blocks, meetings, no_hits, sides, within_reach
from dealflow.operators.knn import BLOCK_FLOATS, HIT_SCHEMA, rounding, vectors_of

MOST_WIDTH = 4096  # bound of the matrix that tasks and the driver hold: 128 MB
FEW = 32  # partial sums that reach the driver at most
REST = 0.7  # of the least inner product, what a pair may owe to the components left out on average
MANY = 32  # rows of one cell's block that a query keeps before it meets all of them
SLACK = 1e-5  # heads are compared as floats


def second_moment(vectors: DataFrame) -> np.ndarray:
    """The sum of the outer products of the unit vectors. Tasks add up their own; ever fewer tasks add up those."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                unit = vectors_of(batch.column("embedding"))
                unit = unit[~np.isnan(unit).any(axis=1)]
                total = unit.T @ unit if total is None else total + unit.T @ unit
        if total is not None:
            yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for one in batch["total"]:
                value = np.frombuffer(one.as_py())
                total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

    sums, count = vectors.select("embedding").mapInArrow(add, "total binary"), vectors.rdd.getNumPartitions()
    while count > FEW:
        count = max(FEW, int(count**0.5))
        sums = sums.repartition(count).mapInArrow(merge, "total binary")
    total = np.sum([np.frombuffer(r["total"]) for r in sums.collect()], axis=0)
    width = int(np.sqrt(np.size(total)))
    return np.reshape(total, (width, width))


def leading(moment: np.ndarray, below: float) -> np.ndarray:
    """The directions of the head, one per column: as few as leave ``REST`` of the least inner product or less to the others.

    No direction if there is nothing to leave out.
    """
    energy, directions = np.linalg.eigh(moment)
    energy, directions = np.maximum(energy[::-1], 0.0), directions[:, ::-1]
    rest = 1.0 - np.cumsum(energy) / max(energy.sum(), 1e-300)
    enough = np.flatnonzero(rest <= REST * (1.0 - below))
    size = int(enough[0]) + 1 if len(enough) and below < 1.0 else len(energy)
    return directions[:, :size] if size < len(energy) else np.empty((len(energy), 0))


def _heads(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The leading components and, last, the norm of the others, in single precision."""
    head = vectors @ directions
    rest = np.sqrt(np.maximum(0.0, 1.0 - (head * head).sum(axis=1)))
    return np.column_stack([head, rest]).astype(np.float32)


def _near(rows: pa.Table, asks: pa.Table, k: int, below: float, directions: np.ndarray, many: int):
    """A block's ids, vectors, arrivals and best rows, and cell by cell the places of the rows, of the queries that keep a few of
    these with the pairs of them that the heads do not rule out, and of the queries that keep many."""
    ids, vectors, arrival, best = sides(rows, asks, k, below)
    heads, asked = _heads(vectors, directions), _heads(best.vectors, directions)
    least = 1.0 - below - SLACK - rounding(heads.shape[1])

    def cells() -> Iterator[tuple]:
        for cell, at, which in meetings(rows, asks):
            step = max(1, BLOCK_FLOATS // len(at))
            for start in range(0, len(which), step):
                some = which[start : start + step]
                near = asked[some] @ heads[at].T >= least
                if arrival is not None:
                    near &= arrival[at][None, :] < best.seqs[some][:, None]
                crowded = near.sum(axis=1) > many
                near[crowded] = False
                yield cell, at, some, np.nonzero(near), some[crowded]

    return ids, vectors, arrival, best, cells()


@dataclass(frozen=True)
class ThresholdJoin:
    """``hits`` (``query_id, id, distance``), and what is compared in full: ``pairs`` one by one, ``counts`` of these (``query_id, n``, a
    row per block), and ``crowds``, queries that meet whole cells of a block (``query_id, cell, block``, and ``n`` rows there). A block may
    have as many pairs as queries and rows multiplied; they leave the task as they are found."""

    hits: DataFrame
    pairs: DataFrame
    counts: DataFrame
    crowds: DataFrame


def threshold_join(
    queries: DataFrame, placed: Placed, k: int, below: float, directions: np.ndarray, many: int = MANY
) -> ThresholdJoin:
    """The ``k`` nearest rows below ``below`` of every query, or more of them; see the module's text.

    ``queries`` has ``query_id, embedding``, ``placed`` is the corpus by cell, both with or without ``seq``.
    """
    asked = queries.withColumn("far", F.lit(float(below)))
    reach = within_reach(placed.pivots, placed.low, placed.high)
    shared = queries.sparkSession.sparkContext.broadcast(directions)

    def hits(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:
            return no_hits()
        ids, vectors, arrival, best, cells = _near(rows, asks, k, below, shared.value, many)
        for _, at, some, (query, row), crowded in cells:
            best.measure(some, query, row, ids[at], vectors[at])
            best.add(ids[at], vectors[at], None if arrival is None else arrival[at], crowded)
        return pa.Table.from_batches([best.batch()])

    def counted(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2, ["query_id", "n"])
        _, _, _, best, cells = _near(rows, asks, k, below, shared.value, many)
        total = np.zeros(len(best.query_ids), np.int64)
        for _, _, some, (query, _), _ in cells:
            total[some] += np.bincount(query, minlength=len(some))
        return pa.table([pa.array(best.query_ids), pa.array(total)], ["query_id", "n"])

    def listed(crowds: bool):
        names = ["query_id", "cell", "block", "n"] if crowds else ["query_id", "id"]

        def found(rows: pa.Table, asks: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, _, _, best, cells = _near(rows, asks, k, below, shared.value, many)
            block = rows.column("block")[0].as_py()
            for cell, at, some, (query, row), crowded in cells:
                if crowds:
                    columns = [best.query_ids[crowded], *[np.full(len(crowded), v, np.int64) for v in (cell, block, len(at))]]
                else:
                    columns = [best.query_ids[some[query]], ids[at[row]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        return found

    return ThresholdJoin(
        meet_in_blocks(asked, placed, reach, in_slices(hits), HIT_SCHEMA),
        list_in_blocks(asked, placed, reach, listed(False), "query_id long, id long"),
        meet_in_blocks(asked, placed, reach, in_slices(counted), "query_id long, n long"),
        list_in_blocks(asked, placed, reach, listed(True), "query_id long, cell long, block long, n long"),
    )
