"""Exact nearest neighbours by cosine distance for a table of queries.

Few queries (the usual case) travel to every task as one matrix of bounded size; the corpus is read once, is never
shuffled, and each task emits only its own best ``k`` rows per query. For more queries than that bound the first ``k`` of every
group of copies make the corpus. If it is of bounded size, it travels to the queries; else they meet it in blocks
(``operators.cells``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.operators.topk import top_per_group
from dealflow.session import materialise

HIT_SCHEMA = "query_id long, id long, distance double"

# Queries times dimensions that may be sent to every task (32 MB of doubles).
BROADCAST_FLOATS = 4_000_000
# Queries that may be sent to every task: each task returns its best rows for all of them.
BROADCAST_QUERIES = 10_000
# Query-by-row distances held at once inside a task (16 MB of floats).
BLOCK_FLOATS = 4_000_000
# Pairs measured before they are merged with the best ones, unless these are more.
WAITING = 200_000
# Hits (at most ``k`` per query) that joins may broadcast: 24 bytes each, so under 5 MB.
BROADCAST_HITS = 200_000
# Distances are compared after rounding, so that exact copies tie and the smaller id goes first.
DISTANCE_DIGITS = 12


def vectors_of(column) -> np.ndarray:
    """An Arrow list column as a matrix of unit rows; an all-zero row becomes NaN and so never matches."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(column), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def rounding(width: int) -> float:
    """More than the product of two unit vectors can lose in single precision."""
    return 1.2e-7 * (width + 8)


def int_column(batch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).to_numpy(zero_copy_only=False), dtype=np.int64)


class BestRows:
    """The ``k`` nearest rows of every query seen so far in one task.

    Single-precision products choose the pairs to look at, with room for their rounding; those are measured in doubles.
    ``far`` are distances beyond which a query wants no row, such as that of the last of ``k`` rows known already.
    """

    def __init__(self, query_ids, vectors, seqs, k: int, below: float | None, far=None):
        self.query_ids, self.vectors, self.seqs, self.k = query_ids, vectors, seqs, k
        self.below = np.inf if below is None else below
        self.limit = np.full(len(query_ids), np.inf) if far is None else np.array(far, np.float64)
        self.rough = None if vectors is None else vectors.astype(np.float32)
        self.query = np.empty(0, np.int64)
        self.row = np.empty(0, np.int64)
        self.distance = np.empty(0)
        self.waiting, self.count = [], 0

    def add(self, ids, vectors, seqs=None, which=None) -> None:
        """Compare rows with all queries, or with the queries at the positions ``which``."""
        known = ~np.isnan(vectors).any(axis=1)
        if not known.all():
            ids, vectors, seqs = ids[known], vectors[known], None if seqs is None else seqs[known]
        positions = np.arange(len(self.query_ids)) if which is None else which
        if not len(ids) or not len(positions):
            return
        queries = self.rough if which is None else self.rough[which]
        rough = vectors.astype(np.float32)
        step = max(1, BLOCK_FLOATS // len(positions))
        for start in range(0, len(ids), step):
            part = slice(start, start + step)
            self._add_block(positions, queries, ids[part], vectors[part], rough[part], None if seqs is None else seqs[part])

    def _add_block(self, positions, queries, ids, vectors, rough, seqs) -> None:
        product = queries @ rough.T
        slack = rounding(rough.shape[1])
        if seqs is not None:
            product[seqs[None, :] >= self.seqs[positions][:, None]] = -np.inf
        limit = self.limit[positions]
        if len(ids) > self.k and np.isinf(limit).any():
            # As many rows as wanted are at least as near as this.
            last = len(ids) - self.k
            limit = np.minimum(limit, 1.0 - np.partition(product, last, axis=1)[:, last] + slack)
            self.limit[positions] = limit
        with np.errstate(invalid="ignore"):
            least = (1.0 - np.minimum(limit, self.below) - 1e-9 - slack).astype(np.float32)
            found = np.flatnonzero((product >= least[:, None]) & (product > -np.inf))
        del product
        self.measure(positions, found // len(ids), found % len(ids), ids, vectors)

    def measure(self, positions, query, row, ids, vectors) -> None:
        """Take pairs of a query, by its place in ``positions``, and a row, by its place in ``ids``."""
        step = max(1, BLOCK_FLOATS // max(1, vectors.shape[1]) // 2)
        for start in range(0, len(query), step):
            q, r = positions[query[start : start + step]], row[start : start + step]
            product = np.einsum("ij,ij->i", self.vectors[q], vectors[r])
            distance = np.round(np.clip(1.0 - product, 0.0, 2.0), DISTANCE_DIGITS)
            near = (distance < self.below) & (distance <= self.limit[q] + 1e-9)
            self.waiting.append((q[near], ids[r[near]], distance[near]))
            self.count += int(near.sum())
            if self.count > max(WAITING, len(self.query)):
                self._settle()

    def _settle(self) -> None:
        """Merge the pairs that wait; they may be as many as those kept."""
        if self.waiting:
            query, row, distance = (np.concatenate(c) for c in zip(*self.waiting, strict=True))
            self.waiting, self.count = [], 0
            self._merge(query, row, distance)

    def _merge(self, query, row, distance) -> None:
        query = np.concatenate([self.query, query])
        row = np.concatenate([self.row, row])
        distance = np.concatenate([self.distance, distance])
        order = np.lexsort((row, distance, query))
        query, row, distance = query[order], row[order], distance[order]
        at = np.arange(len(query))
        first = np.r_[True, query[1:] != query[:-1]]
        rank = at - np.maximum.accumulate(np.where(first, at, 0))
        keep = rank < self.k
        self.query, self.row, self.distance = query[keep], row[keep], distance[keep]
        last = rank[keep] == self.k - 1
        self.limit[self.query[last]] = self.distance[last]

    def batch(self) -> pa.RecordBatch:
        self._settle()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.query_ids[self.query], pa.int64()),
                pa.array(self.row, pa.int64()),
                # Adding zero turns -0.0 into 0.0.
                pa.array(self.distance + 0.0, pa.float64()),
            ],
            names=["query_id", "id", "distance"],
        )


def usable_vectors(df: DataFrame, key: str) -> DataFrame:
    """Key, vector and (when there is one) arrival number of the rows that have a vector."""
    columns = [F.col(key).cast("long").alias(key), "embedding"]
    if "seq" in df.columns:
        columns.append(F.col("seq").cast("long").alias("seq"))
    return df.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(*columns)


def collect_vectors(df: DataFrame, key: str, most: int | None = None):
    """Ids, unit vectors and arrival numbers, or None when they exceed the broadcast bound or ``most`` rows."""
    head = df.select("embedding").limit(1).toArrow()
    width = len(head.column(0)[0]) if head.num_rows else 1
    bound = max(1, BROADCAST_FLOATS // max(1, width))
    bound = bound if most is None else min(bound, most)
    table = df.limit(bound + 1).toArrow()
    if table.num_rows > bound:
        return None
    if not table.num_rows:
        return np.empty(0, np.int64), np.empty((0, width)), None
    seqs = int_column(table, "seq") if "seq" in table.column_names else None
    return int_column(table, key), vectors_of(table.column("embedding")), seqs


def collect_queries(queries: DataFrame):
    """Query ids, unit vectors and arrival numbers, or None when they are too many to be sent to every task."""
    return collect_vectors(queries, "query_id", BROADCAST_QUERIES)


def scan_hits(collected, corpus: DataFrame, k: int, below: float | None, reach: np.ndarray | None = None) -> DataFrame:
    """Each task's best rows per query, with the queries sent to the tasks.

    With ``reach`` (queries by cells), rows carry a ``cell`` and only meet the queries that reach it.
    """
    shared = corpus.sparkSession.sparkContext.broadcast((*collected, reach))

    def scan(batches):
        query_ids, vectors, seqs, reach = shared.value
        best = BestRows(query_ids, vectors, seqs, k, below)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, rows = int_column(batch, "id"), vectors_of(batch.column("embedding"))
            if reach is None:
                best.add(ids, rows, None if seqs is None else int_column(batch, "seq"))
                continue
            home = int_column(batch, "cell")
            for cell in np.unique(home):
                best.add(ids[home == cell], rows[home == cell], which=np.flatnonzero(reach[:, cell]))
        yield best.batch()

    return corpus.mapInArrow(scan, HIT_SCHEMA)


def scan_queries(queries: DataFrame, collected, k: int, below: float | None) -> DataFrame:
    """The best rows of every query, with the corpus sent to the tasks. Nothing is shuffled."""
    shared = queries.sparkSession.sparkContext.broadcast(collected)

    def scan(batches):
        ids, rows, seqs = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            arrival = None if seqs is None else int_column(batch, "seq")
            best = BestRows(int_column(batch, "query_id"), vectors_of(batch.column("embedding")), arrival, k, below)
            best.add(ids, rows, seqs)
            yield best.batch()

    return queries.mapInArrow(scan, HIT_SCHEMA)


def first_copies(corpus: DataFrame, k: int) -> DataFrame:
    """The corpus without rows that ``k`` equal vectors go before, whatever the query: smaller ids and, with ``seq``, no later
    arrivals. Rows of equal vectors that a query may see at different times stay."""
    ordered = "seq" in corpus.columns
    first = top_per_group(corpus, "embedding", [F.col(c) for c in (["seq", "id"] if ordered else ["id"])], k)
    if not ordered:
        return first.drop("rank")
    # Every other row arrives with these or later, so those of larger ids than all ``k`` have no chance.
    last = first.groupBy("embedding").agg(F.max("id").alias("_last"), F.count(F.lit(1)).alias("_first"))
    last = last.where(F.col("_first") >= k).select("embedding", "_last")
    kept = corpus.join(last, "embedding", "left").where(F.coalesce(F.col("id") <= F.col("_last"), F.lit(True)))
    return kept.select(*corpus.columns)


def many_hits(queries: DataFrame, corpus: DataFrame, k: int, below: float | None) -> DataFrame:
    """Hits for query tables of any size. Copies are compared once, on either side."""
    from dealflow.operators.cells import bounded_hits

    corpus = materialise(first_copies(corpus, k), "first-copies")
    collected = collect_vectors(corpus, "id")
    if collected is not None:
        return scan_queries(queries, collected, k, below)
    if "seq" in queries.columns:
        return bounded_hits(queries, corpus, k, below)
    different = queries.select("embedding").distinct().withColumn("_class", F.monotonically_increasing_id())
    different = materialise(different, "different")
    if different.count() == queries.count():
        return bounded_hits(queries, corpus, k, below)
    found = bounded_hits(different.withColumnRenamed("_class", "query_id"), corpus, k, below)
    found = top_per_group(found, "query_id", [F.col("distance"), F.col("id")], k).drop("rank")
    members = queries.join(different, "embedding").select("query_id", "_class")
    return members.join(found.withColumnRenamed("query_id", "_class"), "_class").select("query_id", "id", "distance")


def best_hits(hits: DataFrame, collected, k: int) -> DataFrame:
    """The ``k`` nearest of all tasks' hits, marked for broadcast when there are provably few."""
    best = top_per_group(hits, "query_id", [F.col("distance").asc(), F.col("id").asc()], k)
    small = collected is not None and len(collected[0]) * k <= BROADCAST_HITS
    # Looking up the hits' columns must not shuffle the table, and the planner cannot see how few hits there are.
    return best.hint("broadcast") if small else best


def nearest(queries: DataFrame, corpus: DataFrame, k: int, below: float | None = None) -> DataFrame:
    """The ``k`` corpus rows nearest to every query, ties by id: ``query_id, id, distance, rank``.

    ``queries`` has ``query_id, embedding`` and ``corpus`` has ``id, embedding``. ``below`` keeps distances strictly
    smaller than it. When both carry ``seq``, a query only sees corpus rows with a smaller one.
    """
    queries, corpus = usable_vectors(queries, "query_id"), usable_vectors(corpus, "id")
    if "seq" not in queries.columns or "seq" not in corpus.columns:
        queries, corpus = queries.drop("seq"), corpus.drop("seq")
    collected = collect_queries(queries)
    if collected is not None:
        hits = scan_hits(collected, corpus, k, below)
    else:
        hits = many_hits(queries, corpus, k, below)
    return best_hits(hits, collected, k)
