"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Each block of vectors has inverted files: per pivot the
vectors among whose first pivots it is. A query visits the files of its own first pivots, ranks what it finds by the
footrule distance between the two orders (how far each of its pivots stands from its place in the other order), and
compares the best part with its exact inner product.

Vectors of unequal length are first put on one sphere by an added component, so that the largest inner product is the
smallest angle. That is for the index alone; scores are taken on the vectors as they are, in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealflow.session import materialise

PIVOTS = 256  # bound of the sample that the index is fitted on
PREFIX = 64  # pivots kept of a vector's order
POSTED = 24  # of these, the files a vector is posted in and a query visits
SHARE = 0.4  # of a block's vectors, the part with the smallest footrule that is compared exactly
BLOCK, QUERIES = 4096, 4096  # vectors and queries that meet in one task call
NEAREST = 20


def usable(vectors: DataFrame) -> DataFrame:
    """``row, vec_id, vector`` (doubles) of the rows of ``vectors(vec_id, embedding)`` that take part, ``row`` a number.

    Left out are null ids, which no result could name, and vectors that are null, empty, zero or hold a null or
    non-finite component. Rows that repeat an id are vectors of their own.
    """
    value = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", value.alias("vector")).where("vec_id IS NOT NULL AND size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector")


def _square(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)


def pivot_orders(data: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each row's ``prefix`` nearest pivots in order, of equally near ones the first."""
    return np.argsort(-(data @ pivots.T), axis=1, kind="stable")[:, :prefix]


def on_sphere(data: np.ndarray, square: float) -> np.ndarray:
    """Rows with a component added that brings all of them to the squared length ``square``."""
    rest = np.maximum(square - (data * data).sum(1), 0.0)
    return np.column_stack([data, np.sqrt(rest)])


def filled(vectors, width: int) -> np.ndarray:
    """Vectors as rows of one matrix, zeros behind those that are shorter."""
    out = np.zeros((len(vectors), width))
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return out


def search_block(ids, numbers, data, orders, query_rows, queries, query_orders, pivots: int, posted: int, share: float, nearest: int):
    """The ``nearest`` best of one block for each query: query rows, vector rows, vector ids and scores, as arrays.

    Equal footrules and equal scores go to the smaller id. A query whose files hold fewer than ``nearest`` of the block's
    vectors is compared with all of them.
    """
    order = np.lexsort((numbers, ids))
    ids, numbers, data, orders = ids[order], numbers[order], data[order], orders[order]
    prefix = orders.shape[1]
    place = np.full((pivots, len(ids)), prefix, np.int16)
    place[orders.T, np.arange(len(ids))] = np.arange(prefix, dtype=np.int16)[:, None]
    files = [np.flatnonzero(p < posted) for p in place]
    most = max(int(np.ceil(share * len(ids))), 2 * nearest)
    there = np.arange(prefix, dtype=np.int16)[:, None]
    found = ([], [], [], [])
    for k, query in enumerate(query_rows):
        visited = np.zeros(len(ids), bool)
        for p in query_orders[k, :posted]:
            visited[files[p]] = True
        other = numbers != query
        rows = np.flatnonzero(visited & other)
        if len(rows) < nearest:
            rows = np.flatnonzero(other)
        if len(rows) > most:
            footrule = np.abs(place[query_orders[k]] - there).sum(0, dtype=np.int16)[rows]
            rows = np.sort(rows[np.argsort(footrule, kind="stable")[:most]])
        if len(rows) > nearest:
            rough = data[rows] @ queries[k]
            rows = rows[rough >= np.partition(rough, -nearest)[-nearest] - 1e-9 * max(1.0, float(np.abs(rough).max()))]
        # One way of adding up for all rows, so that equal vectors have equal scores.
        scores = np.einsum("ij,j->i", data[rows], queries[k])
        best = np.lexsort((numbers[rows], ids[rows], -scores))[:nearest]
        found[0].append(np.full(len(best), query))
        found[1].append(numbers[rows][best])
        found[2].append(ids[rows][best])
        found[3].append(scores[best])
    return tuple(np.concatenate(f) if f else np.empty(0) for f in found)


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, pivots: int = PIVOTS, share: float = SHARE) -> DataFrame:
    """The ``k`` vectors with the largest inner product for each query: ``query_id, rank, vec_id, score``.

    Queries are the rows of ``vectors(vec_id, embedding)`` for which ``is_query`` (of ``vec_id``) holds, candidates all
    rows but the query's own, so another row with the query's id is one; queries that repeat an id each have their
    ``k`` rows. In vectors with fewer components than the longest the missing ones count as zero. Every row is
    indexed; pivots are the at most ``pivots`` different vectors with the smallest hashes, so copies take one place.
    Vectors and queries meet in blocks, of which each gives its ``k`` best.
    """
    rows = materialise(usable(vectors).withColumn("square", _square(F.col("vector"))), "vectors")
    sums = [F.count(F.lit(1)), F.coalesce(F.max("square"), F.lit(1.0)), F.coalesce(F.max(F.size("vector")), F.lit(0))]
    count, square, width = rows.agg(*sums).first()
    # At most ``pivots`` vectors reach the driver.
    hashed = rows.select(F.xxhash64("vector").alias("code"), "vector").dropDuplicates(["code"])
    chosen = [r["vector"] for r in hashed.orderBy("code").limit(pivots).collect()]
    total = len(chosen)
    centres = on_sphere(filled(chosen, width), square)
    prefix, posted = min(PREFIX, total), min(POSTED, total)
    queries = rows.where(is_query).select("row", "vec_id", "vector")
    blocks, parts = max(1, -(-count // BLOCK)), max(1, -(-queries.count() // QUERIES))

    def dealt(side: DataFrame, own: str, number: int, other: str, copies: int) -> DataFrame:
        placed = side.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(number)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "row", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names})
        data, asked = filled(left["vector"], width), filled(right["vector"], width)
        orders = pivot_orders(on_sphere(data, square), centres, prefix)
        lengths = np.sqrt((asked * asked).sum(1, keepdims=True))
        query_orders = pivot_orders(np.column_stack([asked / lengths, np.zeros(len(asked))]), centres, prefix)
        own = left["vec_id"].to_numpy(), left["row"].to_numpy(), data, orders
        found = search_block(*own, right["row"].to_numpy(), asked, query_orders, total, posted, share, k)
        return pd.DataFrame(dict(zip(names, found, strict=True)))

    one = dealt(rows.select("row", "vec_id", "vector"), "block", blocks, "part", parts).groupBy("block", "part")
    two = dealt(queries, "part", parts, "block", blocks).groupBy("block", "part")
    found = one.cogroup(two).applyInPandas(search, "query long, row long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", "rank", "vec_id", "score")
