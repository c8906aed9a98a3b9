"""The threshold join by leading components against the scan of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealflow.operators import cells, knn, rotation
from dealflow.operators.topk import top_per_group

BELOW, K = 0.15, 3


def tables_of(spark, queries, corpus, seqs=None):
    q = [(i, v.tolist(), i) for i, v in enumerate(queries)]
    c = [(i, v.tolist(), -1 if seqs is None else int(seqs[i])) for i, v in enumerate(corpus)]
    return (
        knn.usable_vectors(spark.createDataFrame(q, "query_id long, embedding array<double>, seq long"), "query_id"),
        knn.usable_vectors(spark.createDataFrame(c, "id long, embedding array<double>, seq long"), "id"),
    )


def best(hits):
    rows = top_per_group(hits, "query_id", [F.col("distance"), F.col("id")], K).collect()
    return sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in rows)


def check(spark, queries, corpus, seqs=None):
    q, c = tables_of(spark, queries, corpus, seqs)
    want = sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in knn.nearest(q, c, K, BELOW).collect())
    assert best(cells.bounded_hits(q, c, K, BELOW)) == want
    return want, q, c


def test_random_vectors_and_copies(spark):
    rng = np.random.default_rng(1)
    corpus = rng.normal(size=(1200, 32))
    queries = np.concatenate([corpus[:200] + rng.normal(size=(200, 32)) * 0.2, rng.normal(size=(200, 32)), corpus[:5], np.zeros((2, 32))])
    want, q, c = check(spark, queries, corpus)
    placed = cells.place(c)
    directions = rotation.leading(rotation.second_moment(c), BELOW)
    assert 0 < directions.shape[1] < 32
    joined = rotation.threshold_join(q, placed, K, BELOW, directions)
    assert len(want) > 190 and joined.crowds.count() == 0
    # Of nearly half a million pairs, few are compared in full.
    assert len({r["query_id"] for r in joined.hits.collect()}) <= joined.pairs.count() < 0.05 * 405 * 1200


def test_counts_of_pairs_leave_a_block_as_a_row_per_query(spark):
    rng = np.random.default_rng(6)
    corpus = rng.normal(size=(900, 32))
    q, c = tables_of(spark, corpus[:300] + rng.normal(size=(300, 32)) * 0.2, corpus)
    joined = rotation.threshold_join(q, cells.place(c), K, BELOW, rotation.leading(rotation.second_moment(c), BELOW))
    assert joined.counts.agg(F.sum("n")).first()[0] == joined.pairs.count() > 300
    # One block of rows meets one of queries.
    assert joined.counts.count() == joined.counts.select("query_id").distinct().count() <= 300


def test_a_third_of_the_rows_are_near_copies(spark):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=24)
    corpus = np.concatenate([hot + rng.normal(size=(400, 24)) * 0.05, np.tile(hot, (100, 1)), rng.normal(size=(800, 24))])
    queries = np.concatenate([hot + rng.normal(size=(60, 24)) * 0.05, corpus[700:720]])
    want, q, c = check(spark, queries, corpus)
    joined = rotation.threshold_join(q, cells.place(c), K, BELOW, rotation.leading(rotation.second_moment(c), BELOW))
    assert joined.crowds.select("query_id").distinct().count() >= 60
    # Copies are met block by block: none of their pairs is listed.
    assert joined.pairs.count() < 2000 and len(want) >= 3 * 60


def test_earlier_rows_only(spark):
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(300, 16))
    check(spark, np.concatenate([corpus, corpus]), corpus, seqs=rng.integers(-1, 600, 300))


@pytest.mark.parametrize("below", [0.5, 1.0, 1.5])
def test_wide_distances(spark, below):
    rng = np.random.default_rng(4)
    q, c = tables_of(spark, rng.normal(size=(40, 8)), rng.normal(size=(200, 8)))
    want = sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in knn.nearest(q, c, K, below).collect())
    assert best(cells.bounded_hits(q, c, K, below)) == want


def test_flat_spectrum_and_empty_tables(spark):
    q, c = tables_of(spark, np.eye(4), np.eye(4))
    assert [(a, b) for a, _, b, _ in best(cells.bounded_hits(q, c, K, BELOW))] == [(i, i) for i in range(4)]
    assert cells.bounded_hits(q, c.limit(0), K, BELOW).count() == 0
    assert cells.bounded_hits(q.limit(0), c, K, BELOW).count() == 0
    one, same = tables_of(spark, np.ones((2, 3)), np.ones((5, 3)))
    assert [r[2] for r in best(cells.bounded_hits(one, same, K, BELOW))] == [0, 1, 2, 0, 1, 2]


def test_a_block_meets_its_queries_in_slices(monkeypatch):
    """Lists and best rows are held for a bounded number of queries, with the hits of the whole block."""
    import pyarrow as pa

    def block(key, **more):
        vectors = np.random.default_rng(len(key)).standard_normal((50, 8)).tolist()
        return pa.table({key: list(range(50)), "embedding": vectors, **more})

    rows = block("id", cell=[i % 3 for i in range(50)])
    asks = block("query_id", cells=pa.array([[0, 2], [1], [0, 1, 2], [], [2]] * 10, pa.list_(pa.int32())))
    held = []
    monkeypatch.setattr(cells, "sides", lambda r, a, *rest, sides=cells.sides: (held.append(a.num_rows), sides(r, a, *rest))[1])
    monkeypatch.setattr(cells, "meet_in_blocks", lambda queries, placed, reach, compare, schema: compare)
    compare, found = cells.cell_hits(None, None, None, 4, None), []
    for most in (100, 7):
        monkeypatch.setattr(cells, "SLICE_QUERIES", most)
        found.append(sorted(compare(rows, asks).to_pydict().items()))
        found[-1] = sorted(zip(*[v for _, v in found[-1]], strict=True))
    assert held == [50] + [7] * 7 + [1]
    assert found[0] == found[1] and len(found[0]) == 4 * 40
    assert compare(rows, asks.slice(0, 0)).num_rows == 0


def test_all_that_is_compared_is_counted(spark, tmp_path):
    """Of 60 copies of one vector every pair is compared, though none is listed one by one."""
    from checks.queries import QUERIES

    vectors = spark.createDataFrame([(i, [0.0, 1.0] + [0.0] * 6) for i in range(60)], "vec_id long, embedding array<float>")
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in QUERIES["semantic_duplicates_pairs"](spark, str(tmp_path)).collect()] == [(60, False)]


def test_pairs_leave_a_block_as_they_are_found(spark, monkeypatch):
    """All pairs are listed, and no batch holds more than one step of the comparison."""
    rng = np.random.default_rng(7)
    corpus = rng.normal(size=(400, 16))
    q, c = tables_of(spark, corpus[:200] + rng.normal(size=(200, 16)) * 0.2, corpus)
    made = []
    monkeypatch.setattr(rotation, "list_in_blocks", lambda asked, placed, reach, compare, schema: made.append(compare))
    placed = cells.place(c)
    joined = rotation.threshold_join(q, placed, K, 0.6, rotation.leading(rotation.second_moment(c), 0.6), many=10**6)
    monkeypatch.undo()
    whole = cells.list_in_blocks(q.withColumn("far", F.lit(0.6)), placed, cells.within_reach(placed.pivots, placed.low, placed.high), made[0], "query_id long, id long")
    listed = {tuple(r) for r in whole.collect()}
    assert len(listed) == whole.count() == joined.counts.agg(F.sum("n")).first()[0]
    monkeypatch.setattr(rotation, "BLOCK_FLOATS", 100)
    import pyarrow as pa

    rows = pa.table({"id": list(range(400)), "embedding": corpus.tolist(), "cell": [i % 4 for i in range(400)], "block": [0] * 400})
    asks = pa.table({"query_id": list(range(200)), "embedding": corpus[:200].tolist(), "cells": pa.array([[0, 1, 2, 3]] * 200, pa.list_(pa.int32()))})
    batches = list(made[0](rows, asks))
    assert len(batches) == 4 * 200 and max(b.num_rows for b in batches) <= 100
