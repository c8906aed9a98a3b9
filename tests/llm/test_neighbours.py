import numpy as np
import pytest
from pyspark.sql import functions as F

from dealflow.llm import neighbours
from dealflow.llm.queries import QUERIES


def exact(rows, is_query, k=20):
    ids = np.array([i for i, _ in rows])
    data = np.array([v for _, v in rows], np.float64)
    out = {}
    for q in np.flatnonzero([is_query(i) for i in ids]):
        scores = data @ data[q]
        scores[q] = -np.inf
        best = np.lexsort((ids, -scores))[: min(k, len(ids) - 1)]
        out[int(ids[q])] = [(int(ids[b]), float(scores[b])) for b in best]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_scores(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = exact(rows, lambda i: i % 20 == 0)
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    found = {}
    for r in QUERIES["op4_neighbours"](spark, f"/root/testdata/{sf}").orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(found[r["query_id"]]) and r["vec_id"] != r["query_id"]
        assert abs(r["score"] - vectors[r["query_id"]] @ vectors[r["vec_id"]]) < 1e-12
    assert found.keys() == want.keys() and {len(f) for f in found.values()} == {20}
    hits = sum(len({i for i, _ in want[q]} & set(found[q])) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_vectors_of_unequal_length_keep_recall(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=16) * rng.lognormal()).tolist()) for i in range(1500)]
    want = exact(rows, lambda i: i % 50 == 0)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len({i for i, _ in want[q]} & found[q]) for q in want) / (20 * len(want)) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]),
        (7, [nan, 1.0]), (8, [inf, 1.0]), (None, [1.0, 1.0]), (40, None),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"row": F.lit(1), "vector": F.lit(1), "block": F.lit(2)})
    found = sorted(tuple(r) for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0).collect())
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 0, 0.0)]
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_ids_and_unequal_widths_are_all_candidates(spark):
    rows = [(0, [1.0, 0.0]), (0, [3.0, 1.0]), (1, [2.0, 1.0]), (1, [2.0, 5.0]), (2, [4.0, 0.0, 7.0]), (3, [-1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in neighbours.nearest(table, F.col("vec_id") == 0).collect())
    one = [(0, 1, 2, 4.0), (0, 2, 0, 3.0), (0, 3, 1, 2.0), (0, 4, 1, 2.0), (0, 5, 3, -1.0)]
    two = [(0, 1, 2, 12.0), (0, 2, 1, 11.0), (0, 3, 1, 7.0), (0, 4, 0, 3.0), (0, 5, 3, -3.0)]
    assert found == sorted(one + two)


@pytest.mark.parametrize("kind", ["cluster", "equal", "far"])
def test_recall_with_a_hot_cluster_equal_vectors_and_far_queries(spark, kind):
    """Several blocks; a third of the rows and more lie in one place, or the queries lie far from all others."""
    rng = np.random.default_rng(7)
    data = rng.normal(size=(9000, 24))
    if kind == "cluster":
        data[:4000] = data[0] + 0.02 * data[:4000]
    elif kind == "equal":
        data[:6000] = data[0]
    else:
        data[::90] = 5.0 + 0.01 * data[::90]
    order = rng.permutation(9000)
    rows = [(int(i), v.tolist()) for i, v in zip(order, data, strict=True)]
    asked = {int(i) for i in (order[::90] if kind == "far" else order[::45])}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(table, F.col("vec_id").isin(sorted(asked))).collect():
        found.setdefault(r["query_id"], []).append(r["score"])
    want = exact(rows, asked.__contains__)
    assert found.keys() == want.keys() and {len(f) for f in found.values()} == {20}
    # By score, since many candidates are equally near.
    hits = sum(sum(s >= want[q][-1][1] - 1e-9 for s in found[q]) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_many_equal_vectors_tie_to_the_smallest_ids(spark):
    table = spark.range(9000).select(F.col("id").alias("vec_id"), F.expr("array(1D, 1D, id % 3 / 100D)").alias("embedding"))
    found = [r["vec_id"] for r in neighbours.nearest(table, F.col("vec_id") == 2).orderBy("rank").collect()]
    assert found == [5 + 3 * i for i in range(20)]
