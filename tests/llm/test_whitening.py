import numpy as np
import pytest
from pyspark.sql import functions as F

from dealflow.llm import whitening
from dealflow.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, most=4):
    """``{(id, component): values}`` by a singular value decomposition of the centred vectors."""
    width = max(len(v) for _, v in rows)
    x = np.array([[int(np.floor(256 * c)) for c in v] + [0] * (width - len(v)) for _, v in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = fit - sums / n
    _, spread, vectors = np.linalg.svd(c, full_matrices=False)
    values, vectors = spread**2 / n, vectors.T
    found = {}
    for (i, _), own in zip(rows, x, strict=True):
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(own, sums, strict=True))
        deviation = deviation if deviation < 1 << 63 else None
        for k in range(min(most, len(spread))):
            if spread[k] > 1e-12 * spread[0]:
                whitened = (own - sums / n) @ vectors[:, k] / np.sqrt(values[k])
                found[i, k + 1] = (n, deviation, abs(whitened), values[k] / values.sum())
    return found


def check(rows, found, close=1e-7):
    want = plain(rows)
    assert len(found) == len(want)
    for r in found:
        n, deviation, whitened, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation) and r["identity_error"] < 1e-4
        assert abs(abs(r["whitened"]) - whitened) < close and abs(r["explained"] / explained - 1) < 1e-4


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_equals_eigenvectors(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = QUERIES["op12_whitening"](spark, f"/root/testdata/{sf}").collect()
    check(rows, found)
    by_component = {}
    for r in sorted(found, key=lambda r: (r["vec_id"], r["component"])):
        by_component.setdefault(r["component"], []).append(r["whitened"])
    own = {i: v for i, v in rows}
    ids = sorted(own)
    x = np.floor(256 * np.array([own[i] for i in ids], np.float64))
    fit = np.unique(x, axis=0)
    c = x - fit.mean(0)
    for k, whitened in by_component.items():
        # One sign for all rows: the component is a linear map of the rows.
        axis = np.linalg.lstsq(c, np.array(whitened), rcond=None)[0]
        assert np.abs(c @ axis - whitened).max() < 1e-8, k


def test_ill_conditioned_and_dependent_dimensions(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 3)) * [1e6, 1, 1e-2]
    data = np.column_stack([base, base[:, 0], np.full(400, 7.0), base[:, :1] * 2])
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    check(rows, whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), 1e-5)


def test_components_of_small_spread_beside_large_ones(spark):
    """The accuracy is that of the vectors: a spread of 1e-6 of the largest is still found."""
    rng = np.random.default_rng(6)
    data = rng.normal(size=(500, 3)) * [1e8, 1e4, 1e2]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in found} == {1, 2, 3} and found[0]["identity_error"] < 1e-8


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, -0.001]), (2, [0.5, 2.0, 0.0]), (2, [0.5, 2.0, 0.0]), (None, [3.0, -1.0, 0.25]), (4, [1.0]), (5, []), (6, [0.0, 0.0, 0.0])]
    bad = [(7, None), (8, [1.0, None]), (9, [nan]), (10, [inf, 1.0, 1.0]), (11, [-inf])]
    table = spark.createDataFrame(good + bad, SCHEMA).withColumns({"x": F.lit(1), "n": F.lit("a"), "component": F.lit(0)})
    found = whitening.whiten(table).collect()
    want = plain(good)
    assert len(found) == sum(1 for i, _ in good for c in range(1, 5) if (i, c) in want)
    assert {(r["vec_id"], r["component"]) for r in found} == set(want) and found[0]["n"] == 5
    assert all(r["deviation"] == want[r["vec_id"], r["component"]][1] for r in found)
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table.where("vec_id = 2")).count() == 0  # one distinct vector has no spread
    assert whitening.whiten(table.where("vec_id = 5")).count() == 0


def test_entries_beyond_a_long(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"]: r["deviation"] for r in found}[1] is None
    assert all(np.isfinite(r["whitened"]) for r in found)


def test_copies_are_fitted_once(spark):
    once = [(i, [float(i % 7), float(i % 5), float(i * i % 11)]) for i in range(70)]
    many = once + [(1000 + i, once[0][1]) for i in range(5000)]
    check(many, whitening.whiten(spark.createDataFrame(many, SCHEMA)).collect())


@pytest.mark.parametrize("n", [3, 1 << 40])
def test_deviations_are_exact(n):
    x, sums = np.array([[5, -7], [0, 1 << 30]]), [11, -(1 << 35)]
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x, n, sums) == [w if w < 1 << 63 else None for w in want]
