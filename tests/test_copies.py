"""Large query tables: copies are compared once, and queries travel once per region."""

import numpy as np
import pyarrow as pa
import pytest

from dealflow.operators import cells, knn
from test_vectors import brute, found_ids, frame


@pytest.fixture(scope="module")
def copied():
    rng = np.random.default_rng(8)
    points = np.round(rng.normal(size=(90, 4)), 2)
    return points[np.r_[np.arange(90), rng.integers(0, 6, 210)]].astype(np.float32).astype(np.float64)


def test_copies_on_both_sides(spark, copied, monkeypatch):
    monkeypatch.setattr(knn, "BROADCAST_FLOATS", 16)
    monkeypatch.setattr(cells, "BLOCK_ROWS", 20)
    asked = []
    own = cells.bounded_hits
    monkeypatch.setattr(cells, "bounded_hits", lambda q, *more: asked.append(q.count()) or own(q, *more))
    got = knn.nearest(frame(spark, "query_id", copied), frame(spark, "id", copied), 3)
    assert found_ids(got) == brute(copied, copied, 3)
    assert asked == [90]


def test_first_copies(spark, copied):
    rows = knn.first_copies(frame(spark, "id", copied), 3)
    assert rows.count() == sum(min(3, n) for n in np.unique(copied, axis=0, return_counts=True)[1])
    arrival = np.random.default_rng(9).integers(-1, 300, 300)
    queries, when = copied[:40], np.arange(40) * 7
    got = knn.many_hits(frame(spark, "query_id", queries, when), frame(spark, "id", copied, arrival), 3, 0.4)
    assert found_ids(knn.best_hits(got, None, 3)) == brute(queries, copied, 3, 0.4, when, arrival)
    rising = knn.first_copies(frame(spark, "id", copied, np.arange(300)), 3)
    assert rising.count() == rows.count()


def test_queries_travel_once_per_region(spark, copied, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 50)
    monkeypatch.setattr(cells, "PIECE_VALUES", 64)
    placed = cells.place(knn.usable_vectors(frame(spark, "id", copied[:90]), "id"))
    region = placed.regions()
    assert 1 < region.max() + 1 < len(placed.pivots)
    reach = cells.nearest_cells(placed.pivots, len(placed.pivots))
    sent = cells.spread_queries(frame(spark, "query_id", copied[:9]), reach, region).collect()
    assert len(sent) == 9 * (region.max() + 1)
    assert sorted(c for r in sent if r["query_id"] == 4 for c in r["cells"]) == list(range(len(placed.pivots)))


def test_ties_and_rounding_in_blocks(copied, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_FLOATS", 700)
    monkeypatch.setattr(knn, "WAITING", 50)
    unit = copied / np.linalg.norm(copied, axis=1, keepdims=True)
    best = knn.BestRows(np.arange(50), unit[:50], None, 4, None)
    best.add(np.arange(300), unit)
    rows = pa.Table.from_batches([best.batch()]).to_pydict()
    found = {q: [i for a, i in zip(rows["query_id"], rows["id"], strict=True) if a == q] for q in range(50)}
    assert found == brute(copied[:50], copied, 4)
