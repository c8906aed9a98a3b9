import numpy as np
import pytest
from pyspark.sql import functions as F

from dealflow.operators import cells, ivf, knn, search
from dealflow.operators.embed import embedding_backfill, embedding_backlog, hashing_embedder
from dealflow.operators.filters import ListingFilter
from dealflow.operators.topk import top_per_group
from dealflow.plans.search import search as search_request
from helpers import listings, plan_of


def frame(spark, key, vectors, seqs=None):
    rows = [(i, [float(x) for x in v]) + (() if seqs is None else (int(seqs[i]),)) for i, v in enumerate(vectors)]
    schema = f"{key} long, embedding array<float>" + ("" if seqs is None else ", seq long")
    return spark.createDataFrame(rows, schema)


def brute(queries, corpus, k, below=np.inf, query_seq=None, corpus_seq=None):
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    c = corpus / np.linalg.norm(corpus, axis=1, keepdims=True)
    distance = np.clip(1 - q @ c.T, 0, 2).round(12)
    found = {}
    for i, row in enumerate(distance):
        seen = [
            (d, j) for j, d in enumerate(row)
            if d < below and (query_seq is None or corpus_seq[j] < query_seq[i])
        ]
        found[i] = [j for _, j in sorted(seen)[:k]]
    return {i: f for i, f in found.items() if f}


def found_ids(df):
    rows = df.collect()
    best = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        best.setdefault(r["query_id"], []).append(r["id"])
    return best


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    points = np.repeat(centres, 60, axis=0) + rng.normal(scale=0.25, size=(720, 16))
    points[:240] = points[0]  # a third of the corpus are copies of one vector
    return points.astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("below", [None, 0.15])
@pytest.mark.parametrize("way", ["scan", "cells"])
def test_nearest_equals_brute_force(spark, clustered, monkeypatch, below, way):
    queries = clustered[::5]
    if way == "cells":
        monkeypatch.setattr(knn, "BROADCAST_FLOATS", 16 * 10)
        monkeypatch.setattr(cells, "BLOCK_ROWS", 50)
        monkeypatch.setattr(cells, "MOST_PIVOTS", 9)
    monkeypatch.setattr(knn, "BLOCK_FLOATS", 5000)
    got = knn.nearest(frame(spark, "query_id", queries), frame(spark, "id", clustered).repartition(5), 7, below)
    assert ("FlatMapCoGroups" in plan_of(got)) == (way == "cells")
    assert found_ids(got) == brute(queries, clustered, 7, np.inf if below is None else below)


@pytest.mark.parametrize("way", ["scan", "cells"])
def test_only_earlier_rows_are_seen(spark, clustered, monkeypatch, way):
    if way == "cells":
        monkeypatch.setattr(knn, "BROADCAST_FLOATS", 16 * 10)
        monkeypatch.setattr(cells, "BLOCK_ROWS", 64)
    queries, query_seq = clustered[:100], np.arange(100)
    corpus_seq = np.where(np.arange(720) % 4 == 0, -1, np.arange(720))
    got = knn.nearest(frame(spark, "query_id", queries, query_seq), frame(spark, "id", clustered, corpus_seq), 5, 0.3)
    assert found_ids(got) == brute(queries, clustered, 5, 0.3, query_seq, corpus_seq)


def test_cells_that_cannot_match_are_skipped(spark, clustered):
    pivots = np.unique(clustered[::40] / np.linalg.norm(clustered[::40], axis=1, keepdims=True), axis=0)
    gap = cells.gaps(clustered / np.linalg.norm(clustered, axis=1, keepdims=True), pivots)
    home = gap.argmin(axis=1)
    low = np.array([gap[home == c, c].min(initial=np.inf) for c in range(len(pivots))])
    high = np.array([gap[home == c, c].max(initial=-np.inf) for c in range(len(pivots))])
    queries = clustered / np.linalg.norm(clustered, axis=1, keepdims=True)
    reach = cells.within_reach(pivots, low, high)(queries, np.full(len(queries), 0.02))
    assert reach.mean() < 0.4
    near = (1 - queries @ queries.T) <= 0.02
    rows, others = np.nonzero(near)
    assert reach[rows, home[others]].all()


def test_empty_and_zero_vectors(spark):
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0, 0.0])], "id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert found_ids(knn.nearest(queries, corpus, 3)) == {1: [4]}
    assert found_ids(knn.nearest(queries.limit(0), corpus, 3)) == {}
    assert found_ids(knn.nearest(queries, corpus.limit(0), 3)) == {}


def test_hits_are_looked_up_by_broadcast(spark, tmp_path):
    path = str(tmp_path / "t")
    listings(spark, {"description_embedding": [1.0, 0.0]}).write.parquet(path)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(search.semantic_candidates(spark.read.parquet(path), queries))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [id" in plan and "SortMergeJoin" not in plan


def test_sliced_top_k_is_the_same(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"), "id").repartition(9)
    order = [F.col("v").desc(), F.col("id").asc()]
    one, many = (sorted(map(tuple, top_per_group(df, "g", order, 20, slices=s).collect())) for s in (1, 4))
    assert one == many and len(one) == 60


def test_ivf_recall(spark, clustered, tmp_path, monkeypatch):
    index = ivf.build_index(frame(spark, "id", clustered), str(tmp_path / "ivf"), lists=12)
    queries = frame(spark, "query_id", clustered[::6])
    some = found_ids(ivf.ivf_nearest(spark, index, queries, 5, probes=4))
    every = found_ids(ivf.ivf_nearest(spark, index, queries, 5, probes=12))
    plan = plan_of(ivf.ivf_nearest(spark, index, queries.limit(1), 5, probes=2))
    assert "PartitionFilters: [cell" in plan and "FlatMapCoGroups" not in plan
    with monkeypatch.context() as patch:
        patch.setattr(knn, "BROADCAST_FLOATS", 16 * 10)
        assert found_ids(ivf.ivf_nearest(spark, index, queries, 5, probes=4)) == some
    exact = brute(clustered[::6], clustered, 5)
    assert every == exact
    hits = [len(set(some[q]) & set(exact[q])) / 5 for q in exact]
    assert np.mean(hits) >= 0.9


def test_search_patterns():
    assert search.like_pattern("50%_a") == "%50%_a%"
    assert search.like_pattern(r"a\bc\%d\\") == r"%abc\%d\\%"
    assert search.like_pattern("end\\") == r"%end\%"


def test_text_search(spark):
    df = listings(spark, {"title": "Car WASH"}, {"city": "washington"}, {"title": "100% off"}, {"description": None}, {"state": "w_h"})

    def ids(q, **more):
        return [r["id"] for r in search.text_search(df, q, **more).collect()]

    assert ids("wash") == [1, 2]
    assert ids("w_h") == [5]
    assert ids(r"0\%") == [3]
    assert ids("hvac", limit=1) == [2]
    assert ids("hvac", filters=ListingFilter(city="washington")) == [2]
    many = search.text_search_many(df, {7: "wash", 8: "off", 9: "zzz"}, limit=1).collect()
    assert {(r["query_id"], r["id"]) for r in many} == {(7, 1), (8, 3)}


VECTORS = [[1.0, 0.0], [0.9, 0.1], [0.6, 0.8], [0.0, 1.0], None]


def searchable(spark):
    words = ["alpha", "beta gamma", "gamma delta words", "delta", "none"]
    return listings(spark, *[{"description_embedding": v, "description": w} for v, w in zip(VECTORS, words)])


def question(spark, text="find gamma words"):
    return spark.createDataFrame([(1, text, [1.0, 0.0])], "query_id long, text string, embedding array<float>")


def test_semantic_search(spark):
    plain = search.semantic_search(searchable(spark), question(spark), rerank=False).orderBy("position").collect()
    assert [(r["id"], r["similarity_score"]) for r in plain] == [(1, 1.0), (2, 0.9939), (3, 0.6)]
    near = search.semantic_search(searchable(spark), question(spark), threshold=0.0, rerank=False).collect()
    assert [r["id"] for r in near] == [1]
    ranked = search.semantic_search(searchable(spark), question(spark)).orderBy("position").collect()
    assert [r["id"] for r in ranked] == [3, 2, 1]
    assert ranked[0]["similarity_score"] == round(0.4 * 0.6 + 0.6 * 2 / 3, 4)
    cut = search.semantic_search(searchable(spark), question(spark), limit=1, rerank_top=2).orderBy("position").collect()
    assert [r["id"] for r in cut] == [2]


def test_index_candidates(spark, tmp_path):
    df = searchable(spark)
    corpus = df.select("id", F.col("description_embedding").alias("embedding"))
    index = ivf.build_index(corpus, str(tmp_path / "ivf"), lists=2)
    hits = ivf.ivf_nearest(spark, index, question(spark), search.NO_CEILING.fetch(20), probes=2)
    found = search.semantic_search(df, question(spark), hits=hits).orderBy("position").collect()
    assert [r["id"] for r in found] == [3, 2, 1]
    with pytest.raises(ValueError):
        search.semantic_search(df, question(spark), hits=hits, filters=ListingFilter(state="CA"))


def test_rerank_model(spark):
    def shortest(query, passages):
        return [1.0 / len(p) for p in passages]

    def run(model):
        return [r["id"] for r in search.semantic_search(searchable(spark), question(spark), rerank_fn=model).orderBy("position").collect()]

    assert run(shortest) == [1, 2, 3]
    assert run(lambda q, p: [1.0]) == [1, 2, 3]
    assert run(lambda q, p: 1 / 0) == [1, 2, 3]
    assert run(lambda q, p: [float(i) for i in range(len(p))]) == [3, 2, 1]


def test_dispatch(spark):
    df = searchable(spark)
    assert search_request(df, "two words", hashing_embedder(2)).method == "text"
    fallback = search_request(df, "gamma delta words", lambda t: 1 / 0)
    assert (fallback.method, fallback.total) == ("text (embedding fallback)", 1)
    assert search_request(df, "gamma delta words", lambda t: [[]]).total == 0
    found = search_request(df, "gamma delta words", lambda t: [[1.0, 0.0]])
    assert found.method == "semantic + rerank" and [r["id"] for r in found.data.collect()] == [3, 2, 1]
    free, bound = search.NO_CEILING, search.SearchBudget(fetch_most=120, rerank_most=40)
    assert [free.fetch(n) for n in (20, 5, 100)] == [40, 30, 200] and bound.fetch(100) == 120
    assert free.depth(100, 20) == 100 and bound.depth(100, 20) == 40


def test_backfill(spark):
    df = listings(spark, {"description_embedding": [9.0]}, {}, {"description": None}, {"description": "N/A"}, {"description": "x" * 9000})
    assert [r["id"] for r in embedding_backlog(df, 2).collect()] == [2, 3]

    def lengths(texts):
        return [[float(len(t)), float(len(texts))] for t in texts]

    def filled(**more):
        out = embedding_backfill(df.coalesce(1), lengths, retry_wait=0.0, **more).orderBy("id").collect()
        return [r["description_embedding"] for r in out]

    assert filled() == [[9.0], [9.0, 4.0], [0.0, 4.0], [3.0, 4.0], [9000.0, 4.0]]
    assert filled(batch_rows=3) == [[9.0], [9.0, 3.0], [0.0, 3.0], [3.0, 3.0], [9000.0, 1.0]]
    assert filled(chars=8000)[4] == [8000.0, 4.0]
    assert filled(limit=1) == [[9.0], [9.0, 1.0], None, None, None]
    assert filled(skip_na=True) == [[9.0], [9.0, 2.0], None, None, [9000.0, 2.0]]
    assert "Exchange" not in plan_of(embedding_backfill(df, lengths))


def test_backfill_repeats_a_failed_call_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def flaky(texts):
        with open(calls, "a") as f:
            f.write("x")
        with open(calls) as f:
            if len(f.read()) == 1:
                raise RuntimeError("busy")
        return [[1.0]] * len(texts)

    df = listings(spark, {}, {}).coalesce(1)
    assert [r[0] for r in embedding_backfill(df, flaky, retry_wait=0.0).select("description_embedding").collect()] == [[1.0]] * 2
    broken = embedding_backfill(df, lambda t: 1 / 0, retry_wait=0.0).select("description_embedding").collect()
    assert [r[0] for r in broken] == [None, None]
