"""Sources that are small beside a block."""

from collections import Counter

import pytest

from dealflow.llm import mixing


def test_small_sources_reach_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "block_words", lambda total: 4096)
    docs = [(i, "w " * 50, "b") for i in range(10)] + [(100 + i, "w " * 600, "d") for i in range(10)]
    docs += [(1000 + i, "w " * 90_000, "a") for i in range(50)] + [(99, "w w w w w", "e"), (98, "w", "f"), (97, "", "g"), (96, None, None)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in rows:
        name = {99: "e", 98: "f", 97: "g", 96: "null"}.get(r["doc_id"]) or "b" if r["doc_id"] < 100 else "d" if r["doc_id"] < 1000 else "a"
        taken[name] += r["taken"]
        target[name] = r["target"]
        assert r["taken"] == sum(r["copies"]) <= 3 * r["size"]
    assert (taken["e"], taken["f"], taken["g"], taken["null"]) == (15, 3, 0, 0)
    assert target["b"] == 1500 and target["d"] == 18_000
    for name in "abd":
        assert taken[name] == pytest.approx(target[name], rel=0.004)


@pytest.mark.parametrize("size", [1, 7, 999, 1000, 1001, 40_949, 40_950, 50_000])
def test_blocks_cover_a_source_once(spark, size):
    """On both sides of the size from which a block is a whole number of words."""
    sources = spark.createDataFrame([("a", size), ("b", 10 * size)], "source string, source_size long")
    cut = mixing.cut_sources(mixing.source_targets(sources), 41).where("source = 'a'")
    row = cut.first()
    assert row["blocks"] >= 1000 or row["per"] == 41
    docs, at = [], 0
    while at < size:
        docs.append((at, min(size - at, 1 + at % 97)))
        at += docs[-1][1]
    placed = spark.createDataFrame(docs, "start long, size long").crossJoin(cut.select("place", "per", "of"))
    got = mixing.fragments(placed).groupBy("block").agg({"words": "sum"}).collect()
    assert sum(r[1] for r in got) == size and max(r[1] for r in got) <= row["per"] / row["of"] + 1
    assert min(r["block"] for r in got) >= 0 and max(r["block"] for r in got) < row["blocks"]
