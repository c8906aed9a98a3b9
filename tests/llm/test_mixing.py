from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from dealflow.llm import mixing
from dealflow.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, source string"


def check(docs, rows, slack):
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(brute.WORD.findall(text or ""))
    target, taken = brute.targets(dict(sizes)), Counter()
    size = {i: len(brute.WORD.findall(t or "")) for i, t, _ in docs}
    source = {i: s for i, _, s in docs}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= slack + 0.002 * sum(sizes.values()), s


def test_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = QUERIES["op7_mixing"](spark, sf).collect()
    check(docs, rows, 10)
    assert sorted(rows) == sorted(QUERIES["op7_mixing"](spark, sf).collect())


def test_odd_rows(spark):
    docs = [(i, "w " * (i % 7), ["a", "B", None, "é", "tiny"][i % 5 if i else 4]) for i in range(200) if i % 5 < 4 or i == 4]
    docs += [(500, None, "a"), (501, "", "empty"), (502, "long " * 30_000, "z")]
    table = spark.createDataFrame(docs, SCHEMA).withColumns({"size": F.lit("x"), "place": F.lit(1), "taken": F.lit(2), "copies": F.lit(3)})
    check(docs, mixing.mix(table).collect(), 10)
    assert mixing.mix(table.limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(spark.createDataFrame([(1, None, None)], SCHEMA)).collect()] == [0]
    same = mixing.mix(spark.createDataFrame([(1, "a b", "s")] * 3 + [(None, "c", "s")] * 2, SCHEMA)).collect()
    assert len(same) == 5 and sum(r["taken"] for r in same) == 8


def test_the_mix_itself_has_the_words_that_are_taken(spark):
    docs = [(i, " ".join(f"w{k}" for k in range(i % 90)), f"s{i * i % 4}") for i in range(300)] + [(1, None, "s1"), (7, "x y", "s1"), (7, "x y", "s1")]
    table = spark.createDataFrame(docs, SCHEMA).withColumn("extra", F.lit(5))
    rows, mixed = mixing.mix(table).collect(), mixing.take(table)
    assert mixed.columns == table.columns
    want, got = Counter(), Counter()
    for r in rows:
        want[r["doc_id"]] += r["taken"]
    for r in mixed.collect():
        words = r["text"].split()
        assert any(words == t.split()[: len(words)] for i, t, _ in docs if i == r["doc_id"] and t)
        got[r["doc_id"]] += len(words)
    assert got == +want


def test_any_stretch_of_the_schedule_is_balanced(spark):
    sizes = spark.createDataFrame([("a", 9000), ("b", 9000), ("c", 9000)], "source string, source_size long")
    slots = mixing.schedule(mixing.cut_sources(mixing.source_targets(sizes), 9)).orderBy("slot").collect()
    for begin in range(0, len(slots) - 400, 400):
        share = Counter(r["place"] for r in slots[begin : begin + 400])
        assert abs(share[0] - 250) <= 6 and abs(share[1] - 100) <= 6 and abs(share[2] - 50) <= 6
