import zlib

import pytest
from pyspark.sql import functions as F

from dealflow.llm import sharding
from dealflow.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string"


def plain_tree(rows, shards):
    """The k-d tree by sorting: ``rows`` are (axes, text code, row code, size); the rows of each shard by row code."""
    whole = [max(max(r[0][a] for r in rows) - min(r[0][a] for r in rows), 1) for a in range(len(rows[0][0]))] if rows else []

    def cut(box, k):
        if k == 1 or not box:
            return [sorted(r[2] for r in box)] + [[]] * (k - 1)
        width = [(max(r[0][a] for r in box) - min(r[0][a] for r in box)) / whole[a] for a in range(len(whole))]
        axis = width.index(max(width))
        box = sorted(box, key=lambda r: (r[0][axis], r[1], r[2]))
        target, below, at = sum(r[3] for r in box) * (k // 2) / k, 0, 0
        while at < len(box) - 1 and below + box[at][3] < target:
            below, at = below + box[at][3], at + 1
        at += below + box[at][3] - target <= target - below
        return cut(box[:at], k // 2) + cut(box[at:], k - k // 2)

    return cut(rows, shards)


def check(docs, shards=40):
    rows = sharding.measured(docs, ["doc_id"])
    own = [(r["axes"], r["text_code"], r["row_code"], r["size"]) for r in rows.collect()]
    levels = sharding.tree(rows, shards)
    found = {}
    for r in sharding._assigned(rows, levels).collect():
        found.setdefault(r["shard"], []).append(r["row_code"])
    want = plain_tree(own, shards)
    assert len(want) == shards
    assert {s: sorted(v) for s, v in found.items()} == {s: v for s, v in enumerate(want) if v}


def test_tree_equals_plain_sorting(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize("shards", [1, 2, 7])
def test_ties_and_copies_equal_plain_sorting(spark, shards):
    rows = [(i % 5, ["same text", "x", None, ""][i % 4], "en", ["a", None][i % 3 == 0]) for i in range(300)]
    check(spark.createDataFrame(rows, SCHEMA), shards)


def test_query_returns_every_document_once(spark):
    found = QUERIES["op11_sharding"](spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    slots = {}
    for r in found:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(40)) and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_near_equal(spark):
    found = QUERIES["op11_sharding"](spark, "/root/testdata/sf0.1")
    sizes = [r["size"] for r in found.groupBy("shard").agg(F.sum("size").alias("size")).collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) < found.agg(F.max("size")).first()[0]


def test_odd_rows(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert sharding.assign(nothing).count() == 0
    odd = [(None, None, None, None), (1, "", "de", None), (1, "", "de", None), (2, "é", None, "s"), (3, "w " * 50_000, "de", "s")]
    docs = spark.createDataFrame(odd, SCHEMA).withColumns({"size": F.lit("x"), "shard": F.lit(7), "row": F.lit(0), "axes": F.lit(1)})
    found = sharding.assign(docs, shards=3).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in found) == [("1", 16), ("1", 16), ("2", 18), ("3", 100_016), ("None", 16)]
    assert sharding.assign(docs.select("doc_id", "text"), shards=2).count() == 5
    with pytest.raises(ValueError):
        sharding.assign(docs, shards=1 << 20)


def test_hot_text_is_split_evenly(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, 'copy', repeat('a', int(id % 40)))").alias("text"))
    sizes = [r["s"] for r in sharding.assign(docs, shards=8).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 56


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("shard", F.lit(99))
    sharding.write(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.drop("shard").collect()) == sorted(docs.drop("shard").select(back.drop("shard").columns).collect())
    sizes = {r["shard"]: r["s"] for r in back.groupBy("shard").agg(F.sum(F.octet_length("text") + 16).alias("s")).collect()}
    plan = sharding.assign(docs, shards=5).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert sizes == {r["shard"]: r["s"] for r in plan}
    assert len(list((tmp_path / "out").glob("shard=*/*.parquet"))) == 5
    assert sharding.shards_of(docs, 100_000) == round(sum(sizes.values()) / 100_000)
