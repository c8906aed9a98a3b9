"""A bucket with many rows is written, and merged, by several tasks."""

import os

from pyspark.sql import functions as F

from dealflow.operators.upsert import normalise_records
from dealflow.sources import buckets
from dealflow.sources.buckets import BucketStore


def test_large_buckets_are_dealt_to_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "PART_ROWS", 50)
    own = BucketStore(spark, str(tmp_path / "large"), buckets=2)
    rows = spark.range(600).select("id", F.concat(F.lit("https://e.org/"), F.col("id")).alias("url"), F.lit("t").alias("title"))
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1024"}
    for name, value in sizes.items():
        spark.conf.set(name, value)
    try:
        own.write(rows.repartition(16))
    finally:
        for name in sizes:
            spark.conf.unset(name)
    files = lambda: {b: len([f for f in os.listdir(f"{own._folder(own.versions()[-1], b)}") if f.endswith(".parquet")]) for b in (0, 1)}
    assert min(files().values()) > 1
    seen = rows.select(F.col("id").alias("seq"), "url", F.lit("u").alias("title"))
    own.merge(normalise_records(seen))
    assert min(files().values()) > 1
    after = own.read().select("id", "url", "title").collect()
    assert sorted(map(tuple, after)) == [(i, f"https://e.org/{i}", "u") for i in range(600)]


def test_many_rows_are_merged_in_turns(spark, tmp_path, monkeypatch):
    """Some buckets at a time, with the rows of a merge at once; neither shuffle files nor the stored batch stay."""
    from pathlib import Path

    from dealflow import session

    def left():
        root = spark._jvm.org.apache.spark.util.Utils.getConfiguredLocalDirs(spark._jsc.sc().conf())
        return {f.name.split("_")[1] for at in root for f in Path(at).glob("blockmgr-*/*/shuffle_*")}

    def listed(step):
        rows = spark.range(900).select((F.col("id") * step).alias("id"), F.concat(F.lit("u"), F.col("id") * step).alias("url"), F.lit(f"t{step}").alias("title"))
        return rows.repartition(3)

    paths, own = [], session.work_path
    monkeypatch.setattr(session, "work_path", lambda *a: paths.append(own(*a)) or paths[-1])
    found, made = [], []
    for turn_rows in (10**6, 500):
        monkeypatch.setattr(buckets, "TURN_ROWS", turn_rows)
        store = BucketStore(spark, str(tmp_path / f"turns{turn_rows}"), buckets=8)
        before = left()
        store.write(listed(1))
        stored = []
        monkeypatch.setattr(store, "_store", lambda *a, own=store._store, stored=stored, **b: stored.append(own(*a, **b)) or stored[-1])
        store.merge(normalise_records(listed(2).withColumnRenamed("id", "seq").withColumn("url", F.when(F.col("seq") % 97 > 0, F.col("url")))), "2024-01-01")
        assert len(left() - before) <= 3  # of the counts and the list of buckets
        assert store.manifest().buckets == {b: [2] for b in range(8)} and sorted(b for some, _ in stored for b in some) == list(range(8))
        made.append((len(stored), store.manifest().largest))
        found.append(sorted(map(str, store.read().select("id", "url", "title", "last_seen_date").collect())))
    # 900 stored rows and as many in the batch.
    assert [n for n, _ in made] == [1, 4] and made[0][1] == made[1][1] > 1798
    assert found[0] == found[1] and len(found[0]) > 1300
    assert len(paths) == 2 and not [p for p in paths if Path(p.removeprefix("file:")).exists()]
