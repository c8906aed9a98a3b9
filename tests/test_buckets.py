"""The bucket store: only touched buckets are written, and the result is that of a merge of the whole table."""

import pytest
from pyspark.sql import functions as F

from dealflow.operators.upsert import normalise_records, upsert
from dealflow.sources.buckets import BucketStore
from helpers import AS_OF, by_url, listings, plan_of, records


def numbered(spark, urls, **changes):
    return normalise_records(records(spark, *[{"url": u, "title": f"t{i}"} | changes for i, u in enumerate(urls)]))


@pytest.fixture
def store(spark, tmp_path):
    made = BucketStore(spark, str(tmp_path / "t"), buckets=64)
    made.write(listings(spark, *[{"url": f"u{i}"} for i in range(300)]))
    return made


def urls_in(store, buckets):
    urls = [f"u{i}" for i in range(300)]
    df = store.spark.createDataFrame([(u,) for u in urls], "url string").withColumn("b", store.bucket_of("url"))
    return [r["url"] for r in df.where(F.col("b").isin(buckets)).orderBy("url").collect()]


def files_of(store, version):
    fs, path = store._files(store._folder(version))
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if "=" in s.getPath().getName())


def test_a_merge_writes_the_touched_buckets_only(spark, store, tmp_path):
    chosen = sorted(store.manifest().buckets)[5:8]
    batch = numbered(spark, [*urls_in(store, chosen), *urls_in(store, chosen)[:4]], price="$5")
    want = by_url(upsert(store.read(), batch, AS_OF))
    version = store.merge(batch, AS_OF)
    assert files_of(store, version) == chosen and store.touched(batch) == chosen
    assert all(len(list((tmp_path / "t" / "data" / f"version={version}" / f"bucket={b}").glob("*.parquet"))) == 1 for b in chosen)
    assert by_url(store.read()) == want
    found = store.manifest()
    assert {b for b, v in found.buckets.items() if v == [version]} == set(chosen)


def test_new_urls_get_ids_beyond_all_buckets(spark, store):
    store.merge(numbered(spark, ["new1", "u3", "new2"]), AS_OF)
    rows = by_url(store.read())
    assert len(rows) == 302 and rows["u3"]["id"] == 4 and (rows["new1"]["id"], rows["new2"]["id"]) == (301, 303)
    store.merge(numbered(spark, ["new3"]), AS_OF)
    assert by_url(store.read())["new3"]["id"] == 304


def test_merges_equal_those_of_the_whole_table(spark, store):
    whole = store.read()
    for step in range(3):
        batch = numbered(spark, [f"u{i * 7 % 400}" for i in range(step * 20, step * 20 + 30)], price=f"${step}")
        whole = upsert(whole, batch, AS_OF)
        store.merge(batch, AS_OF)
    assert by_url(store.read()) == by_url(whole)


def test_added_rows_are_further_files_and_merge_into_one(spark, store):
    extra = listings(spark, {"url": "a1"}, {"url": "a2"}).withColumn("id", F.col("id") + 1000)
    version = store.add(extra)
    assert store.read().count() == 302 and len(files_of(store, version)) <= 2
    store.merge(numbered(spark, ["a1"]), AS_OF)
    rows = by_url(store.read())
    assert len(rows) == 302 and rows["a1"]["title"] == "t0" and rows["a2"]["id"] == 1002


def test_existing_urls_read_touched_buckets_only(spark, store):
    batch = numbered(spark, ["u1", "no", "u1", "u2"])
    found = store.existing_urls(batch)
    assert sorted(r["url"] for r in found.collect()) == ["u1", "u2"]
    assert len(store.rows_for(batch).inputFiles()) <= 3
    assert store.rows_for(numbered(spark, ["", None])).count() == 0


def test_old_snapshots_stay_readable_until_pruned(spark, store):
    before = by_url(store.read())
    store.merge(numbered(spark, ["u1"], price="$77"), AS_OF)
    assert by_url(store.read(1)) == before
    gone = store.prune(keep=1)
    assert len(gone) == 1 and store.versions() == [2] and store.read().count() == 300
    with pytest.raises(ValueError):
        store.read(1)
    with pytest.raises(ValueError):
        store.prune(0)


def test_a_lost_merge_leaves_the_snapshot_in_force(spark, store, monkeypatch):
    before = by_url(store.read())
    monkeypatch.setattr(store, "_commit", lambda manifest: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.merge(numbered(spark, ["u1"], price="$77"), AS_OF)
    monkeypatch.undo()
    assert by_url(store.read()) == before
    store._claim(2)
    with pytest.raises(ValueError):
        store.merge(numbered(spark, ["u1"]), AS_OF)
    store.release(2)
    store.merge(numbered(spark, ["u1"], price="$77"), AS_OF)
    assert by_url(store.read())["u1"]["price"] == "$77"


def test_odd_tables_and_batches(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "t"), buckets=4)
    assert store.read().count() == 0 and store.versions() == []
    store.merge(numbered(spark, [None, ""]), AS_OF)
    assert store.read().count() == 0 and store.versions() == [1]
    store.merge(numbered(spark, ["x"]), AS_OF)
    store.write(spark.createDataFrame([(1, "y", "$4")], "id long, url string, price string"))
    assert [(r["url"], r["price_num"]) for r in store.read().collect()] == [("y", 4)]
    with pytest.raises(ValueError):
        BucketStore(spark, str(tmp_path / "t"), buckets=8).read()


def test_touched_rows_are_shuffled_once(spark, store, monkeypatch):
    plans = []
    own = store._store
    monkeypatch.setattr(store, "_store", lambda rows, version: plans.append(plan_of(rows)) or own(rows, version))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.merge(numbered(spark, ["u1", "u2"]), AS_OF)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One for the stored rows; for the batch one to make it one row per URL and one to its bucket.
    assert plans[0].count("Exchange hashpartitioning") == 3, plans[0]
