from decimal import Decimal

from pyspark.sql import functions as F

from dealflow.operators import upload, upsert
from dealflow.operators.embed import hashing_embedder
from dealflow.operators.numbering import number_rows
from dealflow.plans.ingest import ingest
from dealflow.plans.upload import upload as upload_batch
from dealflow.sources.listings import ListingStore
from dealflow.streaming.ingest import merge_batch, record_stream, start_ingest
from helpers import AS_OF, by_url, listings, moment, plan_of, records

ONE = "https://example.com/1"
NEW = "https://example.com/new"


def test_merge_rules(spark):
    table = listings(spark, {}, {})
    batch = records(
        spark,
        {"url": NEW, "title": "first", "state": "NV", "price": "$1"},
        {"url": ONE, "title": "changed", "state": "TX", "price": "(5)"},
        {"url": NEW, "title": "last", "state": "TX", "price": "$2"},
    )
    rows = by_url(upsert.upsert(table, batch, AS_OF))
    assert len(rows) == 3
    old, new = rows[ONE], rows[NEW]
    assert (old["id"], old["title"], old["state"], old["price_num"]) == (1, "changed", "CA", Decimal(-5))
    assert old["first_seen_date"].isoformat()[:10] == "2026-02-01" and old["last_seen_date"].isoformat()[:10] == "2026-02-21"
    assert (new["id"], new["title"], new["state"], new["price_num"]) == (3, "last", "NV", Decimal(2))
    assert new["first_seen_date"] == new["last_seen_date"] and len(new["listing_hash"]) == 64
    assert rows["https://example.com/2"]["title"] == "HVAC Business"


def test_merge_is_repeatable(spark):
    table = listings(spark, {}, {})
    batch = records(spark, {"url": NEW, "title": "a"}, {"url": ONE, "title": "b"}, {"url": NEW, "title": "c"})
    once = upsert.upsert(table, batch, AS_OF)
    again = upsert.upsert(once, batch, AS_OF)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_merge_into_nothing_and_missing_urls(spark):
    batch = records(spark, {"url": "N/A", "title": "lost"}, {"url": NEW}, {"url": NEW})
    rows = upsert.upsert(listings(spark, {}).limit(0), batch, AS_OF).collect()
    assert [(r["id"], r["url"]) for r in rows] == [(2, NEW)]
    accepted, rejected = upsert.split_rejects(batch)
    assert accepted.count() == 2 and rejected.first()["error"] == "Missing URL"


def test_stale_embeddings_can_be_reset(spark):
    table = listings(spark, {"description_embedding": [1.0]}, {"description_embedding": [1.0]})
    batch = records(spark, {"url": ONE, "description": "other"}, {"url": "https://example.com/2", "description": "Nice deal"})
    kept = by_url(upsert.upsert(table, batch, AS_OF))
    assert kept[ONE]["description_embedding"] == [1.0]
    reset = by_url(upsert.upsert(table, batch, AS_OF, reset_changed_embeddings=True))
    assert reset[ONE]["description_embedding"] is None
    assert reset["https://example.com/2"]["description_embedding"] == [1.0]


def test_hot_url(spark):
    """Most of a batch being one URL still gives one row, from its first and last record."""
    rows = spark.range(30000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 > 0, NEW).otherwise(F.concat(F.lit("https://example.com/u"), "id")).alias("url"),
        F.col("id").cast("string").alias("title"),
    )
    batch = upsert.normalise_records(rows.repartition(8))
    merged = upsert.upsert(listings(spark, {}), batch, AS_OF)
    assert merged.count() == 10002
    hot = merged.where(F.col("url") == NEW).first()
    assert (hot["id"], hot["title"]) == (3, "29999")
    counts = upload.classify(batch, listings(spark, {})).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in counts} == {"inserted": 10001, "skipped": 19999}


def test_known_urls(spark):
    table = listings(spark, {}, {"source": "SiteB"})
    batch = records(spark, {"url": ONE}, {"url": NEW}, {"url": ONE})
    assert [r["seq"] for r in upsert.existing_rows(batch, table).orderBy("seq").collect()] == [0, 2]
    assert [r["seq"] for r in upsert.new_rows(batch, table).collect()] == [1]
    assert [r["url"] for r in upsert.urls_of_source(table, "SiteB").collect()] == ["https://example.com/2"]


def test_upload_report(spark):
    table = listings(spark, {"description": "old shop by the sea", "description_embedding": hashing_embedder(64)(["old shop by the sea"])[0]})
    batch = records(
        spark,
        {"url": NEW, "title": "A", "description": "a quite different mill in town", "scraping_date": "2001-01-01"},
        {"title": "no url"},
        {"url": ONE, "title": "again"},
        {"url": NEW, "title": "twice"},
        {"url": NEW + "2", "title": "B", "description": "Old shop by the sea"},
        {"url": NEW + "3", "title": "C", "description": "a quite different mill in town"},
        {"url": NEW + "4", "title": "D"},
    )
    result = upload_batch(table, batch, hashing_embedder(64), AS_OF, retry_wait=0.0)
    status = {r["seq"]: r["status"] for r in result.outcomes.collect()}
    assert status == {0: "inserted", 1: "error", 2: "skipped", 3: "skipped", 4: "inserted", 5: "inserted", 6: "inserted"}
    assert tuple(result.summary.first()) == (4, 2, 1, "Processed CSV: 4 inserted, 2 skipped (duplicates), 1 errors.")
    assert [tuple(r) for r in result.errors.collect()] == [(3, "Missing URL")]
    assert {(r["query_id"], r["id"]) for r in result.similar.collect()} == {(4, 1), (5, 2)}
    report = result.report.collect()
    assert [(r["row"], r["title"], [s["url"] for s in r["similar_to"]]) for r in report] == [(6, "B", [ONE]), (7, "C", [NEW])]
    after = by_url(result.listings)
    assert len(after) == 5 and after[ONE]["title"] == "HVAC Business"
    assert after[NEW]["scraping_date"] == "2026-02-21" and len(after[NEW]["description_embedding"]) == 64
    assert after[NEW + "4"]["description_embedding"] is None


def test_long_description_is_embedded_whole(spark):
    def embed(texts):
        return [[float(len(t)), 1.0] for t in texts]

    batch = records(spark, {"url": NEW, "description": "x" * 9000}, {"url": ONE, "description": "y"})
    result = upload_batch(listings(spark, {}).limit(0), batch, embed, AS_OF, retry_wait=0.0)
    seen = by_url(result.listings)
    assert seen[NEW]["description_embedding"] == [9000.0, 1.0] and seen[ONE]["description_embedding"] == [1.0, 1.0]


def test_entry_form(spark):
    typed = spark.createDataFrame([(0, "T", "", "D", None), (1, "T", "", "D", "Phone")], "seq long, title string, url string, description string, source string")
    done = upload.classify(upload.form_records(typed), listings(spark, {})).orderBy("seq").collect()
    assert [r["status"] for r in done] == ["inserted", "skipped"]
    assert done[0]["url"].startswith("manual://") and done[0]["source"] == "Manual" and done[0]["country"] == "US"
    assert done[0]["industry"] == "" and done[1]["source"] == "Phone"
    result = upload_batch(listings(spark, {}), upload.form_records(typed), hashing_embedder(16), AS_OF, check_skipped=True, retry_wait=0.0)
    assert [(r["query_id"], r["id"]) for r in result.similar.collect()] == [(1, 2)]


def test_row_numbers_follow_the_order(spark):
    df = spark.range(1000).repartition(7).orderBy(F.col("id").desc())
    rows = {r["id"]: r["n"] for r in number_rows(df, "n").collect()}
    assert rows == {i: 999 - i for i in range(1000)}


def test_snapshots(spark, tmp_path):
    store = ListingStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0 and store.versions() == []
    assert ingest(store, records(spark, {"url": ONE, "title": " a "}, {"title": "lost"}), AS_OF) == 1
    (tmp_path / "store" / "snapshot=2").mkdir()
    (tmp_path / "store" / "snapshot=2" / "part-0.parquet").write_bytes(b"half")
    assert store.versions() == [1]
    assert ingest(store, records(spark, {"url": ONE, "title": "b"}, {"url": NEW}), AS_OF) == 2
    assert {r["url"]: r["title"] for r in store.read().collect()} == {ONE: "b", NEW: "N/A"}
    assert store.read(1).count() == 1


def test_bucketed_snapshots_are_merged_without_shuffling_them(spark, tmp_path):
    store = ListingStore(spark, str(tmp_path / "store"), buckets=4)
    ingest(store, records(spark, *[{"url": f"u{n}", "title": "a"} for n in range(50)]), AS_OF)
    batch = records(spark, *[{"url": f"u{n}", "title": "b"} for n in range(40, 60)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(upsert.upsert(store.read(), batch, AS_OF))
        assert ingest(store, batch, AS_OF) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tables = [line for line in plan.splitlines() if "FileScan" in line and "Bucketed: true" in line]
    assert len(tables) == 1 and plan.count("FullOuter") == 1
    again = ListingStore(spark, str(tmp_path / "store"), buckets=4).read()
    titles = {r["url"]: r["title"] for r in again.collect()}
    files = [p.name for p in (tmp_path / "store" / "snapshot=2").glob("*.parquet")]
    assert len(files) <= 8  # stored rows: one per bucket; new rows: one per bucket
    assert len(titles) == 60 and titles["u39"] == "a" and titles["u40"] == titles["u59"] == "b"


def test_row_numbers_with_many_files_per_task(spark, tmp_path):
    from dealflow.operators.numbering import with_origin

    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        ordered = spark.range(40).select((F.col("id") * 7 % 40).alias("v")).orderBy("v")
        assert [r["v"] for r in number_rows(ordered, "n").orderBy("n").collect()] == list(range(40))
        assert sorted(r["n"] for r in number_rows(ordered, "n").collect()) == list(range(40))
        for k in range(5):
            (tmp_path / f"{k}.txt").write_text("".join(f"{k}-{i}\n" for i in range(8)))
        lines = with_origin(spark.read.text(str(tmp_path)))
        found = [r["value"] for r in number_rows(lines, "n").orderBy("n").collect()]
        assert found == [f"{k}-{i}" for k in range(5) for i in range(8)]
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_buckets_stay_one_file_each(spark, tmp_path):
    store = ListingStore(spark, str(tmp_path / "store"), buckets=4)
    for n in range(6):
        batch = records(spark, *[{"url": f"u{i}", "title": f"t{n}"} for i in range(10 * n, 10 * n + 30)])
        version = store.merge(batch, AS_OF)
        files = list((tmp_path / "store" / f"snapshot={version}").glob("*.parquet"))
        assert len(files) == 4
    titles = {r["url"]: r["title"] for r in store.read().collect()}
    assert len(titles) == 80 and titles["u5"] == "t0" and titles["u25"] == "t2" and titles["u79"] == "t5"
    assert store.prune(keep=2) == [1, 2, 3, 4] and store.versions() == [5, 6]
    assert store.read().count() == 80 and not (tmp_path / "store" / "snapshot=1").exists()


def test_a_second_writer_of_a_snapshot_fails(spark, tmp_path):
    import pytest

    store = ListingStore(spark, str(tmp_path / "store"))
    assert store.merge(records(spark, {"url": ONE}), AS_OF) == 1
    store.claim(2)
    with pytest.raises(ValueError, match="being written"):
        store.merge(records(spark, {"url": NEW}), AS_OF)
    store.release(2)
    assert store.merge(records(spark, {"url": NEW}), AS_OF) == 2 and store.read().count() == 2


def test_merge_reads_each_side_once(spark, tmp_path):
    listings(spark, {}, {}).write.parquet(str(tmp_path / "t"))
    records(spark, {"url": ONE}).write.parquet(str(tmp_path / "b"))
    table, batch = spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "b"))
    plan = plan_of(upsert.upsert(table, batch, AS_OF))
    # Once each for the join, and the ids for the largest one.
    assert plan.count("FileScan") == 3 and plan.count("ReadSchema: struct<id:bigint>") == 1


def test_failed_ingest_keeps_the_table_and_saves_the_records(spark, tmp_path, monkeypatch):
    import pytest

    store = ListingStore(spark, str(tmp_path / "store"))
    ingest(store, records(spark, {"url": ONE}), AS_OF)
    monkeypatch.setattr(store, "write", lambda *given, **more: (_ for _ in ()).throw(RuntimeError("no space")))
    with pytest.raises(RuntimeError):
        ingest(store, records(spark, {"url": NEW}), AS_OF, fallback_csv=str(tmp_path / "csv"))
    assert store.versions() == [1]
    assert [r["URL"] for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()] == [NEW]


def test_stream(spark, tmp_path):
    files, store = str(tmp_path / "in"), ListingStore(spark, str(tmp_path / "store"))
    rejects, progress = str(tmp_path / "rejects"), str(tmp_path / "progress")

    def arrive(*rows):
        records(spark, *rows).drop("seq").coalesce(1).write.mode("append").json(files)
        start_ingest(record_stream(spark, files), store, rejects, progress).awaitTermination()

    arrive({"url": ONE, "title": "a", "state": "NV"}, {"title": "lost"})
    arrive({"url": ONE, "title": "b", "state": "TX"}, {"url": NEW})
    rows = {r["url"]: r.asDict() for r in store.read().collect()}
    assert set(rows) == {ONE, NEW} and (rows[ONE]["title"], rows[ONE]["state"]) == ("b", "NV")
    assert [r["title"] for r in spark.read.parquet(rejects).collect()] == ["lost"]
    (tmp_path / "in" / "part-zz.json").write_text('{"url": "https://example.com/ok"}\nnot json\n')
    start_ingest(record_stream(spark, files), store, rejects, progress).awaitTermination()
    kept = spark.read.option("mergeSchema", True).parquet(rejects).where("_corrupt_record is not null")
    assert [r["_corrupt_record"] for r in kept.collect()] == ["not json"] and store.read().count() == 3
    before = {(r["id"], r["url"]) for r in store.read().collect()}
    merge_batch(store, rejects, records(spark, {"url": NEW}).drop("seq"), 1)
    assert {(r["id"], r["url"]) for r in store.read().collect()} == before


def test_upload_dates_are_kept(spark):
    row = by_url(upsert.upsert(listings(spark, {}), records(spark, {"url": ONE}), AS_OF, upsert.COLLECTOR_UPDATES))[ONE]
    assert row["first_seen_date"].replace(tzinfo=None) == moment("2026-02-01").replace(tzinfo=None)
