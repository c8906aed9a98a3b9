import bench
from checks import tables
from dealflow.operators.filters import ListingFilter
from dealflow.session import work_path
from dealflow.sources.buckets import BucketStore
from dealflow.sources.listings import ListingStore

SF = "/root/testdata/sf0.001"


def test_stored_queries_run(spark):
    every = bench.stored(spark, SF)
    assert {"stored_filter", "stored_screen", "stored_page", "stored_merge", "stored_merge_buckets"} == set(every)
    assert every["stored_filter"]().count() == ListingFilter(state="CHINA", min_cash_flow=500_000).apply(tables.listings(spark, SF)).count()
    assert every["stored_page"]().count() > 0
    for build in every.values():
        build().write.format("noop").mode("overwrite").save()


def test_headline_queries_are_registered():
    assert set(bench.HEADLINE) <= set(bench.queries())


def test_a_frame_without_all_columns_is_stored(spark):
    rows = tables.listings(spark, SF).drop("description_embedding", "price", "price_num")
    for store in (ListingStore(spark, work_path(spark, "some")), BucketStore(spark, work_path(spark, "some"), 4)):
        store.write(rows)
        assert store.read().count() == rows.count() and store.read().where("price_num IS NOT NULL").isEmpty()
