import pytest
from pyspark.sql import functions as F

from checks import tables
from dealflow.operators import dashboard
from dealflow.operators.upsert import normalise_records
from dealflow.schema import RECORD_COLUMNS
from dealflow.sources.buckets import BucketStore
from dealflow.sources.rollups import SKETCH_ERROR, SKETCHED, Rollups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    made = BucketStore(spark, str(tmp_path_factory.mktemp("t") / "t"), buckets=16)
    made.write(tables.listings(spark, SF))
    return made


def groups(df):
    columns = ["source", "industry", "total", "new", "qualified", "local", "cash_flow", "margin", "has_revenue", "has_ebitda", "has_cash_flow", "has_location"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


MOMENTS = [("2001-08-01 00:00:00Z", 90, None), ("1998-03-05 13:45:10Z", 30, "us,mx"), ("1996-01-02 00:00:01Z", 400, "CA"), ("1970-01-01 00:00:00Z", 1, None)]


def test_counts_equal_those_of_the_listings(spark, store):
    rollups = Rollups(store)
    assert len(rollups.refresh()) == len(store.manifest().buckets)
    for as_of, days, scope in MOMENTS:
        want = groups(dashboard.group_counts(store.read(), as_of, days, scope))
        assert groups(rollups.group_counts(as_of, days, scope)) == want
    assert rollups.refresh() == []


def test_a_merge_makes_only_its_buckets_again(spark, store):
    rollups = Rollups(store)
    rollups.refresh()
    for step in range(3):
        visited = store.read().where((store.bucket_of("url") % 8 == step) & (F.col("id") % 3 == 0)).withColumn("seq", F.col("id"))
        more = visited.limit(5).withColumns({"url": F.concat("url", F.lit(f"/{step}")), "price": F.lit("$9")})
        batch = normalise_records(visited.unionByName(more).select("seq", *[c for c in visited.columns if c in RECORD_COLUMNS]))
        touched = store.touched(batch)
        store.merge(batch, f"1998-0{step + 1}-07 05:00:00Z")
        assert rollups.refresh() == touched and len(touched) < 16
    for as_of, days, scope in [*MOMENTS, ("1998-03-10 00:00:00Z", 10, "US")]:
        assert groups(rollups.group_counts(as_of, days, scope)) == groups(dashboard.group_counts(store.read(), as_of, days, scope))


def test_sketches_are_near_the_exact_numbers(spark, store):
    rollups = Rollups(store)
    rollups.refresh()
    for as_of, days in (("2001-08-01 00:00:00Z", 4000), ("1998-03-05 00:00:00Z", 200)):
        rows = dashboard.in_scope(store.read(), as_of, days)
        exact = rows.agg(*[F.countDistinct(F.when(~F.upper(F.trim(c)).isin("N/A", "", "NULL", "NA", "NONE"), F.col(c))).alias(c) for c in SKETCHED]).first()
        found = rollups.distinct_values(as_of, days).first()
        assert all(abs(found[c] - exact[c]) <= 4 * SKETCH_ERROR * exact[c] + 1 for c in SKETCHED)


def test_empty(spark, tmp_path):
    rollups = Rollups(BucketStore(spark, str(tmp_path / "t"), buckets=2))
    assert rollups.refresh() == [] and rollups.group_counts("2001-08-01 00:00:00Z").count() == 0
    assert list(rollups.distinct_values("2001-08-01 00:00:00Z").first()) == [0] * len(SKETCHED)
    with pytest.raises(ValueError):
        rollups.group_counts(lookback_days=0)
