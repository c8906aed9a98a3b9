import pytest

from dealflow.functions.money import with_numeric_columns
from dealflow.operators import browse
from dealflow.operators.filters import SortChoice
from dealflow.sources.buckets import BucketStore
from dealflow.sources.page_index import EVERY, PageIndex
from helpers import listings

PRICES = ["$5", None, "n/a", "$900", "$5", "(20)"]


@pytest.fixture(scope="module")
def table(spark):
    rows = listings(spark, *[{"price": PRICES[i % 6], "price_num": None} for i in range(240)])
    return with_numeric_columns(rows)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_pages_equal_sorting(spark, table, tmp_path):
    choices = [SortChoice("price_num", "desc"), SortChoice("price", "asc"), SortChoice("last_seen_date", "desc")]
    index = PageIndex.build(table, str(tmp_path / "i"), choices, range_rows=30)
    assert len(index.counts(choices[0])) > 4 and index.total(choices[1]) == 240
    for by, order in (("price_num", "desc"), ("price", "asc"), ("last_seen_date", "desc")):
        for page in (1, 2, 5, 7, 8, 99):
            want = browse.listing_page(table, page=page, per_page=35, sort_by=by, sort_order=order)
            found = index.page(table, page, 35, by, order)
            assert ids(found) == ids(want) and found.columns == want.columns, (by, order, page)


def test_a_page_reads_one_range_and_few_buckets(spark, table, tmp_path):
    store = BucketStore(spark, str(tmp_path / "t"), buckets=32)
    store.write(table)
    choice = SortChoice("price", "asc")
    index = PageIndex.build(store.read(), str(tmp_path / "i"), [choice], range_rows=20)
    before = sum(rows for _, rows in index.counts(choice)[:3])
    rows = index.rows(choice, before, 3)
    assert len({f.split("range=")[1].split("/")[0] for f in rows.inputFiles()}) == 1
    found = index.page(store, page=60, per_page=4, sort_by="price", sort_order="asc")
    assert ids(found) == ids(browse.listing_page(table, page=60, per_page=4, sort_by="price", sort_order="asc"))
    assert len(found.inputFiles()) <= 4


def test_empty_table_and_wrong_requests(spark, table, tmp_path):
    index = PageIndex.build(table.limit(0), str(tmp_path / "i"), EVERY[:1])
    assert index.total(EVERY[0]) == 0 and index.page(table).count() == 0
    with pytest.raises(ValueError):
        index.page(table, page=0)
    with pytest.raises(ValueError):
        index.page(table, sort_by="title")
