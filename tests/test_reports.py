from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dealflow.operators import browse, dashboard, screen, sla, stats
from dealflow.operators.filters import ListingFilter, SortChoice
from dealflow.plans.overview import overview, overview_rows
from helpers import AS_OF, listings, moment, plan_of, records, values


def ids(df):
    return [r["id"] for r in df.collect()]


def test_filter_parts():
    wanted = ListingFilter(
        source=" SiteA ", industry="Services", state="CA", country="US", city=" ",
        min_cash_flow=100, max_cash_flow=500, min_revenue=10, max_price=5,
    )
    assert len(wanted.predicates()) == 8


@pytest.mark.parametrize(
    "bad", [{"min_cash_flow": 500000, "max_cash_flow": 200000}, {"min_price": 900000, "max_price": 100000},
            {"revenue_min": 2, "max_revenue": 1}]
)
def test_filter_ranges_are_checked(bad):
    with pytest.raises(ValueError, match="cannot be greater than"):
        ListingFilter(**bad)


def test_older_bound_names():
    assert ListingFilter(revenue_min=1).bounds("revenue") == (1, None)
    assert ListingFilter(revenue_min=1, min_revenue=0).bounds("revenue") == (0, None)


def test_filters(spark):
    df = listings(spark, {}, {"cash_flow_num": None}, {"cash_flow_num": Decimal(500)}, {"state": "ca"}, {"city": "Reno"})
    assert ids(ListingFilter(min_cash_flow=300000).apply(df)) == [1, 4, 5]
    assert ids(ListingFilter(state="CA", max_cash_flow=300000, city="Los Angeles").apply(df)) == [1, 3]
    texts_only = df.drop("price_num", "gross_revenue_num", "cash_flow_num", "ebitda_num")
    assert ids(ListingFilter(min_ebitda=250000, max_ebitda=250000).apply(texts_only)) == [1, 2, 3, 4, 5]


def test_sort_names():
    choice = SortChoice("cash_flow", "ASC")
    assert (choice.column, choice.descending) == ("cash_flow_num", False)
    for bad in ("title", "drop table"):
        with pytest.raises(ValueError, match="Invalid sort_by"):
            SortChoice(bad, "asc")
    with pytest.raises(ValueError):
        SortChoice("price", "up")


def test_pages_are_stable_with_nulls_last(spark):
    df = listings(spark, *[{"price_num": None if n % 3 == 0 else Decimal(n % 2)} for n in range(1, 22)])
    for order in ("asc", "desc"):
        pages = [ids(browse.listing_page(df, page=p, per_page=10, sort_by="price", sort_order=order)) for p in (1, 2, 3)]
        assert [len(p) for p in pages] == [10, 10, 1]
        rows = [(r["id"], r["price_num"]) for r in df.collect()]
        sign = 1 if order == "asc" else -1
        want = sorted(rows, key=lambda r: (r[1] is None, sign * (r[1] or 0), -r[0]))
        assert sum(pages, []) == [r[0] for r in want]
    info = browse.page_info(df, page=2, per_page=10).first()
    assert tuple(info) == (21, 2, 10, 3)
    assert browse.listing_page(df).first()["cash_flow_numeric"] == 300000.0


def test_far_pages_equal_near_pages(spark, monkeypatch):
    df = listings(spark, *[{"price_num": Decimal(n % 7)} for n in range(200)]).repartition(5)
    near = ids(browse.listing_page(df, page=4, per_page=30, sort_by="price_num"))
    monkeypatch.setattr(browse, "TOP_ROWS", 10)
    assert ids(browse.listing_page(df, page=4, per_page=30, sort_by="price_num")) == near
    assert ids(browse.listing_page(df, page=9, per_page=30, sort_by="price_num")) == []


def test_page_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan_of(browse.listing_page(listings(spark, {})))
    assert "TakeOrderedAndProject" in plan_of(dashboard.priority_queue(listings(spark, {}), AS_OF))


def test_lookup_and_facets(spark):
    df = listings(spark, {"source": "b"}, {"source": "A"}, {"source": " n/a "}, {"source": None}, {"source": "B"})
    assert browse.listing_by_id(df, 2).first()["source"] == "A"
    assert browse.listing_by_id(df, 99).count() == 0
    found = browse.filter_options(df).where("facet = 'source'")
    assert [r["value"] for r in found.collect()] == ["A", "B", "b"]


def test_stats(spark):
    df = listings(
        spark, {"first_seen_date": moment("2026-02-14")}, {"first_seen_date": moment("2026-02-15")},
        {"industry": "N/A", "source": "SiteB"}, {"industry": " n/a"}, {"industry": None},
    )
    assert tuple(stats.stats_totals(df, AS_OF).first()) == (5, 1, 2)
    assert tuple(stats.stats_totals(df.limit(0), AS_OF).first()) == (0, 0, 0)
    assert [tuple(r) for r in stats.stats_by_source(df).collect()] == [("SiteA", 4), ("SiteB", 1)]
    assert [tuple(r) for r in stats.stats_top_industries(df).collect()] == [("Services", 2), (" n/a", 1)]


GOOD = {
    "cash_flow_num": Decimal(2_000_000), "gross_revenue_num": Decimal(20_000_000), "ebitda_num": Decimal(2_000_000),
    "first_seen_date": moment("2026-02-14"),
}


def test_scores_and_reasons(spark):
    df = listings(
        spark, GOOD, GOOD | {"country": " ca "}, GOOD | {"country": None, "cash_flow_num": Decimal(1_000_000)},
        GOOD | {"ebitda_num": Decimal(1_999_999), "first_seen_date": None},
        {"gross_revenue_num": Decimal(0), "cash_flow_num": None, "country": "MX"},
    )
    rows = df.select(dashboard.fit_score(AS_OF).alias("s"), dashboard.fit_reasons(AS_OF).alias("r")).collect()
    assert [r.s for r in rows] == [100, 100, 65, 65, 0]
    assert rows[0].r == ["Local", "Cash Flow Fit", "Margin Fit", "Revenue >= $10M", "New This Week"]
    assert rows[2].r == ["Cash Flow Near Fit", "Margin Fit", "Revenue >= $10M", "New This Week"]
    assert rows[4].r == []


def test_priority_order(spark):
    df = listings(
        spark, GOOD, GOOD, GOOD | {"first_seen_date": moment("2026-02-20")},
        GOOD | {"first_seen_date": None}, {"last_seen_date": moment("2025-01-01")}, {"title": "  "},
    )
    queue = dashboard.priority_queue(df, AS_OF, limit=50).collect()
    assert [r["id"] for r in queue] == [3, 2, 1, 4, 6]
    assert queue[-1]["title"] == "N/A"
    with pytest.raises(ValueError):
        dashboard.priority_queue(df, AS_OF, limit=51)


def test_scope_text():
    assert dashboard.country_scope(" us, ,mx,US") == ["US", "MX"]
    assert dashboard.country_scope(" , ") == ["US", "CA"]


def test_overview(spark):
    df = listings(spark, GOOD, {}, {"source": " n/a", "state": "N/A"}, {"last_seen_date": None}, {"last_seen_date": moment("2025-11-23"), "industry": "Food"})
    found = overview(df, as_of=AS_OF)
    snap = found.snapshot.first()
    assert (snap.total_listings, snap.new_this_week, snap.qualified_count, snap.pass_rate) == (5, 1, 1, 0.2)
    assert (snap.active_sources, snap.distinct_industries) == (1, 2)
    assert [(r.stage, r["count"]) for r in found.criteria_funnel.orderBy("position").collect()] == [
        ("All Listings", 5), ("Local (US/CA)", 5), ("Cash Flow Fit", 1), ("Margin Fit", 5), ("Shortlist", 1)]
    assert [tuple(r) for r in found.source_yield.select("source", "total", "qualified", "qualified_rate").collect()] == [
        ("SiteA", 4, 1, 0.25), ("Unknown", 1, 0, 0.0)]
    assert found.data_quality.first().parseable_location_pct == 0.8
    assert tuple(found.sla.first()) == (None, None, None, None)
    assert overview_rows(found).count() == 6 + 5 + 4 + 4 + 2 + 5


def test_overview_of_nothing(spark):
    found = overview(listings(spark, {}).limit(0), as_of=AS_OF)
    assert tuple(found.snapshot.first()) == (0, 0, 0, 0.0, 0, 0)
    assert [r["count"] for r in found.criteria_funnel.collect()] == [0] * 5
    assert tuple(found.data_quality.first()) == (0.0, 0.0, 0.0, 0.0)
    assert found.source_yield.count() == found.priority_queue.count() == 0


def test_sla(spark):
    day = moment("2026-02-01")
    rows = [
        (day, moment("2026-02-03"), None, None, "Open"), (day, moment("2026-02-04"), None, None, " LOST "),
        (day, None, moment("2026-02-06"), moment("2026-05-01"), None), (moment("2020-01-01"), day, day, day, "open"),
    ]
    schema = "created_at timestamp, responded_at timestamp, offered_at timestamp, closed_at timestamp, status string"
    deals = spark.createDataFrame(rows, schema)
    assert tuple(sla.sla_rates(spark, deals, AS_OF).first()) == (0.5, 1.0, 0.0, 2)
    assert tuple(sla.sla_rates(spark, deals.drop("status"), AS_OF).first()) == (None,) * 4


SCREENED = [
    ({"cash_flow": "$2,000,000"}, True, False), ({"ebitda": "1,900,000", "gross_revenue": "9,000,000"}, False, True),
    ({"gross_revenue": "$5,000,000"}, True, True), ({"price": "6000000"}, True, False), ({}, False, False),
    ({"gross_revenue": "2000000"}, False, True), ({"price": "5,999,999"}, False, False),
]


def test_screen(spark):
    df = records(spark, *[case[0] for case in SCREENED])
    assert values(df, screen.passes_screen("non-software")) == [c[1] for c in SCREENED]
    assert values(df, screen.passes_screen("software")) == [c[2] for c in SCREENED]
    assert all(values(df, screen.passes_screen("all")))
    with pytest.raises(ValueError):
        screen.passes_screen("other")


def test_lookback_reaches_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    listings(spark, {}).write.parquet(path)
    plan = plan_of(dashboard.in_scope(spark.read.parquet(path), AS_OF).select("id"))
    assert "Or(GreaterThanOrEqual(last_seen_date" in plan


def test_results_do_not_depend_on_partitions(spark):
    df = listings(spark, *[GOOD | {"source": f"S{n % 3}", "cash_flow_num": Decimal(n * 90_000)} for n in range(60)])
    one, many = df.coalesce(1), df.repartition(7, F.col("title"))
    for build in (lambda d: dashboard.source_yield(dashboard.group_counts(d, AS_OF)), lambda d: dashboard.priority_queue(d, AS_OF, limit=20)):
        assert build(one).collect() == build(many).collect()
