"""The registered queries against their SQL; ``checks/compare.py`` runs all of them."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "dashboard_overview", "priority_queue", "listing_page", "filter_options", "stats_totals", "money_numeric",
    "strip_html", "collector_map", "html_extract_labelled", "upsert_collector", "upload_outcomes", "listing_csv",
    "semantic_duplicates", "semantic_rerank", "text_search_many", "stream_ingest",
]

needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the driver's tables are not here")


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_tables
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF_DIR), connect(SF_DIR), entry.oracle_sql()[name]) is None


@needs_tables
def test_entry(spark):
    assert entry.entry(spark).count() == 12
