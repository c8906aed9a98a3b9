"""Browse, look up and list the facet values of the listing table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.functions.money import ensure_numeric_columns, with_money_fields
from dealflow.functions.text import is_present
from dealflow.operators.filters import NO_FILTER, ListingFilter, SortChoice
from dealflow.operators.numbering import number_rows
from dealflow.schema import LISTING_COLUMNS, NUMERIC_COLUMNS

# Up to this many leading rows a page is a top-k; deeper pages are found by their row numbers.
TOP_ROWS = 10_000
FACETS = ["source", "industry", "state", "country"]


def listing_view(listings: DataFrame) -> DataFrame:
    """The fixed result columns: listing columns, stored numbers and their float readings."""
    columns = LISTING_COLUMNS + list(NUMERIC_COLUMNS)
    return with_money_fields(ensure_numeric_columns(listings).select(*columns))


def listing_page(
    listings: DataFrame,
    filters: ListingFilter = NO_FILTER,
    page: int = 1,
    per_page: int = 10,
    sort_by: str = "last_seen_date",
    sort_order: str = "desc",
) -> DataFrame:
    """One page in a stable order: sort column with NULLs last, then newest id first."""
    if page < 1 or not 1 <= per_page <= 100:
        raise ValueError("page must be at least 1 and per_page between 1 and 100")
    choice = SortChoice(sort_by, sort_order)
    order = [choice.ordering(), F.col("id").desc()]
    matching = filters.apply(listings)
    offset = (page - 1) * per_page
    if offset + per_page > TOP_ROWS:
        matching = _deep_page(matching, choice.column, order, offset, per_page)
        return listing_view(matching.orderBy(*order).limit(per_page))
    return listing_view(matching.orderBy(*order).offset(offset).limit(per_page))


def _deep_page(matching: DataFrame, column: str, order: list, offset: int, rows: int) -> DataFrame:
    """Rows of a far page without a top-k of that depth: number the range-sorted (key, id) pairs.

    Only the pairs are sorted and stored; the ids that go back to the wide rows are at most one page (100).
    """
    numbered = number_rows(matching.select(column, "id").orderBy(*order), "position")
    wanted = numbered.where(F.col("position").between(offset, offset + rows - 1)).select("id")
    return matching.join(F.broadcast(wanted), "id", "left_semi")


def listing_count(listings: DataFrame, filters: ListingFilter = NO_FILTER) -> DataFrame:
    return filters.apply(listings).agg(F.count(F.lit(1)).alias("total"))


def page_info(
    listings: DataFrame, filters: ListingFilter = NO_FILTER, page: int = 1, per_page: int = 10
) -> DataFrame:
    """Total, page, page size and number of pages."""
    return listing_count(listings, filters).select(
        "total",
        F.lit(page).alias("page"),
        F.lit(per_page).alias("per_page"),
        F.ceil(F.col("total") / F.lit(per_page)).alias("total_pages"),
    )


def listing_by_id(listings: DataFrame, listing_id: int) -> DataFrame:
    """The listing with that id; no row when there is none."""
    return listing_view(listings.where(F.col("id") == F.lit(listing_id)))


def filter_options(listings: DataFrame) -> DataFrame:
    """Distinct usable values of every facet, ordered within the facet without regard to case."""
    values = listings.select(*FACETS).unpivot([], FACETS, "facet", "value")
    return (
        values.where(is_present(F.col("value")))
        .distinct()
        .orderBy("facet", F.lower("value"), "value")
    )
