"""Stored orders of the listing table, so that any page is found by reading one range of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.operators.browse import listing_view
from dealflow.operators.filters import SORT_COLUMNS, SortChoice
from dealflow.schema import LISTING_SCHEMA
from dealflow.sources.buckets import BucketStore

RANGE_ROWS = 100_000  # rows of a range, about: what a page reads and sorts
EVERY = [SortChoice(column, direction) for column in SORT_COLUMNS for direction in ("desc", "asc")]


def _order(choice: SortChoice) -> list[Column]:
    return [choice.ordering(), F.col("id").desc()]


def _name(choice: SortChoice) -> str:
    return f"{choice.column}-{'desc' if choice.descending else 'asc'}"


class PageIndex:
    """The (key, id, URL) rows of one snapshot in the orders that pages are asked in, each cut into ranges.

    An order is a folder of ranges, numbered along it, and ``counts`` has the rows of every range. It belongs to the
    snapshot it was built of. Requests with filters go through ``browse.listing_page``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, listings: DataFrame, path: str, choices: list[SortChoice] | None = None, range_rows: int = RANGE_ROWS) -> PageIndex:
        """Write the orders ``choices``, all by default. Each takes one range shuffle of its three columns; the id is part of the
        order, so equal and absent keys are spread over ranges like others."""
        index = cls(listings.sparkSession, path)
        ranges = max(1, -(-listings.count() // range_rows))
        for choice in choices or EVERY:
            keys = listings.select(F.col(choice.column), "id", "url").repartitionByRange(ranges, *_order(choice))
            keys = keys.withColumn("range", F.spark_partition_id()).sortWithinPartitions("range", *_order(choice))
            folder = f"{index.path}/{_name(choice)}"
            keys.write.partitionBy("range").parquet(folder)
            counts = index.spark.read.schema(index._schema(choice)).parquet(folder).groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
            counts.coalesce(1).write.parquet(f"{index.path}/counts/{_name(choice)}")
        return index

    @staticmethod
    def _schema(choice: SortChoice) -> str:
        kind = LISTING_SCHEMA[choice.column].dataType.simpleString()
        return f"{choice.column} {kind}, id bigint, url string, range int"

    def counts(self, choice: SortChoice) -> list[tuple[int, int]]:
        """Number and rows of every range in order: a short row for each ``RANGE_ROWS`` listings."""
        stored = self.spark.read.schema("range int, rows long").parquet(f"{self.path}/counts/{_name(choice)}")
        return sorted((r["range"], r["rows"]) for r in stored.collect())

    def total(self, choice: SortChoice) -> int:
        return sum(rows for _, rows in self.counts(choice))

    def rows(self, choice: SortChoice, offset: int, count: int) -> DataFrame:
        """The key, id and URL of ``count`` listings from ``offset`` on, in order."""
        wanted, first, before = [], 0, 0
        for number, rows in self.counts(choice):
            if before < offset + count and before + rows > offset:
                first = first if wanted else before
                wanted.append(number)
            before += rows
        if not wanted:
            return self.spark.createDataFrame([], self._schema(choice)).drop("range")
        folder = f"{self.path}/{_name(choice)}"
        files = [f"{folder}/range={n}" for n in wanted]
        stored = self.spark.read.option("basePath", folder).schema(self._schema(choice)).parquet(*files).drop("range")
        return stored.orderBy(*_order(choice)).offset(offset - first).limit(count)

    def page(
        self, listings: DataFrame | BucketStore, page: int = 1, per_page: int = 10, sort_by: str = "last_seen_date", sort_order: str = "desc"
    ) -> DataFrame:
        """The page that ``browse.listing_page`` gives without filters. Of a ``BucketStore`` only the buckets of the page's URLs
        are read."""
        if page < 1 or not 1 <= per_page <= 100:
            raise ValueError("page must be at least 1 and per_page between 1 and 100")
        choice = SortChoice(sort_by, sort_order)
        # At most 100 short rows; the index is read once for both uses.
        found = [(r["id"], r["url"]) for r in self.rows(choice, (page - 1) * per_page, per_page).select("id", "url").collect()]
        wanted = self.spark.createDataFrame(found, "id long, url string")
        source = listings.rows_for(wanted) if isinstance(listings, BucketStore) else listings
        rows = source.join(F.broadcast(wanted.select("id")), "id", "left_semi")
        return listing_view(rows.orderBy(*_order(choice)))
