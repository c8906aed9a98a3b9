"""Whole-table statistics (no look-back window)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.functions.text import moment
from dealflow.schema import NA


def stats_totals(listings: DataFrame, as_of=None) -> DataFrame:
    """Listing count, listings first seen within 7 days, and distinct industries.

    Counting per industry first leaves one row per industry to combine, so the distinct count needs no second
    copy of the rows.
    """
    recent = F.col("first_seen_date") > moment(as_of) - F.expr("INTERVAL 7 DAYS")
    per_industry = listings.groupBy("industry").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(recent).alias("recent")
    )
    return per_industry.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_listings"),
        F.coalesce(F.sum("recent"), F.lit(0)).alias("new_this_week"),
        F.count_if(F.col("industry") != NA).alias("distinct_industries"),
    )


def _counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def _largest_first(key: str) -> list[Column]:
    return [F.col("count").desc(), F.col(key).asc()]


def stats_by_source(listings: DataFrame) -> DataFrame:
    return _counts(listings, "source").orderBy(*_largest_first("source"))


def stats_top_industries(listings: DataFrame, limit: int = 5) -> DataFrame:
    named = listings.where(F.col("industry") != NA)
    return _counts(named, "industry").orderBy(*_largest_first("industry")).limit(limit)
