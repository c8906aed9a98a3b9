"""Small tables for the tests."""

from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.operators.upsert import as_listings
from dealflow.schema import LISTING_SCHEMA, RECORD_COLUMNS

AS_OF = "2026-02-21 00:00:00"


def values(df: DataFrame, expression) -> list:
    return [r[0] for r in df.select(expression).collect()]


def texts(spark: SparkSession, *rows) -> DataFrame:
    return spark.createDataFrame([(r,) for r in rows], "v string")


def moment(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


SAMPLE = {
    "id": 1,
    "url": "https://example.com/1",
    "source": "SiteA",
    "title": "HVAC Business",
    "city": "Los Angeles",
    "state": "CA",
    "country": "US",
    "industry": "Services",
    "description": "Nice deal",
    "price": "$900,000",
    "gross_revenue": "$1,500,000",
    "cash_flow": "$300,000",
    "inventory": "N/A",
    "ebitda": "$250,000",
    "first_seen_date": moment("2026-02-01"),
    "last_seen_date": moment("2026-02-20"),
    "price_num": Decimal(900000),
    "gross_revenue_num": Decimal(1500000),
    "cash_flow_num": Decimal(300000),
    "ebitda_num": Decimal(250000),
}


def listings(spark: SparkSession, *changes: dict) -> DataFrame:
    """The sample listing once per change, with ids from 1."""
    rows = []
    for number, change in enumerate(changes, 1):
        row = SAMPLE | {"id": number, "url": f"https://example.com/{number}"} | change
        rows.append(tuple(row.get(f.name) for f in LISTING_SCHEMA))
    return spark.createDataFrame(rows, LISTING_SCHEMA)


def records(spark: SparkSession, *rows: dict) -> DataFrame:
    """Records numbered in the given order; what a row leaves out is ``N/A``."""
    data = [(n, *[r.get(c, "N/A") for c in RECORD_COLUMNS]) for n, r in enumerate(rows)]
    schema = "seq long, " + ", ".join(f"{c} string" for c in RECORD_COLUMNS)
    return spark.createDataFrame(data, schema)


def by_url(df: DataFrame) -> dict:
    return {r["url"]: r.asDict() for r in as_listings(df).collect()}


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


__all__ = ["AS_OF", "F", "by_url", "listings", "moment", "plan_of", "records", "texts", "values"]
