"""Table layouts: the stored listing table, the collector record and their column names."""

from __future__ import annotations

from pyspark.sql import types as T

NA = "N/A"

# Collector display name -> stored column name, in output order.
COLLECTOR_COLUMNS = {
    "Title": "title",
    "City": "city",
    "State": "state",
    "Country": "country",
    "URL": "url",
    "Industry": "industry",
    "Source": "source",
    "Description": "description",
    "Listed By (Firm)": "listed_by_firm",
    "Listed By (Name)": "listed_by_name",
    "Phone": "phone",
    "Email": "email",
    "Price": "price",
    "Gross Revenue": "gross_revenue",
    "Cash Flow": "cash_flow",
    "Inventory": "inventory",
    "EBITDA": "ebitda",
    "Scraping Date": "scraping_date",
    "Financial Data": "financial_data",
    "source Link": "source_link",
    "Extra Information": "extra_information",
    "Deal Date": "deal_date",
}

RECORD_COLUMNS = list(COLLECTOR_COLUMNS.values())

# Numeric column -> the money text it is derived from.
NUMERIC_COLUMNS = {
    "price_num": "price",
    "gross_revenue_num": "gross_revenue",
    "cash_flow_num": "cash_flow",
    "ebitda_num": "ebitda",
}

MONEY = T.DecimalType(24, 6)
EMBEDDING = T.ArrayType(T.FloatType())

# Columns returned by browse, lookup and search (the embedding is never among them).
LISTING_COLUMNS = [
    "id", "url", "source", "title", "city", "state", "country", "industry", "description",
    "listed_by_firm", "listed_by_name", "phone", "email",
    "price", "gross_revenue", "cash_flow", "inventory", "ebitda",
    "financial_data", "source_link", "extra_information", "deal_date",
    "first_seen_date", "last_seen_date", "scraping_date",
]


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


LISTING_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType(), False)]
    + _text(
        "url", "listing_hash", "source", "title", "city", "state", "country", "industry", "description",
        "listed_by_firm", "listed_by_name", "phone", "email",
        "price", "gross_revenue", "cash_flow", "inventory", "ebitda",
    )
    + [T.StructField(n, MONEY) for n in NUMERIC_COLUMNS]
    + _text("financial_data", "source_link", "extra_information", "deal_date")
    + [T.StructField(n, T.TimestampType()) for n in ("first_seen_date", "last_seen_date")]
    + _text("scraping_date", "business_entity_id")
    + [T.StructField("description_embedding", EMBEDDING)]
)

# Declared next to the listing table; no operator reads or writes it.
BUSINESS_ENTITY_SCHEMA = T.StructType(
    _text("id", "derived_name", "primary_city", "primary_state", "primary_country")
    + [T.StructField("aggregate_revenue", MONEY)]
    + _text("primary_broker_email")
    + [
        T.StructField("confidence_score", T.FloatType()),
        T.StructField("description_embedding", EMBEDDING),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

SLA_COLUMNS = ["created_at", "responded_at", "offered_at", "closed_at", "status"]
