"""Merging collected records into the listing table by URL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.functions.money import ensure_numeric_columns, money_numeric, with_numeric_columns
from dealflow.functions.text import is_present, moment, strip_space, url_hash, value_or_na
from dealflow.schema import LISTING_SCHEMA, NUMERIC_COLUMNS, RECORD_COLUMNS

# Columns a repeated URL overwrites; every other column keeps its first value.
COLLECTOR_UPDATES = [
    "title", "price", "gross_revenue", "cash_flow", "ebitda", "inventory",
    "financial_data", "extra_information", "description", "scraping_date",
]
UPLOAD_UPDATES = [
    "title", "price", "gross_revenue", "cash_flow", "ebitda", "description", "description_embedding",
]


def normalise_records(records: DataFrame) -> DataFrame:
    """Normalise all 22 text columns; a column that is absent reads as missing.

    Trimming comes as a projection of its own, so that each trimmed text is made once.
    """
    texts = {c: F.col(c).cast("string") if c in records.columns else F.lit(None).cast("string") for c in RECORD_COLUMNS}
    trimmed = records.withColumns({c: strip_space(t) for c, t in texts.items()})
    return trimmed.withColumns({c: value_or_na(F.col(c)) for c in RECORD_COLUMNS})


def has_url(url: str = "url") -> Column:
    return is_present(F.col(url))


def split_rejects(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with a URL, and the others with the reason they cannot be stored."""
    return records.where(has_url()), records.where(~has_url()).withColumn("error", F.lit("Missing URL"))


def known_urls(listings: DataFrame, batch: DataFrame) -> DataFrame:
    """Those URLs of the batch that are stored already.

    The table is the streamed side and only its URL column is read, so with a batch that Spark may broadcast the
    table is not shuffled; a larger batch becomes a sort-merge join. The batch's URLs are made distinct before, so one
    that fills much of it is a single row.
    """
    return listings.select("url").join(batch.where(has_url()).select("url").distinct(), "url", "left_semi")


def existing_rows(batch: DataFrame, listings: DataFrame) -> DataFrame:
    return batch.join(known_urls(listings, batch), "url", "left_semi")


def new_rows(batch: DataFrame, listings: DataFrame) -> DataFrame:
    return batch.join(known_urls(listings, batch), "url", "left_anti")


def urls_of_source(listings: DataFrame, source: str) -> DataFrame:
    return listings.where(F.col("source") == F.lit(source)).select("url")


def collapse(batch: DataFrame, updates: list[str]) -> DataFrame:
    """One row per URL: the first record's values, and the last record's for the columns that updates overwrite.

    ``min_by``/``max_by`` combine before the shuffle, so a URL that fills much of the batch arrives as one row per
    task.
    """
    fixed = [c for c in batch.columns if c not in updates and c not in ("url", "seq")]
    return batch.groupBy("url").agg(
        F.min("seq").alias("seq"),
        F.min_by(F.struct(*fixed), "seq").alias("first"),
        F.max_by(F.struct(*updates), "seq").alias("last"),
    )


def upsert(
    listings: DataFrame,
    batch: DataFrame,
    as_of=None,
    updates: list[str] = COLLECTOR_UPDATES,
    reset_changed_embeddings: bool = False,
    largest: int | None = None,
    together: tuple[Callable[[str], Column], int] | None = None,
) -> DataFrame:
    """The listing table after the batch, applied in ``seq`` order.

    A known URL gets the batch's last values for ``updates`` and a new last-seen date; a new URL becomes a row.
    Numbers are derived again for the touched rows only. Table and batch, reduced to one row per URL, meet in one full
    join, so each is computed once; a table bucketed by URL is not shuffled and its rows stay in their buckets.
    ``largest`` is the largest id so far, else that of ``listings``. ``together`` names a bucket of a URL and a number of
    partitions: rows then meet, and stay, by bucket.
    """
    now = moment(as_of)
    listings = as_listings(listings)
    top = F.lit(largest) if largest is not None else listings.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    merged = collapse(batch.where(has_url()), updates)
    merged = merged.select(F.col("url").alias("_url"), F.col("seq").alias("_seq"), "first", "last")
    stored = listings.withColumn("_stored", F.lit(True))
    same = F.col("url") == F.col("_url")
    if together:
        bucket_of, parts = together
        stored = stored.withColumn("_at", bucket_of("url")).repartition(parts, "_at")
        merged = merged.withColumn("_to", bucket_of("_url")).repartition(parts, "_to")
        same = (F.col("_at") == F.col("_to")) & same
    met = stored.join(merged, same, "full_outer")

    touched, fresh = F.col("_url").isNotNull(), F.col("_stored").isNull()
    values = {c: F.when(fresh, F.col(f"first.{c}")).otherwise(F.col(c)) for c in batch.columns if c in listings.columns}
    values |= {c: F.when(touched, F.col(f"last.{c}")).otherwise(F.col(c)) for c in updates}
    for num, text in NUMERIC_COLUMNS.items():
        values[num] = F.when(touched, money_numeric(F.col(f"last.{text}"))).otherwise(F.col(num))
    if reset_changed_embeddings and "description_embedding" not in updates:
        changed = touched & ~fresh & ~F.col("last.description").eqNullSafe(F.col("description"))
        kept = values.get("description_embedding", F.col("description_embedding"))
        values["description_embedding"] = F.when(~changed, kept)
    values |= {
        "id": F.coalesce("id", top + 1 + F.col("_seq")),
        "url": F.coalesce("url", "_url"),
        "listing_hash": F.when(fresh, url_hash(F.col("_url"))).otherwise(F.col("listing_hash")),
        "first_seen_date": F.when(fresh, now).otherwise(F.col("first_seen_date")),
        "last_seen_date": F.when(touched, now).otherwise(F.col("last_seen_date")),
    }
    return as_listings(met.select(*[values.get(c, F.col(c)).alias(c) for c in listings.columns]))


def added_ids(listings: DataFrame, rows: DataFrame) -> DataFrame:
    """Give new rows the id ``largest id + 1 + seq`` (ids may have gaps)."""
    largest = listings.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return rows.withColumn("id", largest + 1 + F.col("seq"))


def added_listings(listings: DataFrame, rows: DataFrame, as_of=None) -> DataFrame:
    """Rows of new URLs as listings, with id, hash, numbers and dates."""
    now = moment(as_of)
    added = with_numeric_columns(added_ids(listings, rows)).withColumns(
        {"listing_hash": url_hash(F.col("url")), "first_seen_date": now, "last_seen_date": now}
    )
    return as_listings(added)


def as_listings(df: DataFrame) -> DataFrame:
    """Exactly the stored columns and types: absent numbers are derived, other absent columns are NULL."""
    absent = [c for c in NUMERIC_COLUMNS.values() if c not in df.columns]
    df = ensure_numeric_columns(df.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else df)
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LISTING_SCHEMA
        ]
    )
