"""From collected records to a new snapshot of the listing table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dealflow.operators.upsert import normalise_records, split_rejects
from dealflow.sources.csv import write_listing_csv
from dealflow.sources.listings import ListingStore


def ingest(store: ListingStore, records: DataFrame, as_of=None, fallback_csv: str | None = None) -> int:
    """Merge records (with ``seq``) into the newest snapshot and return the new one's number.

    All or nothing: a failing merge leaves the table as it is, and the records go to ``fallback_csv`` if given.
    """
    accepted, _ = split_rejects(normalise_records(records))
    try:
        return store.merge(accepted, as_of)
    except Exception:
        if fallback_csv is not None:
            write_listing_csv(records, fallback_csv)
        raise
