"""Merging records into the listing table as files of them arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dealflow.operators.numbering import number_rows, with_origin
from dealflow.operators.upsert import normalise_records, split_rejects
from dealflow.schema import RECORD_COLUMNS
from dealflow.sources.buckets import BucketStore
from dealflow.sources.listings import ListingStore

RECORD_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RECORD_COLUMNS])


def record_stream(
    spark: SparkSession, path: str, file_format: str = "json", files_per_batch: int | None = None
) -> DataFrame:
    """Record files (JSON lines or Parquet) as they appear in a folder; within a batch files count in name order."""
    schema = RECORD_SCHEMA
    if file_format == "json":
        # A line that is no JSON has no URL either, and goes to the rejects as it came.
        schema = T.StructType([*RECORD_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_origin(reader.load(path))


def merge_batch(store: ListingStore | BucketStore, reject_path: str, records: DataFrame, batch_id: int) -> None:
    """Merge one micro-batch into a new snapshot. Merging a batch again, after a lost run, finds every URL stored and
    adds no row.

    Records without a URL go to ``reject_path`` and do not hold up the others.
    """
    numbered = number_rows(normalise_records(records), "seq")
    accepted, rejected = split_rejects(numbered)
    rejected.write.mode("overwrite").parquet(f"{reject_path}/batch={batch_id}")
    store.merge(accepted)


def start_ingest(
    records: DataFrame, store: ListingStore | BucketStore, reject_path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Run the merge for every micro-batch, by default for all files present and then stop.

    Into a ``BucketStore`` a merge reads and rewrites only the buckets of the micro-batch's URLs; a ``ListingStore`` writes a
    whole snapshot, so give it few and large batches.
    """
    return (
        records.writeStream.foreachBatch(
            lambda batch, batch_id: merge_batch(store, reject_path, batch, batch_id)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
