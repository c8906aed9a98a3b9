"""Uploaded records: what happens to each row, and which stored listings it resembles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.functions.text import manual_url
from dealflow.operators.knn import nearest
from dealflow.operators.upsert import has_url, new_rows
from dealflow.schema import RECORD_COLUMNS

DUPLICATE_DISTANCE = 0.15
SIMILAR_SHOWN = 5

# What an entered deal holds where the form leaves a field out, and the answers' wording.
FORM_DEFAULTS = {"source": "Manual", "country": "US"}


SUMMARY = "Processed CSV: %d inserted, %d skipped (duplicates), %d errors."
NO_URL = "Missing URL"


def classify(batch: DataFrame, listings: DataFrame) -> DataFrame:
    """Add ``status``: ``error`` without URL, ``inserted`` for the first row of a new URL, else ``skipped``.

    The winning row of each URL is found by a combining aggregate and joined back on ``seq``, which is unique, so
    a URL that fills much of the batch does not make one large group.
    """
    winners = batch.where(has_url()).groupBy("url").agg(F.min("seq").alias("seq"))
    fresh = new_rows(winners, listings).select("seq", F.lit(True).alias("fresh"))
    return (
        batch.join(fresh, "seq", "left")
        .withColumn(
            "status",
            F.when(~has_url(), "error").when(F.col("fresh"), "inserted").otherwise("skipped"),
        )
        .drop("fresh")
    )


def upload_summary(outcomes: DataFrame) -> DataFrame:
    counts = outcomes.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("inserted", "skipped", "error")]
    )
    return counts.select(
        "inserted",
        F.col("skipped").alias("skipped_duplicates"),
        F.col("error").alias("error_count"),
        F.format_string(SUMMARY, "inserted", "skipped", "error").alias("message"),
    )


def upload_errors(outcomes: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows that could not be stored (file rows count from 2, the header being row 1), or the first ``limit``."""
    failed = outcomes.where(F.col("status") == "error")
    found = failed.select((F.col("seq") + 2).alias("row"), F.lit(NO_URL).alias("error"))
    return found if limit is None else found.orderBy("row").limit(limit)


def form_records(deals: DataFrame) -> DataFrame:
    """Entered deals as records: absent fields get the form's defaults, texts stay as typed, a URL is made if empty."""
    values = {}
    for name in RECORD_COLUMNS:
        default = F.lit(FORM_DEFAULTS.get(name, ""))
        values[name] = F.coalesce(F.col(name), default) if name in deals.columns else default
    filled = deals.withColumns(values)
    return filled.withColumn("url", manual_url(F.col("url"), F.col("title"), F.col("description")))


def semantic_duplicates(
    queries: DataFrame,
    corpus: DataFrame,
    distance: float = DUPLICATE_DISTANCE,
    shown: int = SIMILAR_SHOWN,
) -> DataFrame:
    """Up to ``shown`` nearest corpus rows below ``distance`` for every query row.

    Give both sides a ``seq`` (-1 for stored listings) to let each row see stored listings and earlier rows only.
    """
    return nearest(queries, corpus, shown, below=distance)


def with_similar(hits: DataFrame, listings: DataFrame) -> DataFrame:
    """``query_id, similar_to``: the listings of its hits, nearest first, at most ``SIMILAR_SHOWN`` each."""
    columns = ["id", "title", "url", "source", "city", "state"]
    found = listings.select(*columns).join(hits, "id")
    similar = F.struct("rank", *columns, "distance")
    return found.groupBy("query_id").agg(F.sort_array(F.collect_list(similar)).alias("similar_to"))


def duplicate_report(hits: DataFrame, batch: DataFrame, listings: DataFrame, limit: int | None = None) -> DataFrame:
    """Flagged rows of the file with the listings they resemble: all of them, or the first ``limit``.

    ``hits.query_id`` is the row's ``seq``. The rows to show are chosen before the listings are looked up.
    """
    if limit is not None:
        first = hits.select("query_id").distinct().orderBy("query_id").limit(limit)
        hits = hits.join(first, "query_id", "left_semi")
    titles = batch.select(F.col("seq").alias("query_id"), F.col("title"))
    found = titles.join(with_similar(hits, listings), "query_id")
    return found.select((F.col("query_id") + 2).alias("row"), "title", "similar_to")


def deal_answers(outcomes: DataFrame, hits: DataFrame, listings: DataFrame) -> DataFrame:
    """What each entered deal is told: ``seq, url, status, message, similar_to``.

    A deal whose URL is stored already is not inserted, but its similar listings are shown all the same.
    """
    similar = with_similar(hits, listings).withColumnRenamed("query_id", "seq")
    answered = outcomes.select("seq", "url", "title", "status").join(similar, "seq", "left")
    known = F.col("status") == "skipped"
    message = (
        F.when(known, "A listing with this URL is stored already.")
        .when(F.col("status") == "error", NO_URL)
        .when(F.col("similar_to").isNotNull(), "Stored; similar listings exist.")
        .otherwise("Stored.")
    )
    status = F.when(known, "duplicate_url").otherwise(F.col("status")).alias("status")
    return answered.select("seq", "url", "title", status, message.alias("message"), "similar_to")
