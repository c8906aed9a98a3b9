"""Uploading a batch of listings: exact and semantic duplicate checks, embedding, merge and report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.functions.text import format_utc, moment
from dealflow.operators.embed import RETRY_WAIT, EmbedFn, description_text, embed_column
from dealflow.operators.upload import (
    classify,
    deal_answers,
    duplicate_report,
    form_records,
    semantic_duplicates,
    upload_errors,
    upload_summary,
)
from dealflow.operators.upsert import added_ids, added_listings, as_listings
from dealflow.session import materialise


@dataclass(frozen=True)
class UploadResult:
    """``listings`` is the table after the upload, ``added`` its new rows; the rest reports on the batch."""

    outcomes: DataFrame
    summary: DataFrame
    errors: DataFrame
    similar: DataFrame
    report: DataFrame
    added: DataFrame
    listings: DataFrame


def upload(
    listings: DataFrame,
    batch: DataFrame,
    embed_fn: EmbedFn,
    as_of=None,
    check_skipped: bool = False,
    retry_wait: float = RETRY_WAIT,
) -> UploadResult:
    """Upload records with ``seq`` (file order). Similar listings are flagged but never keep a row out.

    A row is compared with the stored listings and with the rows inserted before it. ``check_skipped`` also reports
    what the skipped rows resemble, as the entry form does.
    """
    now = moment(as_of)
    listings = as_listings(listings)
    outcomes = classify(batch, listings)
    vector = embed_column(description_text(), embed_fn, retry_wait=retry_wait)
    # Model calls are made once, for the check and the table alike; everything below reads their stored results.
    done = materialise(outcomes.withColumn("description_embedding", vector), "upload")

    inserted = done.where(F.col("status") == "inserted")
    asked = done if check_skipped else inserted
    known = F.col("description_embedding").alias("embedding")
    queries = asked.where(F.col("status") != "error").select(F.col("seq").alias("query_id"), known, "seq")
    # Every row that is let in has a new URL, so they are added as they are, without touching the stored rows.
    dated = inserted.withColumn("scraping_date", format_utc(now, "yyyy-MM-dd"))
    added = added_listings(listings, dated, now)
    after = listings.unionByName(added)

    stored = listings.select("id", known, F.lit(-1).cast("long").alias("seq"))
    earlier = added_ids(listings, inserted).select("id", known, "seq")
    similar = semantic_duplicates(queries, stored.unionByName(earlier))
    return UploadResult(
        outcomes=done.drop("description_embedding"),
        summary=upload_summary(done),
        errors=upload_errors(done),
        similar=similar,
        report=duplicate_report(similar, done, after),
        added=added,
        listings=after,
    )


def enter_deals(
    listings: DataFrame, deals: DataFrame, embed_fn: EmbedFn, as_of=None, retry_wait: float = RETRY_WAIT
) -> tuple[UploadResult, DataFrame]:
    """Store deals typed into the entry form and answer each: the upload's result and ``operators.upload.deal_answers``.

    Deals without a URL get one made from their title and description. All deals, the skipped ones too, are compared
    with stored listings and earlier deals.
    """
    result = upload(listings, form_records(deals), embed_fn, as_of, check_skipped=True, retry_wait=retry_wait)
    return result, deal_answers(result.outcomes, result.similar, result.listings)
