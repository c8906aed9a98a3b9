"""Response, offer and close rates of the deals in progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.functions.text import moment, share
from dealflow.schema import SLA_COLUMNS

# Result name -> (end time, time allowed).
SLA_LIMITS = {
    "response_48h_rate": ("responded_at", "48 HOURS"),
    "offer_5d_rate": ("offered_at", "5 DAYS"),
    "close_60d_rate": ("closed_at", "60 DAYS"),
}
FINISHED = ["closed", "lost", "dead"]


def _within(end: str, allowed: str) -> Column:
    in_time = F.col(end) <= F.col("created_at") + F.expr(f"INTERVAL {allowed}")
    both = F.col("created_at").isNotNull() & F.col(end).isNotNull()
    return share(F.count_if(in_time), F.count_if(both))


def sla_rates(
    spark: SparkSession, deals: DataFrame | None, as_of=None, lookback_days: int = 90
) -> DataFrame:
    """One row of rates; all NULL when there is no such table or it lacks a needed column."""
    if deals is None or not set(SLA_COLUMNS) <= set(deals.columns):
        rates = [F.lit(None).cast("double").alias(n) for n in SLA_LIMITS]
        return spark.range(1).select(*rates, F.lit(None).cast("bigint").alias("in_pipeline"))
    recent = deals.where(F.col("created_at") >= moment(as_of) - F.make_interval(days=F.lit(lookback_days)))
    open_deal = ~F.coalesce(F.lower(F.trim("status")), F.lit("")).isin(FINISHED)
    return recent.agg(
        *[_within(*limit).alias(name) for name, limit in SLA_LIMITS.items()],
        F.count_if(open_deal).alias("in_pipeline"),
    )
