"""The full dashboard: every report over one look-back window and country scope."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.functions.text import iso_utc, moment
from dealflow.operators import dashboard as d
from dealflow.operators.sla import sla_rates
from dealflow.session import materialise


@dataclass(frozen=True)
class Overview:
    generated_at: DataFrame
    snapshot: DataFrame
    criteria_funnel: DataFrame
    source_yield: DataFrame
    priority_queue: DataFrame
    sla: DataFrame
    data_quality: DataFrame


def overview(
    listings: DataFrame,
    deals: DataFrame | None = None,
    as_of=None,
    lookback_days: int = 90,
    priority_limit: int = 12,
    scope: str | list[str] | None = None,
) -> Overview:
    spark = listings.sparkSession
    # Four sections are roll-ups of these few rows; stored, they cost one scan in all.
    groups = materialise(d.group_counts(listings, as_of, lookback_days, scope), "group-counts")
    return Overview(
        generated_at=spark.range(1).select(iso_utc(moment(as_of)).alias("generated_at")),
        snapshot=d.snapshot(groups),
        criteria_funnel=d.criteria_funnel(groups),
        source_yield=d.source_yield(groups),
        priority_queue=d.priority_queue(listings, as_of, lookback_days, scope, priority_limit),
        sla=sla_rates(spark, deals, as_of, lookback_days),
        data_quality=d.data_quality(groups),
    )


def measures(section: str, row: DataFrame) -> DataFrame:
    """A one-row report as ``section, item, value`` rows."""
    values = row.select(*[F.col(c).cast("double").alias(c) for c in row.columns])
    return values.unpivot([], row.columns, "item", "value").select(F.lit(section).alias("section"), "item", "value")


def overview_rows(found: Overview) -> DataFrame:
    """All sections in one long table, so that a single job fills the dashboard."""
    parts = [
        measures("snapshot", found.snapshot),
        found.criteria_funnel.select(F.lit("criteria_funnel"), "stage", F.col("count").cast("double")),
        measures("data_quality", found.data_quality),
        measures("sla", found.sla),
        found.source_yield.select(F.lit("source_yield"), "source", "qualified_rate"),
        found.priority_queue.select(
            F.lit("priority_queue"), F.col("id").cast("string"), F.col("fit_score").cast("double")
        ),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result
