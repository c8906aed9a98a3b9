"""Dashboard reports over the listings seen within a look-back window.

The snapshot, the funnel, the data-quality shares and the source yield are all roll-ups of one small table of
counts per (source, industry), so a full dashboard reads the listings twice: once for the counts, once for the
priority queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.functions.text import display_text, is_present, moment, share, source_label

DEFAULT_SCOPE = ["US", "CA"]

# Screening limits and score weights.
CASH_FLOW_FIT = 2_000_000
CASH_FLOW_NEAR = 1_000_000
LARGE_REVENUE = 10_000_000
SCORE_LOCAL, SCORE_CASH_FLOW, SCORE_CASH_FLOW_NEAR, SCORE_MARGIN, SCORE_REVENUE, SCORE_NEW = 20, 35, 20, 25, 10, 10


def country_scope(text: str | list[str] | None) -> list[str]:
    """Upper-cased country codes in first-seen order; the default scope when none is given."""
    chunks = text.split(",") if isinstance(text, str) else (text or [])
    codes = dict.fromkeys(c.strip().upper() for c in chunks)
    return [c for c in codes if c] or list(DEFAULT_SCOPE)


def seen_within(as_of, days: int) -> Column:
    """Last seen (else first seen) within ``days``; spelled so that both comparisons reach the Parquet reader."""
    start = moment(as_of) - F.make_interval(days=F.lit(days))
    last, first = F.col("last_seen_date"), F.col("first_seen_date")
    return (last >= start) | (last.isNull() & (first >= start))


def is_local(scope=None) -> Column:
    return F.upper(F.trim(F.coalesce(F.col("country"), F.lit("")))).isin(country_scope(scope))


def cash_flow_fit() -> Column:
    return F.col("cash_flow_num") >= CASH_FLOW_FIT


def margin_fit() -> Column:
    """EBITDA at least a tenth of a positive revenue, by multiplication (no division by zero, no rounding)."""
    revenue, ebitda = F.col("gross_revenue_num"), F.col("ebitda_num")
    return F.coalesce((revenue > 0) & (ebitda * 10 >= revenue), F.lit(False))


def is_new_week(as_of) -> Column:
    return F.col("first_seen_date") >= moment(as_of) - F.expr("INTERVAL 7 DAYS")


def in_scope(listings: DataFrame, as_of=None, lookback_days: int = 90) -> DataFrame:
    if lookback_days < 1:
        raise ValueError("lookback_days must be at least 1")
    return listings.where(seen_within(as_of, lookback_days))


def with_flags(listings: DataFrame, as_of=None, scope=None) -> DataFrame:
    return listings.withColumns(
        {
            "is_local": is_local(scope),
            "cash_flow_fit": cash_flow_fit(),
            "margin_fit": margin_fit(),
            "is_new_week": is_new_week(as_of),
        }
    )


def group_counts(listings: DataFrame, as_of=None, lookback_days: int = 90, scope=None) -> DataFrame:
    """Conditional counts per (source, industry): one scan, combined before the shuffle."""
    flagged = with_flags(in_scope(listings, as_of, lookback_days), as_of, scope)
    qualified = F.col("is_local") & F.col("cash_flow_fit") & F.col("margin_fit")
    return flagged.groupBy("source", "industry").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_new_week").alias("new"),
        F.count_if(qualified).alias("qualified"),
        F.count_if("is_local").alias("local"),
        F.count_if("cash_flow_fit").alias("cash_flow"),
        F.count_if("margin_fit").alias("margin"),
        F.count("gross_revenue_num").alias("has_revenue"),
        F.count("ebitda_num").alias("has_ebitda"),
        F.count("cash_flow_num").alias("has_cash_flow"),
        F.count_if(is_present(F.col("state")) & is_present(F.col("country"))).alias("has_location"),
    )


def overall_counts(groups: DataFrame) -> DataFrame:
    """One row of totals, all zero for an empty window."""
    sums = [
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in groups.columns if c not in ("source", "industry")
    ]
    distinct = [
        F.countDistinct(F.when(is_present(F.col(c)), F.col(c))).alias(name)
        for c, name in (("source", "active_sources"), ("industry", "distinct_industries"))
    ]
    return groups.agg(*sums, *distinct)


def snapshot(groups: DataFrame) -> DataFrame:
    return overall_counts(groups).select(
        F.col("total").alias("total_listings"),
        F.col("new").alias("new_this_week"),
        F.col("qualified").alias("qualified_count"),
        F.coalesce(share(F.col("qualified"), F.col("total")), F.lit(0.0)).alias("pass_rate"),
        "active_sources",
        "distinct_industries",
    )


def criteria_funnel(groups: DataFrame) -> DataFrame:
    """Five stages, each counted on its own; the label of the second is fixed whatever the scope."""
    return overall_counts(groups).selectExpr(
        "stack(5, 1, 'All Listings', total, 2, 'Local (US/CA)', local, 3, 'Cash Flow Fit', cash_flow, "
        "4, 'Margin Fit', margin, 5, 'Shortlist', qualified) AS (position, stage, count)"
    )


def data_quality(groups: DataFrame) -> DataFrame:
    return overall_counts(groups).select(
        *[
            F.coalesce(share(F.col(f"has_{c}"), F.col("total")), F.lit(0.0)).alias(f"parseable_{c}_pct")
            for c in ("revenue", "ebitda", "cash_flow", "location")
        ]
    )


def source_yield(groups: DataFrame) -> DataFrame:
    """Totals and qualified share per source label, best share first."""
    labelled = groups.groupBy(source_label(F.col("source")).alias("source")).agg(
        F.sum("total").alias("total"), F.sum("qualified").alias("qualified")
    )
    exact_rate = F.col("qualified") / F.col("total")
    return labelled.orderBy(
        exact_rate.desc(), F.col("qualified").desc(), F.col("total").desc(), F.col("source").asc()
    ).withColumn("qualified_rate", share(F.col("qualified"), F.col("total")))


def fit_score(as_of=None, scope=None) -> Column:
    """0 to 100 points for place, cash flow, margin, size and age."""

    def points(hit: Column, value: int) -> Column:
        return F.when(hit, value).otherwise(0)

    cash_flow = (
        F.when(cash_flow_fit(), SCORE_CASH_FLOW)
        .when(F.col("cash_flow_num") >= CASH_FLOW_NEAR, SCORE_CASH_FLOW_NEAR)
        .otherwise(0)
    )
    total = (
        points(is_local(scope), SCORE_LOCAL)
        + cash_flow
        + points(margin_fit(), SCORE_MARGIN)
        + points(F.col("gross_revenue_num") >= LARGE_REVENUE, SCORE_REVENUE)
        + points(is_new_week(as_of), SCORE_NEW)
    )
    return F.least(F.lit(100), total)


def fit_reasons(as_of=None, scope=None) -> Column:
    """Labels of the criteria that scored, in fixed order."""
    return F.array_compact(
        F.array(
            F.when(is_local(scope), "Local"),
            F.when(cash_flow_fit(), "Cash Flow Fit").when(
                F.col("cash_flow_num") >= CASH_FLOW_NEAR, "Cash Flow Near Fit"
            ),
            F.when(margin_fit(), "Margin Fit"),
            F.when(F.col("gross_revenue_num") >= LARGE_REVENUE, "Revenue >= $10M"),
            F.when(is_new_week(as_of), "New This Week"),
        )
    )


def priority_queue(
    listings: DataFrame, as_of=None, lookback_days: int = 90, scope=None, limit: int = 12
) -> DataFrame:
    """The best-scoring listings; labels and display texts are made for the chosen rows only."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    scored = in_scope(listings, as_of, lookback_days).withColumn("fit_score", fit_score(as_of, scope))
    top = scored.orderBy(
        F.col("fit_score").desc(), F.col("first_seen_date").desc_nulls_last(), F.col("id").desc()
    ).limit(limit)
    shown = ["title", "state", "country", "gross_revenue", "ebitda", "cash_flow"]
    return top.select(
        "id",
        source_label(F.col("source")).alias("source"),
        *[display_text(F.col(c)).alias(c) for c in shown],
        "first_seen_date",
        "fit_score",
        fit_reasons(as_of, scope).alias("reasons"),
    )
