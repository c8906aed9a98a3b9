"""Financial screen applied to collected records before they are stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealflow.functions.money import money_loose

# Least amounts by the first figure that is known.
LEAST_EARNINGS = 2_000_000
LEAST_REVENUE = 5_000_000
LEAST_PRICE = 6_000_000
LEAST_SOFTWARE_REVENUE = 2_000_000

SCREEN_MODES = ("all", "non-software", "software")


def passes_screen(mode: str = "non-software") -> Column:
    """Cash flow or EBITDA decides when known, else revenue, else price; software looks at revenue alone."""
    if mode not in SCREEN_MODES:
        raise ValueError(f"mode must be one of {', '.join(SCREEN_MODES)}")
    if mode == "all":
        return F.lit(True)
    if mode == "software":
        return money_loose(F.col("gross_revenue")) >= LEAST_SOFTWARE_REVENUE

    def decide(amounts: Column) -> Column:
        earnings, revenue, price = (amounts[i] for i in range(3))
        return (
            F.when(earnings > 0, earnings >= LEAST_EARNINGS)
            .when(revenue > 0, revenue >= LEAST_REVENUE)
            .when(price > 0, price >= LEAST_PRICE)
            .otherwise(False)
        )

    earnings = F.greatest(money_loose(F.col("cash_flow")), money_loose(F.col("ebitda")))
    amounts = F.array(earnings, money_loose(F.col("gross_revenue")), money_loose(F.col("price")))
    # Inside the lambda the amounts are values already, so a text is parsed once however the filter is planned.
    return F.transform(F.array(amounts), decide)[0]
