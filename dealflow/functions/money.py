"""Money text to numbers. All functions are Column -> Column and stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.functions.text import strip_space
from dealflow.schema import MONEY, NUMERIC_COLUMNS

PLAIN_NUMBER = r"\A[+-]?[0-9]+(\.[0-9]+)?\z"


def _plain_number(text: Column) -> Column:
    """Accounting brackets become a minus sign, then thousands marks, dollar signs and blanks go.

    Texts for "no amount" (empty, ``N/A``, ``none``, dashes) are no numbers afterwards either.
    """
    signed = F.regexp_replace(text, r"(?s)\A\((.*)\)\z", "-$1")
    return F.translate(signed, ",$ ", "")


def money_numeric(value: Column) -> Column:
    """Exact decimal of a money text, NULL when it is not one. Only blanks are trimmed, not tabs or line ends."""
    number = _plain_number(F.trim(value))
    return F.when(number.rlike(PLAIN_NUMBER), number.try_cast(MONEY))


def money_float(value: Column) -> Column:
    """Floating-point reading of a money text; any white space around it is ignored."""
    number = F.rtrim(_plain_number(strip_space(value)), F.lit("\n"))
    return F.when(number.rlike(PLAIN_NUMBER), number.try_cast("double"))


def money_loose(value: Column) -> Column:
    """Digits and points only (sign and suffix are lost), 0.0 when that is not a number, as for ``N/A``."""
    return F.coalesce(F.regexp_replace(value, "[^0-9.]", "").try_cast("double"), F.lit(0.0))


def with_numeric_columns(df: DataFrame) -> DataFrame:
    """Set the four ``*_num`` columns from their texts."""
    return df.withColumns({num: money_numeric(F.col(text)) for num, text in NUMERIC_COLUMNS.items()})


def ensure_numeric_columns(df: DataFrame) -> DataFrame:
    """Use the stored ``*_num`` columns, or derive all four when any is absent."""
    if set(NUMERIC_COLUMNS) <= set(df.columns):
        return df
    return with_numeric_columns(df)


def with_money_fields(df: DataFrame) -> DataFrame:
    """Add ``{price,gross_revenue,cash_flow,ebitda}_numeric``: the stored number, else the parsed text."""
    return df.withColumns(
        {
            f"{text}_numeric": F.coalesce(F.col(num).cast("double"), money_float(F.col(text)))
            for num, text in NUMERIC_COLUMNS.items()
        }
    )


def numeric_drift(df: DataFrame) -> DataFrame:
    """Rows whose stored numbers differ from their texts, with the numbers set right."""
    stale = F.lit(False)
    for num, text in NUMERIC_COLUMNS.items():
        stale = stale | ~F.col(num).eqNullSafe(money_numeric(F.col(text)))
    return with_numeric_columns(df.where(stale))
