"""CSV in and out: listing files, URL lists, and the 22-column output file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.functions.text import is_auction_url, strip_space
from dealflow.operators.numbering import ORIGIN, number_rows, with_origin
from dealflow.operators.upsert import normalise_records
from dealflow.schema import COLLECTOR_COLUMNS
from dealflow.session import materialise
from dealflow.sources.records import cells, read_records, read_table


def map_columns(df: DataFrame) -> DataFrame:
    """Display-named columns to record columns; unknown ones go, missing ones read as empty text."""
    return df.select(
        *[c for c in ORIGIN if c in df.columns],
        *[
            (F.col(f"`{shown}`") if shown in df.columns else F.lit("")).alias(name)
            for shown, name in COLLECTOR_COLUMNS.items()
        ]
    )


def read_listing_csv(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """Records of listing files with a header row, as text, with ``seq``, their 0-based position (by file name, then row).

    Cells may hold line breaks, and one large file is read by many tasks; see ``sources.records``. Pass
    ``line_breaks=False`` for files known to have none: they are read once and split by line, and ``numbered_records``
    numbers them. Bytes that are not UTF-8 become the replacement character.
    """
    if line_breaks:
        return read_table(spark, path, COLLECTOR_COLUMNS)
    raw = spark.read.csv(path, header=True, multiLine=False, escape='"', inferSchema=False, encoding="UTF-8")
    return map_columns(with_origin(raw))


def numbered_records(records: DataFrame) -> DataFrame:
    """Normalised records with ``seq``, their 0-based position (by file name, then row); stored once for later steps."""
    if "seq" in records.columns:
        return materialise(normalise_records(records), "records")
    return number_rows(normalise_records(records), "seq")


def write_listing_csv(records: DataFrame, path: str) -> None:
    """The 22 columns under their display names; a missing value is an empty cell."""
    shown = records.select(
        *[
            F.coalesce(F.col(name) if name in records.columns else F.lit(None), F.lit("")).alias(title)
            for title, name in COLLECTOR_COLUMNS.items()
        ]
    )
    shown.write.csv(
        path,
        header=True,
        escape='"',
        emptyValue="",
        encoding="UTF-8",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def first_url(cells: Column, domain: str) -> Column:
    """The first cell that is a link to the site, NULL when none is."""
    links = F.filter(
        F.transform(cells, strip_space), lambda c: c.startswith("http") & F.contains(c, F.lit(domain))
    )
    return F.get(links, F.lit(0))


def listing_urls(rows: DataFrame, domain: str, cells: str = "cells", order: str = "seq") -> DataFrame:
    """Distinct first links of the rows with the position of their first row; auction pages are left out."""
    found = rows.select(first_url(F.col(cells), domain).alias("url"), F.col(order).alias("seq"))
    found = found.where(F.col("url").isNotNull() & ~is_auction_url(F.col("url")))
    return found.groupBy("url").agg(F.min("seq").alias("seq"))


def read_url_rows(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every record of header-less CSV files of any width, numbered: ``cells array<string>, seq``.

    Quoted cells may hold line breaks, and one large file is read by many tasks.
    """
    return read_records(spark, path).select(cells("text").alias("cells"), "seq")
