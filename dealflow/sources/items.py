"""Result pages of the search API as files of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealflow.operators.collector import ITEM_SCHEMA, map_items
from dealflow.operators.numbering import ORIGIN, number_rows, with_origin
from dealflow.operators.screen import passes_screen

PAGE_SCHEMA = T.StructType([T.StructField("results", T.ArrayType(ITEM_SCHEMA))])


def read_items(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One row per result item, as an ``item`` struct."""
    pages = with_origin(spark.read.schema(PAGE_SCHEMA).json(path, multiLine=multi_line))
    return pages.select(*ORIGIN, F.explode("results").alias("item"))


def collect_items(
    items: DataFrame,
    source: str,
    base_url: str,
    scraping_date: str,
    mode: str = "all",
    limit: int = 0,
    legacy_na: bool = False,
) -> DataFrame:
    """Mapped records that pass the screen, numbered in page order; the first ``limit`` of them when it is set."""
    records = map_items(items, source, base_url, scraping_date, legacy_na=legacy_na).where(passes_screen(mode))
    numbered = number_rows(records, "seq")
    return numbered.where(F.col("seq") < limit) if limit > 0 else numbered
