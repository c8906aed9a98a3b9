"""Consecutive row numbers for large results, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealflow.session import materialise

_PART, _BLOCK, _POSITION = "_part", "_origin", "_position"
_RANGE = "_range"
# Where a row comes from: its file and the part of that file which one task reads.
ORIGIN = {"_file": "_metadata.file_path", "_block": "_metadata.file_block_start"}


def with_origin(files: DataFrame) -> DataFrame:
    """Remember each row's file and block, for ``number_rows``."""
    return files.select("*", *[F.col(source).alias(name) for name, source in ORIGIN.items()])


def number_rows(df: DataFrame, column: str) -> DataFrame:
    """Add 0-based row numbers: by file name and position after ``with_origin``, else in the current order of ``df``.

    The rows are written once with their task and their position in it. Within a task the rows of a block follow each
    other, so a row's number is its distance from the block's first row plus the sizes of the earlier blocks, and only
    one short row per block and task is ever brought together.
    """
    origin = [c for c in ORIGIN if c in df.columns]
    block = F.xxhash64(*origin) if origin else F.lit(0).cast("long")
    # The high bits are the task, the low 33 the position.
    place = F.monotonically_increasing_id()
    stored = materialise(df.withColumn(_POSITION, place).withColumn(_BLOCK, block), "numbered")
    placed = stored.withColumn(_PART, F.shiftright(_POSITION, 33))
    keys = [*origin, _PART, _BLOCK]
    blocks = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.min(_POSITION).alias("_first"))
    starts = running_starts(blocks, keys).select(_PART, _BLOCK, (F.col("_before") - F.col("_first")).alias("_offset"))
    return (
        # One short row per block and task; the rows themselves are not shuffled.
        placed.join(F.broadcast(starts), [_PART, _BLOCK])
        .withColumn(column, F.col("_offset") + F.col(_POSITION))
        .drop(*keys, _POSITION, "_offset")
    )


def running_starts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_before``, the rows of all earlier blocks. Blocks are added up within ranges of the order, then the
    ranges themselves, of which there are no more than shuffle partitions."""
    ranged = materialise(blocks.repartitionByRange(*keys).withColumn(_RANGE, F.spark_partition_id()), "blocks")
    sums = ranged.groupBy(_RANGE).agg(F.sum("_rows").alias("_sum"))
    earlier = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(_RANGE, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(_RANGE).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    near = ranged.withColumn("_near", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
    return near.join(bases, _RANGE).withColumn("_before", F.col("_base") + F.col("_near"))
