"""Best rows per group when a group may be very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tasks whose candidates one final task may rank directly; above it, candidates are first thinned in slices.
TASKS_PER_SLICE = 512


def _best(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def top_per_group(
    df: DataFrame, group: str, order: list[Column], k: int, rank: str = "rank", slices: int | None = None
) -> DataFrame:
    """Rows of each group with rank ``1..k``. Spark keeps at most ``k`` rows per group and task before the shuffle.

    On a large cluster even those leave one task per group with many candidates, so they are thinned per
    (group, slice) first.
    """
    if slices is None:
        slices = 1 + df.sparkSession.sparkContext.defaultParallelism // TASKS_PER_SLICE
    if slices > 1:
        sliced = df.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(slices)))
        df = _best(sliced, [group, "_slice"], order, k, rank).drop("_slice", rank)
    return _best(df, [group], order, k, rank)
