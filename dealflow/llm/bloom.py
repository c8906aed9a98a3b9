"""A blocked Bloom filter of bounded size, in DataFrame functions.

All bits of a key lie in one block of 512 bits. The filter is a table of blocks that is sent to every task; a longer
list than it is made for lets more keys through, so what passes is always checked by an exact join behind it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 512  # eight longs: one cache line
PROBES = 6
BITS_PER_KEY = 12
MOST_BLOCKS = 1 << 19  # 32 MB


def block_count(keys: int) -> int:
    """Blocks for that many keys, up to ``MOST_BLOCKS``."""
    return max(1, min(MOST_BLOCKS, math.ceil(keys * BITS_PER_KEY / BLOCK_BITS)))


def _block(key: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(count))


def _bits(key: Column) -> list[Column]:
    """The places of the key's ``PROBES`` bits within its block; nine bits of hash choose each."""
    code = F.xxhash64(key, F.lit("bits"))
    return [F.shiftrightunsigned(code, 9 * k).bitwiseAND(BLOCK_BITS - 1).cast("int") for k in range(PROBES)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63))


def build(keys: DataFrame, column: str, count: int) -> DataFrame:
    """The filter of ``count`` blocks over the keys: ``block`` and its eight words ``bits``; empty blocks are left out."""
    key = F.col(column)
    places = keys.select(_block(key, count).alias("block"), F.explode(F.array(*_bits(key))).alias("place"))
    words = [
        F.bit_or(F.when(F.shiftright("place", 6) == n, _bit(F.col("place"))).otherwise(F.lit(0).cast("long")))
        for n in range(BLOCK_BITS // 64)
    ]
    return places.groupBy("block").agg(F.array(*words).alias("bits"))


def test(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_maybe``: false only if the value in ``column`` is surely none of ``keys``.

    ``keys`` are counted and read once more, so they should be stored.
    """
    count = block_count(keys.count())
    # At most 2^19 blocks of 64 bytes, whatever the number of keys.
    blocks = F.broadcast(build(keys, key, count).select(F.col("block").alias("_block"), F.col("bits").alias("_bits")))
    # Probe by probe, not as a function of an array, which Spark interprets row by row.
    probes = [F.col("_bits")[F.shiftright(p, 6)].bitwiseAND(_bit(p)) != 0 for p in _bits(F.col(column))]
    known = reduce(Column.__and__, probes)
    tested = rows.join(blocks, _block(F.col(column), count) == F.col("_block"), "left")
    return tested.withColumn("_maybe", F.coalesce(known, F.lit(False))).drop("_block", "_bits")


def screen(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows that may hold one of ``keys``, before an exact join with them."""
    return test(rows, column, keys, key).where("_maybe").drop("_maybe")
