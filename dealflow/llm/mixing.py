"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Every source's documents are put in a shuffled order and cut into blocks of equal words. The mix is a row of slots;
slot ``i`` belongs to the source in whose share of the cumulated targets the golden-ratio point ``frac(i * phi)``
falls, and the slots of a source, ranked, take its blocks in turn, from the first again after the last. The points are
so even that after any number of slots each source has its share but for a few blocks. No block is more than a
thousandth of its source, so these few are little to a small source as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealflow.llm.common import WORD, words
from dealflow.session import materialise

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
GOLDEN = 0.6180339887498949
BLOCK_WORDS = 4096
LEAST_SLOTS = 100_000  # small inputs get smaller blocks
LEAST_BLOCKS = 1000  # that a source is cut into
CELLS = 4096
CHUNK = 1 << 16  # slots ranked together
BUCKET_ROWS = 20_000  # documents put in order together, about


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Targets of the sources of ``sizes(source, source_size)``: ``place, weight, target`` are added.

    Sources stand by code point, a null one last, and weigh ``weights`` in turn. A target is the source's share by
    weight of all words, but at most ``most`` times its own; what that leaves over is shared out again until none is
    above. Sources that stop there are those with the smallest room per weight, so one pass in that order finds the
    common level. One row per source meets in one task.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.asc_nulls_last("source"))
    placed = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size").cast("double"))
    placed = placed.withColumn("room", F.col("cap") / F.col("weight"))
    by_room = everything.orderBy("room", "place")
    total = F.sum("source_size").over(everything).cast("double")
    before = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    placed = placed.withColumn("level", (total - before) / after)
    level = F.min(F.when(F.col("room") >= F.col("level"), F.struct("room", "place", "level"))).over(everything)["level"]
    placed = placed.withColumn("target", F.least("cap", level * F.col("weight")))
    return placed.select("source", "source_size", "place", "weight", "target")


def block_words(total: int) -> int:
    return max(1, min(BLOCK_WORDS, total // LEAST_SLOTS))


def cut_sources(targets: DataFrame, block: int, least: int = LEAST_BLOCKS) -> DataFrame:
    """Cut the sources of ``source_targets`` into blocks: ``per, of, blocks, upto, low, high`` are added.

    A source has at least ``least`` blocks of equal width, ``per / of`` words, which is ``block`` or less; block ``k``
    begins at word ``k * per / of``, rounded up, so in a source of few words some are empty. The schedule has a slot
    for each block's width of the target: ``upto`` are the slots up to this source, and ``low`` and ``high``
    bound its share of them. One row per source meets in one task.
    """
    large = F.col("source_size") >= least * block
    cut = targets.withColumn("per", F.when(large, F.lit(block).cast("long")).otherwise(F.col("source_size")))
    cut = cut.withColumn("of", F.when(large, F.lit(1)).otherwise(F.lit(least)).cast("long"))
    cut = cut.withColumn("blocks", F.when(F.col("per") > 0, F.ceil(F.col("source_size") * F.col("of") / F.col("per"))).otherwise(F.lit(0)))
    by_place = Window.partitionBy(F.lit(0)).orderBy("place")
    slots = F.when(F.col("per") > 0, F.col("target") * F.col("of") / F.col("per")).otherwise(F.lit(0.0))
    cut = cut.withColumn("upto", F.sum(slots).over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = F.max("upto").over(Window.partitionBy(F.lit(0)))
    cut = cut.withColumn("high", F.when(whole > 0, F.col("upto") / whole).otherwise(F.lit(0.0)))
    return cut.withColumn("low", F.coalesce(F.lag("high").over(by_place), F.lit(0.0)))


def schedule(cut: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """The slots of the mix of ``cut_sources``: ``slot, place, rank, block, epoch``.

    Intervals of the sources are looked up by an equi-join on cells of the unit interval. Ranks are counted within
    chunks of slots and the chunks added up, so that a large source is ranked by many tasks.
    """
    cells = F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.least(F.col("high"), F.lit(1 - 1e-12)) * CELLS))
    spans = cut.where("high > low").select("place", "low", "high", "blocks", F.explode(cells).alias("cell"))
    total = cut.agg(F.coalesce(F.floor(F.max("upto") + 0.5), F.lit(0))).first()[0]
    slots = cut.sparkSession.range(total).select(F.col("id").alias("slot"), ((F.col("id") * F.lit(GOLDEN)) % 1.0).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") * CELLS))
    found = slots.join(spans, "cell").where("point >= low AND point < high")
    found = found.select("slot", "place", "blocks", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = found.groupBy("place", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("place", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1
    ranked = found.withColumn("inside", inside).join(counts, ["place", "chunk"])
    ranked = ranked.withColumn("rank", F.col("earlier") + F.col("inside"))
    ranked = ranked.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("epoch", F.floor(F.col("rank") / F.col("blocks")))
    return ranked.where(F.col("epoch") < most).select("slot", "place", "rank", "block", "epoch")


def shuffled(sized: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    """Add to ``sized(doc_id, source, size)`` its ``place`` and the word ``start`` at which it lies in its source.

    The order is that of a hash of ``doc_id``, then ``doc_id`` and ``size``. It is cut into buckets by the hash's
    first digits; the sizes of whole buckets are added up first, so no task sorts more than a bucket.
    """
    digits = max(1, math.ceil(math.log(max(rows / BUCKET_ROWS, 1), 16)))
    code = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    coded = sized.withColumn("code", code).withColumn("bucket", F.substring("code", 1, digits))
    coded = coded.join(targets.select(F.col("source").alias("_source"), "place", "source_size", "target", "per", "of"), F.col("source").eqNullSafe(F.col("_source")))
    sums = coded.groupBy("place", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    order = Window.partitionBy("place", "bucket").orderBy("code", "doc_id", "size")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = coded.withColumn("inside", before).join(sums, ["place", "bucket"])
    return placed.withColumn("start", F.col("base") + F.col("inside")).drop("_source", "code", "bucket", "inside", "base")


def fragments(placed: DataFrame) -> DataFrame:
    """The part of each block that a document fills: ``place, start, block, words``."""
    last = F.expr("((start + size - 1) * of) div per")
    cut = placed.where("size > 0").select("place", "start", "size", "per", "of", F.explode(F.sequence(F.expr("(start * of) div per"), last)).alias("block"))
    begin, end = F.expr("(block * per + of - 1) div of"), F.expr("((block + 1) * per + of - 1) div of")
    words = F.least(F.col("start") + F.col("size"), end) - F.greatest("start", begin)
    return cut.select("place", "start", "block", words.alias("words"))


def mix(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Mix ``docs(doc_id, text, source)``: the columns ``keep`` (``doc_id``) and ``size, source_size, target, taken``.

    ``taken`` is the number of the document's words in the mix, repeats counted, and ``copies`` how many words each
    repeat takes, always the document's first ones. A null text has size 0 and nothing of it is taken; a null source
    is a source. Rows that repeat a ``doc_id`` are documents of their own.
    """
    keep = ["doc_id"] if keep is None else keep
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    size = F.size(words(F.col("text"))).cast("long")
    sized = materialise(docs.select(*kept, "doc_id", "source", size.alias("size")), "sizes")
    total, rows = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    cut = materialise(cut_sources(targets, block_words(total)), "targets")
    placed = materialise(shuffled(sized, cut, rows), "placed")
    times = schedule(cut).groupBy("place", "block").agg(F.count(F.lit(1)).alias("times"))
    repeats = [F.sum(F.when(F.col("times") > k, F.col("words")).otherwise(F.lit(0))) for k in range(MOST_REPEATS)]
    taken = fragments(placed).join(times, ["place", "block"]).groupBy("place", "start").agg(F.array(*repeats).alias("copies"))
    filled = placed.where("size > 0").join(taken, ["place", "start"], "left")
    none = F.array(*[F.lit(0).cast("long")] * MOST_REPEATS)
    empty = placed.where("size = 0").withColumn("copies", none)
    every = filled.withColumn("copies", F.coalesce("copies", none)).unionByName(empty)
    added: Column = F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x)
    return every.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", added.alias("taken"), "copies"
    )


def take(docs: DataFrame) -> DataFrame:
    """The mix itself: ``docs(doc_id, text, source, ...)`` with each row as often as the mix takes it, 0 to 3 times.

    Where the mix ends within a document, that repeat keeps the document's first words, joined by spaces. Rows that
    agree in ``doc_id``, ``source`` and size are numbered and matched by number. Only this step moves whole rows.
    """
    names = docs.columns
    key = ["doc_id", "source", "size"]
    number = F.row_number().over(Window.partitionBy(*[f"_{k}" for k in key]).orderBy("_doc_id")).alias("_n")
    size = F.size(words(F.col("text"))).cast("long")
    rows = docs.select(
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)], *[F.col(k).alias(f"_{k}") for k in key[:2]], size.alias("_size")
    ).select("*", number)
    plan = mix(docs, ["doc_id", "source"]).select(*[F.col(k).alias(f"_{k}") for k in key], "copies").select("*", number)
    plan = plan.select(*[F.col(f"_{k}").alias(k) for k in key], F.col("_n").alias("n"), "copies")
    same = F.col("_n") == F.col("n")
    for k in key:
        same = same & F.col(f"_{k}").eqNullSafe(F.col(k))
    copies = rows.join(plan, same).withColumn("_words", F.explode(F.filter("copies", lambda x: x > 0)))
    at = names.index("text")
    text = F.col(f"_c{at}")
    first = F.array_join(F.slice(words(text), 1, F.greatest("_words", F.lit(1)).cast("int")), " ")
    cut = F.when(F.col("_words") == F.col("_size"), text).otherwise(first)
    return copies.select(*[(cut if i == at else F.col(f"_c{i}")).alias(c) for i, c in enumerate(names)])


__all__ = ["WORD", "block_words", "cut_sources", "fragments", "mix", "schedule", "shuffled", "source_targets", "take"]
