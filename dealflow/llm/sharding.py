"""Sharding by a k-d tree over document metadata.

Documents are points: one axis per metadata column and one for their length. The tree starts with one box for all of
them. A box that is to become ``k`` shards is split along its widest axis at the weighted median, for an odd ``k`` at the
``k // 2`` of ``k`` quantile, until each leaf holds the bytes of one shard. Shards are thus boxes: near equal in bytes, and
a reader of one source or of long documents needs only some of them.

Only the metadata is looked at, and it is not shuffled for the tree. A weighted median is found for all boxes of a level at
once by histograms: the bin that the median falls in is divided again until one document is left in it. Documents with the
same place on the axis are ordered by a hash of their text, so that equal texts stay together as far as sizes allow, then
by a hash of their row number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealflow.llm.groups import remove
from dealflow.session import materialise, work_path

SHARDS = 40
ROW_BYTES = 16  # size of a document beside its text
CATEGORIES = ("source", "lang")
MOST_SHARDS = 1 << 16  # bound of the splits that tasks hold
BINS = 1 << 16  # of all histograms of a pass together: what reaches the driver
LEAST_BINS = 16
BUCKET_ROWS = 20_000  # documents put in order together, about
TOP = (1 << 62) - 1  # largest code
_LOG_STEPS = 1 << 20


def _code(value: Column) -> Column:
    """A hash of 62 bits, so that differences of two fit a long."""
    return F.shiftrightunsigned(F.xxhash64(value), 2)


def measured(docs: DataFrame, keep: list[str], categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """One row per document, stored: ``_k0...`` (the columns ``keep``), ``size, text_crc32, axes, text_code, row_code, row``.

    A category has a hash of its value as its place, a null one too; the length has the logarithm of the size. Categories
    that ``docs`` lacks are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + ROW_BYTES
    places = [_code(F.col(c).cast("string")) for c in categories if c in docs.columns]
    length = F.floor(F.log2(size.cast("double")) * _LOG_STEPS).cast("long")
    rows = docs.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)],
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.array(*places, length).alias("axes"),
        _code(text).alias("text_code"),
        F.monotonically_increasing_id().alias("row"),
    )
    # The row number is fixed by storing it; its hash is made of what was stored.
    return materialise(rows, "sizes").withColumn("row_code", _code(F.col("row")))


@dataclass
class Search:
    """The search for the split of one box: among the keys (place on the axis, text code, row code) of its rows."""

    shard: int
    left: int
    axis: int
    low: int
    high: int
    target: float
    below: int = 0
    fixed: list[int] = field(default_factory=list)
    cut: tuple[int, int, int] | None = None

    @property
    def key(self) -> int:
        return len(self.fixed)

    def step(self, bins: int) -> int:
        return max(1, -(-(self.high - self.low + 1) // bins))

    def look(self, bins: list) -> None:
        """Go on into the bin (rows, size, least and largest key) that the target falls in, or cut there."""
        for at, found in enumerate(bins):
            if self.below + found["size"] >= self.target or at == len(bins) - 1:
                break
            self.below += found["size"]
        if found["rows"] == 1 or found["least"] == found["most"] and self.key == 2:
            over, under = self.below + found["size"] - self.target, self.target - self.below
            last = found["most"] if over <= under else found["least"] - 1
            self.cut = tuple([*self.fixed, last, TOP, TOP][:3])
        elif found["least"] == found["most"]:
            self.fixed.append(found["least"])
            self.low, self.high = 0, TOP
        else:
            self.low, self.high = found["least"], found["most"]


def _place(axis: Column) -> Column:
    return F.get("axes", axis)


def medians(rows: DataFrame, searches: list[Search]) -> None:
    """Find the cuts of all ``searches`` on ``rows(shard, axes, text_code, row_code, size)``, a pass for all at a time."""
    spark = rows.sparkSession
    while waiting := {s.shard: s for s in searches if s.cut is None}:
        bins = max(LEAST_BINS, BINS // len(waiting))
        states = [(s.shard, s.axis, s.key, s.low, s.high, s.step(bins), *[*s.fixed, 0, 0][:2]) for s in waiting.values()]
        # At most MOST_SHARDS rows.
        state = F.broadcast(spark.createDataFrame(states, "shard int, axis int, key int, low long, high long, step long, f0 long, f1 long"))
        place, code = _place(F.col("axis")), F.col("text_code")
        value = F.when(F.col("key") == 0, place).when(F.col("key") == 1, code).otherwise(F.col("row_code"))
        inside = ((F.col("key") < 1) | (place == F.col("f0"))) & ((F.col("key") < 2) | (code == F.col("f1")))
        met = rows.join(state, "shard").where(inside).withColumn("value", value).where("value BETWEEN low AND high")
        counts = met.groupBy("shard", F.expr("(value - low) DIV step").alias("bin")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size"), F.min("value").alias("least"), F.max("value").alias("most")
        )
        found: dict[int, list] = {}
        for r in counts.collect():
            found.setdefault(r["shard"], []).append(r)
        for shard, search in waiting.items():
            search.look(sorted(found[shard], key=lambda r: r["bin"]))


def descend(rows: DataFrame, splits: list[Search]) -> DataFrame:
    """Move the rows behind a cut from box ``shard`` to the right one of its halves, ``shard + left``. No shuffle."""
    table = [(s.shard, s.left, s.axis, *s.cut) for s in splits]
    # At most MOST_SHARDS rows.
    cuts = F.broadcast(rows.sparkSession.createDataFrame(table, "shard int, left int, axis int, c0 long, c1 long, c2 long"))
    place = _place(F.col("axis"))
    text = (F.col("text_code") > F.col("c1")) | ((F.col("text_code") == F.col("c1")) & (F.col("row_code") > F.col("c2")))
    right = (place > F.col("c0")) | ((place == F.col("c0")) & text)
    moved = rows.join(cuts, "shard", "left").withColumn("shard", F.col("shard") + F.when(right, F.col("left")).otherwise(0))
    return moved.drop("left", "axis", "c0", "c1", "c2")


def tree(rows: DataFrame, shards: int) -> list[list[Search]]:
    """The splits of each level. A box is known by its first shard; the boxes of a level are looked at together."""
    if shards > MOST_SHARDS:
        raise ValueError(f"at most {MOST_SHARDS} shards")
    spark, levels, old = rows.sparkSession, [], None
    first = rows.select(F.size("axes")).first()
    count = first[0] if first else 0
    bounds = [f(_place(F.lit(a))).alias(f"{n}{a}") for a in range(count) for n, f in (("least", F.min), ("most", F.max))]
    boxes, whole = {0: shards}, None
    rows = rows.withColumn("shard", F.lit(0))
    while count and any(k > 1 for k in boxes.values()):
        searches = []
        for r in rows.groupBy("shard").agg(F.sum("size").alias("size"), *bounds).collect():
            spread = [r[f"most{a}"] - r[f"least{a}"] for a in range(count)]
            whole = whole or [max(s, 1) for s in spread]
            axis = max(range(count), key=lambda a: (spread[a] / whole[a], -a))
            k = boxes[r["shard"]]
            if k > 1:
                searches.append(Search(r["shard"], k // 2, axis, r[f"least{axis}"], r[f"most{axis}"], r["size"] * (k // 2) / k))
        medians(rows, searches)
        levels.append(searches)
        boxes = {s: n for f, k in boxes.items() for s, n in ([(f, k // 2), (f + k // 2, k - k // 2)] if k > 1 else [(f, k)])}
        if not searches:
            continue
        path = work_path(spark, "boxes")
        descend(rows, searches).write.parquet(path)
        rows = spark.read.parquet(path)
        if old:
            remove(spark, old)
        old = path
    if old:
        remove(spark, old)
    return levels


def _assigned(rows: DataFrame, levels: list[list[Search]]) -> DataFrame:
    rows = rows.withColumn("shard", F.lit(0))
    for splits in levels:
        if splits:
            rows = descend(rows, splits)
    return rows


def with_slots(rows: DataFrame, count: int, shards: int) -> DataFrame:
    """Add ``slot``, the place in the shard in the order of ``row_code``; buckets of codes are counted and added up first."""
    bits = max(0, (count // (shards * BUCKET_ROWS)).bit_length())
    rows = rows.withColumn("bucket", F.shiftrightunsigned("row_code", 62 - bits))
    order = Window.partitionBy("shard", "bucket").orderBy("row_code", "row")
    ranked = rows.withColumn("inside", F.row_number().over(order) - 1)
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    bases = bases.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    slot = (F.col("base") + F.col("inside")).cast("long")
    return ranked.join(bases, ["shard", "bucket"]).withColumn("slot", slot).drop("bucket", "inside", "base")


def assign(docs: DataFrame, keep: list[str] | None = None, shards: int = SHARDS, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Shards of ``docs(text, ...)``: the columns ``keep`` (``doc_id``) and ``size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` counts the UTF-8 bytes of the text, none for a null one, and 16 more; ``text_crc32`` is that of the bytes.
    The law is ``bytes``: the shards' sizes differ by no more than documents do. ``slot`` numbers the documents of a shard
    from 0 without gaps, in a shuffled order; ``grown_shard`` is null. Rows that repeat are documents of their own; with
    fewer documents than shards some shards are empty. The same stored table read in the same way gives the same shards.
    """
    keep = ["doc_id"] if keep is None else keep
    rows = measured(docs, keep, categories)
    placed = materialise(_assigned(rows, tree(rows, shards)), "shards")
    found = with_slots(placed, placed.count(), shards)
    return found.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "size", "text_crc32", F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def shards_of(docs: DataFrame, target_bytes: int) -> int:
    """The number of shards of about ``target_bytes``, for ``assign`` and ``write``."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES)).first()[0] or 0
    return max(1, round(total / target_bytes))


def write(docs: DataFrame, path: str, shards: int = SHARDS, categories: tuple[str, ...] = CATEGORIES) -> None:
    """Write the documents, all columns, to folders ``shard=N``, one file each, in a shuffled order.

    Whole rows are stored once with their number and shuffled once, to their shards. A column ``shard`` of ``docs`` gives
    way to the new one.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != "shard"]
    rows = materialise(docs.select(*names).withColumn("_row", F.monotonically_increasing_id()), "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    plan = measured(rows, ["_row"], categories).withColumn("row_code", _code(F.col("_k0")))
    levels = tree(plan, shards)
    places = [_code(F.col(c).cast("string")) for c in categories if c in docs.columns]
    size = (F.octet_length(text) + ROW_BYTES).cast("double")
    own = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("_own")
    points = rows.select(
        own, F.array(*places, F.floor(F.log2(size) * _LOG_STEPS).cast("long")).alias("axes"),
        _code(text).alias("text_code"), _code(F.col("_row")).alias("row_code"),
    )
    found = _assigned(points, levels).repartition(shards, "shard").sortWithinPartitions("shard", "row_code")
    found.select(*[F.col(f"_own.c{i}").alias(c) for i, c in enumerate(names)], "shard").write.partitionBy("shard").parquet(path)


__all__ = ["assign", "descend", "measured", "medians", "shards_of", "tree", "with_slots", "write"]
