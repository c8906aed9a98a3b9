"""Close fingerprints by pigeonhole blocks, and the connected groups of links."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.llm import bloom
from dealflow.session import WorkTables, materialise, remove, stored, work_path

BITS = 64
SAME = 2  # blocks that a close pair shares at the first look
LONGEST = 8  # most blocks shared
HOT = 4096  # nodes with one block value from which longer blocks are used
PASS_PAIRS, MOST_PASSES = 1 << 26, 16  # pairs of blocks whose ids meet at once, and how often those of all blocks are read at most
ORDERS = [0, 0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F]  # sorting by the exclusive or with each


def block_masks(distance: int, same: int) -> list[int]:
    """Masks over ``same`` of ``distance + same`` even parts of the bits.

    At most ``distance`` parts hold a differing bit, so two fingerprints at that distance agree under some mask.
    """
    parts = distance + same
    cuts = [BITS * k // parts for k in range(parts + 1)]
    spans = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(parts)]
    return [sum(chosen) for chosen in combinations(spans, same)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def blocks(fp: Column, distance: int, same: int = SAME) -> Column:
    """The block values of a fingerprint, one long per mask; they differ between masks but for hash collisions."""
    return F.array(*[F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(_signed(m)))) for n, m in enumerate(block_masks(distance, same))])


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def close_links(
    nodes: DataFrame, distance: int, verify: Callable[[DataFrame], DataFrame] | None = None, same: int = SAME, hot: int = HOT
) -> DataFrame:
    """Links ``a, b`` that connect ``nodes(id, fp)`` exactly as all pairs within ``distance`` bits do.

    Without ``verify``, ids are the fingerprints themselves, each once. With it a pair also has to stay in what
    ``verify`` returns of a table of pairs ``a, b``; then fingerprints may repeat.

    Nodes meet in blocks, but a group of close ones is never expanded into its pairs. First every node is compared with
    a few heads of its blocks, the smallest ids in as many orders; a dense group becomes connected by these stars.
    Then only nodes that are still in different groups, but share a block, are compared with each other. Heads have met all of
    their block by then and take no part; in a block of two there is nothing else. Block values of over ``hot`` nodes in different groups are left to
    longer blocks, which share more bits. The links are stored; what they were found by is removed.
    """
    work = WorkTables()
    plain = verify is None
    check = verify or (lambda pairs: pairs)
    rows = nodes.select("id", "fp", F.explode(F.array_distinct(blocks(F.col("fp"), distance, same))).alias("block"))
    if plain:
        first = [F.min(F.col("id").bitwiseXOR(F.lit(o))).alias(f"head{k}") for k, o in enumerate(ORDERS)]
    else:
        first = [F.min(F.struct(F.col("id").bitwiseXOR(F.lit(o)).alias("order"), "fp")).alias(f"head{k}") for k, o in enumerate(ORDERS)]
    # Most nodes are alone in their blocks: those are left out before anything wider is shuffled.
    shared = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block")
    shared = work.materialise(shared, "blocks")
    some = work.materialise(bloom.screen(rows, "block", shared, "block"), "some")
    work.release("blocks")
    heads = some.groupBy("block").agg(F.count(F.lit(1)).alias("n"), *first).where("n > 1")
    met = work.materialise(some.join(heads, "block"), "met")
    work.release("some")

    def own(k: int) -> Column:
        order = F.col("id").bitwiseXOR(F.lit(ORDERS[k]))
        return order if plain else F.struct(order.alias("order"), "fp")

    def head(k: int) -> Column:
        value, order = F.col(f"head{k}"), F.lit(ORDERS[k])
        if plain:
            return F.struct(value.bitwiseXOR(order).alias("b"), value.bitwiseXOR(order).alias("fp_b"))
        return F.struct(value["order"].bitwiseXOR(order).alias("b"), value["fp"].alias("fp_b"))

    tried = met.select("id", "fp", F.explode(F.array_distinct(F.array(*[head(k) for k in range(len(ORDERS))]))).alias("h"))
    tried = tried.where((F.col("id") != F.col("h.b")) & (bits_apart(F.col("fp"), F.col("h.fp_b")) <= distance))
    stars = work.materialise(check(tried.select(F.col("id").alias("a"), F.col("h.b").alias("b")).distinct()), "stars")

    several = met.where("n > 2").where(~_any_head(own)).select("id", "fp", "block", "n")
    roots = components(stars).withColumnRenamed("node", "id")
    several = several.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = work.materialise(several, "labelled")
    work.release("met")
    mixed = several.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("block")
    several = work.materialise(several.join(mixed, "block", "left_semi"), "mixed")
    work.release("labelled")
    usual = several if same >= LONGEST else several.where(F.col("n") <= hot)
    one = usual.select("block", F.col("id").alias("a"), F.col("fp").alias("fp_a"), F.col("root").alias("root_a"))
    two = usual.select(F.col("block").alias("block_b"), F.col("id").alias("b"), F.col("fp").alias("fp_b"), F.col("root").alias("root_b"))
    across = (F.col("block") == F.col("block_b")) & (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b"))
    rest = one.join(two, across & (bits_apart(F.col("fp_a"), F.col("fp_b")) <= distance)).select("a", "b").distinct()
    links = stars.unionByName(check(rest))
    if same < LONGEST and not several.where(F.col("n") > hot).isEmpty():
        crowded = work.materialise(several.where(F.col("n") > hot).select("id", "fp").distinct(), "crowded")
        links = links.unionByName(close_links(crowded, distance, verify, same + 2, hot))
    links = materialise(links, "links")
    work.drop()
    return links


def _any_head(own: Callable[[int], Column]) -> Column:
    """Whether a row of ``met`` is one of its block's heads; ``own`` is what it would be as the head in each of the orders."""
    return reduce(Column.__or__, [F.col(f"head{k}") == own(k) for k in range(len(ORDERS))])


def marked(marks: DataFrame, side: str) -> DataFrame:
    """``marks`` by ``side`` in the place of ``id``, which is added to the other names."""
    return marks.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in marks.columns if c != "id"])


def block_links(rows: DataFrame, verifier: Callable, hot: int = HOT) -> DataFrame:
    """Links ``a, b`` that connect the ids of ``rows(id, block)`` exactly as all verified pairs that share a block do.

    ``verifier`` takes the ids that share a block (``id``, stored, each once) and returns the step that keeps the pairs
    ``a, b`` that are linked (``lines.Verifier``). As in ``close_links`` all are compared with heads first, then only ids that
    are still in different groups and no heads of their block. These bring their marks along, so that pairs that the marks rule out are never shuffled.
    The pairs of a block with over ``hot`` of these are spread over many tasks. Marks and pairs are shuffled for a part of the blocks at
    a time, so that their shuffle files do not grow with all pairs.
    """
    work = WorkTables()
    shared = work.materialise(rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block"), "blocks")
    some = work.materialise(bloom.screen(rows, "block", shared, "block"), "some")
    work.release("blocks")
    first = [F.min(F.col("id").bitwiseXOR(F.lit(o))).alias(f"head{k}") for k, o in enumerate(ORDERS)]
    heads = some.groupBy("block").agg(F.count(F.lit(1)).alias("n"), *first).where("n > 1")
    met = work.materialise(some.join(heads, "block"), "met")
    work.release("some")
    check = verifier(work.materialise(met.select("id").distinct(), "met-ids"))
    tried = F.array_distinct(F.array(*[F.col(f"head{k}").bitwiseXOR(F.lit(o)) for k, o in enumerate(ORDERS)]))
    tried = met.select("id", F.explode(tried).alias("head")).where("id <> head")
    tried = tried.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
    stars = work.materialise(check(tried), "stars")

    roots = components(stars).withColumnRenamed("node", "id")
    rest = met.where("n > 2").where(~_any_head(lambda k: F.col("id").bitwiseXOR(F.lit(ORDERS[k]))))
    several = rest.select("id", "block").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = work.materialise(several, "labelled")
    work.release("met")
    mixed = several.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = mixed.where("low <> high").select("block", "n", F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    several = work.materialise(several.join(mixed, "block"), "mixed")
    work.release("labelled")
    pairs = several.agg(F.sum((F.col("n") - 1) / 2)).first()[0] or 0
    passes = min(MOST_PASSES, math.ceil(pairs / PASS_PAIRS))
    across = F.expr("block_a = block_b AND part_a = part_b AND a < b AND root_a <> root_b")
    links = stars
    for k in range(passes):
        here = several.drop("n").where(F.pmod(F.xxhash64("block", F.lit("pass")), F.lit(passes)) == k).join(check.marks(), "id")
        one = marked(here, "a").withColumn("part_a", F.pmod(F.xxhash64("a"), F.col("parts_a")).cast("int"))
        two = marked(here, "b").withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
        rest = check.exact(one.join(two, across & check.may()).select("a", "b").distinct())
        links = links.unionByName(work.materialise(rest, "found"))
    links = materialise(links, "links")
    work.drop()
    return links


def components(links: DataFrame) -> DataFrame:
    """The connected groups of ``links(a, b)``: ``node, root`` for every linked node, the smallest node being the root.

    Alternates the large-star and small-star steps: each node's larger neighbours, then its smaller ones, are attached
    to the smallest node next to it. Edges never become more than nodes and links together. Each round is stored, and
    two sums decide whether it changed anything. Links with a null end or to the node itself are ignored.
    """
    ends = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    edges, path = _stored(links.where("a <> b").select(*ends).distinct())
    before = None
    while (now := _signature(edges)) != before:
        before = now
        if not now[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large, large_path = _stored(large)
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        last = path
        edges, path = _stored(small.unionByName(lowest.withColumnRenamed("low", "b")).distinct())
        for done in (last, large_path):
            remove(edges.sparkSession, done)
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stored(edges: DataFrame) -> tuple[DataFrame, str]:
    """The edges in a table of their own, and its path, which goes when the next round is stored."""
    path = work_path(edges.sparkSession, "edges")
    return stored(edges, path), path


def _signature(edges: DataFrame) -> tuple:
    code = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(code.cast("decimal(38,0)")), F.bit_xor(code)).first())
