"""Spelling variants by a frequency-vector trie.

A word's frequency vector counts its letters by letter group. One inserted, deleted or replaced letter changes it by a
surplus of at most one in one group and a deficit of at most one in another. A trie arranges words by their counts, a group
per level; a depth-first search with a word's own counts spends that budget of one surplus and one deficit, and
compares the word with those at the leaves it comes to.

The trie of all words is cut into parts. A box is the words that agree in their first counts; boxes of over ``BOX`` words are cut
by the next count, and every box left is a subtrie that one task builds and searches. A word is sent to the boxes
that its budget reaches. Words that agree in all counts and are more than a box are cut once more: near words agree
in the first or in the last half of their letters. Both the words and the searches of a box are dealt in parts of
bounded size, so that no group grows with the input.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import arrow_map
from dealflow.session import materialise, work_path

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
DELETED = 31  # a hash that this divides costs a run a letter
LEAST_LETTERS, LEAST_COUNT = 7, 2
# Shorter runs do not become words: a letter may go, none comes.
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LETTERS)
TIMES = 10  # a form occurs so many times as often
GROUPS = 16  # letter groups, one per level: code points by remainder
CODE_BITS = 32  # of the code of a path: counts times numbers of this length fit a long
CODE_MASK = (1 << CODE_BITS) - 1
CODES = [random.Random(g).getrandbits(CODE_BITS) for g in range(GROUPS)]
BOX = 20_000  # words in a subtrie, and searches in it, per task call
LEAF = 32  # words that are compared without a further level
SEARCHES = 1024  # words compared with a leaf together
TABLE_BITS = 1 << 24  # of the table of boxes that tasks hold: 2 MB
MIXER, STRIDE = 0x2545F491, 0x9E3779B97F4A
ROUTED = 256  # words whose paths are listed together
PIECE = 50_000  # different words of a batch held together


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: the words of ``docs(doc_id, text)`` as the contract of ``variants`` has them, stored.

    Runs are counted per document and batch in tasks, so that a frequent word reaches the shuffle as few rows. A null id
    is an empty text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text.as_py()
                if not text:
                    continue
                mark = doc_id.as_py()
                start = zlib.crc32(f"{'' if mark is None else mark}:".encode())
                for run, n in Counter(RUN.findall(text)).items():
                    if not run.islower():
                        run = run.translate(_LOWER)
                    code = zlib.crc32(run.encode(), start)
                    if code % DELETED == 0:
                        at = code % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_LETTERS:
                            continue
                    found[run] += n
                if len(found) >= PIECE:
                    yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())})
                    found.clear()
        if found:
            yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())})

    counts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return materialise(counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT), "words")


def vectors(words: list[str]) -> np.ndarray:
    """Each word's letters per group."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) % GROUPS
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    return np.bincount(owner * GROUPS + letters, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def path_codes(counts: np.ndarray) -> np.ndarray:
    """The codes of each vector's paths by depth: counts times the groups' numbers, added up in ``CODE_BITS`` bits."""
    total = np.zeros((len(counts), GROUPS + 1), np.int64)
    for g, number in enumerate(CODES):
        total[:, g + 1] = (total[:, g] + counts[:, g].astype(np.int64) * number) & CODE_MASK
    return total


def with_codes(words: DataFrame) -> DataFrame:
    """``word, n, codes``: the codes of the paths of the word's frequency vector, by depth."""

    def step(batch: pa.RecordBatch) -> dict:
        codes = path_codes(vectors(batch["word"].to_pylist()))
        ends = np.arange(0, codes.size + 1, GROUPS + 1, dtype=np.int32)
        return {"word": batch["word"], "n": batch["n"], "codes": pa.ListArray.from_arrays(ends, codes.reshape(-1))}

    return arrow_map(words.select("word", "n"), "word string, n long, codes array<long>", step)


def boxed(words: DataFrame, most: int = BOX) -> tuple[DataFrame, DataFrame]:
    """The boxes of ``words(word, n, codes)``: ``box, depth, code, size``, and the words with their ``box`` and its ``size``.

    A word's box is the first on its path that holds no more than ``most`` words, or has all counts. Paths with one code share a
    box. The trie is cut level by level, and only words whose boxes are still too large go on; of these boxes there are few.
    """
    spark, found, held, waiting = words.sparkSession, [], [], words
    for depth in range(GROUPS + 1):
        own = waiting.withColumn("code", F.get("codes", F.lit(depth)))
        nodes = materialise(own.groupBy("code").agg(F.count(F.lit(1)).alias("size")), "nodes")
        large = (F.col("size") > most) & F.lit(depth < GROUPS)
        small = nodes.where(~large).select((F.col("code") * (GROUPS + 1) + depth).alias("box"), F.lit(depth).alias("depth"), "code", "size")
        found.append(small)
        held.append(own.join(small.select("box", "code", "size"), "code").select("box", "size", "word", "n"))
        if nodes.where(large).isEmpty():
            break
        waiting = own.join(nodes.where(large).select("code"), "code", "left_semi").drop("code")
    boxes, posts = found[0], held[0]
    for more, rows in zip(found[1:], held[1:], strict=True):
        boxes, posts = boxes.unionByName(more), posts.unionByName(rows)
    path = work_path(spark, "boxes")
    boxes.write.parquet(path)
    return spark.read.parquet(path), posts


def offsets(depth: int) -> list[int]:
    """The steps from a path's code to those of all paths that differ by a surplus and a deficit of at most one, itself too."""
    groups = range(depth)
    single = [sign * CODES[g] for g in groups for sign in (1, -1)]
    return [0, *single, *[CODES[up] - CODES[down] for up in groups for down in groups if up != down]]


def _bit(code, depth):
    """The place of a path in the table of ``box_bits``; of columns or of arrays."""
    return ((code * MIXER + depth * STRIDE) // (1 << 20)) % TABLE_BITS


def box_bits(found: DataFrame) -> np.ndarray:
    """A table of ``TABLE_BITS`` bits, set for the paths of all boxes. Its size does not depend on their number."""
    bit = F.expr(f"((code * {MIXER} + depth * {STRIDE}) DIV {1 << 20}) % {TABLE_BITS}")
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits")
    words = np.zeros(TABLE_BITS // 64, np.int64)
    for r in found.select(bit.alias("bit")).groupBy(F.expr("bit DIV 64").alias("at")).agg(word).collect():
        words[r["at"]] = r["bits"]
    return words


def _routed(words: DataFrame, found: DataFrame, depths: list[int]) -> DataFrame:
    """Each word in every box that its budget reaches. Steps differ, so none is reached twice; equal codes of different
    paths may take a word to a box in vain. Most paths have no box; a table of bits drops them before the join."""
    steps = [np.array(offsets(d), np.int64) for d in depths]
    depth = np.repeat(np.array(depths, np.int64), [len(s) for s in steps])
    table = box_bits(found)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROUTED):
                some = batch.slice(at, ROUTED)
                codes = some["codes"].flatten().to_numpy().reshape(-1, GROUPS + 1)
                reached = np.concatenate([codes[:, d, None] + s for d, s in zip(depths, steps, strict=True)], axis=1) & CODE_MASK
                bit = _bit(reached, depth)
                row, column = np.nonzero(table[bit >> 6] >> (bit & 63) & 1)
                rows = some.select(["word", "n"]).take(pa.array(row))
                there = [pa.array(depth[column].astype(np.int32)), pa.array(reached[row, column])]
                yield pa.RecordBatch.from_arrays([*rows.columns, *there], ["word", "n", "depth", "code"])

    routes = words.select("word", "n", "codes").mapInArrow(step, "word string, n long, depth int, code long")
    return routes.join(found, ["depth", "code"]).select("box", "size", "word", "n")


def _halves(length: Column) -> list[Column]:
    """What a word shares with a near one if the shorter of the two has ``length`` letters: its first half, or its last.

    An edit leaves the shorter word's first ``length // 2`` letters at the start of the other word, or all behind them at its end.
    """
    half = F.floor(length / 2).cast("int")
    first, last = F.substring("word", F.lit(1), half), F.right(F.col("word"), length - half)
    return [F.struct(F.lit(side).alias("side"), F.xxhash64(length, F.lit(side), text).alias("code")) for side, text in enumerate((first, last))]


def _bucketed(rows: DataFrame, search: bool, most: int) -> DataFrame:
    """Add ``side, bucket``: -1 and 0 in a box of usual size, else one row per half by which the word is found, or finds."""
    length = F.char_length("word")
    keys = _halves(length) if search else [*_halves(length), *_halves(length - 1)]
    whole = F.array(F.struct(F.lit(-1).alias("side"), F.lit(0).cast("long").alias("bucket")))
    parts = F.ceil(F.col("size") / most)
    split = F.array_distinct(F.transform(F.array(*keys), lambda k: F.struct(k["side"].alias("side"), F.pmod(k["code"], parts).alias("bucket"))))
    return rows.withColumn("_at", F.explode(F.when(F.col("size") > most, split).otherwise(whole))).select("box", "_at.side", "_at.bucket", "word", "n")


def near(a: str, b: str) -> bool:
    """Whether one replaced letter makes ``b`` of ``a``, or one inserted letter."""
    longer = len(b) - len(a)
    if longer not in (0, 1):
        return False
    for at, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return a[at + 1 - longer :] == b[at + 1 :]
    return longer == 1


class Trie:
    """Words by their counts, a level per group. Words in the order of their vectors are the trie: a node is a range of them.

    A leaf holds few words, or words that agree in all counts; these are found by either half, so that a large leaf is not
    looked through.
    """

    def __init__(self, words: list[str]):
        counts = vectors(words)
        order = np.lexsort(counts.T[::-1])
        self.words, self.counts = [words[i] for i in order], counts[order]
        #: Codes of the halves, by the shorter word's letters: as many as the word has, and one fewer.
        self.halves = np.stack([half_codes(self.words, 0), half_codes(self.words, 1)])

    def search(self, words: list[str]) -> Iterator[tuple[int, str]]:
        """The near words of each of ``words``, by its number: those of the same length that come after it, and those a letter
        longer.

        The depth-first search takes all words along at once. At every node go on those that can pay for the node's count,
        out of one surplus and one deficit.
        """
        asked = vectors(words)
        both, own_halves = np.ones(len(words), np.int16), half_codes(words, 0)
        stack = [(0, len(self.words), 0, np.arange(len(words)), both, both)]
        while stack:
            low, high, level, some, surplus, deficit = stack.pop()
            if high - low <= LEAF:
                yield from self._leaf(low, high, some, words, own_halves)
                continue
            if level == GROUPS:
                halves = Halves(self.words[low:high])
                yield from ((i, found) for i in some.tolist() for found in halves.search(words[i]))
                continue
            column, own = self.counts[low:high, level], asked[some, level]
            ends = [*(np.flatnonzero(column[1:] != column[:-1]) + 1).tolist(), high - low]
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                more = column[start] - own
                payable = (more <= surplus) & (-more <= deficit)
                if payable.any():
                    more, left, over = more[payable], surplus[payable], deficit[payable]
                    stack.append((low + start, low + end, level + 1, some[payable], left - np.maximum(more, 0), over - np.maximum(-more, 0)))

    def _leaf(self, low, high, some, words, own_halves) -> Iterator[tuple[int, str]]:
        """The leaf's words that share a half with a word that came here are compared letter by letter."""
        for at in range(0, len(some), SEARCHES):
            numbers = some[at : at + SEARCHES]
            shared = np.zeros((len(numbers), high - low), bool)
            for fewer in (0, 1):
                for side in (0, 1):
                    shared |= own_halves[numbers, side, None] == self.halves[fewer, low:high, side]
            for i, j in np.argwhere(shared).tolist():
                word, found = words[numbers[i]], self.words[low + j]
                if near(word, found) and (len(found) > len(word) or found > word):
                    yield int(numbers[i]), found


def half_codes(words: list[str], fewer: int) -> np.ndarray:
    """Hashes of the first and the last half that a near word shares with each, the shorter of the two having ``fewer`` letters less."""
    cuts = [(len(w) - fewer) // 2 for w in words]
    found = [(hash((len(w) - fewer, w[:half])), hash((len(w) - fewer, w[fewer + half :]))) for w, half in zip(words, cuts, strict=True)]
    return np.array(found, np.int64).reshape(-1, 2)


class Halves:
    """The words of a large leaf by the halves that a near word shares with them."""

    def __init__(self, words: list[str]):
        self.found: dict[tuple[int, int, str], list[str]] = {}
        for word in words:
            for length in (len(word), len(word) - 1):
                half = length // 2
                self.found.setdefault((length, 0, word[:half]), []).append(word)
                self.found.setdefault((length, 1, word[len(word) - (length - half) :]), []).append(word)

    def search(self, word: str) -> Iterator[str]:
        length = len(word)
        half = length // 2
        first = word[:half]
        for found in self.found.get((length, 0, first), ()):
            if near(word, found) and (len(found) > length or found > word):
                yield found
        for found in self.found.get((length, 1, word[half:]), ()):
            if not found.startswith(first) and near(word, found) and (len(found) > length or found > word):
                yield found


def _search(held: pa.Table, asked: pa.Table) -> pa.Table:
    """All near pairs of one cell, in both directions: ``word, near, near_n``."""
    sizes = dict(zip(held["word"].to_pylist(), held["n"].to_pylist(), strict=True))
    words, counts, sides, rows = *[asked[c].to_pylist() for c in ("word", "n", "side")], ([], [], [])
    for number, found in Trie(list(sizes)).search(words):
        word, side = words[number], sides[number]
        # Where a box is cut by halves, a pair that shares the first one is found by that alone.
        if side >= 0 and found.startswith(word[: len(word) // 2]) != (side == 0):
            continue
        for column, values in zip(rows, ((word, found), (found, word), (sizes[found], counts[number])), strict=True):
            column.extend(values)
    types = (pa.string(), pa.string(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["word", "near", "near_n"])


def near_pairs(words: DataFrame, most: int = BOX) -> DataFrame:
    """``word, near, near_n`` of ``words(word, n)``, each word once: every pair that is one edit apart, in both directions."""
    coded = materialise(with_codes(words), "codes")
    found, placed = boxed(coded, most)
    depths = sorted(r["depth"] for r in found.select("depth").distinct().collect())  # at most GROUPS + 1
    posts = materialise(_bucketed(placed, False, most), "posts")
    searches = materialise(_bucketed(_routed(coded, found, depths), True, most), "searches")
    cell = ["box", "side", "bucket"]
    sizes = [
        side.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name)) for side, name in ((posts, "held"), (searches, "asked"))
    ]
    parts = materialise(sizes[0].join(sizes[1], cell), "cells")

    def spread(side: DataFrame, own: str, other: str) -> DataFrame:
        placed = side.join(parts, cell).withColumn(f"{own}_part", F.pmod(F.xxhash64("word"), F.col(own)).cast("int"))
        return placed.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("held", "asked")

    keys = [*cell, "held_part", "asked_part"]
    one, two = spread(posts, "held", "asked").groupBy(*keys), spread(searches, "asked", "held").groupBy(*keys)
    return one.cogroup(two).applyInArrow(_search, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``: where the forms lead. Each round doubles the steps taken; a form occurs ten
    times as often as its word, so there are few."""
    up = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = up.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        met = up.join(further, F.col("root") == F.col("_word"), "left")
        moved = materialise(met.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        up = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return up


def variants(docs: DataFrame, most: int = BOX) -> DataFrame:
    """The words of ``docs(doc_id, text)`` with their spelling variants: ``word, form, root, n, n_near, form_n``.

    Words are the runs of letters ``A-Z a-z U+00C0-U+00FF`` with A-Z folded; a run whose hash with the document's id is a
    multiple of ``DELETED`` loses a letter. Those of ``LEAST_LETTERS`` or more that occur ``LEAST_COUNT`` times or more
    (``n``) count. ``n_near`` is the number of words one edit apart, ``form`` the most frequent of them (ties: the first by
    code point) if it occurs ``TIMES`` times as often, else null, ``form_n`` its count, and ``root`` the word that following
    the forms ends at. A null text has no words and a null id is an empty text in the hash; repeated rows all count.
    """
    words = word_counts(docs)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    by_word = near_pairs(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    led = (-F.col("best.less")) >= TIMES * F.col("n")
    rows = words.join(by_word, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(led, F.col("best.near")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n"),
    )
    rows = materialise(rows, "variants")
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
