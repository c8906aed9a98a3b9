"""Records of CSV files whose quoted cells may hold line breaks, read by many tasks per file.

A line cannot be read alone: it may begin within a quoted cell. But what a line does is a function of one question, whether
a cell is open before it, and so is what a block of lines does. A first pass finds for every block of a file
what is open behind it and how many records start in it, either way; going through the blocks of a file, of which there are
few, says which way it is. In the second pass each block gives the records that start in it. Only the last record of a
block may go on in the next ones; such pieces alone are put together by a shuffle.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealflow.operators.numbering import ORIGIN, running_starts, with_origin
from dealflow.session import materialise

WHOLE, FIRST, FURTHER = 0, 1, 2  # a record, the first piece of one, a later piece
#: A line with a quoted cell left open: whole cells, each with its comma, then a quote without its counterpart.
OPEN = re.compile(r'(?:(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+)?+,)*+"(?:[^"]|"")*+')
MOST_HEADERS = 100  # different header rows of the files read together
ROWS = 500  # rows of an Arrow batch that are Python texts at once
_BLOCK = list(ORIGIN)
_SUMMARY = "_file string, _block long, behind_closed boolean, behind_open boolean, rows_closed long, rows_open long, head string"
_PIECES = "_file string, _block long, _index long, part int, text string"


def leaves_open(line: str, is_open: bool) -> bool:
    """Whether a quoted cell is open behind a line, given whether one is before it."""
    if '"' not in line:
        return is_open
    return OPEN.fullmatch('"' + line if is_open else line) is not None


def lines_of(raw: str) -> list[tuple[str, str]]:
    """The lines of what stands between two line feeds, each with the break behind it."""
    body, end = (raw[:-1], "\r\n") if raw.endswith("\r") else (raw, "\n")
    if "\r" not in body:
        return [(body, end)]
    *lines, last = body.split("\r")
    return [*[(line, "\r") for line in lines], (last, end)]


class Walk:
    """Goes through the lines of a block from one answer to the question: records started and whether one is open."""

    def __init__(self, is_open: bool):
        self.is_open, self.started = is_open, 0

    def step(self, line: str) -> bool:
        """Whether a record starts with the line; a blank one is none."""
        starts = not self.is_open and line != ""
        self.started += starts
        self.is_open = leaves_open(line, self.is_open)
        return starts


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, without a copy: a batch may have 10,000 long ones."""
    return (batch.slice(at, ROWS) for batch in batches for at in range(0, len(batch), ROWS))


def _lines(batch: pa.RecordBatch) -> Iterator[tuple]:
    for file, block, is_open, raw in zip(*[batch[c].to_pylist() for c in (*_BLOCK, "open", "text")], strict=True):
        for line, end in lines_of(raw):
            yield (file, block), bool(is_open), line, end


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: what is open behind it and the records started, if none is open before it and if one is; of a
    file's first block its first record too."""
    at, walks, head, head_open = None, (), [], False
    types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string())

    def row() -> pa.RecordBatch:
        first = "".join(head).rstrip("\r\n") if head else None
        values = (*at, *[w.is_open for w in walks], *[w.started for w in walks], first)
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(values, types, strict=True)],
            [*_BLOCK, "behind_closed", "behind_open", "rows_closed", "rows_open", "head"],
        )

    for batch in _slices(batches):
        for place, _, line, end in _lines(batch):
            if place != at:
                if at:
                    yield row()
                at, walks, head = place, (Walk(False), Walk(True)), []
            for walk in walks:
                walk.step(line)
            if place[1] == 0 and walks[0].started == 1 and (not head or head_open):
                head += [line, end]
                head_open = walks[0].is_open
    if at:
        yield row()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that start in each block, in order, and what the block adds to an earlier one."""
    at, walk, text, part, index, rows = None, Walk(False), [], WHOLE, -1, []

    def finish(open_behind: bool) -> None:
        if text:
            rows.append((*at, index, FIRST if open_behind and part == WHOLE else part, "".join(text)))
            text.clear()

    def batch_of() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*_BLOCK, "_index", "part", "text"])

    for batch in _slices(batches):
        for place, is_open, line, end in _lines(batch):
            if place != at:
                finish(walk.is_open)
                at, walk, part, index = place, Walk(is_open), FURTHER if is_open else WHOLE, -1
            if walk.step(line):
                part, index = WHOLE, index + 1
            elif not text and part == WHOLE:
                continue  # a blank line
            text.append(line)
            if walk.is_open:
                text.append(end)
            else:
                finish(False)
                part = WHOLE
        if rows:
            yield batch_of()
            rows.clear()
    finish(walk.is_open)
    if rows:
        yield batch_of()


def _started(blocks: DataFrame) -> DataFrame:
    """Add to the ``_summaries`` whether a cell is ``open`` before each block, the ``_rows`` that start in it, whether these are the
    ``_top`` of the file, and the ``_owner``: the last block before in which a record started.

    A block either leaves things as they are, turns them round, or ends the same either way. So the last earlier block of
    the third kind says what is open behind it, and the number of turns since then says the rest.
    """
    order = Window.partitionBy("_file").orderBy("_block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("behind_closed") == F.col("behind_open")
    turn = F.when(~fixed & F.col("behind_closed"), 1).otherwise(0)
    counted = blocks.withColumn("_turns", F.sum(turn).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(fixed, F.struct("behind_closed", "_turns")), ignorenulls=True).over(earlier)
    counted = counted.withColumn("_last", last).withColumn("_before_turns", F.coalesce(F.lag("_turns").over(order), F.lit(0)))
    turned = (F.col("_before_turns") - F.coalesce("_last._turns", F.lit(0))) % 2 == 1
    counted = counted.withColumn("open", F.coalesce("_last.behind_closed", F.lit(False)) != turned)
    counted = counted.withColumn("_rows", F.when(F.col("open"), F.col("rows_open")).otherwise(F.col("rows_closed")))
    owner = F.last(F.when(F.col("_rows") > 0, F.col("_block")), ignorenulls=True).over(earlier)
    return counted.withColumn("_owner", owner).withColumn("_top", F.col("_owner").isNull() & (F.col("_rows") > 0))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files as texts: ``seq`` (from 0, by file name and position), ``text``.

    Cells are quoted by ``"`` and a quote within them is doubled, one in an unquoted cell is a letter. Lines end at a line
    feed, a carriage return or both, outside quotes; blank lines are no records. Line breaks in cells stay as they are.
    Bytes that are not UTF-8 become the replacement character. A cell that is never closed goes on to the end of its file; a
    record is at most 2 GB.
    """
    return _read(spark, path, False)[0].select("seq", "text")


def _with_headers(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The records but the first of each file, with that as ``header``, and the different headers.

    A header has to lie in its file's first block.
    """
    rows, blocks = _read(spark, path, True)
    heads = blocks.where("_top").select("_file", F.col("head").alias("header"))
    different = [r["header"] for r in heads.select("header").distinct().limit(MOST_HEADERS + 1).collect()]
    if len(different) > MOST_HEADERS:
        raise ValueError(f"over {MOST_HEADERS} different header rows")
    rows = rows.where("_index >= 0")
    if len(different) > 1:
        return rows.join(heads, "_file").select("seq", "text", "header"), different
    return rows.select("seq", "text", F.lit(different[0] if different else None).cast("string").alias("header")), different


def _read(spark: SparkSession, path: str, header: bool) -> tuple[DataFrame, DataFrame]:
    """The records, numbered without the headers if there are any (``_index`` in the block is then -1), and the blocks."""
    files = spark.read.text(path, lineSep="\n").select(F.make_valid_utf8("value").alias("text"), "_metadata")
    raw = with_origin(files).select("text", *_BLOCK)
    found = raw.withColumn("open", F.lit(False)).mapInArrow(_summaries, _SUMMARY)
    blocks = _started(materialise(found, "csv-blocks"))
    if header:
        blocks = blocks.withColumn("_rows", F.col("_rows") - F.col("_top").cast("long"))
    # One short row per block of a file: under a million for 100 TB.
    blocks = running_starts(blocks.select(*_BLOCK, "open", "head", "_rows", "_owner", "_top"), _BLOCK)
    blocks = materialise(blocks.select(*_BLOCK, "open", "head", "_owner", "_top", F.col("_before").alias("_base")), "csv-starts")
    inside = F.broadcast(blocks.where("open").select(*_BLOCK, "open"))
    pieces = raw.join(inside, _BLOCK, "left").mapInArrow(_pieces, _PIECES)
    starts = blocks.select(*_BLOCK, "_base", "_owner", F.col("_top") if header else F.lit(False).alias("_top"))
    placed = pieces.join(starts, _BLOCK).withColumn("_index", F.col("_index") - F.col("_top").cast("long"))
    whole = placed.where(F.col("part") == WHOLE).select("_file", (F.col("_base") + F.col("_index")).alias("seq"), "_index", "text")
    cut = placed.where(F.col("part") != WHOLE)
    owner = F.when(F.col("part") == FIRST, F.col("_block")).otherwise(F.col("_owner"))
    own = F.when(F.col("part") == FIRST, F.struct("_base", "_index"))
    # A block's later piece belongs to an earlier record, so it comes before the first piece of its own last record.
    joined = cut.groupBy("_file", owner.alias("_owner")).agg(
        F.max(own).alias("own"), F.array_sort(F.collect_list(F.struct("_block", "text"))).alias("parts")
    )
    text = F.array_join(F.col("parts.text"), "")
    joined = joined.select("_file", (F.col("own._base") + F.col("own._index")).alias("seq"), F.col("own._index").alias("_index"), text.alias("text"))
    return whole.unionByName(joined), blocks


def cells_of(text: str) -> list[str]:
    """The cells of one record."""
    csv.field_size_limit(2**31 - 1)
    return next(csv.reader(io.StringIO(text, newline="")), [])


@F.arrow_udf(T.ArrayType(T.StringType()))
def cells(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The cells of records, a few records in one go where none of them is left open."""
    csv.field_size_limit(2**31 - 1)
    for part in _slices(texts):
        own = part.to_pylist()
        rows = list(csv.reader(io.StringIO("\n".join(own), newline="")))
        yield pa.array(rows if len(rows) == len(own) else [cells_of(t) for t in own], pa.list_(pa.string()))


def read_table(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Files with a header row as ``seq`` and the columns named by ``columns`` (shown name to name), as text.

    Every file's own header says where its columns are; of two columns of one name the last counts. A column that a file
    lacks reads as empty text, a cell that a row lacks as null.
    """
    rows, headers = _with_headers(spark, path)
    rows = rows.select("seq", "header", cells("text").alias("cells"))
    places = {h: {shown: i for i, shown in enumerate(cells_of(h.removeprefix("\ufeff")))} for h in headers}

    def column(shown: str) -> Column:
        found = F.lit("")
        for header, at in places.items():
            value = F.get("cells", F.lit(at[shown])) if shown in at else F.lit("")
            found = F.when(F.col("header") == header, value).otherwise(found) if len(places) > 1 else value
        return found

    return rows.select("seq", *[column(shown).alias(name) for shown, name in columns.items()])
