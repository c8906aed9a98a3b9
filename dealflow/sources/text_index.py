"""Three-letter postings of the searched texts, for requests that would otherwise read every text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.operators.browse import listing_view
from dealflow.operators.filters import NO_FILTER, ListingFilter
from dealflow.operators.search import SEARCHED, like_pattern, text_matches
from dealflow.operators.topk import top_per_group

GRAM = 3
RAREST = 4  # postings that a request intersects
SCANNED_SHARE = 0.1  # of the rows: requests whose rarest gram is in more are answered by a scan
MOST_LITERALS = 1000  # grams named in a filter, so that the files without them are skipped
ROWS_PER_FILE = 5_000_000  # postings
PIECE = 1_000_000  # postings listed together: bound of a row's ids
CODE = 21  # bits of a character
_POSTINGS, _COUNTS = "gram string, ids array<long>", "gram string, rows long"


def grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def gram_codes(text: str) -> np.ndarray:
    """The same as sorted numbers of three times ``CODE`` bits."""
    at = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = np.sort(at[:-2] << 2 * CODE | at[1:-1] << CODE | at[2:])
    return codes[np.append(True, codes[1:] != codes[:-1])[: len(codes)]]


def posting_lists(keys: list, codes: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each three letters of some texts, with the keys of those that have them."""
    every = np.concatenate(codes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(len(codes)), [len(c) for c in codes])[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
    letters = ["".join(chr(g >> CODE * k & (1 << CODE) - 1) for k in (2, 1, 0)) for g in every[first].tolist()]
    ids = pa.ListArray.from_arrays(pa.array(np.append(first, len(every)), pa.int32()), pa.array(keys, pa.int64()).take(pa.array(owner)))
    return pa.RecordBatch.from_arrays([pa.array(letters, pa.string()), ids], ["gram", "ids"])


def fixed_parts(pattern: str) -> list[str]:
    """The texts between the wildcards of a LIKE pattern, which every match has."""
    parts = re.split(r"(?s)(?<!\\)((?:\\\\)*)[%_]", pattern)
    whole = [a + (b or "") for a, b in zip(parts[::2], [*parts[1::2], ""], strict=True)]
    return [re.sub(r"(?s)\\(.)", r"\1", p) for p in whole]


class TextIndex:
    """For one snapshot the ids of the listings in which each three letters (lower-cased) occur in a searched column.

    ``postings`` list the ids of some thousand texts in a row per three letters. They are sorted by letters and first id in
    ranges, so that frequent letters are spread over tasks and files, and a request skips the files without its letters;
    ``counts`` has the number of listings per three letters.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, listings: DataFrame, path: str) -> TextIndex:
        """Write the index of ``listings(id, ...)``."""
        index = cls(listings.sparkSession, path)
        text = F.concat_ws("\x00", *[F.lower(c) for c in SEARCHED])

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, codes, count = [], [], 0
            for batch in batches:
                for key, value in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                    keys.append(key)
                    codes.append(gram_codes(value.as_py()))
                    count += len(codes[-1])
                    if count >= PIECE:
                        yield posting_lists(keys, codes)
                        keys, codes, count = [], [], 0
            if keys:
                yield posting_lists(keys, codes)

        rows = listings.select(F.col("id").cast("long").alias("id"), F.make_valid_utf8(text).alias("text")).mapInArrow(post, _POSTINGS)
        raw = f"{index.path}/unsorted"
        rows.write.parquet(raw)
        stored = index.spark.read.schema(_POSTINGS).parquet(raw)
        size = F.sum(F.size("ids").cast("long"))
        ranges = max(1, -(-(stored.agg(size).first()[0] or 0) // ROWS_PER_FILE))
        order = [F.col("gram"), F.get("ids", F.lit(0))]
        stored.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.parquet(f"{index.path}/postings")
        counts = index._postings().groupBy("gram").agg(size.alias("rows"))
        counts.repartitionByRange(max(1, ranges // 16), "gram").sortWithinPartitions("gram").write.parquet(f"{index.path}/counts")
        listings.agg(F.count(F.lit(1)).alias("rows")).write.parquet(f"{index.path}/total")
        target = index.spark._jvm.org.apache.hadoop.fs.Path(raw)
        target.getFileSystem(index.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        return index

    def _postings(self) -> DataFrame:
        return self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings")

    def _named(self, table: DataFrame, letters: set[str]) -> DataFrame:
        """The rows of some letters; files without them are skipped."""
        if len(letters) <= MOST_LITERALS:
            return table.where(F.col("gram").isin(sorted(letters)))
        return table.join(self.spark.createDataFrame([(g,) for g in sorted(letters)], "gram string"), "gram", "left_semi")

    def plan(self, queries: dict[int, str]) -> tuple[dict[int, list[str]], list[int]]:
        """Per request the letters to intersect, the rarest ones, and the requests that need a scan.

        These have no three letters between wildcards, or none that is rare. A request with letters that no listing has
        is in neither: nothing answers it.
        """
        # Letters are lower-cased by the engine that compares them.
        asked = self.spark.createDataFrame([(i, like_pattern(q)) for i, q in queries.items()], "query_id int, pattern string")
        lowered = {r["query_id"]: r["pattern"] for r in asked.select("query_id", F.lower("pattern").alias("pattern")).collect()}
        letters = {i: set().union(*map(grams, fixed_parts(p))) for i, p in lowered.items()}
        stored = self.spark.read.schema(_COUNTS).parquet(f"{self.path}/counts")
        every = set().union(*letters.values())
        counts = {r["gram"]: r["rows"] for r in self._named(stored, every).collect()}  # no more than the requests have
        most = SCANNED_SHARE * self.spark.read.schema("rows long").parquet(f"{self.path}/total").first()["rows"]
        chosen, scanned = {}, []
        for i, own in letters.items():
            rarest = sorted(own, key=lambda g: (counts.get(g, 0), g))[:RAREST]
            if not own or counts.get(rarest[0], 0) > most:
                scanned.append(i)
            elif rarest[0] in counts:
                chosen[i] = rarest
        return chosen, scanned

    def candidates(self, chosen: dict[int, list[str]]) -> DataFrame:
        """``query_id, id`` of the listings that have all letters chosen for a request."""
        rows = [(i, g, len(own)) for i, own in chosen.items() for g in own]
        wanted = self.spark.createDataFrame(rows, "query_id int, gram string, needed int")
        found = self._named(self._postings(), {g for _, g, _ in rows}).join(F.broadcast(wanted), "gram")
        found = found.select("query_id", "needed", F.explode("ids").alias("id"))
        met = found.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed"))
        return met.where("n = needed").select("query_id", "id")

    def search(self, listings: DataFrame, queries: dict[int, str], limit: int = 20, filters: ListingFilter = NO_FILTER) -> DataFrame:
        """What ``operators.search.text_search_many`` gives, on the snapshot that the index was built of.

        Letters choose the listings to look at; the request itself decides, compared as there.
        """
        if not queries:
            return listing_view(listings).limit(0).select(F.lit(0).alias("query_id"), "*", F.lit(0).alias("rank"))
        chosen, scanned = self.plan(queries)
        matching = filters.apply(listings)
        answers = []
        if chosen:
            patterns = [(i, like_pattern(queries[i])) for i in chosen]
            patterns = F.broadcast(self.spark.createDataFrame(patterns, "query_id int, _pattern string"))
            looked = matching.select("id", *SEARCHED).join(self.candidates(chosen), "id").join(patterns, "query_id")
            hit = F.lit(False)
            for column in SEARCHED:
                hit = hit | F.expr(f"{column} ILIKE _pattern")
            answers.append(looked.where(hit).select("query_id", "id"))
        if scanned:
            hits = F.array_compact(F.array(*[F.when(text_matches(queries[i]), F.lit(i)) for i in scanned]))
            answers.append(matching.select("id", F.explode(hits).alias("query_id")).select("query_id", "id"))
        if not answers:
            return listing_view(listings).limit(0).select(F.lit(0).alias("query_id"), "*", F.lit(0).alias("rank"))
        rows = answers[0] if len(answers) == 1 else answers[0].unionByName(answers[1])
        best = top_per_group(rows, "query_id", [F.col("id")], limit)
        return listing_view(listings).join(best, "id")
