"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter n-grams in order. A document is compared with each profile
by the out-of-place distance: the sum, over the document's own most frequent n-grams, of how far each stands from its
place in the profile; an n-gram that the profile lacks counts as the full profile length.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealflow.llm.common import arrow_map

PROFILE = 300  # n-grams kept per language and per document
LONGEST = 3  # letters per n-gram at most; three code points of 21 bits fit a long
PIECE = 1 << 18  # characters of a text that are looked at together
MOST_LANGUAGES = 2000  # bound on the profiles that tasks hold: 2,000 x 300 n-grams
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, each run of other characters as one 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    points[~_letters()[points]] = 0
    return points[(points != 0) | (np.append(1, points[:-1]) != 0)]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the words of a text, coded as longs, and their counts.

    Words are runs of letters, marked at both ends by code 0; an n-gram of marks alone or one that spans two words
    does not count. Long texts are counted in pieces of bounded size.
    """
    found: dict[str, list] = {"grams": [], "counts": []}
    tail = np.zeros(1, np.int64)
    for start in range(0, len(text), PIECE):
        fresh = _codes(text[start : start + PIECE])
        if start + PIECE >= len(text):
            fresh = np.append(fresh, 0)
        codes = np.concatenate([tail, fresh])
        held = len(tail)
        grams = [codes[held:][codes[held:] != 0]]
        if LONGEST >= 2 and len(codes) >= 2:
            pair = (codes[:-1] << 21) | codes[1:]
            grams.append(pair[max(held - 1, 0) :][(pair != 0)[max(held - 1, 0) :]] | (1 << 62))
        if LONGEST >= 3 and len(codes) >= 3:
            inner = (codes[1:-1] != 0) & ((codes[:-2] != 0) | (codes[2:] != 0))
            triple = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
            first = max(held - 2, 0)
            grams.append(-1 - triple[first:][inner[first:]])
        values, counts = np.unique(np.concatenate(grams), return_counts=True)
        found["grams"].append(values)
        found["counts"].append(counts)
        tail = codes[-2:]
    if not found["grams"]:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(found["grams"]) == 1:
        return found["grams"][0], found["counts"][0]
    values, back = np.unique(np.concatenate(found["grams"]), return_inverse=True)
    return values, np.bincount(back, np.concatenate(found["counts"])).astype(np.int64)


def _top(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams in order, ties by code."""
    return values[np.lexsort((values, -counts))[:most]]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id is neither learned from nor held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def profiles(labelled: DataFrame, most: int = PROFILE) -> list[tuple[str, list[int]]]:
    """The profile of every language of ``labelled(text, lang)``, counted over all its rows.

    N-grams are counted per batch, summed by a shuffle, and ranked in two steps, so that a frequent language meets in
    no single task. What reaches the driver is ``most`` numbers per language; over ``MOST_LANGUAGES`` languages are
    refused. Rows with a null text or language are left out.
    """

    def count(batch: pa.RecordBatch) -> dict:
        rows: dict[str, list] = {}
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
            rows.setdefault(lang, []).append(text)
        out: dict[str, list] = {"lang": [], "gram": [], "n": []}
        for lang, texts in rows.items():
            values, counts = ngram_counts(" ".join(texts))
            out["lang"].append(np.full(len(values), lang, object))
            out["gram"].append(values)
            out["n"].append(counts)
        return {
            "lang": pa.array(np.concatenate(out["lang"]), pa.string()),
            "gram": np.concatenate(out["gram"]),
            "n": np.concatenate(out["n"]),
        }

    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    counted = arrow_map(rows, "lang string, gram long, n long", count)
    sums = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    part = F.pmod(F.xxhash64("gram"), F.lit(64))
    near = Window.partitionBy("lang", "part").orderBy(*order)
    best = (
        sums.withColumn("part", part)
        .withColumn("place", F.row_number().over(near))
        .where(F.col("place") <= most)
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
        .where(F.col("place") <= most)
        .groupBy("lang")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gram"))), lambda x: x["gram"]).alias("grams"))
    )
    found = best.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return sorted((r["lang"], list(r["grams"])) for r in found)


def predict(docs: DataFrame, learned: list[tuple[str, list[int]]], keep: list[str], most: int = PROFILE) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to the columns ``keep`` of ``docs(text, ...)``; one row per row.

    The nearest profile wins, ties by language name. ``score`` is 1 less the distance as a share of the largest
    possible one. A text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned.
    """
    names = [n for n, _ in learned]
    grams = np.unique(np.array([g for _, p in learned for g in p], np.int64))
    places = np.full((len(grams) + 1, len(names)), -1, np.int32)
    for k, (_, profile) in enumerate(learned):
        places[np.searchsorted(grams, np.array(profile, np.int64)), k] = np.arange(len(profile))

    def judge(text: str | None) -> tuple[str, float]:
        values, counts = ngram_counts(text) if text else (np.empty(0, np.int64),) * 2
        if not len(values) or not names:
            return UNKNOWN, 0.0
        top = _top(values, counts, most)
        at = np.searchsorted(grams, top)
        at[(at == len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != top)] = len(grams)
        there = places[at]
        off = np.where(there < 0, most, np.abs(there - np.arange(len(top))[:, None])).sum(0)
        k = int(np.argmin(off))
        return names[k], 1.0 - float(off[k]) / (most * len(top))

    def step(batch: pa.RecordBatch) -> dict:
        found = [judge(t) for t in batch["_text"].to_pylist()]
        out = {name: batch[f"_k{i}"] for i, name in enumerate(keep)}
        return out | {
            "lang_pred": pa.array([f[0] for f in found], pa.string()),
            "score": pa.array([f[1] for f in found], pa.float64()),
        }

    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["lang_pred string", "score double"])
    return arrow_map(rows, schema, step)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents that are not held out and predict all documents.

    Returns ``doc_id, held_out, lang_pred, score`` for every row of ``docs(doc_id, text, lang, ...)``; repeated rows
    are predicted alike. Languages of equal distance go to the smaller name.
    """
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    learned = profiles(rows.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return predict(rows, learned, ["doc_id", "held_out"])
