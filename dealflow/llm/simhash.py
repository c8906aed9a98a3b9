"""Near-duplicate documents by SimHash: pigeonhole blocks, Hamming check, connected groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.llm import bloom
from dealflow.llm.common import arrow_map
from dealflow.llm.groups import close_links, components
from dealflow.session import materialise

SHINGLE = 3  # words
DISTANCE = 3  # bits that may differ
SEED = 42
PIECE = 1 << 16  # hashes whose bits are counted together
HOT = 1000  # a fingerprint of more than this part of all rows is one of so few that they are broadcast


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without a word.

    A-Z are folded, words end at ASCII white space, and a text of fewer words than a shingle is one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        set_bits += np.unpackbits(hashes[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(2 * set_bits > len(hashes))
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (``doc_id``) and the fingerprint ``fp`` (a long with the same bits) of every row of ``docs``."""
    keep = ["doc_id"] if keep is None else keep

    def step(batch: pa.RecordBatch) -> dict:
        found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch["text"]), np.uint64, batch.num_rows)
        return {c: batch[c] for c in keep} | {"fp": found.view(np.int64)}

    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return arrow_map(docs.select(*keep, "text"), f"{schema}, fp long", step)


def classes(marked: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fp, root, component_id, links, rows`` per distinct fingerprint of the stored ``marked(doc_id, fp)``.

    ``root`` names the connected group, ``rows`` counts the fingerprint's rows.
    """
    found = marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    distinct = materialise(found, "classes")
    links = close_links(distinct.select(F.col("fp").alias("id"), "fp"), distance)
    roots = components(links).withColumnRenamed("node", "fp")
    linked = distinct.join(roots, "fp")
    heads = linked.groupBy("root").agg(F.min("first").alias("head"), (F.count("*") - 1).alias("links"))
    named = linked.join(heads, "root").select("fp", "root", "head", "links")
    return distinct.join(named, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("head", "first").alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("links"), "rows",
    )


def looked_up(rows: DataFrame, known: DataFrame, key: str, count: str) -> DataFrame:
    """The stored ``rows`` joined on ``key`` with the stored ``known``, whose ``count`` says how many rows each meets.

    Keys of more than one row in ``HOT`` are looked up by a broadcast of these alone, which are fewer than ``HOT``,
    so that no task gets all rows of one key.
    """
    total = known.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.broadcast(known.where(F.col(count) * HOT > total))
    usual = rows.join(hot.select(key), key, "left_anti").join(known, key)
    return usual.unionByName(rows.join(hot, key))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Group ``docs(doc_id, text)``: ``doc_id, fingerprint, component_id, links``.

    Documents link at ``distance`` or fewer differing bits; ``component_id`` is the smallest ``doc_id`` reachable and
    ``links`` the number of other fingerprints of the document's group. Null texts and texts without a word have
    fingerprint zero and link like any other; repeated rows give equal rows; a null id is in the group of its
    fingerprint but names none, so a group of null ids alone has a null ``component_id``.

    Documents are reduced to their distinct fingerprints before any pair is looked at, so copies, however many, are
    one row there.
    """
    marked = materialise(fingerprints(docs, shingle), "fingerprints")
    known = materialise(classes(marked, distance), "known")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return looked_up(marked, known, "fp", "rows").select("doc_id", shown, "component_id", "links")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` without near copies: one row of each group of ``near_groups`` stays.

    It is the row with the smallest ``doc_id``, null ids last, of these the one with the smallest hash of both; of rows
    equal in both, any one. So every group keeps exactly one row, whether ids repeat, are null or both. Rows
    are told apart by 96 bits of hash over id and text. Only those that may have to go are moved for a join; the
    others stay where they are read.
    """
    names, id_text = docs.columns, [F.col("doc_id").cast("string"), F.col("text")]
    key, check = F.xxhash64(*id_text, F.col("doc_id").isNull()), F.hash(*reversed(id_text))
    own = docs.select("doc_id", "text", key.alias("key"), check.alias("check"))
    marked = materialise(fingerprints(own, shingle, ["doc_id", "key", "check"]), "fingerprints")
    known = materialise(classes(marked, distance), "known")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "check")
    found = looked_up(marked, known.select("fp", "root", "rows"), "fp", "rows")
    same = materialise(found.groupBy("root", "doc_id", "key", "check").agg(F.count(F.lit(1)).alias("n")), "texts")
    heads = same.groupBy("root").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("texts"), F.sum("n").alias("members"))
    heads = heads.where("members > 1").select("root", "texts", F.col("head.key").alias("head_key"), F.col("head.check").alias("head_check"))
    stays = (F.col("key") == F.col("head_key")) & (F.col("check") == F.col("head_check"))
    met = looked_up(same, materialise(heads, "heads"), "root", "texts").withColumn("stays", stays)
    met = materialise(met.where("NOT stays OR n > 1").select("key", "check", "stays"), "copies")
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)], key.alias("_key"), check.alias("_check"))
    tested = bloom.test(rows, "_key", met, "key")
    gone = met.select(F.col("key").alias("_key"), F.col("check").alias("_check"), "stays")
    left = tested.where("_maybe").join(gone, ["_key", "_check"], "left").where("stays IS NULL OR stays")
    # Repeated rows become one before they are shuffled; what the filter let through by chance stays row by row.
    left = left.withColumn("_own", F.when(F.col("stays").isNull(), F.monotonically_increasing_id()))
    row = F.struct(*[F.col(f"_c{i}") for i in range(len(names))])
    once = left.groupBy("_key", "_check", "_own").agg(F.first(row).alias("row")).select("row.*")
    every = once.unionByName(tested.where("NOT _maybe").select(*once.columns))
    return every.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
