"""Repeated byte strings by merged Burrows-Wheeler transforms.

Every byte that lies in a string of ``SPAN`` bytes which also starts elsewhere in the corpus is marked.

Each window of ``SPAN`` bytes is known by its anchor: the place in it whose ``GRAM`` bytes have the smallest hash, the
leftmost of equal ones. Equal windows have equal anchors at equal offsets, so windows only need to be compared within
the groups of equal anchors, and only anchors found twice are looked at. Neighbouring windows of one anchor are kept
together as a snippet, the bytes they cover; equal snippets become one with a count. Snippets of different text under
the same anchor are cut to the windows near each other and are indexed: shards of them get their suffix order and Burrows-Wheeler transform, and the transforms
are merged by refining how their rows interleave, in prefixes of doubling length, without comparing the texts again. The
refinement also gives the rows that have a common prefix of ``SPAN`` bytes, which are the repeated strings.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.llm import bloom
from dealflow.llm.common import arrow_map
from dealflow.session import materialise

SPAN = 200  # bytes
GRAM = 50  # bytes whose hash makes an anchor
PIECE = 1 << 19  # windows of a text that are looked at together; places within fit 20 bits
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses
FILTER_WORDS = 1 << 21  # 16 MB: most that tasks hold of the filter of repeated anchors
PART = 12  # windows of a snippet that are indexed together
BATCH_BYTES = 32 << 10  # snippets indexed together: small enough for the caches of a core
HOT_BYTES = 512 << 10  # different snippets of one key beyond which their windows are compared by their hashes


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse modulo 2^64, for a piece."""
    inverse = pow(BASE, -1, 1 << 64)
    size = PIECE + SPAN
    out = []
    for base in (BASE, inverse):
        column = np.full(size, base, np.uint64)
        column[0] = 1
        out.append(np.multiply.accumulate(column))
    return out[0], out[1]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    forth, back = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forth[: len(data)], out=sums[1:])
    value = (sums[GRAM:] - sums[:-GRAM]) * back[: len(data) - GRAM + 1]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the mixing steps of splitmix64
        value = (value ^ (value >> np.uint64(shift))) * np.uint64(factor)
    return value ^ (value >> np.uint64(31))


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, from running minima of blocks in both directions."""
    short = -len(values) % width
    padded = np.append(values, np.full(short, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    forward = np.minimum.accumulate(padded, 1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(backward[:count], forward[width - 1 : width - 1 + count])


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: hash of the anchor, first window, number of windows, place behind the first."""
    data = np.frombuffer(text, np.uint8)
    found: list[tuple] = []
    places = np.uint64((1 << 20) - 1)
    for start in range(0, len(data) - SPAN + 1, PIECE):
        part = data[start : start + PIECE + SPAN - 1]
        hashes = _gram_hashes(part)
        keyed = (hashes & ~places) | np.arange(len(hashes), dtype=np.uint64)
        at = (_window_minima(keyed, SPAN - GRAM + 1) & places).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        found.append((hashes[at[first]].view(np.int64), first + start, np.diff(np.append(first, len(at))), at[first] - first))
    if not found:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.where(F.octet_length("text") >= SPAN)


def _repeated_anchors(docs: DataFrame) -> DataFrame:
    """Anchors that occur at least twice: ``anchor``."""

    def step(batch: pa.RecordBatch) -> dict:
        return {"anchor": np.concatenate([anchors(t.as_py().encode())[0] for t in batch["text"]])}

    every = arrow_map(_texts(docs).select("text"), "anchor long", step)
    return materialise(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of the anchors' low bits, 16 bits for each of them but never above ``FILTER_WORDS`` words.

    It only spares work: an anchor it lets through wrongly meets no equal one later.
    """
    words = 1 << max(6, min(FILTER_WORDS.bit_length() - 1, (keys.count() // 4).bit_length()))
    word = F.shiftright("anchor", 6).bitwiseAND(words - 1).alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("anchor").bitwiseAND(63).cast("int"))
    # At most 2^21 rows of two longs.
    found = keys.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def snippets(docs: DataFrame) -> DataFrame:
    """The snippets of repeated anchors, stored: ``doc_id, text_hash, start, windows, ahead, anchor, code, snippet``.

    ``start`` is the first window in the text, ``ahead`` the anchor's place behind it and ``code`` a hash of the bytes;
    with the anchor it tells snippets apart.
    """
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(_repeated_anchors(docs)))

    def step(batch: pa.RecordBatch) -> dict:
        bits = held.value
        rows: dict[str, list] = {k: [] for k in ("row", "start", "windows", "ahead", "anchor", "code", "snippet")}
        for row, text in enumerate(batch["text"]):
            data = text.as_py().encode()
            anchor, first, windows, ahead = anchors(data)
            word = bits[(anchor >> 6) & (len(bits) - 1)]
            known = np.flatnonzero((word >> (anchor & 63)) & 1)
            cut = [data[a : a + n + SPAN - 1] for a, n in zip(first[known].tolist(), windows[known].tolist(), strict=True)]
            rows["row"].append(np.full(len(known), row, np.int64))
            rows["start"].append(first[known])
            rows["windows"].append(windows[known])
            rows["ahead"].append(ahead[known])
            rows["anchor"].append(anchor[known])
            rows["code"].append(np.fromiter(map(xxhash.xxh64_intdigest, cut), np.uint64, len(cut)).view(np.int64))
            rows["snippet"].extend(cut)
        at = pa.array(np.concatenate(rows["row"]))
        return {
            "doc_id": batch["doc_id"].take(at),
            "text_hash": batch["text_hash"].take(at),
            **{k: np.concatenate(rows[k]).astype(np.int64) for k in ("start", "windows", "ahead", "anchor", "code")},
            "snippet": pa.array(rows["snippet"], pa.binary()),
        }

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text_hash long, start long, windows long, ahead long, anchor long, code long, snippet binary"
    return materialise(arrow_map(_texts(docs), schema, step), "snippets")


def suffix_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order and transform of a shard: place of each suffix in the joined shard, symbol before it, terminators.

    Strings end in terminators of their own, which come before all bytes in the order of the strings and are symbol 0
    of the transform; byte ``b`` is symbol ``b + 1``, which UTF-8 keeps below 256. Ranks are doubled in length until all
    suffixes differ.
    """
    joined = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
    ends = np.flatnonzero(joined == 0xFF)
    rank = joined.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    length = 1
    while True:
        key = rank * (len(joined) + len(ends) + 256)
        key[:-length] += rank[length:] + 1
        order = np.argsort(key)  # equal keys get equal ranks, in whatever order they come
        step = np.append(0, np.diff(key[order]) != 0)
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == len(joined) - 1:
            break
        length *= 2
    before = np.append(0xFF, joined[:-1])[order].astype(np.int16) + 1
    return order, np.where(before == 256, 0, before).astype(np.uint8), ends


def merge_transforms(transforms: list[np.ndarray], terminators: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """How the rows of the transforms interleave, and which rows begin a new prefix of ``depth`` symbols.

    A transform's rows sorted by their symbols are the rows of the suffixes one symbol longer; that gives the first symbol
    of every row, its first class, and the row of the suffix one symbol shorter. A round refines the classes by those of the
    suffixes as many symbols shorter as the classes are deep, so their depth doubles; the last round goes just to ``depth``.
    Terminators are classes of their own, so nothing behind one is looked at. Rounds stop when all rows differ.
    """
    source = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    shorter, prefix, start, ended = [], [], 0, 0
    for transform, ends in zip(transforms, terminators, strict=True):
        order = np.argsort(transform, kind="stable")
        first = transform[order].astype(np.int64) + sum(terminators)
        first[:ends] = np.arange(ended, ended + ends)
        shorter.append(order + start)
        prefix.append(first)
        start, ended = start + len(order), ended + ends
    hops, prefix, reached = [np.concatenate(shorter)], np.concatenate(prefix), 1  # hop ``k`` leads 2^k symbols on
    while reached < depth:
        step = min(reached, depth - reached)
        behind = prefix
        for k, hop in enumerate(hops):
            if step >> k & 1:
                behind = behind[hop]
        key = prefix * (int(prefix.max()) + 1) + behind
        order = np.argsort(key)
        key = key[order]
        prefix[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        if prefix[order[-1]] == len(prefix) - 1:
            break
        hops.append(hops[-1][hops[-1]])
        reached += step
    order = np.argsort(prefix, kind="stable")
    prefix = prefix[order]
    return source[order], np.append(True, prefix[1:] != prefix[:-1])


def repeated_windows(strings: list[bytes], span: int = SPAN, shard_bytes: int | None = None) -> list[np.ndarray]:
    """For each string the starts of its windows of ``span`` bytes that some string holds elsewhere too.

    Strings go to shards of ``shard_bytes``, by default to two shards.
    """
    shards, size = [[]], 0
    most = shard_bytes or sum(map(len, strings)) // 2 + 1
    for k, text in enumerate(strings):
        if size and size + len(text) > most and len(shards) < 255:
            shards.append([])
            size = 0
        shards[-1].append(k)
        size += len(text)
    parts = [suffix_order([strings[k] for k in shard]) for shard in shards]
    source, fresh = merge_transforms([p[1] for p in parts], [len(p[2]) for p in parts], span)
    alone = fresh & np.append(fresh[1:], True)
    base = np.cumsum([0] + [len(p[0]) for p in parts])
    places = np.empty(len(source), np.int64)
    places[np.argsort(source, kind="stable")] = np.concatenate([p[0] + b for p, b in zip(parts, base, strict=False)])
    shared = np.sort(places[~alone])
    starts = np.cumsum([0] + [len(t) + 1 for t in strings])
    cuts = np.searchsorted(shared, starts)
    return [shared[a:b] - s for a, b, s in zip(cuts[:-1], cuts[1:], starts, strict=False)]


def _indexed(texts: DataFrame) -> DataFrame:
    """``key, code, found`` of ``texts(key, code, snippet)`` by merged transforms; no key is in two tasks' indexes."""
    total = texts.agg(F.coalesce(F.sum(F.octet_length("snippet").cast("long")), F.lit(0))).first()[0]
    batches = max(1, -(-total // BATCH_BYTES))

    def index(rows: pd.DataFrame) -> pd.DataFrame:
        found = repeated_windows(rows["snippet"].tolist())
        return pd.DataFrame({"key": rows["key"], "code": rows["code"], "found": [f.astype(np.int32) for f in found]})

    batch = F.pmod(F.xxhash64("key"), F.lit(batches))
    return texts.groupBy(batch.alias("batch")).applyInPandas(index, "key long, code long, found array<int>")


def _compared(texts: DataFrame) -> DataFrame:
    """The same for keys with very many different snippets: windows are dealt by a hash of their bytes."""
    at = F.sequence(F.lit(0), F.octet_length("snippet") - SPAN)
    windows = texts.select("key", "code", "snippet", F.explode(at).alias("at"))
    windows = windows.select("key", "code", "at", F.md5(F.substring("snippet", F.col("at") + 1, SPAN)).alias("window"))
    windows = materialise(windows, "windows")
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    return windows.join(twice, "window").groupBy("key", "code").agg(F.sort_array(F.collect_list("at")).alias("found"))


def _parts(texts: DataFrame, with_text: bool) -> DataFrame:
    """Snippets cut to runs of at most ``PART`` windows: ``owner, owner_code, first, windows, key, code`` and ``snippet``.

    Cuts lie at fixed distances from the anchor, and the key is a hash of the bytes that all windows there may be have in
    common. Equal windows so keep equal keys, and far fewer different snippets share one.
    """

    def step(batch: pa.RecordBatch) -> dict:
        rows: dict[str, list] = {k: [] for k in ("row", "first", "windows", "key", "code", "snippet")}
        digest = xxhash.xxh64_intdigest
        for row, (text, ahead) in enumerate(zip(batch["snippet"].to_pylist(), batch["ahead"].to_pylist(), strict=True)):
            first, count = 0, len(text) - SPAN + 1
            while first < count:
                core = ahead - (ahead - first) // PART * PART  # the last window of the part that may be there
                end = min(count, core + 1)
                piece = text[first : end + SPAN - 1]
                rows["row"].append(row)
                rows["first"].append(first)
                rows["windows"].append(end - first)
                rows["key"].append(digest(text[core : core + SPAN - PART + 1]))
                rows["code"].append(digest(piece))
                rows["snippet"].append(piece)
                first = end
        at = pa.array(rows["row"], pa.int64())
        out = {"owner": batch["key"].take(at), "owner_code": batch["code"].take(at)}
        out |= {k: pa.array(rows[k], pa.int64()) for k in ("first", "windows")}
        out |= {k: np.array(rows[k], np.uint64).view(np.int64) for k in ("key", "code")}
        return out | ({"snippet": pa.array(rows["snippet"], pa.binary())} if with_text else {})

    schema = "owner long, owner_code long, first long, windows long, key long, code long" + ", snippet binary" * with_text
    return arrow_map(texts.select("key", "code", "ahead", "snippet"), schema, step)


def _found(rows: DataFrame, texts: DataFrame, look: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The repeated windows of ``rows(key, code)``: ``key, code, found``, a null meaning all of them.

    Equal snippets are one with a count; all windows of one that occurs twice are repeated. ``look`` finds them among
    the snippets that share their key with different ones. It gets those of ``texts(key, code, snippet, ...)``, whose
    other columns are equal for equal snippets, and the number of kinds per key.
    """
    counts = materialise(rows.groupBy("key", "code").agg(F.count(F.lit(1)).alias("n")), "counts")
    kinds = counts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    kinds = materialise(kinds, "kinds")
    some = bloom.screen(texts, "key", kinds, "key").distinct()
    mixed = materialise(some.join(kinds, "key"), "mixed")
    once = counts.where("n = 1").select("key", "code")
    partly = look(mixed).where(F.size("found") > 0).join(once, ["key", "code"])
    wholly = counts.where("n > 1").select("key", "code", F.lit(None).cast("array<int>").alias("found"))
    return wholly.unionByName(materialise(partly.select("key", "code", "found"), "partly"))


def _by_index(texts: DataFrame) -> DataFrame:
    usual = F.col("kinds") * (2 * SPAN) <= HOT_BYTES
    found = _indexed(texts.where(usual).select("key", "code", "snippet"))
    if texts.where(~usual).isEmpty():
        return found
    return found.unionByName(_compared(texts.where(~usual).select("key", "code", "snippet")))


def _by_parts(texts: DataFrame) -> DataFrame:
    parts = materialise(_parts(texts, False), "parts")
    known = _found(parts, _parts(texts, True).select("key", "code", "snippet"), _by_index)
    met = parts.join(known, ["key", "code"])
    every = F.sequence(F.lit(0), (F.col("windows") - 1).cast("int"))
    starts = F.transform(F.coalesce("found", every), lambda x: (x + F.col("first")).cast("int"))
    runs = met.select(F.col("owner").alias("key"), F.col("owner_code").alias("code"), starts.alias("starts"))
    return runs.groupBy("key", "code").agg(F.flatten(F.collect_list("starts")).alias("found"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, spans``: for each text with repeated strings, runs of window starts ``(first, last)``.

    Runs may touch or overlap.
    """
    every = snippets(docs).withColumnRenamed("anchor", "key")
    known = _found(every, every.select("key", "code", "ahead", "snippet"), _by_parts)
    met = every.drop("snippet").join(known, ["key", "code"])
    whole = F.array(F.struct(F.col("start").alias("first"), (F.col("start") + F.col("windows") - 1).alias("last")))
    single = F.transform("found", lambda x: F.struct((F.col("start") + x).alias("first"), (F.col("start") + x).alias("last")))
    runs = met.select("doc_id", "text_hash", F.when(F.col("found").isNull(), whole).otherwise(single).alias("runs"))
    return runs.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("runs")).alias("spans"))


def _covered(size: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A mask of the bytes that lie in a repeated window, from runs of window starts."""
    change = np.bincount(first, minlength=size + 1) - np.bincount(np.minimum(last + SPAN, size), minlength=size + 1)
    return np.cumsum(change[:size]) > 0


def _report(rows: DataFrame) -> DataFrame:
    def step(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        spans, cuts = batch["spans"].flatten(), batch["spans"].offsets.to_numpy()
        first, last = (spans.field(n).to_numpy(zero_copy_only=False) for n in ("first", "last"))
        cuts = (cuts - cuts[0]).tolist()
        for text, a, b in zip(batch["text"], cuts, cuts[1:], strict=False):
            data = (text.as_py() or "").encode()
            removed = runs = 0
            if a < b:
                gone = _covered(len(data), first[a:b], last[a:b])
                removed, runs = int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out["n_bytes"].append(len(data))
            out["n_removed"].append(removed)
            out["n_spans"].append(runs)
            out["kept_sha256"].append(hashlib.sha256(kept if removed else data).hexdigest())
        kinds = {"kept_sha256": pa.string()}
        return {"doc_id": batch["doc_id"]} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()}

    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return arrow_map(rows.select("doc_id", "text", "spans"), schema, step)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs(doc_id, text)``.

    Texts are judged as UTF-8 bytes and as they come in; a null text is empty. All occurrences of a repeated string are
    removed, the first one too. Rows that repeat both id and text count as occurrences of their own. Texts without
    a repeated string, found by a filter on the id, stay where they are read.
    """
    spans = materialise(repeated_spans(docs), "spans").withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash")
    key = F.xxhash64("doc_id", "text_hash")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").withColumn("_key", key)
    keys = spans.select(F.xxhash64("_id", "_hash").alias("_known"))
    tested = bloom.test(rows, "_key", keys, "_known")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    none = F.array().cast("array<struct<first: bigint, last: bigint>>")
    hits = tested.where("_maybe").join(spans, same, "left").withColumn("spans", F.coalesce("spans", none))
    rest = tested.where("NOT _maybe").withColumn("spans", none)
    return _report(hits.select("doc_id", "text", "spans")).unionByName(_report(rest.select("doc_id", "text", "spans")))
