"""Best-fit packing of documents into token sequences, improved by a swap-based local search.

Documents become token ids and only those longer than a sequence are cut. Full pieces are sequences of their own; the
others are dealt at random into groups of bounded size. Each group is packed best-fit decreasing, then documents move
between its underfull sequences (one for one, two for one, or a plain move) as long as the sum of the squared fills
grows; a sequence that becomes empty is dropped. A group ends at most a part of one sequence above what its own
tokens allow as a lower bound, or where no exchange helps any more. The emptiest sequences of all groups are then
packed again with each other, in groups of bounded size, until one group is left.
"""

from __future__ import annotations

import os
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.session import materialise

SEQUENCE = 4096
END_ID = 1  # follows each document
VOCABULARY = "word_bpe_49k.json"
GROUP = 20_000  # pieces that one task packs together
WORD_END = "</w>"  # of the vocabulary's tokens
MARKS = [".", ","]
ROW, ROWS = 100, 100  # words encoded as one text, and texts encoded together
TEXTS = 1000  # whose ids are gathered together
SLAB_BYTES = 8 << 20  # of texts whose different words are encoded together

# Letters that normalise to themselves and fold one by one, so that such a word is one piece of the vocabulary's.
_LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+[.,]?$"
_ODD = "[\\x1c-\\x1f]"  # white space to Arrow, but not to the vocabulary's own rule
_encoders: dict[str, "Encoder"] = {}


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each range, one after the other."""
    end = np.cumsum(count)
    return np.repeat(start - (end - count), count) + np.arange(end[-1] if len(end) else 0)


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers.

    The vocabulary drops white space and never joins what it separates, so a text's ids are those of its words. Of many
    texts, each different word is encoded once and the ids are gathered by word number.
    """

    def __init__(self, path: str):
        # A task has one core; more threads would only hold on to more memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        # For folded Latin words normalising changes nothing, and white space is the only place to split.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.marks = np.array([self.tokenizer.encode(m, add_special_tokens=False).ids for m in MARKS], "<u4").reshape(-1)

    def _encode(self, texts: list[str], plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All ids and their number per text; few texts at a time, since what the tokenizer returns of each is large."""
        tool, found = self.plain if plain else self.tokenizer, []
        for k in range(0, len(texts), ROWS):
            part = tool.encode_batch_fast(texts[k : k + ROWS], add_special_tokens=False)
            found += [np.array(f.ids, "<u4") for f in part]
        return np.concatenate([np.empty(0, "<u4"), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _encode_latin(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for folded Latin words, which are one piece each: encoded in rows, cut behind word ends."""
        rows = [" ".join(words[k : k + ROW]) for k in range(0, len(words), ROW)]
        ids, _ = self._encode(rows, plain=True)
        cuts = np.flatnonzero(self.ends[ids])
        return (ids, np.diff(cuts, prepend=-1)) if len(cuts) == len(words) else self._encode(words)

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for different words. A Latin word with a mark behind is the folded word's ids and the mark's."""
        latin = pc.match_substring_regex(words, _LATIN).to_numpy(zero_copy_only=False)
        some = words.filter(pa.array(latin))
        last = pc.utf8_slice_codeunits(some, -1)
        mark = np.full(len(words), -1)
        mark[latin] = pc.fill_null(pc.index_in(last, pa.array(MARKS)), -1).to_numpy(zero_copy_only=False)
        cores = pc.utf8_lower(pc.utf8_rtrim(some, characters="".join(MARKS))).dictionary_encode()
        core_ids, core_count = self._encode_latin(cores.dictionary.to_pylist())
        other_ids, other_count = self._encode(words.filter(pa.array(~latin)).to_pylist())
        number = np.empty(len(words), np.int64)  # of the word's ids among all that were encoded
        number[latin] = cores.indices.to_numpy(zero_copy_only=False)
        number[~latin] = len(core_count) + np.arange(len(other_count))
        counts = np.concatenate([core_count, other_count])
        starts = np.cumsum(counts) - counts
        count = counts[number] + (mark >= 0)
        at = _ranges(starts[number], count)
        ids = np.concatenate([core_ids, other_ids, np.zeros(1, "<u4")])[at]
        marked = np.flatnonzero(mark >= 0)
        ids[np.cumsum(count)[marked] - 1] = self.marks[mark[marked]]
        return ids, count

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        odd = pc.fill_null(pc.match_substring_regex(texts, _ODD), False)
        split = pc.utf8_split_whitespace(pc.if_else(odd, "", pc.fill_null(texts, "")))
        coded = split.flatten().dictionary_encode()
        ids, count = self._encode_words(coded.dictionary)
        start, word = np.cumsum(count) - count, coded.indices.to_numpy(zero_copy_only=False)
        bounds, odd = split.offsets.to_numpy(), odd.to_numpy(zero_copy_only=False)
        for k in range(0, len(texts), TEXTS):
            cuts = bounds[k : k + TEXTS + 1]
            part = word[cuts[0] : cuts[-1]]
            part_ids = ids[_ranges(start[part], count[part])]
            ends = np.append(0, np.cumsum(count[part]))[cuts - cuts[0]].tolist()
            for n, (a, b) in enumerate(zip(ends, ends[1:], strict=False), k):
                yield (self._encode([texts[n].as_py()])[0] if odd[n] else part_ids[a:b]).tobytes()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(path: str | None = None) -> str:
    """The vocabulary file; on a cluster every worker has it at the same place."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _slabs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of bytes of text, or of one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLAB_BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end


def pieces(docs: DataFrame, tokens: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """Cut ``docs(doc_id, text)`` into pieces of at most ``tokens`` ids: ``doc_id, piece, start, length, ids``.

    A document is its text's ids and one end id; a null or empty text is the end id alone. ``ids`` are bytes, four per id.
    """
    file = vocabulary(path)

    def step(batch: pa.RecordBatch) -> dict:
        end = np.array([END_ID], "<u4").tobytes()
        rows: dict[str, list] = {"at": [], "piece": [], "start": [], "length": [], "ids": []}
        for at, ids in enumerate(encoder(file).encode(pa.concat_arrays([batch["text"]]))):
            ids += end
            for piece, start in enumerate(range(0, len(ids) // 4, tokens)):
                part = ids[4 * start : 4 * (start + tokens)]
                for name, value in (("at", at), ("piece", piece), ("start", start), ("length", len(part) // 4), ("ids", part)):
                    rows[name].append(value)
        return {
            "doc_id": batch["doc_id"].take(pa.array(rows["at"], pa.int64())),
            "piece": pa.array(rows["piece"], pa.int32()),
            "start": pa.array(rows["start"], pa.int64()),
            "length": pa.array(rows["length"], pa.int64()),
            "ids": pa.array(rows["ids"], pa.binary()),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in _slabs(batch):
                yield pa.RecordBatch.from_pydict(step(slab))
                pa.default_memory_pool().release_unused()

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths``: each, longest first, goes where it leaves the least room."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, []  # rooms: bit r is set if some bin has r left
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[item]
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            k = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(item)
        if room > need:
            free[room - need].append(k)
            rooms |= 1 << (room - need)
    return bins


class _Underfull:
    """The bins with room left, and where pieces of each length lie in them."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.fill = {k: f for k, b in enumerate(bins) if 0 < (f := sum(lengths[i] for i in b)) < capacity}
        self.items = {k: list(bins[k]) for k in self.fill}
        self.at: dict[int, dict[int, set[int]]] = {}  # length -> bin -> items
        self.sizes: list[int] = []
        self.pairs: dict[int, dict[int, tuple[int, int]]] | None = None  # length of two items -> bin -> items, once needed
        self.pair_sizes: list[int] = []
        for k, own in self.items.items():
            for i in own:
                self._put(k, i)

    def _put(self, k: int, item: int) -> None:
        size = self.lengths[item]
        if size not in self.at:
            self.at[size] = {}
            insort(self.sizes, size)
        self.at[size].setdefault(k, set()).add(item)

    def _take(self, k: int, item: int) -> None:
        size = self.lengths[item]
        self.at[size][k].discard(item)
        if not self.at[size][k]:
            del self.at[size][k]
            if not self.at[size]:
                del self.at[size]
                self.sizes.pop(bisect_right(self.sizes, size) - 1)

    def _two(self, k: int) -> dict[int, tuple[int, int]]:
        """Two pieces of bin ``k`` for each length that two of them have together."""
        by_size: dict[int, list[int]] = {}
        for i in self.items[k]:
            by_size.setdefault(self.lengths[i], []).append(i)
        distinct, found = sorted(by_size), {}
        for n, s in enumerate(distinct):
            if len(by_size[s]) > 1:
                found.setdefault(2 * s, (by_size[s][0], by_size[s][1]))
            for t in distinct[n + 1 :]:
                found.setdefault(s + t, (by_size[s][0], by_size[t][0]))
        return found

    def _put_pairs(self, k: int) -> None:
        for size, two in self._two(k).items():
            if size not in self.pairs:
                self.pairs[size] = {}
                insort(self.pair_sizes, size)
            self.pairs[size][k] = two

    def _take_pairs(self, k: int) -> None:
        for size in self._two(k):
            del self.pairs[size][k]
            if not self.pairs[size]:
                del self.pairs[size]
                self.pair_sizes.pop(bisect_right(self.pair_sizes, size) - 1)

    def _pair_partner(self, a: int, least: int, most: int, base: int) -> tuple[int, int, tuple[int, int]] | None:
        """As ``_partner``, for the longest two pieces of one bin."""
        if self.pairs is None:
            self.pairs = {}
            for k in self.items:
                self._put_pairs(k)
        at = bisect_right(self.pair_sizes, most) - 1
        while at >= 0 and (size := self.pair_sizes[at]) > least:
            for b, two in self.pairs[size].items():
                if b != a and self.fill[b] < base + size - least:
                    return size - least, b, two
            at -= 1
        return None

    def exchange(self, a: int, give: list[int], b: int, get: list[int]) -> None:
        """Bin ``a`` gives ``give`` to ``b`` for ``get``."""
        if self.pairs is not None:
            self._take_pairs(a)
            self._take_pairs(b)
        for source, target, moved in ((a, b, give), (b, a, get)):
            for i in moved:
                self._take(source, i)
                self.items[source].remove(i)
                self.items[target].append(i)
                self._put(target, i)
                self.fill[source] -= self.lengths[i]
                self.fill[target] += self.lengths[i]
        if self.pairs is not None:
            self._put_pairs(a)
            self._put_pairs(b)

    def _holder(self, size: int, a: int, below: int) -> int | None:
        """A bin other than ``a`` that holds a piece of this length and is filled less than ``below``."""
        return next((k for k in self.at[size] if k != a and self.fill[k] < below), None)

    def _partner(self, a: int, least: int, most: int, base: int) -> tuple[int, int, int] | None:
        """Gain, bin and piece for the longest piece in ``(least, most]`` whose exchange raises the squared fill.

        The gain is the piece's length less ``least``; ``base`` is the fill of ``a``.
        """
        at = bisect_right(self.sizes, most) - 1
        while at >= 0 and (size := self.sizes[at]) > least:
            if (b := self._holder(size, a, base + size - least)) is not None:
                return size - least, b, next(iter(self.at[size][b]))
            at -= 1
        return None

    def improve(self, a: int) -> bool:
        """Make the exchange that fills bin ``a`` best, if one raises the squared fill."""
        room, base, own = self.capacity - self.fill[a], self.fill[a], self.items[a]
        by_size = {self.lengths[i]: i for i in own}
        twice = {self.lengths[i]: (by_size[self.lengths[i]], i) for i in own if by_size[self.lengths[i]] != i}
        gives: dict[int, list[int]] = {0: []}
        gives.update({s: [i] for s, i in by_size.items()})
        distinct = sorted(by_size)
        for n, s in enumerate(distinct):  # two of a's pieces for one
            for t in distinct[n:]:
                if s != t:
                    gives.setdefault(s + t, [by_size[s], by_size[t]])
                elif s in twice:
                    gives.setdefault(s + t, list(twice[s]))
        best: tuple[int, list[int], int, list[int]] | None = None
        for total, give in gives.items():
            if (found := self._partner(a, total, total + room, base)) and (not best or found[0] > best[0]):
                best = (found[0], give, found[1], [found[2]])
                if found[0] == room:
                    break
        if not best or best[0] < room:  # two pieces of an emptier bin for one
            for total, i in by_size.items():
                if (found := self._pair_partner(a, total, total + room, base)) and (not best or found[0] > best[0]):
                    best = (found[0], [i], found[1], list(found[2]))
                    if found[0] == room:
                        break
        if not best:
            return False
        _, give, b, get = best
        self.exchange(a, give, b, get)
        if not self.items[b]:
            del self.items[b], self.fill[b]
        return True


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Exchange pieces between underfull bins until none can be saved or no exchange raises the squared fill."""
    full = [b for b in bins if sum(lengths[i] for i in b) == capacity]
    state = _Underfull(bins, lengths, capacity)
    spare = sum(capacity - f for f in state.fill.values())
    queue = sorted(state.fill, key=lambda k: -state.fill[k])
    while queue and spare >= capacity:
        again = []
        for a in queue:
            before = len(state.fill)
            while a in state.fill and 0 < state.fill[a] < capacity and state.improve(a):
                if again[-1:] != [a]:
                    again.append(a)
            spare -= capacity * (before - len(state.fill))
            if spare < capacity:
                break
        queue = sorted((k for k in state.fill if state.fill[k] < capacity), key=lambda k: -state.fill[k]) if again else []
    return full + [b for b in state.items.values() if b]


def place(rest: DataFrame, tokens: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Give each row of ``rest(length, ...)`` a ``sequence_id`` and a gapless ``offset``; lengths are 1 to ``tokens``.

    Rows are dealt by their position, so that equal or hot documents spread over all groups. Each group's emptiest
    sequence is opened again and its rows go to the next round, which has as many groups as they need; the last round
    has one.
    """
    full = rest.where(F.col("length") >= tokens)
    done = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rest.dtypes) + ", sequence_id long, offset long"
    names = [*rest.columns, "sequence_id", "offset"]

    def packer(before: int, last: bool):
        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            lengths = rows["length"].tolist()
            sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            bins = local_search(best_fit(lengths, tokens), lengths, tokens)
            fills = [sum(lengths[i] for i in own) for own in bins]
            least = min(range(len(bins)), key=fills.__getitem__)
            for k, own in enumerate(bins):
                at = 0
                for i in own:
                    sequence[i], offset[i] = k, at
                    at += lengths[i]
            number = before + int(rows["_group"].iloc[0])
            out = rows.drop(columns="_group").assign(sequence_id=(number << 32) + sequence, offset=offset)
            return out if last else out.assign(_open=(sequence == least) & (fills[least] < tokens))

        return pack

    part, before = rest.where(F.col("length") < tokens), 0
    while True:
        groups = max(1, -(-part.count() // group))
        dealt = part.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))).groupBy("_group")
        if groups == 1:
            return done.unionByName(dealt.applyInPandas(packer(before, True), schema))
        packed = materialise(dealt.applyInPandas(packer(before, False), schema + ", _open boolean"), "packed")
        done = done.unionByName(packed.where("NOT _open").select(*names))
        part, before = packed.where("_open").select(*rest.columns), before + groups


def pack(docs: DataFrame, tokens: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """Pack ``docs(doc_id, text)``: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece.

    Every row is a document of its own, repeated rows and null ids included; an empty table gives no piece. Lengths of
    all pieces are stored once, since they are counted before they are dealt. ``sequences`` gives their ids.
    """
    cut = pieces(docs, tokens, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = place(materialise(cut, "pieces"), tokens)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, tokens: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """The packed sequences of ``docs(doc_id, text)``: ``sequence_id`` and the ``ids`` of its pieces, four bytes per id.

    Pieces are stored with their ids and numbered, and each is looked up once by its number, so rows that repeat an id
    and rows without one keep their own.
    """
    cut = materialise(pieces(docs, tokens, path).withColumn("number", F.monotonically_increasing_id()), "pieces")
    placed = place(cut.select("number", "length"), tokens)
    whole = placed.join(cut.select("number", "ids"), "number")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return whole.groupBy("sequence_id").agg(joined.alias("ids"))
