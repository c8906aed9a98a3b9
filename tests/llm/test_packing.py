import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dealflow.llm import packing
from dealflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def plain_ids(text):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(packing.vocabulary())
    return tool.encode(text or "", add_special_tokens=False).ids + [1]


def check(docs, rows, tokens=4096):
    """Pieces are the documents' ids, sequences are gapless and within the limit."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in docs:
        ids = plain_ids(text)
        own = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), tokens))
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + tokens], "<u4")
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert not fill or max(fill.values()) <= tokens
    return len(fill), sum(fill.values())


def test_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    sequences, total = check(docs, QUERIES["op5_packing"](spark, SF).collect())
    assert sequences == -(-total // 4096)


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, " \n"), (4, "Word. WORD, word's 'S don't ...!? 12a"), (5, "a\x1cb \x1f c"), (6, "x" * 9000), (7, "<|endoftext|> b"),
        (8, "İstanbul ŉ ǅ ß ẞ Σας e\u0301 क़ख़ 漢字 \u00a0a\u2003b\u200bc"), (9, "the cat " * 3000), (10, "word <|startoftext|>word.,"),
    ]
    table = spark.createDataFrame(docs, SCHEMA).withColumns({"length": F.lit("x"), "ids": F.lit(1), "_group": F.lit(2)})
    rows = packing.pack(table).collect()
    assert check(docs, rows)[0] == 3
    check(docs, packing.pack(table, tokens=16).collect(), 16)
    twice = packing.pack(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c")], SCHEMA)).collect()
    assert sorted(r["offset"] for r in twice) in ([0, 2, 5], [0, 3, 5], [0, 3, 6])
    assert packing.pack(table.limit(0)).count() == 0


def test_sequences_hold_the_documents(spark):
    docs = [(i, f"w{i} " * (i + 1)) for i in range(40)] + [(7, "w7 " * 8)] * 3 + [(7, "other"), (None, "a b"), (None, "c"), (50, None)]
    whole = [np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(spark.createDataFrame(docs, SCHEMA), 64).collect()]
    assert max(map(len, whole)) <= 64
    want = Counter()
    for _, text in docs:
        ids = plain_ids(text)
        for at in range(0, len(ids), 64):
            want.update(ids[at : at + 64])
    assert Counter(i for w in whole for i in w) == want
    assert packing.sequences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_leftovers_of_groups_are_packed_together(spark):
    rng = random.Random(5)
    lengths = [rng.choice([rng.randrange(1, 100), rng.randrange(1, 20), 100]) for _ in range(3000)]
    rest = spark.createDataFrame(list(enumerate(lengths)), "n long, length long").repartition(4)
    rows = packing.place(packing.materialise(rest, "rest"), 100, 50).collect()
    assert sorted(r["n"] for r in rows) == list(range(3000))
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 100
    # About 40 groups; without the further rounds most of them would leave a sequence of their own half empty.
    assert len(fill) <= -(-sum(lengths) // 100) + 8


def test_slabs_never_change_ids(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Häuser,", "can't", "x.y", "ONE.", "naïve", f"w{rng.randrange(200)}", "…"]) for _ in range(30)) for _ in range(60)]
    texts[9] = texts[10] = None
    tool, batch = packing.Encoder(packing.vocabulary()), pa.RecordBatch.from_pydict({"text": pa.array(texts)}).slice(3)
    for size in (1, 700, 1 << 20):
        monkeypatch.setattr(packing, "SLAB_BYTES", size)
        found = [ids for slab in packing._slabs(batch) for ids in tool.encode(pa.concat_arrays([slab["text"]]))]
        assert found == [np.array(plain_ids(t)[:-1], "<u4").tobytes() for t in texts[3:]]


@pytest.mark.parametrize("seed", range(6))
def test_search_never_loses_and_seldom_wastes(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randrange(1, 100), rng.randrange(30, 70), rng.randrange(1, 30)]) for _ in range(300)]
    start = packing.best_fit(lengths, 100)
    bins = packing.local_search([list(b) for b in start], lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert max(sum(lengths[i] for i in b) for b in bins) <= 100
    assert len(bins) <= len(start)


def test_exchange_saves_a_sequence():
    # Best fit leaves 6+3, 5+4 and 2: exchanging fills two of them.
    lengths, bins = [6, 3, 5, 4, 2], [[0, 1], [2, 3], [4]]
    assert len(packing.local_search(bins, lengths, 10)) == 2


def squares(bins, lengths):
    return sum(sum(lengths[i] for i in b) ** 2 for b in bins)


@pytest.mark.parametrize("seed", range(8))
def test_no_exchange_is_left_where_sequences_could_be_saved(seed):
    """Against every move, one-for-one and two-for-one exchange between any two underfull sequences."""
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randrange(34, 60), rng.randrange(12, 40)]) for _ in range(60)]
    start = [[i] for i in range(60)] if seed % 2 else packing.best_fit(lengths, 100)
    bins = packing.local_search([list(b) for b in start], lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(60)) and squares(bins, lengths) >= squares(start, lengths)
    if sum(100 - sum(lengths[i] for i in b) for b in bins) < 100:
        return
    fill = [sum(lengths[i] for i in b) for b in bins]
    for a in range(len(bins)):
        gives = [0, *(lengths[i] for i in bins[a])]
        twos = [lengths[i] + lengths[j] for n, i in enumerate(bins[a]) for j in bins[a][n + 1 :]]
        for b in range(len(bins)):
            if a == b or fill[a] == 100 or fill[b] == 100:
                continue
            gets = [lengths[i] for i in bins[b]]
            pairs = [lengths[i] + lengths[j] for n, i in enumerate(bins[b]) for j in bins[b][n + 1 :]]
            moves = [(x, y) for x in gives + twos for y in gets] + [(x, y) for x in gives[1:] for y in pairs]
            for x, y in moves:
                gain = y - x
                assert not (0 < gain <= 100 - fill[a] and fill[a] + gain > fill[b]), (a, b, x, y)
