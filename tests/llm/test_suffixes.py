import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from dealflow.llm import suffixes
from dealflow.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def check(docs, found):
    want = []
    for (doc_id, text), gone in zip(docs, brute.repeated_bytes([t for _, t in docs]), strict=True):
        data = (text or "").encode()
        kept = bytes(b for i, b in enumerate(data) if i not in gone)
        want.append((str(doc_id), len(data), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == sorted(want)


def random_text(rng, size):
    return "".join(rng.choice("abcdeé \n") for _ in range(size))


def corpus():
    rng = random.Random(5)
    passage, other = random_text(rng, 420), random_text(rng, 230)
    docs = [(i, random_text(rng, rng.randrange(20, 500)) + passage[rng.randrange(150) :] + random_text(rng, 90)) for i in range(40)]
    docs += [(100 + i, other[:199] if i % 2 else other + random_text(rng, 5)) for i in range(6)]
    docs += [(200, "z" * 700), (201, "ab" * 300), (202, None), (203, ""), (204, random_text(rng, 60_000) + passage), (205, passage), (206, passage)]
    docs += [(207, docs[0][1][:-1] + "!"), (None, docs[3][1]), (208, other + other), (209, passage[:200]), (209, passage[:200])]
    return docs


@pytest.mark.parametrize("hot", [suffixes.HOT_BYTES, 1000])
def test_planted_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_BYTES", hot)
    docs = corpus()
    table = spark.createDataFrame(docs, SCHEMA).withColumns({"spans": F.lit(1), "anchor": F.lit(2), "_key": F.lit(3)})
    check(docs, suffixes.without_repeats(table).collect())


def test_texts_are_looked_at_in_pieces(spark, monkeypatch):
    docs = corpus()
    rows = suffixes.without_repeats(spark.createDataFrame(docs[:12] + docs[-8:], SCHEMA)).collect()
    check(docs[:12] + docs[-8:], rows)
    data = docs[46 + 4][1].encode()
    whole = suffixes.anchors(data)
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    parts = suffixes.anchors(data)
    assert int(whole[2].sum()) == int(parts[2].sum()) == len(data) - suffixes.SPAN + 1
    assert set(whole[0].tolist()) == set(parts[0].tolist())


def test_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(docs, QUERIES["op8_suffixes"](spark, sf).collect())


def test_nothing_repeated_and_no_rows(spark):
    one = suffixes.without_repeats(spark.createDataFrame([(1, "only " * 3)], SCHEMA)).first()
    assert (one["n_bytes"], one["n_removed"], one["n_spans"]) == (15, 0, 0)
    assert suffixes.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_merged_transforms_equal_brute_force(seed):
    rng = random.Random(seed)
    strings = ["".join(rng.choice("ab" if seed % 2 else "abc") for _ in range(rng.randrange(0, 60))).encode() for _ in range(30)]
    for span in (1, 4, 9):
        count = {}
        for s in strings:
            for i in range(len(s) - span + 1):
                count[s[i : i + span]] = count.get(s[i : i + span], 0) + 1
        want = [[i for i in range(len(s) - span + 1) if count[s[i : i + span]] > 1] for s in strings]
        for shard in (1, 100, 10_000):
            assert [f.tolist() for f in suffixes.repeated_windows(strings, span, shard)] == want


def test_suffix_order_is_that_of_sorting():
    strings = [b"banana", b"", b"ananas", b"banana"]
    joined = b"".join(s + b"\xff" for s in strings)
    order, symbols, ends = suffixes.suffix_order(strings)
    number = {e: k for k, e in enumerate(ends.tolist())}
    suffix = lambda p: [(number[q], 0) if q in number else (1000, joined[q]) for q in range(p, min(e for e in number if e >= p) + 1)]
    assert order.tolist() == sorted(range(len(joined)), key=suffix)
    assert symbols.tolist() == [0 if p == 0 or joined[p - 1] == 0xFF else joined[p - 1] + 1 for p in order]


def test_transforms_are_merged_in_few_sorts(monkeypatch):
    rng = random.Random(8)
    common = "".join(rng.choice("abc") for _ in range(230)).encode()
    strings = [bytes([rng.choice(b"abc")]) + common[: rng.randrange(180, 231)] for _ in range(12)]
    sorts, argsort = [], suffixes.np.argsort
    monkeypatch.setattr(suffixes.np, "argsort", lambda *a, **k: sorts.append(1) or argsort(*a, **k))
    for span in (1, 2, 3, 7, 64, 200):
        parts = [suffixes.suffix_order(strings[:6]), suffixes.suffix_order(strings[6:])]
        sorts.clear()
        suffixes.merge_transforms([p[1] for p in parts], [len(p[2]) for p in parts], span)
        assert len(sorts) <= 3 + span.bit_length()
        windows = [[s[i : i + span] for i in range(len(s) - span + 1)] for s in strings]
        every = [w for own in windows for w in own]
        found = suffixes.repeated_windows(strings, span, 500)
        assert [f.tolist() for f in found] == [[i for i, w in enumerate(own) if every.count(w) > 1] for own in windows]
