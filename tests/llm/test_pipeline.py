"""The stages against brute force, each on what its predecessor kept."""

import zlib
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from dealflow.llm import mixing
from dealflow.llm.common import table
from test_packing import plain_ids

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def test_stages(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    names = docs.columns
    good = stages["quality"](spark, docs, SF)
    assert good.columns == names and sorted(rows(good)) == sorted(r for r in rows(docs) if brute.kept(r[1]))
    cut = stages["line_dedup"](spark, good, SF)
    source = {r[0]: r[2] for r in rows(good)}
    assert cut.columns == names and {r[0]: r[2] for r in rows(cut)} == source
    own = [r[:2] for r in rows(good)]
    every, copies = brute.edited_lines(own), brute.edited_lines(own, least=1.0)
    lost = lambda gone: Counter(i for i, _, _ in gone)
    left = {r[0]: r[1] for r in rows(cut)}
    found = Counter({i: t.count("\n") + 1 - (left[i].count("\n") + 1 if left[i] else 0) for i, t in own})
    assert lost(copies) <= found <= lost(every)
    assert found.total() - len(copies) >= 0.9 * (len(every) - len(copies))
    alone = stages["near_dedup"](spark, cut, SF)
    prints = {r[0]: brute.text_print(r[1]) for r in rows(cut)}
    root = brute.groups(sorted(set(prints.values())), brute.near(list(prints.values())))
    first = {}
    for i in sorted(prints):
        first.setdefault(root[prints[i]], i)
    assert alone.columns == names and sorted(rows(alone)) == sorted(r for r in rows(cut) if r[0] in first.values())
    mixed = stages["mixing"](spark, alone, SF)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(alone).collect()}
    words = Counter()
    for i, text, _ in rows(mixed):
        words[i] += len(brute.WORD.findall(text))
    assert mixed.columns == names and words == +Counter(taken)
    packed = stages["packing"](spark, mixed, SF).collect()
    want, fill = Counter(), Counter()
    for i, text, _ in rows(mixed):
        ids = plain_ids(text)
        for n, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], "<u4")
            want[i, n, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert max(Counter(r[0] for r in rows(mixed)).values()) > 1
    assert want == Counter(tuple(r)[:5] for r in packed)
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= -(-fill.total() // 4096) + 1


def test_run(spark):
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() > 100 and whole.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096


def test_odd_rows(spark):
    good = " ".join(f"word{c}" for c in "abcdefghijklmnop")
    docs = [(1, good, "en", "a", 1), (1, good, "en", "a", 1), (2, good.upper() + " x", "en", None, 1), (None, good + " more", None, "a", None)]
    docs += [(4, None, "en", "b", 0), (5, "", "en", "b", 0), (6, "short", "en", "b", 5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), SF).count() == 0
        if name != "packing":
            assert stage(spark, frame, SF).columns == frame.columns
    assert corpus_pipeline.drop_copies(spark, frame.where("doc_id = 1"), SF).count() == 1
    assert corpus_pipeline.drop_copies(spark, frame.where("doc_id IS NULL").unionAll(frame.where("doc_id IS NULL")), SF).count() == 1
