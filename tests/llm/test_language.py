from collections import Counter

import pytest
from pyspark.sql import functions as F

from dealflow.llm import language
from dealflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"


def plain_ngrams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        marked = "\0" + w + "\0"
        for n in (1, 2, 3):
            for i in range(len(marked) - n + 1):
                gram = marked[i : i + n]
                if gram.strip("\0") and not (n == 3 and gram[0] == gram[2] == "\0"):
                    out[gram] += 1
    return out


@pytest.mark.parametrize("piece", [5, 7, 1 << 18])
def test_counts_equal_plain_ones_in_any_pieces(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    for text in ("", "1, 2!", "Abc a  abcé", "x" * 40, "the cat -- the CAT, the catalogue " * 3, " é ", "a b"):
        assert sorted(language.ngram_counts(text)[1]) == sorted(plain_ngrams(text).values())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op1_language"](spark, SF)
    assert found.count() == 1000
    right = found.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog were there", "en") for i in range(30)] + [(100 + i, "der hund und die katze", "de") for i in range(30)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "12 !?", "de"), (1003, "die katze " * 9000, None), (None, "the dog", "fr")]
    docs = spark.createDataFrame(rows + rows[:3], SCHEMA).withColumns({"score": F.lit("x"), "lang_pred": F.lit(1), "_k0": F.lit(2)})
    found = {}
    for r in language.identify(docs).collect():
        assert found.setdefault(r["doc_id"], r) == r
        assert 0 <= r["score"] <= 1
    assert {found[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"}
    assert found[1003]["lang_pred"] == "de" and found[None]["lang_pred"] == "en" and not found[None]["held_out"]


def test_nothing_to_learn(spark):
    assert language.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    only = language.identify(spark.createDataFrame([(1, "abc", None)], SCHEMA)).first()
    assert (only["lang_pred"], only["score"]) == ("und", 0.0)
