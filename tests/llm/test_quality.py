import brute
from pyspark.sql import functions as F

from dealflow.llm import quality

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def check(docs, found):
    want = sorted((str(i), *[brute.measures(t)[c] for c in COLUMNS], brute.base_failed(brute.measures(t)), brute.kept(t)) for i, t in docs)
    assert sorted((str(r["doc_id"]), *[r[c] for c in COLUMNS], r["base_failed"], r["kept"]) for r in found) == want


def test_odd_rows_against_brute_force(spark):
    words = "one two three four five six seven eight nine ten eleven"
    docs = [
        (1, None), (2, ""), (3, " \t\n\x0b"), (4, words), (5, words + " " + words), (6, "\n".join([words, words, "", " ", "x"])),
        (7, "a a a a a a a a a a a a"), (8, "# " * 40 + words), (9, words.upper()), (10, "é ß " * 30), (11, "wow! " * 12 + words),
        (12, "x" * 400 + " " + words), (13, "- " + "\n- ".join(words.split() * 2)), (14, "...\n".join(words.split())), (None, words),
        (15, " ".join(f"w{i}" for i in range(30_000)) + " " + words), (16, "\r\n".join([words + " a", words + " b"])), (4, words),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"kept": F.lit(1), "_m": F.lit(2), "n_words": F.lit("x")})
    check(docs, quality.judge(table, ["doc_id"]).collect())


def test_order_of_rules_changes_no_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    usual = quality.judge(docs, ["doc_id"]).select("doc_id", "kept")
    turned = quality.judge(docs, ["doc_id"], quality.RULES[::-1]).select("doc_id", "kept")
    assert sorted(usual.collect()) == sorted(turned.collect())
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], quality.judge(docs, ["doc_id"]).collect())


def test_rules_are_ordered_by_rejections_per_cost(spark):
    texts = spark.createDataFrame([("one two three four five six seven eight nine ten %d" % i,) for i in range(50)], "_text string")
    never, always = quality.Rule("never", lambda t, m: F.lit(False)), quality.Rule("always", lambda t, m: m["n_words"] > 0)
    assert [r.name for r in quality.order_rules(texts, [never, always])] == ["always", "never"]
    assert quality.judge(texts.limit(0).withColumnRenamed("_text", "text"), []).count() == 0
