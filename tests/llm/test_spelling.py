import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dealflow.llm import spelling
from dealflow.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def plain_counts(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(counts):
    """Near words share what is left of them when one letter of either, or of both at one place, is taken out."""
    less = {}
    for w in counts:
        for i in range(len(w)):
            less.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    near = {w: set() for w in counts}
    for w in counts:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            near[w].update(o for o in less[i, cut] if o != w)
            if cut in counts:
                near[w].add(cut)
                near[cut].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        if best and counts[best] >= 10 * counts[w]:
            form[w] = best
    rows = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return sorted(rows, key=lambda r: r[0])


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_plain_search(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_variants(plain_counts(docs))
    assert rows_of(QUERIES["op13_spelling"](spark, f"/root/testdata/{sf}")) == want and any(r[1] for r in want)


@pytest.mark.parametrize("most", [40, 700])
def test_boxes_of_any_size_find_the_same(spark, most):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = plain_variants(plain_counts([tuple(r) for r in table.collect()]))
    assert rows_of(spelling.variants(table, most)) == want


def test_words_that_agree_in_all_counts(spark):
    """Anagrams and words one letter from them fill boxes that counts alone do not cut."""
    from itertools import islice, permutations

    words = ["".join(p) for p in islice(permutations("abcdefgh"), 0, 4000, 9)]
    words += [w[:3] + "q" + w[4:] for w in words] + [w + "a" for w in words[:50]] + ["r" + w[1:] for w in words] + [w[:-1] for w in words]
    text = " ".join(w for w in words for _ in range(2))
    docs = [(i, text) for i in range(2)]
    assert rows_of(spelling.variants(spark.createDataFrame(docs, SCHEMA), 20)) == plain_variants(plain_counts(docs))


def test_forms_are_followed_to_the_last(spark):
    docs = [(1, "abcdefgh " * 3 + "abcdefghi " * 40 + "abcdefghij " * 500 + "abcdefghijk " * 6000)]
    found = {r["word"]: r for r in spelling.variants(spark.createDataFrame(docs, SCHEMA)).collect()}
    last = max(found, key=lambda w: found[w]["n"])
    assert [r[0] for r in plain_variants(plain_counts(docs))] == sorted(found)
    assert {r["root"] for r in found.values()} == {last} and len(found) == 4


def test_odd_rows(spark):
    long = "x" * 30_000
    odd = [
        (None, "Straßen straßen STRASSEN strassen Übermut übermut"), (None, None), (1, ""), (2, "1 2 3 !"), (3, f"{long} {long} {long}y {long}y"),
        (4, "kürzlich kürzlich kürzlicH"), (4, "kürzlich kürzlich kürzlicH"), (5, "a×b÷cdefg a×b÷cdefg abcdefg"),
    ]
    docs = spark.createDataFrame(odd, SCHEMA).withColumns({"word": F.lit("w"), "n": F.lit(0), "box": F.lit(1)})
    assert rows_of(spelling.variants(docs)) == plain_variants(plain_counts(odd))
    assert rows_of(spelling.variants(docs.limit(0))) == []


def test_near_is_one_edit():
    def edits(w):
        letters = "abc"
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        return {a + c + b[1:] for a, b in cuts if b for c in letters} - {w}, {a + c + b for a, b in cuts for c in letters}

    words = ["aab", "abab", "abba", "cab", "abcab", "aaaa", "aaa", "bbaa"]
    for a in words:
        replaced, inserted = edits(a)
        for b in words:
            assert spelling.near(a, b) == (b in replaced or b in inserted), (a, b)


def test_steps_between_paths_differ():
    found = spelling.offsets(spelling.GROUPS)
    assert len({o & spelling.CODE_MASK for o in found}) == len(found) == 1 + 2 * 16 + 16 * 15
