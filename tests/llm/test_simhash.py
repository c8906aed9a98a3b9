import random

import brute
from pyspark.sql import functions as F

from dealflow.llm import groups, simhash
from dealflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def check(docs, found):
    prints = {i: brute.text_print(t) for i, t in docs}
    root = brute.groups(sorted(set(prints.values())), brute.near(list(prints.values())))
    first = {}
    for i in sorted(prints):
        first.setdefault(root[prints[i]], i)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in found} == {
        (i, f"{p:016x}", first[root[p]]) for i, p in prints.items()
    }


def test_all_documents_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(docs, QUERIES["op2_simhash"](spark, SF).collect())


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (4, " \n"), (9, "One"), (8, "one"), (7, "a b"), (6, "a b c d é"), (2, "A\tb"), (1, "x y " * 30_000)]
    docs = spark.createDataFrame(rows + [(9, "One")], "doc_id long, text string").withColumns({"fp": F.lit(1), "first": F.lit(2)})
    found = simhash.near_groups(docs).collect()
    assert len(found) == 10
    check(rows, found)
    with_null = simhash.near_groups(spark.createDataFrame([(None, "q"), (1, "q"), (None, "other thing")], "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in with_null.collect()) == [(0, 0), (0, 1), (1, 1)]
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_close_links_connect_what_all_pairs_do(spark):
    rng = random.Random(1)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            prints.add(centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p, p) for p in signed], "id long, fp long")
    want = brute.groups(sorted(signed), [(a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b) for a, b in brute.near(list(prints))])
    for hot in (4096, 6):
        links = groups.close_links(table, 3, hot=hot)
        assert links.where(groups.bits_apart(F.col("a"), F.col("b")) > 3).count() == 0
        roots = {r["node"]: r["root"] for r in groups.components(links).collect()}
        assert {p: roots.get(p, p) for p in signed} == want


def test_components_of_a_long_path_and_odd_links(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    table = spark.createDataFrame(links, "a long, b long")
    roots = {r["node"]: r["root"] for r in groups.components(table).collect()}
    assert roots == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_one_row_of_each_group_stays(spark):
    """Ids that repeat with other texts, null ids, repeated rows and hot copies, against brute force on rows."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(12)] + [None, "", "One", "one"]
    rows = [(rng.choice([None, *range(9)]), rng.choice(texts), k % 3) for k in range(150)]
    rows += [(None, texts[0], 1)] * 60 + [(7, texts[1], 2)] * 60
    frame = spark.createDataFrame(rows, "doc_id long, text string, _key int").withColumns({"stays": F.lit(1), "fp": F.lit("x")})
    prints = {t: brute.text_print(t) for t in texts}
    root = brute.groups(sorted(set(prints.values())), brute.near(list(prints.values())))
    members = {}
    for i, t, _ in rows:
        members.setdefault(root[prints[t]], []).append((i, t))
    for hot in (1000, 5, 1):
        simhash.HOT, before = hot, simhash.HOT
        try:
            found = simhash.one_of_each(frame.repartition(5))
            got = [(r["doc_id"], r["text"]) for r in found.collect()]
        finally:
            simhash.HOT = before
        assert found.columns == frame.columns and len(got) == len(members)
        for own in members.values():
            first = min((i is None, i or 0) for i, _ in own)
            (kept,) = [g for g in got if g in own and root[prints[g[1]]] == root[prints[own[0][1]]]]
            assert (kept[0] is None, kept[0] or 0) == first
    assert simhash.one_of_each(frame.limit(0)).count() == 0
