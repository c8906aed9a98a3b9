import random

from pyspark.sql import functions as F

from dealflow.llm import bloom, urls
from dealflow.llm.queries import RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def fitting(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_odd_urls_against_brute_force(spark):
    rows = [
        (1, None), (2, ""), (3, "no scheme.org/x"), (4, "http://A.Example.ORG/es/1"), (5, "http://example.org/en/12"), (6, "http://org"),
        (7, "http://org/"), (8, "http://xorg/"), (9, "https://a.com/fr/x?y#z"), (10, "ftp://a.com/de/"), (11, "x://y.com/fr/://b.org/"),
        (12, "http://spam.net/a.html"), (13, "http://www.spam.net/a/?q"), (14, "http://ÄB.net/a"), (15, "http://m.spam.net/a#x"),
        (16, "http://spam.net\n/a"), (17, "http:///only/path"), (18, "http://spam.net/b"), (None, "http://spam.net/a"), (12, "http://spam.net/a.html"),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "_maybe": F.lit(2), "listed": F.lit(3)})
    listing = spark.createDataFrame([("spam.net/a",), ("spam.net/a",), (None,)], "url string")
    want = []
    for page, url in rows:
        host, path = split(url)
        rule = fitting(host, path)
        bare = host.removeprefix("www.").removeprefix("m.") if not host.startswith("www.") else host.removeprefix("www.")
        block = bare + path.removesuffix(".html").rstrip("/") == "spam.net/a"
        want.append((str(page), host, path, rule and rule.name, rule.verdict if rule else "block" if block else "allow"))
    found = [(str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(table, RULES, listing).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(found, key=key) == sorted(want, key=key)
    assert {r["verdict"] for r in urls.judge(table.where("page_id = 12"), [], listing.limit(0)).collect()} == {"allow"}
    assert urls.judge(table.limit(0), RULES, listing).count() == 0


def test_filter_has_no_false_no_and_few_false_yes(spark):
    rng = random.Random(4)
    keys = [f"k{rng.random()}" for _ in range(3000)]
    rows = spark.createDataFrame([(k,) for k in keys] + [(f"other{i}",) for i in range(3000)], "key string")
    tested = bloom.test(rows, "key", spark.createDataFrame([(k,) for k in keys], "k string"), "k").collect()
    assert all(r["_maybe"] for r in tested if r["key"].startswith("k"))
    assert sum(r["_maybe"] for r in tested if r["key"].startswith("o")) < 150


def test_a_full_filter_still_gives_exact_answers(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_BLOCKS", 1)
    listing = spark.range(2000).select(F.concat(F.lit("u"), "id").alias("url"))
    rows = spark.range(4000).select(F.concat(F.lit("u"), "id").alias("url"))
    assert urls.listed(rows, "url", listing).where("listed").count() == 2000
