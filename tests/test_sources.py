import json

import pytest
from pyspark.sql import functions as F

from dealflow.operators import pages
from dealflow.operators.collector import map_items, parse_item
from dealflow.sources import csv as files
from dealflow.sources.items import collect_items, read_items
from helpers import records

ITEM = {
    "title": " Mill ", "state": "CA", "county": "Kern", "urlPath": "a/1", "description": "<p>Old &amp; good</p>",
    "businessCategory": ["Food", "", "Retail"], "businessTypes": ["Bakery", ""], "businessAttributes": ["Franchise", "Remote"],
    "firstName": "Ann", "lastName": "Lee", "contactName": "Office", "phoneNumber": "1", "email": "a@b.c",
    "askingPrice": 900000, "revenueInt": 0, "revenue": "$5,000,000", "cashFlow": 300000, "adjustedNet": "0",
    "employees": 12, "establishedYear": 1990, "sizeInSquareFeet": 800, "saleReason": "n/a", "down": "$5",
    "businessStatus": "open", "ffe": None, "createdAt": 1767225600000,
}


def mapped(spark, item, legacy=False):
    df = spark.createDataFrame([(json.dumps(item),)], "j string").select(parse_item("j").alias("item"))
    return map_items(df, "SiteX", "https://example.com", "2026-02-21", legacy_na=legacy).first().asDict()


def test_item(spark):
    row = mapped(spark, ITEM)
    assert row["title"] == "Mill" and row["city"] == "Kern" and row["country"] == "US"
    assert row["url"] == row["source_link"] == "https://example.com/business-for-sale/a/1"
    assert row["industry"] == "Food, Retail (Bakery)" and row["description"] == "Old & good"
    assert row["listed_by_name"] == "Ann Lee" and row["gross_revenue"] == "$5,000,000" and row["ebitda"] == "N/A"
    assert row["financial_data"] == "Revenue: $5,000,000; Cash Flow: 300000"
    assert row["extra_information"] == (
        "Employees: 12 | Established: 1990 | Size: 800 sqft | Attributes: Franchise, Remote | Down Payment: $5 | Status: open")
    assert row["deal_date"] == "2026-01-01" and row["inventory"] == ""


def test_bare_item(spark):
    row = mapped(spark, {"contactName": "Office", "businessTypes": ["Bakery"], "businessCategory": ""})
    assert row["listed_by_name"] == "Office" and row["industry"] == "Bakery" and row["url"] == ""
    assert row["financial_data"] == row["extra_information"] == row["deal_date"] == ""
    old = mapped(spark, {"contactName": "Office", "businessTypes": ["Bakery"]}, legacy=True)
    assert old["listed_by_name"] == "N/A N/A" and old["industry"] == "N/A (Bakery)"
    assert old["financial_data"] == "Revenue: N/A; Cash Flow: N/A; EBITDA: N/A"
    assert old["extra_information"] == "Sale Reason: N/A | Down Payment: N/A | Status: N/A | FF&E: N/A"


def test_item_files(spark, tmp_path):
    for page in range(3):
        items = [ITEM | {"title": f"{page}-{n}", "cashFlow": 3_000_000 * n} for n in range(2)]
        (tmp_path / f"p{page}.json").write_text(json.dumps({"results": items, "nextPageToken": "x"}))
    items = read_items(spark, str(tmp_path))
    every = collect_items(items, "S", "https://example.com", "2026-02-21")
    assert sorted(r["seq"] for r in every.collect()) == list(range(6))
    screened = collect_items(items, "S", "https://example.com", "2026-02-21", mode="non-software", limit=2).collect()
    assert sorted(r["seq"] for r in screened) == [0, 1]


def test_csv_round_trip(spark, tmp_path):
    rows = records(spark, {"title": 'He said "hi"', "url": "https://e.com/1", "description": "two\nlines, one cell"}, {"title": None, "email": ""})
    files.write_listing_csv(rows, str(tmp_path / "out"))
    files.write_listing_csv(records(spark, {"title": " kept "}), str(tmp_path / "blanks"))
    assert files.read_listing_csv(spark, str(tmp_path / "blanks")).first()["title"] == " kept "
    back = files.read_listing_csv(spark, str(tmp_path / "out")).collect()
    assert {r["description"] for r in back} == {"two\nlines, one cell", "N/A"}
    assert 'He said "hi"' in {r["title"] for r in back}
    lines = files.read_listing_csv(spark, str(tmp_path / "blanks"), line_breaks=False)
    assert files.numbered_records(lines).first()["title"] == "kept"


def test_csv_oddities(spark, tmp_path):
    text = b'Title,URL,Other,Price\n"A ""x"", y",https://e.com/1,z, 0 \n\nshort,https://e.com/2\n"two\nlines",https://e.com/3,o,$5,more\nbad\xff,https://e.com/4,o,n/a\n'
    (tmp_path / "f.csv").write_bytes(text)
    rows = files.numbered_records(files.read_listing_csv(spark, str(tmp_path / "f.csv"))).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == [0, 1, 2, 3]
    assert [r["title"] for r in rows] == ['A "x", y', "short", "two\nlines", "bad�"]
    assert [r["price"] for r in rows] == ["N/A", "N/A", "$5", "N/A"]
    assert {r["city"] for r in rows} == {"N/A"} and "Other" not in rows[0]


def test_url_lists(spark, tmp_path):
    (tmp_path / "u.csv").write_text(
        "name\nx, https://site.com/1 ,https://site.com/2\nhttps://other.com/1,y,z,w,https://site.com/3\n"
        "https://site.com/1\nhttp://www.site.com/Business-Auction/9\nsite.com/4\n"
    )
    rows = files.read_url_rows(spark, str(tmp_path / "u.csv"))
    found = files.listing_urls(rows, "site.com").orderBy("seq").collect()
    assert [tuple(r) for r in found] == [("https://site.com/1", 1), ("https://site.com/3", 2)]


PAGE = """<html><head><title>t</title></head><body><h1> The <b>Mill</b> </h1>
<h2 class="big gray">Reno, NV</h2>
<div class="a businessDescription"><div>Well<br>kept &amp; old</div> works</div>
<p><span class="t">Asking Price:</span><i>x</i> <span>$900,000</span></p>
<p><span>Gross Revenue: </span><span> </span></p>
<div><span>Cash Flow (SDE)</span> <span>$0</span><span>later</span></div>
<span>EBITDA:</span>
<section>Business Listed By: <span>Joe Doe</span></section><a class="cmp-name">Firm &eacute;</a>
<div><span><span>Phone Number</span></span><span><a href="tel: 555 ">call</a></span></div>
<a href="/x">x</a><a href="mailto:me@b.c">m</a><script>var a = "<h1>no</h1>";</script></body></html>"""


def test_page(spark):
    df = spark.createDataFrame([("https://e.com/1", PAGE), ("https://e.com/2", None)], "url string, html string")
    row, empty = [r.asDict() for r in pages.extract_pages(df, "SiteY", "2026-02-21").orderBy("url").collect()]
    assert row["title"] == "The Mill" and (row["city"], row["state"], row["country"]) == ("Reno", "NV", "US")
    assert row["description"] == "Wellkept & old works" and row["price"] == "$900,000"
    assert row["gross_revenue"] == row["cash_flow"] == row["ebitda"] == row["financial_data"] == "N/A"
    assert row["listed_by_firm"] == "Firm é" and row["phone"] == "555" and row["email"] == "me@b.c"
    assert row["listed_by_name"] == "Joe Doe"
    assert {v for k, v in empty.items() if k not in ("url", "source_link", "source", "country", "scraping_date")} == {"N/A"}
    old = pages.extract_pages(df.where("html is not null"), "SiteY", "2026-02-21", legacy_na=True).first().asDict()
    assert old["financial_data"] == "Gross Revenue: N/A; Cash Flow: N/A" and old["ebitda"] == "N/A"


def test_page_tries_the_next_selector_on_blanks(spark):
    html = '<div class="listing-location"> </div><div class="business-location">Elko</div><b id="ContactBrokerNameHyperLink"></b><i class="x broker-name">Al</i>'
    df = spark.createDataFrame([("u", html)], "url string, html string")
    new = pages.extract_pages(df, "S", "d").first()
    old = pages.extract_pages(df, "S", "d", legacy_na=True).first()
    assert (new["city"], new["state"], new["listed_by_name"]) == ("Elko", "N/A", "Al")
    assert (old["city"], old["state"], old["listed_by_name"]) == ("N/A", "N/A", "N/A")


def test_deep_and_broken_pages():
    assert pages.page_fields("<div>" * 5000 + "<h1>x</h1>")["title"] == "x"
    assert pages.page_fields("</div></p><h1>a<p>b</h1></i>")["title"] == "ab"
    assert pages.page_fields("<li>a<li><span>Asking Price:</span><span>5</span>")["price"] == "5"


def test_page_python_runs_once(spark):
    df = spark.createDataFrame([("u", PAGE)], "url string, html string")
    plan = pages.extract_pages(df, "S", "d")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and F is not None


def test_usual_tags_do_not_need_the_general_parser(monkeypatch):
    usual = "<H1 id=a>x</H1><div class='b broker-name' CLASS=\"c broker-name\">n</div><span>Asking Price:</span><span>5</span><a href='mailto:a@b'>m</a>"
    odd = "<title><h1>no</h1></title><h1 x y=1>y</h1 ><a href=mailto:p/q&amp;r>m</a><script><h1>z</h1></script>"
    general = []
    for name in ("parse_starttag", "parse_endtag"):
        own = getattr(pages.HTMLParser, name)
        monkeypatch.setattr(pages.HTMLParser, name, lambda self, i, own=own: general.append(i) or own(self, i))
    found = {k: v for k, v in pages.page_fields(usual).items() if v}
    assert found == {"title": "x", "price": "5", "listed_by_name": "n", "email": "mailto:a@b"}
    assert not general
    pages.page_fields(odd)
    assert general
