import hashlib
import html

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dealflow.functions import money, text
from dealflow.functions.vectors import cosine_distance
from helpers import listings, texts, values

MONEY_CASES = {
    "$1,200,000": 1200000.0,
    "  450000  ": 450000.0,
    "(12,500.50)": -12500.5,
    "99.25": 99.25,
    "+7": 7.0,
    "N/A": None,
    "na": None,
    "": None,
    None: None,
    "abc": None,
    "$12.3.4": None,
    "$4k": None,
    "--": None,
    "-": None,
    "null": None,
    "()": None,
    "(-5)": None,
    "1e5": None,
    "1 000": 1000.0,
}


def test_money_texts(spark):
    df = texts(spark, *MONEY_CASES)
    want = list(MONEY_CASES.values())
    got = values(df, money.money_numeric(F.col("v")))
    assert [None if g is None else float(g) for g in got] == want
    assert values(df, money.money_float(F.col("v"))) == want


def test_money_trims_differ(spark):
    df = texts(spark, "\t5", "5\n", " 5")
    assert values(df, money.money_numeric(F.col("v"))) == [None, None, None]
    assert values(df, money.money_float(F.col("v"))) == [5.0, 5.0, 5.0]


def test_money_too_large_is_null(spark):
    df = texts(spark, "9" * 18, "9" * 19)
    assert [v is None for v in values(df, money.money_numeric(F.col("v")))] == [False, True]


def test_money_loose(spark):
    df = texts(spark, "$2,500,000", "-5", "$4k", "N/A", None, "", "1.2.3", ".", "n/a 7")
    assert values(df, money.money_loose(F.col("v"))) == [2500000.0, 5.0, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0, 7.0]


def test_money_fields_prefer_the_stored_number(spark):
    from decimal import Decimal

    df = listings(
        spark,
        {"price": "$150,000", "price_num": Decimal(145000), "gross_revenue": "$1,000,000", "gross_revenue_num": None,
         "cash_flow": "N/A", "cash_flow_num": None, "ebitda": "$250,000", "ebitda_num": Decimal(260000)},
    )
    row = money.with_money_fields(df).first()
    assert (row.price_numeric, row.gross_revenue_numeric, row.cash_flow_numeric, row.ebitda_numeric) == (
        145000.0, 1000000.0, None, 260000.0)


def test_numeric_drift_returns_changed_rows_only(spark):
    from decimal import Decimal

    df = listings(spark, {}, {"price_num": None}, {"ebitda": "N/A"}, {"price": "N/A", "price_num": None})
    got = {r["id"]: (r["price_num"], r["ebitda_num"]) for r in money.numeric_drift(df).collect()}
    assert got == {2: (Decimal(900000), Decimal(250000)), 3: (Decimal(900000), None)}


def test_normalise(spark):
    df = texts(spark, None, "", " ", "0", "$0", " 0.0", "0.00", "$0.00", "None", "n/a", "NULL", " x ", " y\x1c")
    assert values(df, text.normalise(F.col("v"))) == ["N/A"] * 11 + ["x", "y"]


def test_clean_text(spark):
    df = texts(spark, None, "", " \n ", " a \t b c ", "N/A", "$0")
    assert values(df, text.clean_text(F.col("v"))) == ["N/A", "N/A", "N/A", "a b c", "N/A", "N/A"]


def test_location(spark):
    df = texts(spark, "Reno, NV", "Reno, NV, CA", "Reno", "", None, "Reno, , US", "Reno,")
    got = [tuple(r) for r in df.select(text.parse_location(F.col("v")).alias("p")).select("p.*").collect()]
    assert got == [
        ("Reno", "NV", "US"), ("Reno", "NV", "CA"), ("Reno", "", "US"), ("N/A", "", "US"), ("N/A", "", "US"),
        ("Reno", "N/A", "US"), ("Reno", "N/A", "US"),
    ]


def test_strip_html(spark):
    df = texts(spark, "<p>A &amp; B</p>&nbsp;<b>C</b>", "&lt;i&gt;x&lt;/i&gt;", None, "", "&#8364;5 &eacute;", "plain")
    assert values(df, text.strip_html(F.col("v"))) == ["A & B C", "x", "", "", "€5 é", "plain"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=["Cs"], blacklist_characters="\x00"), max_size=12), min_size=1, max_size=30))
def test_strip_space_is_python_strip(spark, samples):
    df = texts(spark, *samples)
    assert values(df, text.strip_space(F.col("v"))) == [s.strip() for s in samples]
    assert values(df, text.unescape_html(F.col("v"))) == [html.unescape(s) for s in samples]


def test_epoch_ms(spark):
    df = texts(spark, "1767225600000", "0", None, "x", "1767225599999", "")
    assert values(df, text.epoch_ms_date(F.col("v"))) == ["2026-01-01", "", "", "", "2025-12-31", ""]


def test_hashes(spark):
    df = texts(spark, "https://example.com/é")
    assert values(df, text.url_hash(F.col("v"))) == [hashlib.sha256("https://example.com/é".encode()).hexdigest()]
    made = "manual://" + hashlib.sha256(b"TD").hexdigest()
    assert values(df, text.manual_url(F.lit(""), F.lit("T"), F.lit("D"))) == [made]
    assert values(df, text.manual_url(F.lit(None), F.lit("TD"), F.lit(None))) == [made]


def test_labels(spark):
    df = texts(spark, None, " ", "n/a", " N/A ", " SiteA ")
    assert values(df, text.source_label(F.col("v"))) == ["Unknown"] * 4 + [" SiteA "]
    assert values(df, text.display_text(F.col("v"))) == ["N/A", "N/A", "n/a", "N/A", "SiteA"]
    assert values(df, text.is_present(F.col("v"))) == [False, False, False, False, True]


def test_block_pages(spark):
    long = "x" * 12000
    df = texts(
        spark, "<title>Access Denied</title> asking price", "<p>Solve the CAPTCHA</p>",
        "<p>captcha</p> Asking Price: 5", long + "captcha", "<p>fine</p>", None,
    )
    assert values(df, text.is_block_page(F.col("v"))) == [True, True, False, True, False, False]
    assert values(df, text.is_block_page(F.col("v"), chars=12_000)) == [True, True, False, False, False, False]


@pytest.mark.parametrize(
    "a,b,want",
    [([1.0, 0.0], [1.0, 0.0], 0.0), ([1.0, 0.0], [0.0, 2.0], 1.0), ([1.0, 0.0], [-3.0, 0.0], 2.0), ([0.0, 0.0], [1.0, 0.0], None)],
)
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    assert df.select(cosine_distance(F.col("a"), F.col("b"))).first()[0] == want
