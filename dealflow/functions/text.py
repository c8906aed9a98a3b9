"""Text clean-up, labels, hashes and dates as Column expressions."""

from __future__ import annotations

import html
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealflow.schema import NA

# White space as Python's str.strip() sees it, as characters and as a pattern.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
SPACES += "\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"

# Lower-cased texts that count as no value.
EMPTY_VALUES = ["", "0", "$0", "0.0", "0.00", "$0.00", "none", "n/a", "null"]

# Phrases of a bot-check page, and phrases that only a real listing page shows.
BLOCK_PHRASES = [
    "access denied",
    "forbidden",
    "temporarily unavailable",
    "blocked",
    "attention required",
    "verify you are human",
    "captcha",
    "enable javascript and cookies",
]
BLOCK_TITLES = ["access denied", "attention required"]
LISTING_PHRASES = ["asking price", "business description"]


def strip_space(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACES))


def collapse_space(value: Column) -> Column:
    return strip_space(F.regexp_replace(value, f"{SPACE}+", " "))


def value_or_na(text: Column) -> Column:
    """``N/A`` for NULL and for every empty-like value (longer texts need no look)."""
    short = F.octet_length(text) <= max(map(len, EMPTY_VALUES))
    return F.when(short & F.lower(text).isin(EMPTY_VALUES), F.lit(NA)).otherwise(F.coalesce(text, F.lit(NA)))


def normalise(value: Column) -> Column:
    return value_or_na(strip_space(value.cast("string")))


def clean_text(value: Column) -> Column:
    return value_or_na(collapse_space(value))


def known(value: Column) -> Column:
    """The normalised value, or NULL where that is ``N/A`` (so that it drops out of ``concat_ws``)."""
    return F.nullif(normalise(value), F.lit(NA))


def is_present(value: Column) -> Column:
    """Not NULL, not blank and not ``N/A`` in any case; never NULL itself."""
    text = F.trim(value)
    return F.coalesce((text != "") & (F.upper(text) != NA), F.lit(False))


def display_text(value: Column) -> Column:
    text = F.trim(value)
    return F.when(text != "", text).otherwise(F.lit(NA))


def source_label(value: Column) -> Column:
    return F.when(is_present(value), value).otherwise(F.lit("Unknown"))


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def manual_url(url: Column, title: Column, description: Column) -> Column:
    """The given URL, or one derived from title and description when it is missing."""
    derived = F.concat(
        F.lit("manual://"),
        F.sha2(F.concat(F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))), 256),
    )
    return F.when(F.coalesce(url, F.lit("")) == "", derived).otherwise(url)


def epoch_ms_date(value: Column) -> Column:
    """Epoch milliseconds to a UTC ``YYYY-MM-DD``; empty text for zero, missing or malformed input."""
    ms = value.cast("string").try_cast("bigint")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / F.lit(86400000)).cast("int"))
    return F.when(F.coalesce(ms, F.lit(0)) == 0, F.lit("")).otherwise(F.date_format(day, "yyyy-MM-dd"))


def parse_location(value: Column) -> Column:
    """``city, state, country`` text to a struct; a blank part reads as ``N/A``, no third part as ``US``."""
    parts = F.transform(F.split(clean_text(value), ",", -1), clean_text)
    return F.struct(
        F.get(parts, F.lit(0)).alias("city"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("state"),
        F.coalesce(F.get(parts, F.lit(2)), F.lit("US")).alias("country"),
    )


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def unescape_html(value: Column) -> Column:
    """Decode character references; texts without ``&`` are never sent to Python."""
    decoded = _unescape(F.when(F.contains(value, F.lit("&")), value))
    return F.coalesce(decoded, value)


def strip_html(value: Column) -> Column:
    """Decode references first, then turn tags into blanks and collapse white space."""
    text = F.regexp_replace(unescape_html(value), "<[^>]+>", " ")
    return F.coalesce(collapse_space(text), F.lit(""))


def page_title(html_text: Column) -> Column:
    return F.regexp_extract(html_text, r"(?is)<title[^>]*>(.*?)</title", 1)


def is_block_page(html_text: Column, chars: int | None = None) -> Column:
    """A bot-check page by its title, or by a phrase when no listing phrase is on the page (or its first ``chars``)."""
    title = F.lower(page_title(html_text))
    head = F.lower(html_text) if chars is None else F.substring(F.lower(html_text), 1, chars)

    def any_of(text: Column, phrases: list[str]) -> Column:
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | F.contains(text, F.lit(phrase))
        return hit

    flagged = any_of(title, BLOCK_TITLES) | (any_of(head, BLOCK_PHRASES) & ~any_of(head, LISTING_PHRASES))
    return F.coalesce(flagged, F.lit(False))


def is_auction_url(url: Column) -> Column:
    return F.contains(url, F.lit("Business-Auction"))


def format_utc(ts: Column, pattern: str) -> Column:
    """The instant written in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), pattern)


def iso_utc(ts: Column) -> Column:
    return format_utc(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` to four places, NULL when ``whole`` is zero."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 4)


def moment(as_of: datetime | str | Column | None) -> Column:
    """The clock of a report: an explicit time, or the query's start time."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("timestamp")
