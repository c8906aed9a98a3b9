"""URL filters: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.llm import bloom
from dealflow.session import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = "://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    """Applies to ``host`` and its subdomains where the URL's path starts with ``path``."""

    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z folded; empty for a null."""
    return F.coalesce(F.translate(F.regexp_extract(url, _SPLIT, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host and path as listed: without ``www.`` or ``m.``, without ``.html`` and slashes at the end; null without a host."""
    bare = F.regexp_replace(host, "^(www|m)\\.", "")
    stem = F.regexp_replace(F.regexp_replace(path, "\\.html$", ""), "/+$", "")
    return F.when(host != "", F.concat(bare, stem))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as a struct of ``rule`` and ``verdict``, or null; of equal ones the first given."""
    found = None
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule: string, verdict: string>") if found is None else found


def listed(urls: DataFrame, column: str, listing: DataFrame) -> DataFrame:
    """Add ``listed``: whether the URL in ``column`` is one of ``listing(url)``.

    The Bloom filter answers no for most URLs where they are read. Only possible hits are shuffled to an exact hash
    join with the distinct listed URLs, which removes the false ones. A null is not listed.
    """
    distinct = materialise(listing.select(F.col("url").alias("_url")).where("_url IS NOT NULL").distinct(), "listed")
    tested = bloom.test(urls, column, distinct, "_url")
    hits = tested.where("_maybe").join(distinct.withColumn("listed", F.lit(True)).hint("shuffle_hash"), F.col(column) == F.col("_url"), "left")
    hits = hits.withColumn("listed", F.coalesce("listed", F.lit(False))).drop("_url")
    return hits.unionByName(tested.where("NOT _maybe").withColumn("listed", F.lit(False))).drop("_maybe")


def judge(pages: DataFrame, rules: list[Rule], listing: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url)``.

    The longest rule that fits decides; without one a URL is blocked if its canonical form is in ``listing(url)`` and
    allowed otherwise. A null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed.
    Rows are judged one by one: repeated rows and null ids stay.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    ruled = rows.where("_rule IS NOT NULL").select("page_id", "host", "path", "_rule.rule", "_rule.verdict")
    rest = rows.where("_rule IS NULL").withColumn("_canonical", canonical(F.col("host"), F.col("path")))
    verdict = F.when(F.col("listed"), "block").otherwise("allow").alias("verdict")
    found = listed(rest, "_canonical", listing).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), verdict)
    return ruled.unionByName(found)
