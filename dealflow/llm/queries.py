"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.llm import (
    language, lines, mixing, neighbours, packing, quality, sharding, simhash, spelling, suffixes, urls, warc, whitening,
)
from dealflow.llm.common import table

QUERIES = {}
ORACLE = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", *columns)


@query
def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


#: Names of hosts whose pages make up the list of blocked URLs.
SPAM_NAMES = ["casino-win", "cheap-pills", "free-bets", "spam-farm"]
RULES = [
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
]


def spam_urls(pages: DataFrame) -> DataFrame:
    """The list of blocked URLs that this query takes: the canonical URLs of all pages of the named hosts."""
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    return pages.where(host.rlike(f"(^|\\.)({'|'.join(SPAM_NAMES)})\\.")).select(urls.canonical(host, path).alias("url"))


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, RULES, spam_urls(pages))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


@query
def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = warc.archive_round_trip(pages)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


@query
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


_W = r"[\x20\x09-\x0D]"

ORACLE["op3_quality"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_W}+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
again AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, unnest(range(0, 5)) AS v(k) GROUP BY r),
m AS (
  SELECT doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered c USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 10 > n_lines * 3
    OR word_chars < n_words * 2 OR word_chars > n_words * 12
    OR len(regexp_extract_all(t, '\p{{Lu}}')) * 2 > word_chars
    OR len(regexp_extract_all(t, '!')) * 10 > n_words * 3
    OR len(regexp_extract_all(t, '(?m)(\.\.\.|…)[\x20\t\r]*$')) * 10 > n_lines * 3
    OR len(regexp_extract_all(t, '(?m)^[\x20\t]*[-*•][\x20\t]')) * 10 > n_lines * 9
    OR len(regexp_extract_all(t, '\p{{L}}')) * 10 < word_chars * 6) AS kept
FROM b"""

_HOST = "translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rules_sql(column: str) -> str:
    cases = [
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, column)}'"
        for r in sorted(RULES, key=lambda r: -len(r.name))
    ]
    return "CASE " + " ".join(cases) + " END"


ORACLE["op6_url_filter"] = rf"""
WITH p AS (
  SELECT page_id, coalesce({_HOST}, '') AS host, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '')
      || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '') END AS canonical FROM p),
spam AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|\.)({'|'.join(SPAM_NAMES)})\.') AND canonical IS NOT NULL)
SELECT page_id, host, path, {_rules_sql("name")} AS rule,
  coalesce({_rules_sql("verdict")}, CASE WHEN s.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM c LEFT JOIN spam s ON c.canonical = s.canonical"""

ORACLE["op7_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_W}+'), lambda w: w <> ''))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
         sum(sum(size)) OVER ()::BIGINT AS total
  FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(place % 3 + 1)::INT] AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, cap / weight AS room,
    (total::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT *, least(cap, weight * (SELECT arg_min(level, (room, place)) FROM l WHERE room >= level)) AS target,
         greatest(1, least(4096, total // 100000)) AS block FROM l),
b AS (SELECT *, CASE WHEN source_size >= 1000 * block THEN block ELSE source_size END AS per,
             CASE WHEN source_size >= 1000 * block THEN 1 ELSE 1000 END AS parts FROM t),
n AS (SELECT *, CASE WHEN per > 0 THEN ceil(source_size * parts / per)::BIGINT ELSE 0 END AS blocks,
             sum(CASE WHEN per > 0 THEN target * parts / per ELSE 0.0 END) OVER (ORDER BY place) AS upto FROM b),
h AS (SELECT *, CASE WHEN max(upto) OVER () > 0 THEN upto / max(upto) OVER () ELSE 0.0 END AS high FROM n),
i AS (SELECT *, coalesce(lag(high) OVER (ORDER BY place), 0.0) AS low FROM h),
points AS (
  SELECT (i * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS point
  FROM unnest(range((SELECT floor(max(upto) + 0.5)::BIGINT FROM i))) AS r(i)),
slots AS (SELECT place, count(*) AS slots FROM points JOIN i ON point >= low AND point < high GROUP BY place),
o AS (
  SELECT d.*, place, source_size, target, per, parts, blocks, coalesce(slots, 0) AS slots,
    sum(size) OVER (PARTITION BY place ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
  FROM d JOIN i ON d.source IS NOT DISTINCT FROM i.source LEFT JOIN slots USING (place))
SELECT doc_id, size, source_size, target,
  list_sum([greatest(0, least(size, (least(greatest(slots - k * blocks, 0), blocks) * per + parts - 1) // parts - start)) for k in [0, 1, 2]])::BIGINT AS taken
FROM o"""
