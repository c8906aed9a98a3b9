"""Listing tables derived from the driver's tables, for the registered queries and the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.functions.money import with_numeric_columns
from dealflow.functions.text import url_hash

AS_OF = "2001-08-01 00:00:00Z"


def money_text(n: str, k: str) -> str:
    """SQL that writes the amount ``n`` in one of several styles, chosen by ``k``."""
    return (
        f"CASE {k} WHEN 0 THEN 'N/A' WHEN 1 THEN '' WHEN 2 THEN '(' || CAST({n} AS STRING) || ')' "
        f"WHEN 3 THEN '  ' || CAST({n} AS STRING) || ' ' WHEN 4 THEN '$' || CAST({n} AS STRING) || '.50' "
        f"WHEN 5 THEN '$4k' WHEN 6 THEN CAST(NULL AS STRING) WHEN 7 THEN '--' "
        f"ELSE '$' || CAST(CAST(floor({n} / 1000) AS BIGINT) AS STRING) || ',' || "
        f"lpad(CAST({n} % 1000 AS STRING), 3, '0') END"
    )


# Runs unchanged in Spark and DuckDB. Every order becomes one listing.
RAW_LISTINGS = f"""
WITH b AS (
  SELECT o_orderkey AS id, o_orderdate, CAST(floor(o_totalprice * 40) AS BIGINT) AS rev,
         c_name, c_mktsegment, n_name, n_regionkey
  FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey),
m AS (
  SELECT *, CAST(floor(rev * (id % 25) / 100) AS BIGINT) AS eb,
         CAST(floor(rev * (id % 31) / 100) AS BIGINT) AS cf,
         CAST(floor(rev * (1 + id % 4)) AS BIGINT) AS pr FROM b)
SELECT id, 'https://example.com/l/' || CAST(id AS STRING) AS url,
  CASE id % 6 WHEN 0 THEN 'SiteA' WHEN 1 THEN 'SiteB' WHEN 2 THEN 'Manual' WHEN 3 THEN 'N/A'
              WHEN 4 THEN ' n/a ' ELSE 'SiteC' END AS source,
  CASE WHEN id % 41 = 0 THEN '  ' ELSE c_name END AS title,
  CASE WHEN id % 7 = 0 THEN 'n/a' ELSE 'City ' || CAST(id % 50 AS STRING) END AS city,
  CASE WHEN id % 13 = 0 THEN 'N/A' ELSE n_name END AS state,
  CASE n_regionkey WHEN 0 THEN 'US' WHEN 1 THEN ' ca ' WHEN 2 THEN 'MX' WHEN 3 THEN 'us' ELSE NULL END AS country,
  CASE WHEN id % 17 = 0 THEN 'N/A' ELSE c_mktsegment END AS industry,
  CASE WHEN id % 19 = 0 THEN ' null ' ELSE c_mktsegment || ' business of ' || c_name || ' in ' || n_name END
    AS description,
  'Firm ' || CAST(id % 9 AS STRING) AS listed_by_firm, c_name AS listed_by_name,
  '555-' || lpad(CAST(id % 10000 AS STRING), 4, '0') AS phone, 'N/A' AS email,
  {money_text('pr', 'id % 11')} AS price, {money_text('rev', '(id + 3) % 23')} AS gross_revenue,
  {money_text('cf', '(id + 5) % 19')} AS cash_flow, {money_text('(rev % 90000)', '(id + 2) % 12')} AS inventory,
  {money_text('eb', '(id + 7) % 29')} AS ebitda,
  'N/A' AS financial_data, 'https://example.com/l/' || CAST(id AS STRING) AS source_link,
  'Employees: ' || CAST(id % 90 AS STRING) AS extra_information, 'N/A' AS deal_date, '2001-07-31' AS scraping_date,
  CASE WHEN id % 97 = 0 THEN NULL ELSE o_orderdate END AS first_seen_date,
  o_orderdate + INTERVAL '1' DAY * CAST(id % 120 AS INT) AS last_seen_date
FROM m
"""

# Orders as deals in progress. Runs unchanged in Spark and DuckDB.
DEALS = """
SELECT o_orderdate AS created_at,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 96 AS INT) END AS responded_at,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 10 AS INT) END AS offered_at,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 120 AS INT) END AS closed_at,
  CASE o_orderkey % 5 WHEN 0 THEN 'Closed' WHEN 1 THEN ' lost ' WHEN 2 THEN 'open' WHEN 3 THEN NULL ELSE 'dead' END
    AS status
FROM {orders}
"""


# A second visit to listings: two orders give the same URL (a repeat within the batch), and every third
# URL number lies among the stored ones while later ones are new. ``seq`` is the order of arrival.
BATCH = f"""
SELECT id AS seq, 'https://example.com/l/' || CAST(CAST(floor(id / 2) AS BIGINT) * 3 AS STRING) AS url,
  source, title, city, state, country, industry, description, listed_by_firm, listed_by_name, phone, email,
  ebitda AS price, price AS gross_revenue, gross_revenue AS cash_flow, inventory, cash_flow AS ebitda,
  'Revenue: ' || CAST(id AS STRING) AS financial_data, source_link, extra_information, deal_date,
  '2001-08-01' AS scraping_date
FROM ({RAW_LISTINGS}) AS r
"""


SPREAD = {"orders", "documents", "pages", "embeddings"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. A small file is a single task, so its rows are spread over the cores before heavier work."""
    table = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in SPREAD and table.rdd.getNumPartitions() < cores:
        return table.repartition(cores)
    return table


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    tables = {n: read(spark, sf_dir, n) for n in ("orders", "customer", "nation") if f"{{{n}}}" in text}
    return spark.sql(text, **tables)


def _timestamps(df: DataFrame) -> DataFrame:
    """The driver's tables hold times without a zone, taken as UTC; the listing table keeps instants."""
    return df.withColumns({c: instant(F.col(c)) for c, kind in df.dtypes if kind == "timestamp_ntz"})


def instant(time):
    return F.concat(time.cast("string"), F.lit("Z")).cast("timestamp")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing table before its numeric columns are derived."""
    return _timestamps(run(spark, sf_dir, RAW_LISTINGS))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_numeric_columns(texts(spark, sf_dir)).withColumn("listing_hash", url_hash(F.col("url")))


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timestamps(run(spark, sf_dir, DEALS))


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, BATCH)


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as listings; those with a vector have it as their description embedding."""
    docs, vectors = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    joined = docs.join(vectors, F.col("doc_id") == F.col("vec_id"), "left")
    return joined.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("https://example.org/d/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.lit("Reno").alias("city"),
        F.lit("NV").alias("state"),
        F.when(F.col("doc_id") % 4 == 0, "CA").otherwise("US").alias("country"),
        F.col("lang").alias("industry"),
        F.col("text").alias("description"),
        *[F.lit("N/A").alias(c) for c in ("listed_by_firm", "listed_by_name", "phone", "email")],
        F.concat(F.lit("$"), F.col("n_chars").cast("string")).alias("price"),
        *[F.lit("N/A").alias(c) for c in ("gross_revenue", "cash_flow", "inventory", "ebitda")],
        *[F.lit("N/A").alias(c) for c in ("financial_data", "source_link", "extra_information", "deal_date")],
        *[F.lit(AS_OF).cast("timestamp").alias(c) for c in ("first_seen_date", "last_seen_date")],
        F.lit("2001-07-31").alias("scraping_date"),
        F.col("embedding").alias("description_embedding"),
    )


def perturbed(vector):
    """Every eighth element set to zero."""
    return F.transform(vector, lambda x, i: F.when(i % 8 == 0, F.lit(0.0).cast("float")).otherwise(x))
