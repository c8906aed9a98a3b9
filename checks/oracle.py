"""For each registered query the same result in plain SQL, written independently of the Spark code."""

from __future__ import annotations

from checks.tables import AS_OF, BATCH, DEALS, RAW_LISTINGS

NAMES = {n: n for n in ("orders", "customer", "nation")}
NOW = f"TIMESTAMP '{AS_OF.removesuffix('Z')}'"
MONEY = ["price", "gross_revenue", "cash_flow", "ebitda"]
RECORD = [
    "title", "city", "state", "country", "url", "industry", "source", "description", "listed_by_firm", "listed_by_name",
    "phone", "email", "price", "gross_revenue", "cash_flow", "inventory", "ebitda", "scraping_date", "financial_data",
    "source_link", "extra_information", "deal_date",
]


def bare(c):
    """The number text inside a money text."""
    t = f"trim({c})"
    return (
        f"regexp_replace(CASE WHEN regexp_matches({t}, '^\\(.*\\)$') THEN '-' || substr({t}, 2, length({t}) - 2) "
        f"ELSE {t} END, '[,$ ]', '', 'g')"
    )


def num(c, kind="DECIMAL(24,6)"):
    return (
        f"(CASE WHEN upper(trim({c})) IN ('', 'N/A', 'NA', 'NULL', 'NONE', '-', '--') THEN NULL "
        f"WHEN regexp_matches({bare(c)}, '^[+-]?[0-9]+(\\.[0-9]+)?$') THEN TRY_CAST({bare(c)} AS {kind}) END)"
    )


def loose(c):
    return (
        f"(CASE WHEN {c} = 'N/A' THEN 0.0::DOUBLE "
        f"ELSE coalesce(TRY_CAST(nullif(regexp_replace({c}, '[^0-9.]', '', 'g'), '') AS DOUBLE), 0.0::DOUBLE) END)"
    )


def strip(c):
    return f"regexp_replace({c}, '^[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+|[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+$', '', 'g')"


def squeeze(c):
    return strip(f"regexp_replace({c}, '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', ' ', 'g')")


def na(c):
    return (
        f"(CASE WHEN {c} IS NULL OR lower({c}) IN ('', '0', '$0', '0.0', '0.00', '$0.00', 'none', 'n/a', 'null') "
        f"THEN 'N/A' ELSE {c} END)"
    )


def norm(c):
    return na(strip(c))


def iso(c):
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


def present(c):
    return f"({c} IS NOT NULL AND trim({c}) <> '' AND upper(trim({c})) <> 'N/A')"


RAW = f"raw AS ({RAW_LISTINGS.format(**NAMES)})"
LISTINGS = (
    f"{RAW}, listings AS (SELECT *, sha256(url) AS listing_hash, "
    + ", ".join(f"{num(c)} AS {c}_num" for c in MONEY)
    + " FROM raw)"
)
FLAGGED = f"""{LISTINGS}, flagged_all AS (SELECT *,
  upper(trim(coalesce(country, ''))) IN ('US', 'CA') AS is_local,
  cash_flow_num >= 2000000 AS cash_flow_fit,
  (gross_revenue_num IS NOT NULL AND ebitda_num IS NOT NULL AND gross_revenue_num > 0
    AND ebitda_num * 10 >= gross_revenue_num) AS margin_fit,
  first_seen_date >= {NOW} - INTERVAL 7 DAY AS is_new_week,
  CASE WHEN {present('source')} THEN source ELSE 'Unknown' END AS source_name
  FROM listings),
flagged AS (SELECT *, coalesce(is_local AND cash_flow_fit AND margin_fit, false) AS qualified FROM flagged_all
  WHERE coalesce(last_seen_date, first_seen_date) >= {NOW} - INTERVAL 90 DAY)"""
SCORE = """CAST(least(100, CASE WHEN is_local THEN 20 ELSE 0 END
  + CASE WHEN cash_flow_num >= 2000000 THEN 35 WHEN cash_flow_num >= 1000000 THEN 20 ELSE 0 END
  + CASE WHEN margin_fit THEN 25 ELSE 0 END + CASE WHEN gross_revenue_num >= 10000000 THEN 10 ELSE 0 END
  + CASE WHEN is_new_week THEN 10 ELSE 0 END) AS INTEGER)"""
REASONS = """concat_ws('|', CASE WHEN is_local THEN 'Local' END,
  CASE WHEN cash_flow_num >= 2000000 THEN 'Cash Flow Fit' WHEN cash_flow_num >= 1000000 THEN 'Cash Flow Near Fit' END,
  CASE WHEN margin_fit THEN 'Margin Fit' END, CASE WHEN gross_revenue_num >= 10000000 THEN 'Revenue >= $10M' END,
  CASE WHEN is_new_week THEN 'New This Week' END)"""
SNAPSHOT = f"""SELECT count(*) AS total_listings, count(*) FILTER (is_new_week) AS new_this_week,
  count(*) FILTER (qualified) AS qualified_count,
  coalesce(round(count(*) FILTER (qualified) / nullif(count(*), 0), 4), 0.0) AS pass_rate,
  count(DISTINCT source) FILTER ({present('source')}) AS active_sources,
  count(DISTINCT industry) FILTER ({present('industry')}) AS distinct_industries FROM flagged"""
QUALITY = "SELECT " + ", ".join(
    f"coalesce(round(count(*) FILTER ({test}) / nullif(count(*), 0), 4), 0.0) AS parseable_{name}_pct"
    for name, test in {
        "revenue": "gross_revenue_num IS NOT NULL",
        "ebitda": "ebitda_num IS NOT NULL",
        "cash_flow": "cash_flow_num IS NOT NULL",
        "location": f"{present('state')} AND {present('country')}",
    }.items()
) + " FROM flagged"
FUNNEL = """SELECT 1::INTEGER AS position, 'All Listings' AS stage, count(*) AS count FROM flagged
  UNION ALL SELECT 2, 'Local (US/CA)', count(*) FILTER (is_local) FROM flagged
  UNION ALL SELECT 3, 'Cash Flow Fit', count(*) FILTER (cash_flow_fit) FROM flagged
  UNION ALL SELECT 4, 'Margin Fit', count(*) FILTER (margin_fit) FROM flagged
  UNION ALL SELECT 5, 'Shortlist', count(*) FILTER (qualified) FROM flagged"""
YIELD = """SELECT source_name AS source, count(*) AS total, count(*) FILTER (qualified) AS qualified,
  round(count(*) FILTER (qualified) / count(*), 4) AS qualified_rate FROM flagged GROUP BY 1"""
shown = lambda c: f"coalesce(nullif(trim({c}), ''), 'N/A') AS {c}"
QUEUE = f"""SELECT id, source_name AS source, {', '.join(shown(c) for c in ('title', 'state', 'country', 'gross_revenue', 'ebitda', 'cash_flow'))},
  {iso('first_seen_date')} AS first_seen_date, {SCORE} AS fit_score, {REASONS} AS reasons
  FROM flagged ORDER BY {SCORE} DESC, flagged.first_seen_date DESC NULLS LAST, id DESC LIMIT 12"""
SLA = f"""WITH deals AS ({DEALS.format(**NAMES)}), recent AS (SELECT * FROM deals WHERE created_at >= {NOW} - INTERVAL 90 DAY)
SELECT
  round(count(*) FILTER (responded_at <= created_at + INTERVAL 48 HOUR) / nullif(count(responded_at), 0), 4) AS response_48h_rate,
  round(count(*) FILTER (offered_at <= created_at + INTERVAL 5 DAY) / nullif(count(offered_at), 0), 4) AS offer_5d_rate,
  round(count(*) FILTER (closed_at <= created_at + INTERVAL 60 DAY) / nullif(count(closed_at), 0), 4) AS close_60d_rate,
  count(*) FILTER (coalesce(lower(trim(status)), '') NOT IN ('closed', 'lost', 'dead')) AS in_pipeline
FROM recent"""

VIEW_COLUMNS = [
    "id", "url", "source", "title", "city", "state", "country", "industry", "description", "listed_by_firm",
    "listed_by_name", "phone", "email", "price", "gross_revenue", "cash_flow", "inventory", "ebitda", "financial_data",
    "source_link", "extra_information", "deal_date", "scraping_date",
]
VIEW = (
    ", ".join(VIEW_COLUMNS)
    + f", {iso('first_seen_date')} AS first_seen_date, {iso('last_seen_date')} AS last_seen_date, "
    + ", ".join(f"{c}_num::DOUBLE AS {c}_num" for c in MONEY)
    + ", "
    + ", ".join(f"coalesce({c}_num::DOUBLE, {num(c, 'DOUBLE')}) AS {c}_numeric" for c in MONEY)
)
WANTED = "industry = 'BUILDING' AND country = 'US' AND cash_flow_num >= 500000 AND price_num <= 60000000 AND gross_revenue_num >= 1000000"
NUMS = ", ".join(f"{c}_num::DOUBLE AS {c}_num" for c in MONEY)
TEXTS = ["price", "gross_revenue", "cash_flow", "ebitda", "inventory"]


def each(columns, rule, table, key="id"):
    return f"SELECT {key}, " + ", ".join(f"{rule(c)} AS {c}" for c in columns) + f" FROM {table}"


def unescape(c):
    """The references that occur in the pages; HTML lets them go without the semicolon (cut-off titles do)."""
    for entity, char in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        c = f"regexp_replace({c}, '&{entity};?', '{char}', 'g')"
    return c


def no_tags(c):
    return squeeze(f"regexp_replace({c}, '<[^>]+>', ' ', 'g')")


BATCH_SQL = BATCH.format(**NAMES)
NORM_BATCH = f"batch AS (SELECT seq, {', '.join(f'{norm(c)} AS {c}' for c in RECORD)} FROM ({BATCH_SQL}) AS b)"
UPLOAD_BATCH = (
    f"batch AS (SELECT seq, CASE WHEN seq % 23 = 0 THEN 'N/A' ELSE {norm('url')} END AS url, "
    f"{', '.join(f'{norm(c)} AS {c}' for c in RECORD if c != 'url')} FROM ({BATCH_SQL}) AS b)"
)
OUTCOMES = f"""{RAW}, {UPLOAD_BATCH}, outcomes AS (SELECT b.*, CASE WHEN b.url = 'N/A' THEN 'error'
  WHEN EXISTS (SELECT 1 FROM raw r WHERE r.url = b.url) THEN 'skipped'
  WHEN row_number() OVER (PARTITION BY b.url ORDER BY b.seq) > 1 THEN 'skipped' ELSE 'inserted' END AS status FROM batch b)"""


def merged(updates, result, batch=NORM_BATCH):
    """The table after an upsert: fixed columns from the first batch row of a URL, ``updates`` from the last."""
    fixed = [c for c in RECORD if c not in updates and c != "url"]
    firsts = ", ".join(f"arg_min({c}, seq) AS {c}" for c in fixed)
    lasts = ", ".join(f"arg_max({c}, seq) AS {c}" for c in updates)
    either = lambda c: f"CASE WHEN m.url IS NULL THEN l.{c} ELSE m.{c} END AS {c}"
    kept = ", ".join(either(c) if c in updates else f"coalesce(l.{c}, CASE WHEN l.url IS NULL THEN m.{c} END) AS {c}" for c in RECORD if c != "url")
    nums = ", ".join(f"{num(c)}::DOUBLE AS {c}_num" for c in MONEY)
    return f"""WITH {LISTINGS}, {batch},
m AS (SELECT url, min(seq) AS seq, max(seq) AS last_seq, {firsts}, {lasts} FROM batch WHERE url <> 'N/A' GROUP BY url),
j AS (SELECT coalesce(l.id, (SELECT max(id) FROM listings) + 1 + m.seq) AS id, coalesce(l.url, m.url) AS url, {kept},
  {iso(f"CASE WHEN l.url IS NULL THEN {NOW} ELSE l.first_seen_date END")} AS first_seen_date,
  {iso(f"CASE WHEN m.url IS NULL THEN l.last_seen_date ELSE {NOW} END")} AS last_seen_date,
  m.url IS NOT NULL AS touched, l.url IS NULL AS fresh, m.last_seq
  FROM listings l FULL JOIN m ON l.url = m.url),
after AS (SELECT *, sha256(url) AS listing_hash, {nums} FROM j)
SELECT {result} FROM after"""


COLLECTOR_UPDATES = ["title", "price", "gross_revenue", "cash_flow", "ebitda", "inventory", "financial_data", "extra_information", "description", "scraping_date"]
UPLOAD_UPDATES = ["title", "price", "gross_revenue", "cash_flow", "ebitda", "description"]


def collected(legacy):
    """Records mapped from the items that ``checks.queries`` builds out of listings."""
    name = (lambda c: norm(c)) if legacy else (lambda c: f"nullif({norm(c)}, 'N/A')")
    truthy = lambda c: f"CASE WHEN {c} NOT IN ('', '0', '0.0', 'false') THEN {c} END"
    label = lambda text, v: f"'{text}: ' || {v}"
    first = "CASE WHEN id % 3 > 0 THEN listed_by_name END"
    last = "CASE WHEN id % 3 = 1 THEN 'Smith' END"
    category = "CASE WHEN id % 2 = 1 THEN concat_ws(', ', nullif(industry, ''), 'Sale') ELSE industry END"
    kinds = "CASE WHEN id % 3 = 0 THEN concat_ws(', ', nullif(state, ''), 'Other') END"
    rev_int = "CASE WHEN id % 6 > 0 THEN CAST(id * (id % 2) AS VARCHAR) END"
    revenue = f"coalesce({truthy(rev_int)}, gross_revenue)"
    url = "CASE WHEN id % 5 > 0 THEN 'https://example.com/business-for-sale/p/' || CAST(id AS VARCHAR) ELSE '' END"
    described = f"({norm('j.html')})"
    full = f"concat_ws(' ', {name(first)}, {name(last)})"
    money = ", ".join([label("Revenue", name(revenue)), label("Cash Flow", name("cash_flow")), label("EBITDA", name("ebitda"))])
    extra = ", ".join([
        label("Employees", truthy("CAST(id % 9 AS VARCHAR)")),
        "'Established: 1999'",
        "'Size: ' || CASE WHEN id % 8 > 0 THEN CAST(id AS VARCHAR) END || ' sqft'",
        label("Sale Reason", name("city")),
        "CASE WHEN id % 4 = 0 THEN 'Attributes: Franchise, Remote' END",
        label("Down Payment", name("inventory")),
        "'Status: open'",
        "'FF&E: N/A'" if legacy else "NULL",
    ])
    industry = f"coalesce(nullif(concat_ws(' ', {name(category)}, CASE WHEN {name(category)} IS NOT NULL THEN '(' || {kinds} || ')' END), ''), {kinds}, 'N/A')"
    return f"""WITH {RAW}, j AS (SELECT *, '<p>' || description || '</p> <b>R&amp;D</b>' AS html FROM raw)
SELECT id, {norm('title')} AS title, {norm('city')} AS city, {norm('state')} AS state, 'US' AS country, {url} AS url,
  {industry} AS industry, 'SiteC' AS source, {no_tags(unescape(described))} AS description, '' AS listed_by_firm,
  coalesce(nullif({full}, ''), {norm('listed_by_firm')}) AS listed_by_name, {norm('phone')} AS phone, {norm('email')} AS email,
  {norm('price')} AS price, {norm(revenue)} AS gross_revenue, {norm('cash_flow')} AS cash_flow, '' AS inventory,
  {norm('ebitda')} AS ebitda, '2001-08-01' AS scraping_date, concat_ws('; ', {money}) AS financial_data,
  {url} AS source_link, concat_ws(' | ', {extra}) AS extra_information,
  coalesce(strftime(first_seen_date, '%Y-%m-%d'), '') AS deal_date FROM j"""


def screened(cf, eb, rev, price):
    return f"""CASE WHEN {cf} > 0 OR {eb} > 0 THEN {cf} >= 2000000 OR {eb} >= 2000000
  WHEN {rev} > 0 THEN {rev} >= 5000000 WHEN {price} > 0 THEN {price} >= 6000000 ELSE false END"""


SCREEN = screened(loose("cash_flow"), loose("ebitda"), loose("gross_revenue"), loose("price"))

DISTANCE = "greatest(0.0, 1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])) + 0.0"
DESCRIBED = """described AS (SELECT doc_id AS id, source, 'Document ' || CAST(doc_id AS VARCHAR) AS title, 'Reno' AS city, 'NV' AS state,
  CASE WHEN doc_id % 4 = 0 THEN 'CA' ELSE 'US' END AS country, lang AS industry, text AS description, n_chars, embedding
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"""


def neighbours(queries, corpus, k, where="true"):
    return f"""ranked AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), id) AS rank
  FROM (SELECT q.query_id, c.id, {DISTANCE} AS distance FROM {queries} q, {corpus} c WHERE {where})),
hits AS (SELECT query_id, id, distance, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {k})"""


VECTORS = "q AS (SELECT vec_id AS query_id, embedding FROM embeddings), c AS (SELECT vec_id AS id, embedding FROM embeddings)"
TOP10 = f"WITH {VECTORS}, {neighbours('q', 'c', 10)} SELECT query_id, id, round(distance, 4) AS distance, rank FROM hits"
PERTURB = "list_transform(embedding, lambda x, i: CASE WHEN (i - 1) % 8 = 0 THEN 0.0::FLOAT ELSE x END)"


def words(c):
    return f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x <> ''))"


def like_any(q):
    return "(" + " OR ".join(f"{c} ILIKE '%{q}%'" for c in ("title", "description", "industry", "city", "state")) + ")"


FAR = f"""WITH {LISTINGS}, r AS (SELECT id, coalesce(price_num::DOUBLE, {num('price', 'DOUBLE')}) AS price_numeric,
  row_number() OVER (ORDER BY price_num DESC NULLS LAST, id DESC) AS n, count(*) OVER () AS total FROM listings)
SELECT id, price_numeric FROM r WHERE n > CAST(floor((total - 1) / 100) AS BIGINT) * 100"""

ORACLE = {
    "source_yield": f"WITH {FLAGGED} {YIELD}",
    "dashboard_snapshot": f"WITH {FLAGGED} {SNAPSHOT}",
    "dashboard_funnel": f"WITH {FLAGGED} {FUNNEL}",
    "dashboard_quality": f"WITH {FLAGGED} {QUALITY}",
    "fit_score": f"WITH {FLAGGED} SELECT id, {SCORE} AS fit_score FROM flagged_all",
    "fit_reasons": f"WITH {FLAGGED} SELECT id, {REASONS} AS reasons FROM flagged_all",
    "priority_queue": f"WITH {FLAGGED} {QUEUE}",
    "sla_rates": SLA,
    "dashboard_overview": f"""WITH {FLAGGED}, s AS ({SNAPSHOT}), y AS ({YIELD}), u AS ({QUALITY}), p AS ({QUEUE}), a AS ({SLA}), f AS ({FUNNEL})
SELECT 'snapshot' AS section, item, value FROM (SELECT COLUMNS(*)::DOUBLE FROM s) UNPIVOT INCLUDE NULLS (value FOR item IN (total_listings, new_this_week, qualified_count, pass_rate, active_sources, distinct_industries))
UNION ALL SELECT 'criteria_funnel', stage, count::DOUBLE FROM f
UNION ALL SELECT 'data_quality', item, value FROM u UNPIVOT INCLUDE NULLS (value FOR item IN (parseable_revenue_pct, parseable_ebitda_pct, parseable_cash_flow_pct, parseable_location_pct))
UNION ALL SELECT 'sla', item, value FROM (SELECT COLUMNS(*)::DOUBLE FROM a) UNPIVOT INCLUDE NULLS (value FOR item IN (response_48h_rate, offer_5d_rate, close_60d_rate, in_pipeline))
UNION ALL SELECT 'source_yield', source, qualified_rate FROM y
UNION ALL SELECT 'priority_queue', CAST(id AS VARCHAR), fit_score::DOUBLE FROM p""",
    "dashboard_rollups": f"""WITH {FLAGGED}, s AS ({SNAPSHOT}), y AS ({YIELD}), u AS ({QUALITY}), f AS ({FUNNEL})
SELECT 'snapshot' AS section, item, value FROM (SELECT COLUMNS(*)::DOUBLE FROM s) UNPIVOT INCLUDE NULLS (value FOR item IN (total_listings, new_this_week, qualified_count, pass_rate, active_sources, distinct_industries))
UNION ALL SELECT 'criteria_funnel', stage, count::DOUBLE FROM f
UNION ALL SELECT 'data_quality', item, value FROM u UNPIVOT INCLUDE NULLS (value FOR item IN (parseable_revenue_pct, parseable_ebitda_pct, parseable_cash_flow_pct, parseable_location_pct))
UNION ALL SELECT 'source_yield', source, qualified_rate FROM y""",
    "distinct_sketches": f"WITH {FLAGGED} " + " UNION ALL ".join(f"SELECT '{c}' AS item, count(DISTINCT {c}) FILTER ({present(c)}) AS exact, true AS near FROM flagged" for c in ("source", "industry", "title", "listed_by_firm", "city")),
    "listing_view": f"WITH {LISTINGS} SELECT {VIEW} FROM listings",
    "filter_listings": f"WITH {LISTINGS} SELECT id, {NUMS} FROM listings WHERE {WANTED}",
    "filter_listings_fallback": f"WITH {LISTINGS} SELECT id, {NUMS} FROM listings WHERE {WANTED}",
    "listing_page": f"WITH {LISTINGS} SELECT {VIEW} FROM listings ORDER BY listings.last_seen_date DESC NULLS LAST, id DESC LIMIT 25 OFFSET 25",
    "listing_page_asc": f"WITH {LISTINGS} SELECT id, url, coalesce(cash_flow_num::DOUBLE, {num('cash_flow', 'DOUBLE')}) AS cash_flow_numeric FROM listings ORDER BY cash_flow_num ASC NULLS LAST, id DESC LIMIT 100 OFFSET 200",
    "listing_page_far": FAR,
    "listing_page_far_index": FAR,
    "listing_page_info": f"WITH {LISTINGS} SELECT count(*) AS total, 2::INTEGER AS page, 10::INTEGER AS per_page, CAST(ceil(count(*) / 10) AS BIGINT) AS total_pages FROM listings WHERE {WANTED}",
    "listing_count": f"WITH {LISTINGS} SELECT count(*) AS total FROM listings WHERE source = 'SiteA' AND ebitda_num <= 1000000",
    "listing_by_id": f"WITH {LISTINGS} SELECT {VIEW} FROM listings WHERE id = 719",
    "filter_options": f"WITH {RAW} " + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS facet, {c} AS value FROM raw WHERE {present(c)}" for c in ("source", "industry", "state", "country")),
    "stats_totals": f"WITH {RAW} SELECT count(*) AS total_listings, count(*) FILTER (first_seen_date > {NOW} - INTERVAL 7 DAY) AS new_this_week, count(DISTINCT industry) FILTER (industry <> 'N/A') AS distinct_industries FROM raw",
    "stats_by_source": f"WITH {RAW} SELECT source, count(*) AS count FROM raw GROUP BY 1",
    "stats_top_industries": f"WITH {RAW} SELECT industry, count(*) AS count FROM raw WHERE industry <> 'N/A' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "money_numeric": f"WITH {RAW} " + each(TEXTS, lambda c: num(c) + "::DOUBLE", "raw"),
    "money_float": f"WITH {RAW} " + each(TEXTS, lambda c: num(c, "DOUBLE"), "raw"),
    "money_loose": f"WITH {RAW} " + each(TEXTS, loose, "raw"),
    "money_fields": f"WITH {LISTINGS} SELECT id, " + ", ".join(f"coalesce({c}_num::DOUBLE, {num(c, 'DOUBLE')}) AS {c}_numeric" for c in MONEY) + " FROM listings",
    "numeric_drift": f"WITH {LISTINGS} SELECT id, {NUMS} FROM listings WHERE (price_num + id % 3) IS DISTINCT FROM price_num",
    "normalise_text": f"WITH {RAW} " + each(["title", "city", "country", "description", "price", "inventory"], norm, "raw"),
    "clean_text": each(["text"], lambda c: na(squeeze(c)), "documents", "doc_id"),
    "strip_html": each(["html"], lambda c: no_tags(unescape(c)), "pages", "page_id"),
    "epoch_ms_date": "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events",
    "parse_location": f"""WITH {RAW}, p AS (SELECT id, CASE id % 5 WHEN 0 THEN city WHEN 1 THEN concat_ws(' , ', city, state)
    WHEN 2 THEN concat_ws(',', city, ' ', country) WHEN 3 THEN concat_ws(', ', city, state, country) END AS place FROM raw),
  t AS (SELECT id, string_split({na(squeeze('place'))}, ',') AS parts FROM p)
SELECT id, {na(squeeze('parts[1]'))} AS city, CASE WHEN len(parts) >= 2 THEN {na(squeeze('parts[2]'))} ELSE '' END AS state,
  CASE WHEN len(parts) >= 3 THEN {na(squeeze('parts[3]'))} ELSE 'US' END AS country FROM t""",
    "url_hash": "SELECT page_id, sha256(url) AS hash FROM pages",
    "manual_url": "SELECT doc_id, CASE WHEN doc_id % 2 <> 0 AND doc_id % 3 = 0 THEN 'https://example.com/x' ELSE 'manual://' || sha256(source || text) END AS url FROM documents",
    "collector_map": collected(False),
    "collector_map_legacy": collected(True),
    "collector_files": f"""WITH c AS ({collected(False)}) SELECT row_number() OVER (ORDER BY id) - 1 AS seq, title, price, gross_revenue, cash_flow, ebitda, extra_information FROM c
WHERE {SCREEN}""",
    "financial_screen": f"WITH {RAW} SELECT id FROM raw WHERE {SCREEN}",
    "financial_screen_software": f"WITH {RAW} SELECT id FROM raw WHERE {loose('gross_revenue')} >= 2000000",
    "html_extract": "SELECT page_id, url, url AS source_link, "
    + na(squeeze(unescape("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')")))
    + " AS title, 'US' AS country, 'SiteB' AS source, '2001-08-01' AS scraping_date, "
    + ", ".join(f"'N/A' AS {c}" for c in RECORD if c not in ("title", "country", "source", "url", "source_link", "scraping_date"))
    + " FROM pages",
    "html_extract_labelled": f"""WITH {RAW}, t AS (SELECT *, string_split({na(squeeze("concat_ws(', ', city, state)"))}, ',') AS parts FROM (SELECT * REPLACE (coalesce(price, '-') AS price, coalesce(cash_flow, '-') AS cash_flow) FROM raw))
SELECT id, 'Deal ' || CAST(id AS VARCHAR) AS title, {na(squeeze('parts[1]'))} AS city, {na(squeeze('parts[2]'))} AS state, 'US' AS country,
  'N/A' AS industry, 'SiteB' AS source, 'OneTwo & ' || industry AS description, listed_by_firm, listed_by_name, phone, 'a@b.c' AS email,
  {na(squeeze('price'))} AS price, 'N/A' AS gross_revenue, {na(squeeze('cash_flow'))} AS cash_flow, 'N/A' AS inventory, 'N/A' AS ebitda,
  '2001-08-01' AS scraping_date, CASE WHEN {na(squeeze('cash_flow'))} = 'N/A' THEN 'N/A' ELSE 'Cash Flow: ' || {squeeze('cash_flow')} END AS financial_data,
  'N/A' AS extra_information, 'N/A' AS deal_date FROM t""",
    "blocked_pages": """SELECT page_id, page_id % 3 = 0 OR (page_id % 5 <> 0 AND page_id % 7 = 0) OR (page_id % 3 <> 0 AND
    regexp_matches(lower(html), 'access denied|forbidden|temporarily unavailable|blocked|attention required|verify you are human|captcha|enable javascript and cookies')) AS blocked FROM pages""",
    "url_list_first_seen": """WITH c AS (SELECT page_id, CASE WHEN starts_with(url, 'http') AND contains(url, 'example.com') THEN url
    ELSE CASE WHEN page_id % 5 = 0 THEN 'https://alt.example.com/Business-Auction/' ELSE 'https://alt.example.com/b/' END || CAST(page_id % 17 AS VARCHAR) END AS u FROM pages)
SELECT u AS url, min(page_id) AS seq FROM c WHERE NOT contains(u, 'Business-Auction') GROUP BY 1""",
    "listing_csv_breaks": f"""WITH {DESCRIBED}, r AS (SELECT *, 'He said "' || description || '",' || chr(10) || '"again" ' || CAST(id AS VARCHAR) AS said,
  'https://example.org/d/' || CAST(id AS VARCHAR) AS url, '$' || CAST(n_chars AS VARCHAR) AS price FROM described)
SELECT row_number() OVER (ORDER BY id) - 1 AS seq, url, title, price, {norm('industry')} AS industry, sha256({norm('said')}) AS description_hash FROM r""",
    "merge_regions": f"WITH {LISTINGS} SELECT 8::INTEGER AS written, 56::INTEGER AS kept, count(*) AS rows, true AS right FROM listings",
    "existing_urls_buckets": f"WITH {LISTINGS}, b AS ({BATCH_SQL}) SELECT DISTINCT url FROM b WHERE url IN (SELECT url FROM listings)",
    "url_list_files": """WITH p AS (SELECT CASE WHEN starts_with(url, 'http') AND contains(url, 'example.com') THEN url WHEN page_id % 4 <> 0 THEN 'https://example.com/never' END AS url,
  row_number() OVER (ORDER BY page_id) - 1 AS seq FROM pages)
SELECT url, min(seq) AS seq FROM p WHERE url IS NOT NULL GROUP BY 1""",
    "listing_csv": f"WITH {RAW} SELECT row_number() OVER (ORDER BY id) - 1 AS seq, " + ", ".join(f"{norm(c)} AS {c}" for c in RECORD) + " FROM raw",
    "merge_buckets": merged(COLLECTOR_UPDATES, "id, url, listing_hash, title, state, description, price, gross_revenue, cash_flow, ebitda, inventory, financial_data, scraping_date, price_num, gross_revenue_num, cash_flow_num, ebitda_num, first_seen_date, last_seen_date"),
    "upsert_collector": merged(COLLECTOR_UPDATES, "id, url, listing_hash, title, state, description, price, gross_revenue, cash_flow, ebitda, inventory, financial_data, scraping_date, price_num, gross_revenue_num, cash_flow_num, ebitda_num, first_seen_date, last_seen_date"),
    "upsert_upload": merged(UPLOAD_UPDATES, "id, url, title, inventory, price, gross_revenue, cash_flow, ebitda, price_num, gross_revenue_num, cash_flow_num, ebitda_num, description, scraping_date, CASE WHEN touched THEN last_seq % 7 END::DOUBLE AS embedding_0, CASE WHEN touched THEN 1.0 END::DOUBLE AS embedding_1"),
    "existing_urls": f"WITH {RAW}, batch AS ({BATCH_SQL}) SELECT seq, url FROM batch WHERE url IN (SELECT url FROM raw)",
    "new_urls": f"WITH {RAW}, batch AS ({BATCH_SQL}) SELECT seq, url FROM batch WHERE url NOT IN (SELECT url FROM raw)",
    "urls_of_source": f"WITH {RAW} SELECT url FROM raw WHERE source = 'SiteB'",
    "record_rejects": f"WITH {UPLOAD_BATCH} SELECT seq, 'Missing URL' AS error FROM batch WHERE url = 'N/A'",
    "upload_outcomes": f"WITH {OUTCOMES} SELECT seq, url, status FROM outcomes",
    "upload_summary": f"""WITH {OUTCOMES}, n AS (SELECT count(*) FILTER (status = 'inserted') AS inserted, count(*) FILTER (status = 'skipped') AS skipped_duplicates,
  count(*) FILTER (status = 'error') AS error_count FROM outcomes)
SELECT *, 'Processed CSV: ' || inserted || ' inserted, ' || skipped_duplicates || ' skipped (duplicates), ' || error_count || ' errors.' AS message FROM n""",
    "upload_errors": f"WITH {OUTCOMES} SELECT seq + 2 AS row, 'Missing URL' AS error FROM outcomes WHERE status = 'error'",
    "upload_manual": f"""WITH {RAW}, b AS ({BATCH_SQL}), f AS (SELECT seq, coalesce(title, '') AS title, coalesce(country, 'US') AS country,
    CASE WHEN seq % 4 = 0 THEN 'Phone' ELSE 'Manual' END AS source, '' AS industry,
    CASE WHEN seq % 3 = 0 THEN 'manual://' || sha256(coalesce(title, '') || coalesce(description, '')) ELSE url END AS url FROM b)
SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM raw r WHERE r.url = f.url) OR row_number() OVER (PARTITION BY f.url ORDER BY f.seq) > 1
  THEN 'skipped' ELSE 'inserted' END AS status FROM f""",
    "upload_listings": f"""WITH {LISTINGS}, {UPLOAD_BATCH},
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.url ORDER BY b.seq) AS nth FROM batch b WHERE b.url <> 'N/A' AND b.url NOT IN (SELECT url FROM raw))
SELECT id, url, title, price_num::DOUBLE AS price_num, scraping_date,
  NULL::DOUBLE AS embedding_0, NULL::DOUBLE AS embedding_1, NULL::DOUBLE AS embedding_2 FROM listings
UNION ALL SELECT (SELECT max(id) FROM raw) + 1 + seq, url, title, {num('price')}::DOUBLE, '2001-08-01',
  CASE WHEN description <> 'N/A' THEN length(description) % 7 END, CASE WHEN description <> 'N/A' THEN length(description) % 11 END,
  CASE WHEN description <> 'N/A' THEN 1 END FROM o WHERE nth = 1""",
    "deal_upload": f"""WITH {DESCRIBED}, v AS (SELECT *, [length(description) % 7, length(description) % 11, 1]::DOUBLE[] AS vector,
    [(length(description) + 1) % 7, (length(description) + 1) % 11, 1]::DOUBLE[] AS asked FROM described),
d AS (SELECT id AS seq, title, asked, CASE WHEN id % 3 = 0 THEN 'manual://' || sha256(title || description || '!')
    ELSE 'https://example.org/d/' || CAST(id * 2 AS VARCHAR) END AS url FROM v),
o AS (SELECT *, CASE WHEN url IN (SELECT 'https://example.org/d/' || CAST(id AS VARCHAR) FROM described)
    OR row_number() OVER (PARTITION BY url ORDER BY seq) > 1 THEN 'duplicate_url' ELSE 'inserted' END AS status FROM d),
c AS (SELECT id, vector, -1 AS seq FROM v UNION ALL SELECT (SELECT max(id) FROM v) + 1 + seq, asked, seq FROM o WHERE status = 'inserted'),
p AS (SELECT o.seq, c.id, round(greatest(0.0, 1 - list_cosine_similarity(o.asked, c.vector)), 12) AS distance FROM o, c WHERE c.seq < o.seq),
r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY distance, id) AS n FROM p WHERE distance < 0.15),
s AS (SELECT seq, string_agg(CAST(id AS VARCHAR), '|' ORDER BY n) AS resembles FROM r WHERE n <= 5 GROUP BY seq)
SELECT seq, url, title, status, CASE WHEN status = 'duplicate_url' THEN 'A listing with this URL is stored already.'
  WHEN resembles IS NOT NULL THEN 'Stored; similar listings exist.' ELSE 'Stored.' END AS message, resembles FROM o LEFT JOIN s USING (seq)""",
    "duplicate_report": f"""WITH {DESCRIBED}, q AS (SELECT vec_id AS query_id, {PERTURB} AS embedding FROM embeddings),
c AS (SELECT vec_id AS id, embedding FROM embeddings), {neighbours('q', 'c', 5, f'{DISTANCE} < 0.15')}
SELECT query_id + 2 AS row, t.title, string_agg(rank || ' ' || h.id || ' ' || t.title || ' ' || d.state, '|' ORDER BY rank) AS resembles
FROM hits h JOIN described d ON h.id = d.id JOIN described t ON t.id = query_id GROUP BY ALL""",
    "stream_ingest": f"""WITH {NORM_BATCH}, m AS (SELECT url, arg_min(state, seq) AS state, arg_min(city, seq) AS city,
    {', '.join(f'arg_max({c}, seq) AS {c}' for c in COLLECTOR_UPDATES)} FROM batch GROUP BY url)
SELECT *, sha256(url) AS listing_hash, {', '.join(f'{num(c)}::DOUBLE AS {c}_num' for c in MONEY)}, true AS dated FROM m""",
    "cosine_distance": f"SELECT vec_id, round(greatest(0.0, 1 - list_cosine_similarity(embedding::DOUBLE[], {PERTURB}::DOUBLE[])), 4) AS distance FROM embeddings",
    "cosine_topk": TOP10,
    "cosine_topk_cells": TOP10,
    "ivf_topk_all_cells": TOP10,
    "semantic_duplicates": f"""WITH q AS (SELECT vec_id AS query_id, {PERTURB} AS embedding, vec_id AS seq FROM embeddings),
c AS (SELECT vec_id AS id, embedding, -1 AS seq FROM embeddings UNION ALL SELECT query_id + 1000000, embedding, seq FROM q),
{neighbours('q', 'c', 5, f'c.seq < q.seq AND {DISTANCE} < 0.15')} SELECT query_id, id, round(distance, 4) AS distance, rank FROM hits""",
    "semantic_duplicates_join": f"""WITH q AS (SELECT vec_id AS query_id, {PERTURB} AS embedding FROM embeddings), c AS (SELECT vec_id AS id, embedding FROM embeddings),
{neighbours('q', 'c', 5, f'{DISTANCE} < 0.15')} SELECT query_id, id, round(distance, 4) AS distance, rank FROM hits""",
    "semantic_duplicates_pairs": f"""WITH q AS (SELECT vec_id AS query_id, {PERTURB} AS embedding FROM embeddings), c AS (SELECT vec_id AS id, embedding FROM embeddings),
{neighbours('q', 'c', 5, f'{DISTANCE} < 0.15')} SELECT count(DISTINCT query_id) AS answered, true AS few FROM hits""",
    "semantic_candidates": f"""WITH {DESCRIBED}, q AS (SELECT vec_id AS query_id, embedding FROM embeddings),
c AS (SELECT * FROM described WHERE embedding IS NOT NULL AND country = 'US'), {neighbours('q', 'c', 40)}
SELECT query_id, h.id, title, rank, round(distance, 4) AS distance, round(1 - distance, 4) AS similarity_score FROM hits h JOIN described d ON h.id = d.id""",
    "semantic_search": f"""WITH {DESCRIBED}, q AS (SELECT vec_id AS query_id, embedding FROM embeddings),
c AS (SELECT * FROM described WHERE embedding IS NOT NULL), {neighbours('q', 'c', 30)}
SELECT query_id, h.id, industry, rank AS position, round(distance, 4) AS distance, round(1 - distance, 4) AS similarity_score
FROM hits h JOIN described d ON h.id = d.id WHERE distance <= 0.6 AND rank <= 10""",
    "semantic_rerank": f"""WITH {DESCRIBED}, q AS (SELECT vec_id AS query_id, embedding, text, {words('text')} AS asked FROM embeddings JOIN documents ON vec_id = doc_id),
c AS (SELECT * FROM described WHERE embedding IS NOT NULL), {neighbours('q', 'c', 30)},
s AS (SELECT h.query_id, h.id, h.rank, CASE WHEN rank <= 20 THEN coalesce(len(list_intersect(asked, {words('description')}))::DOUBLE / nullif(len(asked), 0), 0.0) END AS score
  FROM hits h JOIN described d ON h.id = d.id JOIN q ON q.query_id = h.query_id WHERE distance <= 0.9 AND rank <= 20),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS position FROM s)
SELECT query_id, id, CAST(position AS INTEGER) AS position, round(score, 4) AS rerank_score FROM p WHERE position <= 10""",
    "rerank_model": f"""WITH {DESCRIBED}, q AS (SELECT vec_id AS query_id, embedding FROM embeddings JOIN documents ON vec_id = doc_id),
c AS (SELECT * FROM described WHERE embedding IS NOT NULL), {neighbours('q', 'c', 20)},
s AS (SELECT h.query_id, h.id, h.rank, length(description)::DOUBLE AS score FROM hits h JOIN described d ON h.id = d.id WHERE distance <= 0.9),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS position FROM s)
SELECT query_id, id, CAST(position AS INTEGER) AS position, score AS rerank_score FROM p WHERE position <= 10""",
    "search_semantic": f"""WITH {DESCRIBED}, q AS (SELECT 0 AS query_id, list_transform(range(64), lambda i: 1.0::FLOAT) AS embedding),
c AS (SELECT * FROM described WHERE embedding IS NOT NULL), {neighbours('q', 'c', 40)},
s AS (SELECT h.id, title, rank, len(list_intersect(['the', 'of', 'and'], {words('description')})) AS score
  FROM hits h JOIN described d ON h.id = d.id WHERE distance <= 1.0 AND rank <= 20)
SELECT id, title, 'semantic + rerank' AS method FROM s ORDER BY score DESC, rank LIMIT 20""",
    "search_fallback": f"WITH {DESCRIBED} SELECT id, title, 'text (embedding fallback)' AS method FROM described WHERE {like_any('the and attion to thanedble')} ORDER BY id LIMIT 20",
    "text_search": f"""WITH {DESCRIBED} SELECT id, 'https://example.org/d/' || CAST(id AS VARCHAR) AS url, source, title, city, state, country, industry, description,
  {', '.join(f"'N/A' AS {c}" for c in ('listed_by_firm', 'listed_by_name', 'phone', 'email'))}, '$' || CAST(n_chars AS VARCHAR) AS price,
  {', '.join(f"'N/A' AS {c}" for c in ('gross_revenue', 'cash_flow', 'inventory', 'ebitda', 'financial_data', 'source_link', 'extra_information', 'deal_date'))},
  '2001-08-01T00:00:00Z' AS first_seen_date, '2001-08-01T00:00:00Z' AS last_seen_date, '2001-07-31' AS scraping_date
  FROM described WHERE {like_any('tion on')} ORDER BY id LIMIT 20""",
    "text_search_many": f"WITH {DESCRIBED}, a AS (" + " UNION ALL ".join(
        f"SELECT {i}::INTEGER AS query_id, id FROM described WHERE industry = 'en' AND {like_any(q)}"
        for i, q in {1: "tion on", 2: "the", 3: "RENO", 4: "100%", 5: "src_"}.items()
    ) + "), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM a) SELECT query_id, id, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 15",
    "text_search_index": f"WITH {DESCRIBED}, a AS (" + " UNION ALL ".join(
        f"SELECT {i}::INTEGER AS query_id, id FROM described WHERE industry = 'en' AND {like_any(q)}"
        for i, q in {1: "tion on", 2: "the", 3: "RENO", 4: "100%", 5: "src_", 6: "the and attion to thanedble", 7: "Document 77"}.items()
    ) + "), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM a) SELECT query_id, id, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 15",
    "search_dispatch": f"WITH {DESCRIBED} SELECT id, title FROM described WHERE {like_any('tion on')} ORDER BY id LIMIT 20",
    "embedding_backlog": "SELECT doc_id AS id, text AS description FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "embedding_backfill": """SELECT doc_id AS id, round(coalesce(embedding[1]::DOUBLE, length(text)), 6) AS embedding_0,
  round(coalesce(embedding[2]::DOUBLE, length(text) - length(replace(text, 'e', ''))), 6) AS embedding_1
FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
    "ivf_topk": "SELECT true AS enough, 10 * count(*) AS rows FROM embeddings",
}
