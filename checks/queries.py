"""The registered queries: every operator over the whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import tables
from checks.tables import AS_OF
from dealflow.functions import money, text
from dealflow.operators import browse, cells, dashboard, embed, ivf, knn, pages, rotation, screen, search, sla, stats, upload, upsert
from dealflow.operators.collector import map_items, parse_item
from dealflow.operators.filters import ListingFilter, SortChoice
from dealflow.plans.overview import measures, overview, overview_rows
from dealflow.plans.search import search as search_request
from dealflow.plans.upload import enter_deals
from dealflow.plans.upload import upload as upload_batch
from dealflow.schema import LISTING_COLUMNS, NUMERIC_COLUMNS, RECORD_COLUMNS
from dealflow.session import materialise, work_path
from dealflow.sources import csv as csv_files
from dealflow.sources import items as item_files
from dealflow.sources.buckets import BucketStore
from dealflow.sources.page_index import PageIndex
from dealflow.sources.rollups import SKETCH_ERROR, SKETCHED, Rollups
from dealflow.sources.text_index import TextIndex
from dealflow.streaming.ingest import record_stream, start_ingest

QUERIES = {}

SITE, SITE_URL, TODAY = "SiteC", "https://example.com", "2001-08-01"


def query(build):
    QUERIES[build.__name__] = build
    return build


def plain(df: DataFrame) -> DataFrame:
    """Times as ISO text, decimals as doubles and text lists as one text, so that any engine can compare them."""
    out = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = text.iso_utc(column)
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, "|")
        out.append(column.alias(field.name))
    return df.select(*out)


# ---- dashboard ---------------------------------------------------------------------------------------------------


def _groups(spark, sf):
    return dashboard.group_counts(tables.listings(spark, sf), AS_OF)


@query
def source_yield(spark, sf):
    return dashboard.source_yield(_groups(spark, sf))


@query
def dashboard_snapshot(spark, sf):
    return dashboard.snapshot(_groups(spark, sf))


def _rollups(spark, sf):
    """Listings that arrive in three parts, with the roll-ups brought up to date after each."""
    store = BucketStore(spark, work_path(spark, "buckets"), buckets=8)
    rollups, listings = Rollups(store), tables.listings(spark, sf)
    for part in range(3):
        store.add(listings.where(F.col("id") % 3 == part))
        rollups.refresh()
    return rollups, store


@query
def dashboard_rollups(spark, sf):
    """The reports that are counts, out of the counts per day."""
    groups = materialise(_rollups(spark, sf)[0].group_counts(AS_OF), "groups")
    funnel = dashboard.criteria_funnel(groups).select(F.lit("criteria_funnel").alias("section"), F.col("stage").alias("item"), F.col("count").cast("double").alias("value"))
    shares = dashboard.source_yield(groups).select(F.lit("source_yield"), "source", "qualified_rate")
    snapshot, quality = measures("snapshot", dashboard.snapshot(groups)), measures("data_quality", dashboard.data_quality(groups))
    return snapshot.union(funnel).union(quality).union(shares)


@query
def distinct_sketches(spark, sf):
    """Numbers of different values in the window, and whether the estimates out of daily sketches are within four standard errors."""
    rollups, store = _rollups(spark, sf)
    seen = dashboard.in_scope(store.read(), AS_OF)
    exact = seen.select([F.countDistinct(F.when(text.is_present(F.col(c)), F.col(c))).alias(c) for c in SKETCHED]).unpivot([], SKETCHED, "item", "exact")
    found = rollups.distinct_values(AS_OF).unpivot([], SKETCHED, "item", "estimate")
    near = F.abs(F.col("estimate") - F.col("exact")) <= 4 * SKETCH_ERROR * F.col("exact") + 1
    return exact.join(found, "item").select("item", "exact", near.alias("near"))


@query
def dashboard_funnel(spark, sf):
    return dashboard.criteria_funnel(_groups(spark, sf))


@query
def dashboard_quality(spark, sf):
    return dashboard.data_quality(_groups(spark, sf))


@query
def fit_score(spark, sf):
    return tables.listings(spark, sf).select("id", dashboard.fit_score(AS_OF).alias("fit_score"))


@query
def fit_reasons(spark, sf):
    return plain(tables.listings(spark, sf).select("id", dashboard.fit_reasons(AS_OF).alias("reasons")))


@query
def priority_queue(spark, sf):
    return plain(dashboard.priority_queue(tables.listings(spark, sf), AS_OF))


@query
def sla_rates(spark, sf):
    return sla.sla_rates(spark, tables.deals(spark, sf), AS_OF)


@query
def dashboard_overview(spark, sf):
    return overview_rows(overview(tables.listings(spark, sf), tables.deals(spark, sf), AS_OF))


# ---- browse and statistics ---------------------------------------------------------------------------------------

WANTED = ListingFilter(industry="BUILDING", country="US", min_cash_flow=500_000, max_price=60_000_000, min_revenue=1_000_000)


@query
def listing_view(spark, sf):
    return plain(browse.listing_view(tables.listings(spark, sf)))


@query
def filter_listings(spark, sf):
    return WANTED.apply(tables.listings(spark, sf)).select("id", *[F.col(c).cast("double").alias(c) for c in NUMERIC_COLUMNS])


@query
def filter_listings_fallback(spark, sf):
    return WANTED.apply(tables.texts(spark, sf)).select("id", *[F.col(c).cast("double").alias(c) for c in NUMERIC_COLUMNS])


@query
def listing_page(spark, sf):
    return plain(browse.listing_page(tables.listings(spark, sf), page=2, per_page=25))


@query
def listing_page_asc(spark, sf):
    found = browse.listing_page(tables.listings(spark, sf), page=3, per_page=100, sort_by="cash_flow", sort_order="asc")
    return found.select("id", "url", "cash_flow_numeric")


@query
def listing_page_far(spark, sf):
    """The last 100 listings by price, wherever the end lies."""
    rows = tables.listings(spark, sf)
    total = browse.listing_count(rows).first()["total"]
    last = -(-total // 100)
    return browse.listing_page(rows, page=last, per_page=100, sort_by="price_num").select("id", "price_numeric")


@query
def listing_page_far_index(spark, sf):
    """The same page out of a stored order: one range of it, and the buckets of the page's URLs."""
    store = BucketStore(spark, work_path(spark, "buckets"), buckets=16)
    store.write(tables.listings(spark, sf))
    choice = SortChoice("price_num", "desc")
    index = PageIndex.build(store.read(), work_path(spark, "pages"), [choice], range_rows=5000)
    return index.page(store, -(-index.total(choice) // 100), 100, "price_num").select("id", "price_numeric")


@query
def listing_page_info(spark, sf):
    return browse.page_info(tables.listings(spark, sf), WANTED, page=2, per_page=10)


@query
def listing_count(spark, sf):
    return browse.listing_count(tables.listings(spark, sf), ListingFilter(source="SiteA", max_ebitda=1_000_000))


@query
def listing_by_id(spark, sf):
    return plain(browse.listing_by_id(tables.listings(spark, sf), 719))


@query
def filter_options(spark, sf):
    return browse.filter_options(tables.listings(spark, sf))


@query
def stats_totals(spark, sf):
    return stats.stats_totals(tables.listings(spark, sf), AS_OF)


@query
def stats_by_source(spark, sf):
    return stats.stats_by_source(tables.listings(spark, sf))


@query
def stats_top_industries(spark, sf):
    return stats.stats_top_industries(tables.listings(spark, sf))


# ---- parsing and normalising -------------------------------------------------------------------------------------

MONEY_TEXTS = ["price", "gross_revenue", "cash_flow", "ebitda", "inventory"]


def _each(rows, columns, rule, key="id"):
    return rows.select(key, *[rule(F.col(c)).alias(c) for c in columns])


@query
def money_numeric(spark, sf):
    return _each(tables.texts(spark, sf), MONEY_TEXTS, lambda c: money.money_numeric(c).cast("double"))


@query
def money_float(spark, sf):
    return _each(tables.texts(spark, sf), MONEY_TEXTS, money.money_float)


@query
def money_loose(spark, sf):
    return _each(tables.texts(spark, sf), MONEY_TEXTS, money.money_loose)


@query
def money_fields(spark, sf):
    found = money.with_money_fields(tables.listings(spark, sf))
    return found.select("id", *[f"{c}_numeric" for c in NUMERIC_COLUMNS.values()])


@query
def numeric_drift(spark, sf):
    rows = tables.listings(spark, sf)
    stored = rows.withColumn("price_num", F.col("price_num") + (F.col("id") % 3))
    return plain(money.numeric_drift(stored).select("id", *NUMERIC_COLUMNS))


@query
def normalise_text(spark, sf):
    return _each(tables.texts(spark, sf), ["title", "city", "country", "description", "price", "inventory"], text.normalise)


@query
def clean_text(spark, sf):
    return _each(tables.read(spark, sf, "documents"), ["text"], text.clean_text, "doc_id")


@query
def strip_html(spark, sf):
    return _each(tables.read(spark, sf, "pages"), ["html"], text.strip_html, "page_id")


@query
def epoch_ms_date(spark, sf):
    ms = F.unix_millis(tables.instant(F.col("ts"))).cast("string")
    kind = F.col("event_id") % 5
    value = F.when(kind == 0, "soon").when(kind == 1, "0").when(kind == 2, None).otherwise(ms)
    return tables.read(spark, sf, "events").select("event_id", text.epoch_ms_date(value).alias("day"))


@query
def parse_location(spark, sf):
    rows = tables.texts(spark, sf)
    kind = F.col("id") % 5
    place = (
        F.when(kind == 0, F.col("city"))
        .when(kind == 1, F.concat_ws(" , ", "city", "state"))
        .when(kind == 2, F.concat_ws(",", "city", F.lit(" "), "country"))
        .when(kind == 3, F.concat_ws(", ", "city", "state", "country"))
    )
    return rows.select("id", text.parse_location(place).alias("p")).select("id", "p.*")


@query
def url_hash(spark, sf):
    rows = tables.read(spark, sf, "pages")
    return rows.select("page_id", text.url_hash(F.col("url")).alias("hash"))


@query
def manual_url(spark, sf):
    rows = tables.read(spark, sf, "documents")
    url = F.when(F.col("doc_id") % 2 == 0, "").when(F.col("doc_id") % 3 == 0, "https://example.com/x")
    return rows.select("doc_id", text.manual_url(url, F.col("source"), F.col("text")).alias("url"))


# ---- collecting --------------------------------------------------------------------------------------------------


def _items(spark, sf) -> DataFrame:
    """Listings as search-API items in JSON text."""
    rows = tables.texts(spark, sf)
    odd = F.col("id") % 2 == 1
    types = F.when(F.col("id") % 3 == 0, F.array(F.col("state"), F.lit(""), F.lit("Other")))
    fields = F.struct(
        F.col("title"),
        F.col("state"),
        F.col("city").alias("county"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("p/"), F.col("id").cast("string"))).alias("urlPath"),
        F.concat(F.lit("<p>"), F.col("description"), F.lit("</p> <b>R&amp;D</b>")).alias("description"),
        F.when(odd, F.concat(F.lit('["'), F.col("industry"), F.lit('","","Sale"]'))).otherwise(F.col("industry")).alias("businessCategory"),
        types.alias("businessTypes"),
        F.when(F.col("id") % 4 == 0, F.array(F.lit("Franchise"), F.lit("Remote"))).otherwise(F.array().cast("array<string>")).alias("businessAttributes"),
        F.when(F.col("id") % 3 > 0, F.col("listed_by_name")).alias("firstName"),
        F.when(F.col("id") % 3 == 1, F.lit("Smith")).alias("lastName"),
        F.col("listed_by_firm").alias("contactName"),
        F.col("phone").alias("phoneNumber"),
        F.col("email"),
        F.col("price").alias("askingPrice"),
        F.when(F.col("id") % 6 > 0, F.col("id") * (F.col("id") % 2)).alias("revenueInt"),
        F.col("gross_revenue").alias("revenue"),
        F.col("cash_flow").alias("cashFlow"),
        F.col("ebitda").alias("adjustedNet"),
        (F.col("id") % 9).alias("employees"),
        F.lit(1999).alias("establishedYear"),
        F.when(F.col("id") % 8 > 0, F.col("id")).alias("sizeInSquareFeet"),
        F.col("city").alias("saleReason"),
        F.col("inventory").alias("down"),
        F.lit("open").alias("businessStatus"),
        F.lit("0").alias("ffe"),
        F.unix_millis("first_seen_date").alias("createdAt"),
    )
    return rows.select("id", F.to_json(fields).alias("json"))


def _mapped(spark, sf, legacy):
    parsed = _items(spark, sf).select("id", parse_item("json").alias("item"))
    return map_items(parsed, SITE, SITE_URL, TODAY, legacy_na=legacy)


@query
def collector_map(spark, sf):
    return _mapped(spark, sf, False)


@query
def collector_map_legacy(spark, sf):
    return _mapped(spark, sf, True)


@query
def collector_files(spark, sf):
    """Items written as files of result pages, read back, mapped, screened and counted."""
    path = work_path(spark, "items")
    folded = _items(spark, sf).orderBy("id").select(F.concat(F.lit('{"results":['), "json", F.lit("]}")).alias("value"))
    folded.write.text(path)
    found = item_files.collect_items(item_files.read_items(spark, path), SITE, SITE_URL, TODAY, mode="non-software")
    return found.select("seq", "title", "price", "gross_revenue", "cash_flow", "ebitda", "extra_information")


@query
def financial_screen(spark, sf):
    return tables.texts(spark, sf).where(screen.passes_screen("non-software")).select("id")


@query
def financial_screen_software(spark, sf):
    return tables.texts(spark, sf).where(screen.passes_screen("software")).select("id")


@query
def html_extract(spark, sf):
    return pages.extract_pages(tables.read(spark, sf, "pages"), "SiteB", TODAY)


@query
def html_extract_labelled(spark, sf):
    """Every listing as a small page with labels and links, read back."""
    rows = tables.texts(spark, sf)
    price, cash_flow = (F.coalesce(c, F.lit("-")) for c in ("price", "cash_flow"))
    html = F.concat(
        F.lit("<html><body><h1>Deal "), F.col("id").cast("string"), F.lit("</h1><h2 class='small gray'>"),
        F.concat_ws(", ", "city", "state"), F.lit("</h2><div class='x businessDescription y'><p>One<p>Two &amp; "),
        F.col("industry"), F.lit("</div><p><span>Asking Price:</span> <b>-</b> <span>"), price,
        F.lit("</span></p><p><span class=l>Cash Flow: </span><span>"), cash_flow,
        F.lit("</span></p><div>Business Listed By: "), F.col("listed_by_name"),
        F.lit("</div><div class=cmp-name>"), F.col("listed_by_firm"),
        F.lit("</div><div><span><span>Phone Number</span></span><span><a href='tel:"), F.col("phone"),
        F.lit("'>call</a></span></div><a href='mailto:a@b.c'>mail</a></body></html>"),
    )
    found = pages.extract_pages(rows.select("id", "url", html.alias("html")), "SiteB", TODAY)
    return found.drop("url", "source_link")


@query
def blocked_pages(spark, sf):
    rows = tables.read(spark, sf, "pages")
    html = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<p>Please solve the CAPTCHA</p>"), "html"))
    html = html.when(F.col("page_id") % 5 == 0, F.concat(F.lit("<p>Blocked? Asking Price: 5</p>"), "html"))
    html = html.when(F.col("page_id") % 7 == 0, F.concat(F.lit("<title>Access Denied</title><p>Asking price</p>"), "html"))
    return rows.select("page_id", text.is_block_page(html.otherwise(F.col("html"))).alias("blocked"))


@query
def url_list_first_seen(spark, sf):
    rows = tables.read(spark, sf, "pages")
    other = F.concat(
        F.when(F.col("page_id") % 5 == 0, "https://alt.example.com/Business-Auction/").otherwise("https://alt.example.com/b/"),
        (F.col("page_id") % 17).cast("string"),
    )
    cells = F.array(F.col("page_id").cast("string"), F.concat(F.lit("  "), "url", F.lit(" ")), other)
    return csv_files.listing_urls(rows.select(cells.alias("cells"), F.col("page_id").alias("seq")), "example.com")


@query
def url_list_files(spark, sf):
    """The same links out of header-less files of any width, one folder read as a whole."""
    path = work_path(spark, "urls")
    rows = tables.read(spark, sf, "pages").orderBy("page_id")
    line = F.when(F.col("page_id") % 4 == 0, F.concat_ws(",", "page_id", "url")).otherwise(
        F.concat_ws(",", F.lit('"a, b"'), F.concat(F.lit('"  '), "url", F.lit('"')), F.lit("https://example.com/never"), F.lit(""))
    )
    rows.select(line.alias("value")).write.text(path)
    return csv_files.listing_urls(csv_files.read_url_rows(spark, path), "example.com")


@query
def listing_csv(spark, sf):
    """Records written to CSV, read back and normalised."""
    path = work_path(spark, "csv")
    csv_files.write_listing_csv(tables.texts(spark, sf).orderBy("id"), path)
    return csv_files.numbered_records(csv_files.read_listing_csv(spark, path))


@query
def listing_csv_breaks(spark, sf):
    """Descriptions with line breaks, commas and quotes, in a few large files, written and read back."""
    path = work_path(spark, "csv-breaks")
    said = F.concat(F.lit('He said "'), "description", F.lit('",\n"again" '), F.col("id").cast("string"))
    rows = tables.described(spark, sf).withColumn("description", said)
    csv_files.write_listing_csv(rows.repartitionByRange(3, "id").sortWithinPartitions("id"), path)
    back = csv_files.numbered_records(csv_files.read_listing_csv(spark, path))
    return back.select("seq", "url", "title", "price", "industry", F.sha2("description", 256).alias("description_hash"))


# ---- upsert and upload -------------------------------------------------------------------------------------------


def _after(df):
    shown = ["id", "url", "listing_hash", "title", "state", "description", "price", "gross_revenue", "cash_flow",
             "ebitda", "inventory", "financial_data", "scraping_date", *NUMERIC_COLUMNS, "first_seen_date", "last_seen_date"]
    return plain(df.select(*shown))


@query
def upsert_collector(spark, sf):
    batch = upsert.normalise_records(tables.batch(spark, sf))
    return _after(upsert.upsert(tables.listings(spark, sf), batch, AS_OF))


@query
def merge_buckets(spark, sf):
    """The same merge in a stored table of buckets, of which those without a URL of the batch are left alone."""
    store = BucketStore(spark, work_path(spark, "buckets"), buckets=16)
    store.write(tables.listings(spark, sf))
    store.merge(upsert.normalise_records(tables.batch(spark, sf)), AS_OF)
    return _after(store.read())


@query
def merge_regions(spark, sf):
    """A visit to the listings of one bucket in eight: the buckets written, the rows, and those with a new price."""
    store = BucketStore(spark, work_path(spark, "buckets"), buckets=64)
    listings = tables.listings(spark, sf)
    first = store.write(listings)
    visited = listings.where(store.bucket_of("url") % 8 == 0).withColumns({"seq": F.col("id"), "price": F.lit("$7")})
    version = store.merge(upsert.normalise_records(visited.select("seq", *RECORD_COLUMNS)), AS_OF)
    written = sum(v == [version] for v in store.manifest().buckets.values())
    kept = sum(v == [first] for v in store.manifest().buckets.values())
    seven = F.count(F.when((F.col("price") == "$7") & (F.col("last_seen_date") == text.moment(AS_OF)), 1))
    right = seven == F.lit(visited.count())
    return store.read().agg(F.lit(written).alias("written"), F.lit(kept).alias("kept"), F.count(F.lit(1)).alias("rows"), right.alias("right"))


@query
def existing_urls_buckets(spark, sf):
    """Known URLs of a batch, looked up in the URL column of the touched buckets."""
    store = BucketStore(spark, work_path(spark, "buckets"), buckets=16)
    store.write(tables.listings(spark, sf))
    return store.existing_urls(tables.batch(spark, sf))


@query
def upsert_upload(spark, sf):
    batch = upsert.normalise_records(tables.batch(spark, sf))
    batch = batch.withColumn("description_embedding", F.array((F.col("seq") % 7).cast("float"), F.lit(1.0).cast("float")))
    merged = upsert.upsert(tables.listings(spark, sf), batch, AS_OF, upsert.UPLOAD_UPDATES)
    shown = ["id", "url", "title", "inventory", "price", "gross_revenue", "cash_flow", "ebitda", *NUMERIC_COLUMNS, "description", "scraping_date"]
    return plain(merged.select(*shown, *_elements("description_embedding", 2)))


def _elements(vector, count):
    """A vector as columns; round numbers, since other engines read them as well."""
    return [F.round(F.get(vector, F.lit(i)).cast("double"), 6).alias(f"embedding_{i}") for i in range(count)]


def _size_embedder(texts_):
    """A model simple enough for SQL."""
    return [[float(len(t) % 7), float(len(t) % 11), 1.0] for t in texts_]


def _upload_batch(spark, sf):
    batch = tables.batch(spark, sf)
    url = F.when(F.col("seq") % 23 == 0, " n/a ").otherwise(F.col("url"))
    return upsert.normalise_records(batch.withColumn("url", url))


def _outcomes(spark, sf):
    return upload.classify(_upload_batch(spark, sf), tables.listings(spark, sf))


@query
def existing_urls(spark, sf):
    return upsert.existing_rows(tables.batch(spark, sf), tables.listings(spark, sf)).select("seq", "url")


@query
def new_urls(spark, sf):
    return upsert.new_rows(tables.batch(spark, sf), tables.listings(spark, sf)).select("seq", "url")


@query
def urls_of_source(spark, sf):
    return upsert.urls_of_source(tables.listings(spark, sf), "SiteB")


@query
def record_rejects(spark, sf):
    return upsert.split_rejects(_upload_batch(spark, sf))[1].select("seq", "error")


@query
def upload_outcomes(spark, sf):
    return _outcomes(spark, sf).select("seq", "url", "status")


@query
def upload_summary(spark, sf):
    return upload.upload_summary(_outcomes(spark, sf))


@query
def upload_errors(spark, sf):
    return upload.upload_errors(_outcomes(spark, sf))


@query
def upload_manual(spark, sf):
    """Entered deals without field clean-up; every third has no URL."""
    entered = tables.batch(spark, sf).select(
        "seq",
        F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("url")).alias("url"),
        "title", "country", "description",
        F.when(F.col("seq") % 4 == 0, "Phone").alias("source"),
    )
    done = upload.classify(upload.form_records(entered), tables.listings(spark, sf))
    return done.select("seq", "url", "title", "source", "country", "industry", "status")


@query
def upload_listings(spark, sf):
    """The whole upload: check, embed, merge."""
    result = upload_batch(tables.listings(spark, sf), _upload_batch(spark, sf), _size_embedder, AS_OF, retry_wait=0.0)
    shown = result.listings.select("id", "url", "title", "price_num", "scraping_date", *_elements("description_embedding", 3))
    return plain(shown)


@query
def deal_upload(spark, sf):
    """Documents entered as deals against documents stored as listings: what each deal is told."""
    docs = tables.described(spark, sf)
    size = F.length("description")
    vector = F.array((size % 7).cast("float"), (size % 11).cast("float"), F.lit(1.0).cast("float"))
    deals = docs.select(
        F.col("id").alias("seq"), "title", F.concat("description", F.lit("!")).alias("description"),
        F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("https://example.org/d/"), (F.col("id") * 2).cast("string"))).alias("url"),
    )
    _, answers = enter_deals(docs.withColumn("description_embedding", vector), deals, _size_embedder, AS_OF, retry_wait=0.0)
    similar = F.array_join(F.transform("similar_to", lambda x: x["id"].cast("string")), "|").alias("resembles")
    return answers.select("seq", "url", "title", "status", "message", similar)


@query
def stream_ingest(spark, sf):
    """Record files that arrive in three parts, merged by a stream into an empty bucketed table."""
    files, root = work_path(spark, "records"), work_path(spark, "stream")
    batch = materialise(tables.batch(spark, sf), "arrivals")  # read for each part, twice where it is sorted
    last = batch.agg(F.max("seq")).scalar()
    store = BucketStore(spark, f"{root}/listings", buckets=16)
    for part in range(3):
        arrived = batch.where(F.floor(F.col("seq") * 3 / (last + 1)) == part)
        arrived.orderBy("seq").select(*RECORD_COLUMNS).write.mode("append").json(files)
        start_ingest(record_stream(spark, files), store, f"{root}/rejects", f"{root}/checkpoint").awaitTermination()
    shown = ["url", "state", "city", "listing_hash", *upsert.COLLECTOR_UPDATES, *NUMERIC_COLUMNS]
    return plain(store.read().select(*shown, F.col("first_seen_date").isNotNull().alias("dated")))


# ---- vectors and search ------------------------------------------------------------------------------------------


def _vectors(spark, sf, key):
    return tables.read(spark, sf, "embeddings").select(F.col("vec_id").alias(key), "embedding")


def _rounded(df):
    return df.withColumn("distance", F.round("distance", 4))


@query
def cosine_distance(spark, sf):
    """Distance of every vector to a perturbed copy of itself, as an expression."""
    from dealflow.functions.vectors import cosine_distance as distance

    rows = tables.read(spark, sf, "embeddings")
    return rows.select("vec_id", F.round(distance(F.col("embedding"), tables.perturbed(F.col("embedding"))), 4).alias("distance"))


@query
def cosine_topk(spark, sf):
    return _rounded(knn.nearest(_vectors(spark, sf, "query_id"), _vectors(spark, sf, "id"), 10))


@query
def cosine_topk_cells(spark, sf):
    """The same through the cell join for query tables of any size."""
    from dealflow.operators.cells import bounded_hits
    from dealflow.operators.topk import top_per_group

    queries = knn.usable_vectors(_vectors(spark, sf, "query_id"), "query_id")
    hits = bounded_hits(queries, knn.usable_vectors(_vectors(spark, sf, "id"), "id"), 10, None)
    return _rounded(top_per_group(hits, "query_id", [F.col("distance"), F.col("id")], 10))


def _copies(spark, sf):
    copied = tables.perturbed(F.col("embedding")).alias("embedding")
    return tables.read(spark, sf, "embeddings").select("vec_id", copied)


@query
def semantic_duplicates(spark, sf):
    """Perturbed copies of all vectors against the stored vectors and the earlier copies."""
    copies = _copies(spark, sf)
    queries = copies.select(F.col("vec_id").alias("query_id"), "embedding", F.col("vec_id").alias("seq"))
    stored = _vectors(spark, sf, "id").withColumn("seq", F.lit(-1).cast("long"))
    earlier = copies.select((F.col("vec_id") + 1_000_000).alias("id"), "embedding", F.col("vec_id").alias("seq"))
    return _rounded(upload.semantic_duplicates(queries, stored.unionByName(earlier)))


def _duplicate_sides(spark, sf):
    """All vectors with every eighth element zero, and the stored vectors, to join by distance."""
    queries = _copies(spark, sf).select(F.col("vec_id").alias("query_id"), "embedding")
    return knn.usable_vectors(queries, "query_id"), knn.usable_vectors(_vectors(spark, sf, "id"), "id")


@query
def semantic_duplicates_join(spark, sf):
    """The copies against the stored vectors by the join for query tables of any size."""
    hits = cells.bounded_hits(*_duplicate_sides(spark, sf), upload.SIMILAR_SHOWN, upload.DUPLICATE_DISTANCE)
    return _rounded(knn.best_hits(hits, None, upload.SIMILAR_SHOWN))


@query
def semantic_duplicates_pairs(spark, sf):
    """What that join compares in full: whether it is at most one pair in ten, and how many copies find a row."""
    queries, corpus = _duplicate_sides(spark, sf)
    placed = cells.place(corpus)
    directions = rotation.leading(rotation.second_moment(corpus), upload.DUPLICATE_DISTANCE)
    joined = rotation.threshold_join(queries, placed, upload.SIMILAR_SHOWN, upload.DUPLICATE_DISTANCE, directions)
    crowded = joined.crowds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    compared, every = joined.pairs.count() + crowded, queries.count() * corpus.count()
    answered = joined.hits.agg(F.countDistinct("query_id").alias("answered"))
    return answered.select("answered", F.lit(compared * 10 <= every).alias("few"))


@query
def duplicate_report(spark, sf):
    """Copies of all vectors as an uploaded file: every flagged row with the listings it resembles."""
    docs = tables.described(spark, sf)
    queries = _copies(spark, sf).select(F.col("vec_id").alias("query_id"), "embedding")
    hits = upload.semantic_duplicates(queries, _vectors(spark, sf, "id"))
    found = upload.duplicate_report(hits, docs.select(F.col("id").alias("seq"), "title"), docs)
    shown = F.transform("similar_to", lambda x: F.concat_ws(" ", x["rank"].cast("string"), x["id"].cast("string"), "title", x["state"]))
    return found.select("row", "title", F.array_join(shown, "|").alias("resembles"))


def _questions(spark, sf):
    docs = tables.read(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text")
    return docs.join(_vectors(spark, sf, "query_id"), "query_id")


@query
def semantic_candidates(spark, sf):
    found = search.semantic_candidates(
        tables.described(spark, sf), _vectors(spark, sf, "query_id"), 20, ListingFilter(country="US")
    )
    return _rounded(found.select("query_id", "id", "title", "rank", "distance", "similarity_score"))


@query
def semantic_search(spark, sf):
    found = search.semantic_search(tables.described(spark, sf), _questions(spark, sf), 10, rerank=False)
    return _rounded(found.select("query_id", "id", "industry", "position", "distance", "similarity_score"))


@query
def semantic_rerank(spark, sf):
    found = search.semantic_search(tables.described(spark, sf), _questions(spark, sf), 10, threshold=0.9)
    return found.select("query_id", "id", "position", F.round("rerank_score", 4).alias("rerank_score"))


@query
def rerank_model(spark, sf):
    """The same with a model for the scores, here the length of the text."""
    found = search.semantic_search(
        tables.described(spark, sf), _questions(spark, sf), 10, threshold=0.9, rerank_fn=lambda _, found: [float(len(t)) for t in found]
    )
    return found.select("query_id", "id", "position", "rerank_score")


@query
def text_search(spark, sf):
    return plain(search.text_search(tables.described(spark, sf), "tion on")).select(*LISTING_COLUMNS)


@query
def text_search_many(spark, sf):
    asked = {1: "tion on", 2: "the", 3: "RENO", 4: "100%", 5: "src_"}
    found = search.text_search_many(tables.described(spark, sf), asked, 15, ListingFilter(industry="en"))
    return found.select(F.col("query_id").cast("int").alias("query_id"), "id", "rank")


@query
def text_search_index(spark, sf):
    """The same requests, and a phrase, through stored postings of three letters."""
    asked = {1: "tion on", 2: "the", 3: "RENO", 4: "100%", 5: "src_", 6: "the and attion to thanedble", 7: "Document 77"}
    listings = tables.described(spark, sf)
    found = TextIndex.build(listings, work_path(spark, "text")).search(listings, asked, 15, ListingFilter(industry="en"))
    return found.select(F.col("query_id").cast("int").alias("query_id"), "id", "rank")


@query
def search_dispatch(spark, sf):
    """A two-word request is answered as text."""
    return search_request(tables.described(spark, sf), "tion on", embed.hashing_embedder(64)).data.select("id", "title")


def _answers(result):
    return result.data.select("id", "title", F.lit(result.method).alias("method"))


@query
def search_semantic(spark, sf):
    """A longer request goes through the vectors and is reranked."""
    result = search_request(tables.described(spark, sf), "the of the and", lambda asked: [[1.0] * 64 for _ in asked], threshold=1.0)
    return _answers(result)


@query
def search_fallback(spark, sf):
    """A request that the model cannot embed is answered as text."""

    def broken(asked):
        raise ConnectionError("no model")

    return _answers(search_request(tables.described(spark, sf), "the and attion to thanedble", broken))


@query
def embedding_backlog(spark, sf):
    return embed.embedding_backlog(tables.described(spark, sf)).select("id", "description")


@query
def embedding_backfill(spark, sf):
    """Vectors of whole texts: their length and how often they have an e."""
    model = lambda found: [[float(len(t)), float(t.count("e"))] for t in found]
    filled = embed.embedding_backfill(tables.described(spark, sf), model)
    return filled.select("id", *_elements("description_embedding", 2))


@query
def ivf_topk(spark, sf):
    """Whether the index finds nine of ten exact neighbours, and how many rows it returns."""
    corpus, queries = _vectors(spark, sf, "id"), _vectors(spark, sf, "query_id")
    index = ivf.build_index(corpus, work_path(spark, "ivf"))
    found = ivf.ivf_nearest(spark, index, queries, 10, probes=max(1, len(index.centroids) * 4 // 5)).select("query_id", "id")
    exact = knn.nearest(queries, corpus, 10).select("query_id", "id", F.lit(1).alias("right"))
    met = found.join(exact, ["query_id", "id"], "left")
    return met.agg((F.count("right") >= 0.9 * F.count(F.lit(1))).alias("enough"), F.count(F.lit(1)).alias("rows"))


@query
def ivf_topk_all_cells(spark, sf):
    """Probing every cell gives the exact answer."""
    index = ivf.build_index(_vectors(spark, sf, "id"), work_path(spark, "ivf"), lists=20)
    return _rounded(ivf.ivf_nearest(spark, index, _vectors(spark, sf, "query_id"), 10, probes=20))
