"""Mapping search-API items (JSON) to collector records."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealflow.functions.text import epoch_ms_date, known, strip_html
from dealflow.schema import NA, RECORD_COLUMNS

_ARRAYS = ["businessTypes", "businessAttributes"]
_TEXTS = [
    "title", "state", "county", "urlPath", "description", "businessCategory",
    "firstName", "lastName", "contactName", "phoneNumber", "email",
    "askingPrice", "revenueInt", "revenue", "cashFlow", "adjustedNet",
    "employees", "establishedYear", "sizeInSquareFeet", "saleReason", "down", "businessStatus", "ffe", "createdAt",
]

# Numbers and the string-or-list category are read as their JSON text.
ITEM_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXTS]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in _ARRAYS]
)

# Fields whose text is cleaned as it stands.
_CLEANED = [
    "title", "state", "county", "description", "firstName", "lastName", "contactName", "phoneNumber", "email",
    "askingPrice", "cashFlow", "adjustedNet", "saleReason", "down", "businessStatus", "ffe",
]

LISTING_PATH = "/business-for-sale/"


def _truthy(value: Column) -> Column:
    """The value, or NULL where it is empty or a zero number."""
    return F.when(~value.isin("", "0", "0.0", "false"), value)


def _joined(values: Column) -> Column:
    """Non-empty entries joined by ``", "``; NULL when there is none."""
    return F.nullif(F.array_join(F.filter(values, lambda v: v != ""), ", "), F.lit(""))


def category_text(category: Column) -> Column:
    """A category that is a text, or a JSON list of texts."""
    entries = F.from_json(F.when(category.startswith("["), category), "array<string>")
    return F.coalesce(F.array_join(F.filter(entries, lambda v: v != ""), ", "), category)


def industry_label(category: Column, kinds: Column) -> Column:
    """``Category (Type, Type)``; only the types when the category is NULL."""
    label = F.when(kinds.isNull(), category).otherwise(F.concat(category, F.lit(" ("), kinds, F.lit(")")))
    return F.coalesce(label, kinds, F.lit(NA))


def labelled(parts: dict[str, Column], separator: str) -> Column:
    """``Label: value`` parts in order; NULL values drop out."""
    return F.concat_ws(separator, *[F.concat(F.lit(f"{label}: "), value) for label, value in parts.items()])


def map_items(
    items: DataFrame, source: str, base_url: str, scraping_date: str, item: str = "item", legacy_na: bool = False
) -> DataFrame:
    """One record (22 columns) per item struct; other columns of ``items`` are kept.

    A missing value leaves its part out of the combined texts. ``legacy_na`` keeps the older form, in which it shows
    as ``N/A`` there (``"N/A N/A"``, ``"Revenue: N/A"``).
    """

    def field(name: str) -> Column:
        return F.col(f"{item}.{name}")

    kept = [c for c in items.columns if c != item and c not in RECORD_COLUMNS]
    # First the cleaned fields, each made once: texts (NULL when missing), then what is used as it is.
    texts = {name: known(field(name)) for name in _CLEANED}
    items = items.withColumn("_category", category_text(field("businessCategory")))
    texts["businessCategory"] = known(F.col("_category"))
    texts["revenue"] = known(F.coalesce(_truthy(field("revenueInt")), field("revenue")))
    raw = {name: _truthy(field(name)) for name in ("employees", "establishedYear", "sizeInSquareFeet")}
    raw["kinds"] = _joined(field("businessTypes"))
    raw["attributes"] = F.nullif(F.array_join(field("businessAttributes"), ", "), F.lit(""))
    raw["path"] = F.nullif(field("urlPath"), F.lit(""))
    raw["createdAt"] = field("createdAt")
    fields = items.select(*kept, *[column.alias(f"_{name}") for name, column in (texts | raw).items()])

    def text(name: str) -> Column:
        return F.coalesce(F.col(f"_{name}"), F.lit(NA))

    def part(name: str) -> Column:
        """The field inside a combined text."""
        return text(name) if legacy_na else F.col(f"_{name}")

    url = F.coalesce(F.concat(F.lit(base_url + LISTING_PATH), F.col("_path")), F.lit(""))
    name = F.when(part("firstName").isNotNull() | part("lastName").isNotNull(), F.concat_ws(" ", part("firstName"), part("lastName")))
    record = {
        "title": text("title"),
        "city": text("county"),
        "state": text("state"),
        "country": F.lit("US"),
        "url": url,
        "industry": industry_label(part("businessCategory"), F.col("_kinds")),
        "source": F.lit(source),
        "description": strip_html(text("description")),
        "listed_by_firm": F.lit(""),
        "listed_by_name": F.coalesce(name, text("contactName")),
        "phone": text("phoneNumber"),
        "email": text("email"),
        "price": text("askingPrice"),
        "gross_revenue": text("revenue"),
        "cash_flow": text("cashFlow"),
        "inventory": F.lit(""),
        "ebitda": text("adjustedNet"),
        "scraping_date": F.lit(scraping_date),
        "financial_data": labelled(
            {"Revenue": part("revenue"), "Cash Flow": part("cashFlow"), "EBITDA": part("adjustedNet")}, "; "
        ),
        "source_link": url,
        "extra_information": labelled(
            {
                "Employees": F.col("_employees"),
                "Established": F.col("_establishedYear"),
                "Size": F.concat(F.col("_sizeInSquareFeet"), F.lit(" sqft")),
                "Sale Reason": part("saleReason"),
                "Attributes": F.col("_attributes"),
                "Down Payment": part("down"),
                "Status": part("businessStatus"),
                "FF&E": part("ffe"),
            },
            " | ",
        ),
        "deal_date": epoch_ms_date(F.col("_createdAt")),
    }
    return fields.select(*kept, *[record[c].alias(c) for c in RECORD_COLUMNS])


parse_item = partial(F.from_json, schema=ITEM_SCHEMA)
