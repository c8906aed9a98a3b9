"""Reading listing fields out of HTML pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.functions.text import clean_text, parse_location
from dealflow.operators.collector import labelled
from dealflow.schema import NA, RECORD_COLUMNS

# Elements without an end tag.
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
}
# An open element of the key ends where one of the listed elements begins.
ENDED_BY = {
    "p": {
        "p", "div", "ul", "ol", "dl", "table", "form", "section", "article", "header", "footer", "nav",
        "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "hr",
    },
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option"},
}


#: Tags as nearly all are written, without references in their values; the parser reads others itself.
START = re.compile(
    r"""<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\r\n]+[a-zA-Z][a-zA-Z0-9-]*=(?:'[^'<>&]*'|"[^"<>&]*"|[^\s'"<>=`&/]+))*)[ \t\r\n]*>"""
)
ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9-]*)=(?:'([^']*)'|"([^"]*)"|([^\s'"]+))""")
END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
# Elements whose content the parser reads in another way.
OTHERWISE = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


def attributes(text: str) -> list[tuple[str, str]]:
    """Names and values of what ``START`` finds behind a tag's name."""
    return [(name.lower(), a or b or c) for name, a, b, c in ATTRIBUTE.findall(text)] if text else []


class Node:
    """An element with its attributes, children and text pieces."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.content: list[Node | str] = []
        self.classes = attrs["class"].split() if "class" in attrs else []

    def text(self) -> str:
        pieces, waiting = [], list(reversed(self.content))
        while waiting:
            item = waiting.pop()
            if isinstance(item, str):
                pieces.append(item)
            else:
                waiting.extend(reversed(item.content))
        return "".join(pieces)

    def first_text(self) -> str:
        for c in self.content:
            if isinstance(c, str):
                return c
        return ""

    def later_siblings(self, tag: str) -> list[Node]:
        around = self.parent.content if self.parent else []
        at = next((i for i, c in enumerate(around) if c is self), len(around))
        return [c for c in around[at + 1 :] if isinstance(c, Node) and c.tag == tag]


class Nodes(list[Node]):
    """The elements of a page in document order, also by tag and by class."""

    def __init__(self) -> None:
        super().__init__()
        self.tags: dict[str, list[Node]] = {}
        self.classes: dict[str, list[Node]] = {}

    def append(self, node: Node) -> None:
        super().append(node)
        self.tags.setdefault(node.tag, []).append(node)
        for cls in dict.fromkeys(node.classes):
            self.classes.setdefault(cls, []).append(node)


class PageParser(HTMLParser):
    """Collects the elements of a page in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.here = Node("", {}, None)
        self.nodes = Nodes()

    def updatepos(self, i, j):
        return j  # nobody asks for line numbers

    def read(self, html: str) -> None:
        """The whole page: its usual tags up to the first other one, then the rest as the parser does."""
        at = 0
        while (start := html.find("<", at)) >= 0:
            found = START.match(html, start) or END.match(html, start)
            if not found or (tag := found[1].lower()) in OTHERWISE:
                break
            if at < start:
                self.handle_data(unescape(html[at:start]))
            if found.re is END:
                self.handle_endtag(tag)
            else:
                self.handle_starttag(tag, attributes(found[2]))
            at = found.end()
        self.feed(html[at:])
        self.close()

    def parse_starttag(self, i):
        found = START.match(self.rawdata, i)
        tag = found[1].lower() if found else ""
        if not found or tag in OTHERWISE:
            return super().parse_starttag(i)
        self.lasttag = tag
        self.handle_starttag(tag, attributes(found[2]))
        return found.end()

    def parse_endtag(self, i):
        found = END.match(self.rawdata, i) if self.cdata_elem is None else None
        if not found:
            return super().parse_endtag(i)
        self.handle_endtag(found[1].lower())
        return found.end()

    def handle_starttag(self, tag, attrs):
        while tag in ENDED_BY.get(self.here.tag, ()):
            self.here = self.here.parent
        node = Node(tag, {k: v or "" for k, v in attrs} if attrs else {}, self.here)
        self.here.content.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        content = self.here.content
        if content and isinstance(content[-1], str):
            content[-1] += data
        else:
            content.append(data)


Selector = Callable[[Nodes], Iterator[Node]]


def tagged(tag: str, cls: str | None = None) -> Selector:
    return lambda nodes: (n for n in nodes.tags.get(tag, ()) if cls is None or cls in n.classes)


def classed(cls: str) -> Selector:
    return lambda nodes: iter(nodes.classes.get(cls, ()))


def with_id(name: str) -> Selector:
    return lambda nodes: (n for n in nodes if n.attrs.get("id") == name)


def value_after(label: str) -> Selector:
    """The span that follows a span whose text has the label."""
    return lambda nodes: (
        s for n in nodes.tags.get("span", ()) if label in n.first_text() for s in n.later_siblings("span")
    )


# Where a page shows each field, in order of preference.
TEXT_FIELDS: dict[str, list[Selector]] = {
    "title": [tagged("h1")],
    "location": [tagged("h2", "gray"), classed("listing-location"), classed("business-location")],
    "description": [
        lambda nodes: (n for n in nodes.tags.get("div", ()) if "businessDescription" in n.attrs.get("class", ""))
    ],
    "price": [value_after("Asking Price:")],
    "gross_revenue": [value_after("Gross Revenue:")],
    "cash_flow": [value_after("Cash Flow")],
    "inventory": [value_after("Inventory")],
    "ebitda": [value_after("EBITDA:")],
    "listed_by_full": [lambda nodes: (n for n in nodes if " Listed By" in n.first_text())],
    "listed_by_name": [with_id("ContactBrokerNameHyperLink"), classed("broker-name")],
    "listed_by_firm": [classed("cmp-name")],
}
LINK_FIELDS: dict[str, list[Selector]] = {
    "phone": [
        lambda nodes: (
            a
            for n in nodes.tags.get("span", ())
            if "Phone Number" in n.first_text() and n.parent
            for s in n.parent.later_siblings("span")
            for a in s.content
            if isinstance(a, Node) and a.tag == "a"
        )
    ],
    "email": [lambda nodes: (n for n in nodes.tags.get("a", ()) if n.attrs.get("href", "").startswith("mailto:"))],
}


def page_fields(html: str, keep_blank: bool = False) -> dict[str, str]:
    """Raw text of every field: the first selector whose first element has any text.

    ``keep_blank`` stops at the first element that exists, and tells such a blank (a space) from a missing field.
    """
    parser = PageParser()
    parser.read(html)

    def first(selectors: list[Selector], read: Callable[[Node], str]) -> str:
        for select in selectors:
            node = next(iter(select(parser.nodes)), None)
            text = "" if node is None else " ".join(read(node).split())
            if text or (keep_blank and node is not None):
                return text or " "
        return ""

    found = {name: first(selectors, Node.text) for name, selectors in TEXT_FIELDS.items()}
    links = {
        name: first(selectors, lambda n: n.attrs.get("href", "")) for name, selectors in LINK_FIELDS.items()
    }
    return found | links


def extract_pages(
    pages: DataFrame, source: str, scraping_date: str, legacy_na: bool = False
) -> DataFrame:
    """One record (22 columns) per page of ``url, html``; other columns are kept.

    Only the HTML itself goes through Python; cleaning and combining are Column expressions. A blank element counts
    as missing and the next selector is tried; ``legacy_na`` stops at it and reads ``N/A``.
    """
    names = [*TEXT_FIELDS, *LINK_FIELDS]

    @F.arrow_udf(", ".join(f"{n} string" for n in names))
    def fields(html: pa.Array) -> pa.Array:
        found = [page_fields(h.as_py() or "", legacy_na) for h in html]
        return pa.StructArray.from_arrays([pa.array([f[n] for f in found], pa.string()) for n in names], names)

    kept = [c for c in pages.columns if c != "html" and c not in RECORD_COLUMNS]
    found = pages.select(*kept, "url", fields("html").alias("f"))

    def value(name: str):
        raw = F.col(f"f.{name}")
        cleaned = clean_text(raw)
        return F.when(raw != "", cleaned) if legacy_na else F.nullif(cleaned, F.lit(NA))

    def shown(name: str):
        return F.coalesce(value(name), F.lit(NA))

    def link(name: str, prefix: str):
        return F.coalesce(F.nullif(F.trim(F.replace(value(name), F.lit(prefix), F.lit(""))), F.lit("")), F.lit(NA))

    place = parse_location(F.col("f.location"))
    full = F.nullif(F.trim(F.replace(value("listed_by_full"), F.lit("Business Listed By:"), F.lit(""))), F.lit(""))
    money = labelled(
        {
            "Gross Revenue": value("gross_revenue"),
            "Cash Flow": value("cash_flow"),
            "Inventory": value("inventory"),
            "EBITDA": value("ebitda"),
        },
        "; ",
    )
    record = {
        "title": shown("title"),
        "city": F.coalesce(F.nullif(place["city"], F.lit("")), F.lit(NA)),
        "state": F.coalesce(F.nullif(place["state"], F.lit("")), F.lit(NA)),
        "country": F.coalesce(F.nullif(place["country"], F.lit("")), F.lit("US")),
        "url": F.col("url"),
        "industry": F.lit(NA),
        "source": F.lit(source),
        "description": shown("description"),
        "listed_by_firm": shown("listed_by_firm"),
        "listed_by_name": F.coalesce(value("listed_by_name"), full, F.lit(NA)),
        "phone": link("phone", "tel:"),
        "email": link("email", "mailto:"),
        "price": shown("price"),
        "gross_revenue": shown("gross_revenue"),
        "cash_flow": shown("cash_flow"),
        "inventory": shown("inventory"),
        "ebitda": shown("ebitda"),
        "scraping_date": F.lit(scraping_date),
        "financial_data": F.coalesce(F.nullif(money, F.lit("")), F.lit(NA)),
        "source_link": F.col("url"),
        "extra_information": F.lit(NA),
        "deal_date": F.lit(NA),
    }
    return found.select(*kept, *[record[c].alias(c) for c in RECORD_COLUMNS])
