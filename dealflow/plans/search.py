"""One search request: choose text or vector search for the query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from dealflow.operators.browse import listing_view
from dealflow.operators.embed import EmbedFn
from dealflow.operators.filters import NO_FILTER, ListingFilter
from dealflow.operators.search import (
    DEFAULT_THRESHOLD,
    NO_CEILING,
    RERANK_TOP,
    RerankFn,
    SearchBudget,
    semantic_search,
    text_search,
)

# Fixed value: queries of fewer words are looked up as text.
LEAST_WORDS = 3


@dataclass(frozen=True)
class SearchResult:
    """``method`` says what ran; ``data`` is not computed before it is read."""

    query: str
    method: str
    data: DataFrame

    @property
    def total(self) -> int:
        return self.data.count()


def search(
    listings: DataFrame,
    query: str,
    embed_fn: EmbedFn,
    limit: int = 20,
    filters: ListingFilter = NO_FILTER,
    threshold: float = DEFAULT_THRESHOLD,
    rerank: bool = True,
    rerank_top: int = RERANK_TOP,
    rerank_fn: RerankFn | None = None,
    budget: SearchBudget = NO_CEILING,
) -> SearchResult:
    """Short queries go to text search, and so does any query that cannot be embedded."""
    if not query:
        raise ValueError("query must not be empty")

    def by_text(method: str) -> SearchResult:
        return SearchResult(query, method, text_search(listings, query, limit, filters))

    if len(query.split()) < LEAST_WORDS:
        return by_text("text")
    try:
        vector = embed_fn([query.strip()])[0]
    except Exception:  # noqa: BLE001 - without a vector the text search still answers
        return by_text("text (embedding fallback)")
    if vector is None or not len(vector):
        return SearchResult(query, "semantic", listing_view(listings).limit(0))
    queries = listings.sparkSession.createDataFrame(
        [(0, query, [float(v) for v in vector])], "query_id long, text string, embedding array<float>"
    )
    hits = semantic_search(listings, queries, limit, threshold, filters, rerank, rerank_top, rerank_fn, budget=budget)
    return SearchResult(query, "semantic + rerank" if rerank else "semantic", hits.orderBy("position"))
