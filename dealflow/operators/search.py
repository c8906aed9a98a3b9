"""Text and vector search over listings, with optional reranking, for one query or a table of queries."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealflow.functions.vectors import similarity
from dealflow.operators.browse import listing_view
from dealflow.operators.filters import NO_FILTER, ListingFilter
from dealflow.operators.knn import BROADCAST_HITS, nearest
from dealflow.operators.topk import top_per_group

RerankFn = Callable[[str, list[str]], list[float]]

# Candidate budget, rerank depth and fusion weights.
FETCH_MULTIPLIER, FETCH_LEAST = 2, 30
RERANK_TOP = 20
WEIGHT_VECTOR, WEIGHT_RERANK = 0.4, 0.6
DEFAULT_THRESHOLD = 0.6

SEARCHED = ["title", "description", "industry", "city", "state"]


@dataclass(frozen=True)
class SearchBudget:
    """How much a search looks at. Without the last three there is no ceiling and texts are scored whole."""

    fetch_multiplier: int = FETCH_MULTIPLIER
    fetch_least: int = FETCH_LEAST
    fetch_most: int | None = None
    rerank_most: int | None = None
    rerank_chars: int | None = None

    def fetch(self, limit: int) -> int:
        """Candidates to fetch for ``limit`` results."""
        wanted = max(limit * self.fetch_multiplier, self.fetch_least)
        return wanted if self.fetch_most is None else min(self.fetch_most, wanted)

    def depth(self, limit: int, rerank_top: int) -> int:
        """Candidates to score for ``limit`` results."""
        wanted = max(limit, rerank_top)
        return wanted if self.rerank_most is None else min(self.rerank_most, wanted)


NO_CEILING = SearchBudget()


def like_pattern(query: str) -> str:
    """``%query%`` with the query's own wildcards kept; a backslash quotes the character after it."""
    return re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], f"%{query}%", flags=re.DOTALL)


def text_matches(query: str) -> Column:
    pattern = like_pattern(query)
    hit = F.lit(False)
    for column in SEARCHED:
        hit = hit | F.col(column).ilike(pattern)
    return hit


def text_search(
    listings: DataFrame, query: str, limit: int = 20, filters: ListingFilter = NO_FILTER
) -> DataFrame:
    """Listings that contain the text in a searched column, lowest id first."""
    matching = filters.apply(listings).where(text_matches(query))
    return listing_view(matching.orderBy("id").limit(limit))


def text_search_many(
    listings: DataFrame, queries: dict[int, str], limit: int = 20, filters: ListingFilter = NO_FILTER
) -> DataFrame:
    """The same for several queries in one pass: each row lists the queries it answers."""
    answered = F.array_compact(F.array(*[F.when(text_matches(q), F.lit(i)) for i, q in queries.items()]))
    matching = filters.apply(listings).withColumn("query_id", F.explode(answered))
    best = top_per_group(matching.select("query_id", "id"), "query_id", [F.col("id")], limit)
    small = len(queries) * limit <= BROADCAST_HITS
    return listing_view(listings).join(best.hint("broadcast") if small else best, "id")


def candidate_ids(
    listings: DataFrame, queries: DataFrame, fetch: int, filters: ListingFilter = NO_FILTER
) -> DataFrame:
    """``query_id, id, distance, rank`` of the nearest listings that pass the filters."""
    corpus = filters.apply(listings).select("id", F.col("description_embedding").alias("embedding"))
    return nearest(queries.select("query_id", "embedding"), corpus, fetch)


def semantic_candidates(
    listings: DataFrame,
    queries: DataFrame,
    limit: int = 20,
    filters: ListingFilter = NO_FILTER,
    budget: SearchBudget = NO_CEILING,
) -> DataFrame:
    """The candidate budget of nearest listings per query, with their columns."""
    return _with_listing(candidate_ids(listings, queries, budget.fetch(limit), filters), listings)


def _with_listing(hits: DataFrame, listings: DataFrame) -> DataFrame:
    scored = hits.withColumn("similarity_score", similarity(F.col("distance")))
    return listing_view(listings).join(scored, "id")


def words(value: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_remove(F.array_distinct(F.split(F.lower(value), r"[^a-z0-9]+")), "")


def word_overlap(asked: Column, text: Column) -> Column:
    """Offline stand-in for a reranking model: the share of the asked words that the text has."""
    shared = F.size(F.array_intersect(asked, words(text)))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(asked).cast("double")), F.lit(0.0))


def rerank_text(chars: int | None = None) -> Column:
    text = F.coalesce(F.col("description"), F.lit("N/A"))
    return text if chars is None else F.substring(text, 1, chars)


def _model_scores(pairs: DataFrame, queries: DataFrame, rerank_fn: RerankFn) -> DataFrame:
    """Scores of one query's slice per call; a failing or short answer leaves them NULL. A query's text travels once, not with
    each of its pairs."""

    def score(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        part = part.merge(asked, on="query_id").sort_values("rank")
        if part.empty:
            return pd.DataFrame({"query_id": [], "id": [], "rerank_score": []}).astype({"query_id": "int64", "id": "int64"})
        try:
            scores = list(rerank_fn(part["text"].iloc[0], part["passage"].tolist()))
        except Exception:  # noqa: BLE001 - a failing model leaves the vector order as it is
            scores = []
        out = part[["query_id", "id"]].copy()
        out["rerank_score"] = scores if len(scores) == len(part) else None
        out["rerank_score"] = out["rerank_score"].astype("float64")
        return out

    schema = "query_id long, id long, rerank_score double"
    return pairs.groupBy("query_id").cogroup(queries.groupBy("query_id")).applyInPandas(score, schema)


def fuse(hits: DataFrame, limit: int) -> DataFrame:
    """Scored hits by rerank score (equal scores keep their order), then the others, cut to ``limit``."""
    scored = F.col("rerank_score").isNotNull()
    fused = F.round(
        F.col("similarity_score") * WEIGHT_VECTOR + F.col("rerank_score") * WEIGHT_RERANK, 4
    )
    order = [(~scored).asc(), F.col("rerank_score").desc(), F.col("rank").asc()]
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return (
        hits.withColumn("position", position)
        .where(F.col("position") <= limit)
        .withColumn("similarity_score", F.when(scored, fused).otherwise(F.col("similarity_score")))
    )


def semantic_search(
    listings: DataFrame,
    queries: DataFrame,
    limit: int = 20,
    threshold: float = DEFAULT_THRESHOLD,
    filters: ListingFilter = NO_FILTER,
    rerank: bool = True,
    rerank_top: int = RERANK_TOP,
    rerank_fn: RerankFn | None = None,
    hits: DataFrame | None = None,
    budget: SearchBudget = NO_CEILING,
) -> DataFrame:
    """Nearest listings per query within ``threshold``, reranked and cut to ``limit``; ordered by ``position``.

    ``queries`` has ``query_id, embedding`` and, for reranking, ``text``. Every step after the vector search works on
    the candidates that ``budget`` allows. ``hits`` are candidates found otherwise, as by ``ivf.ivf_nearest``; an index knows
    nothing of filters, so they exclude each other.
    """
    if not 1 <= limit <= 100 or not 0.0 <= threshold <= 1.0 or not 1 <= rerank_top <= 100:
        raise ValueError("limit and rerank_top must be 1..100 and threshold 0..1")
    if hits is None:
        hits = candidate_ids(listings, queries, budget.fetch(max(limit, rerank_top if rerank else 0)), filters)
    elif filters != NO_FILTER:
        raise ValueError("give either hits or filters")
    hits = hits.where(F.col("distance") <= threshold)
    if not rerank:
        found = _with_listing(hits.where(F.col("rank") <= limit), listings)
        return found.withColumnRenamed("rank", "position")
    depth = budget.depth(limit, rerank_top)
    found = _with_listing(hits.where(F.col("rank") <= max(depth, limit)), listings)
    in_slice = F.col("rank") <= depth
    if rerank_fn is None:
        # The words of a query are taken once, not once per hit.
        asked = queries.select("query_id", words(F.col("text")).alias("_asked"))
        score = F.when(in_slice, word_overlap(F.col("_asked"), rerank_text(budget.rerank_chars)))
        found = found.join(asked, "query_id").withColumn("rerank_score", score).drop("_asked")
    else:
        pairs = found.where(in_slice).select("query_id", "id", "rank", rerank_text(budget.rerank_chars).alias("passage"))
        scores = _model_scores(pairs, queries.select("query_id", "text"), rerank_fn)
        found = found.join(scores, ["query_id", "id"], "left")
    return fuse(found, limit).drop("rank")
