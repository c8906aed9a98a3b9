"""Filling in description embeddings with a pluggable model."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.functions.text import is_present, strip_space
from dealflow.schema import EMBEDDING, NA

EmbedFn = Callable[[list[str]], list[list[float]]]

BATCH_ROWS = 25
RETRY_WAIT = 10.0
DIMENSIONS = 1024


def hashing_embedder(dimensions: int = DIMENSIONS) -> EmbedFn:
    """Offline stand-in for a model: signed word counts folded into ``dimensions``, as unit vectors."""

    def embed(texts: list[str]) -> list[list[float]]:
        vectors = np.zeros((len(texts), dimensions), np.float32)
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                code = zlib.crc32(word.encode())
                vectors[row, code % dimensions] += 1.0 if code >> 31 else -1.0
        sizes = np.linalg.norm(vectors, axis=1, keepdims=True)
        return (vectors / np.where(sizes > 0, sizes, 1.0)).tolist()

    return embed


def embed_column(
    text: Column, embed_fn: EmbedFn, batch_rows: int = BATCH_ROWS, retry_wait: float = RETRY_WAIT, delay: float = 0.0
) -> Column:
    """Vector of a text; NULL texts are not sent. A failing call is repeated once, then its rows stay NULL."""

    def call(texts: list[str]) -> list:
        for attempt in range(2):
            try:
                vectors = embed_fn(texts)
                if len(vectors) == len(texts):
                    return [v if v is not None and len(v) else None for v in vectors]
            except Exception:  # noqa: BLE001 - any model or network failure leaves the rows for a later run
                pass
            if attempt == 0:
                time.sleep(retry_wait)
        return [None] * len(texts)

    @F.pandas_udf(EMBEDDING)
    def run(texts: pd.Series) -> pd.Series:
        wanted = texts.dropna()
        found: list = []
        for start in range(0, len(wanted), batch_rows):
            if start and delay:
                time.sleep(delay)
            found.extend(call(wanted.iloc[start : start + batch_rows].tolist()))
        return pd.Series(found, index=wanted.index, dtype=object).reindex(texts.index).map(
            lambda v: None if not isinstance(v, (list, tuple, np.ndarray)) else v
        )

    return run(text)


def description_text(column: str = "description", chars: int | None = None) -> Column:
    """The text an uploaded description is embedded by, cut to ``chars`` if given; NULL for a blank or missing one."""
    text = F.col(column) if chars is None else F.substring(F.col(column), 1, chars)
    trimmed = strip_space(text)
    return F.when((trimmed != "") & (F.col(column) != NA), trimmed)


def embedding_backlog(listings: DataFrame, limit: int = 0) -> DataFrame:
    """Listings without an embedding, lowest id first when only some are wanted."""
    waiting = listings.where(F.col("description_embedding").isNull()).select("id", "description")
    return waiting.orderBy("id").limit(limit) if limit > 0 else waiting


def embedding_backfill(
    listings: DataFrame,
    embed_fn: EmbedFn,
    limit: int = 0,
    batch_rows: int = BATCH_ROWS,
    retry_wait: float = RETRY_WAIT,
    delay: float = 0.0,
    skip_na: bool = False,
    chars: int | None = None,
) -> DataFrame:
    """The table with missing embeddings filled in.

    A full run is one narrow pass over the table: no join, no shuffle, and only waiting texts reach Python. With
    ``limit`` the chosen ids are looked up first. ``chars`` cuts the texts for models that take no longer ones.
    """
    waiting = F.col("description_embedding").isNull()
    if limit > 0:
        chosen = embedding_backlog(listings, limit).select("id", F.lit(True).alias("_chosen"))
        listings = listings.join(chosen, "id", "left")
        waiting = waiting & F.col("_chosen")
    if skip_na:
        waiting = waiting & is_present(F.col("description"))
    text = F.coalesce("description", F.lit(""))
    text = text if chars is None else F.substring(text, 1, chars)
    vector = embed_column(F.when(waiting, text), embed_fn, batch_rows, retry_wait, delay)
    return listings.withColumn("description_embedding", F.coalesce("description_embedding", vector)).drop("_chosen")
