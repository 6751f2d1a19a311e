"""Search over songs, artists and playlists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hits of a listing, of a contact search, of a crawl.
LISTED, CONTACTED, CRAWLED = 15, 30, 50


def search(category: str, query: str, source: DataFrame, limit: int = LISTED) -> DataFrame:
    """name, subtitle, uri of the first hits by name. source has these columns; the query is matched without case."""
    if category not in ("track", "artist", "playlist"):
        raise ValueError(f"unknown category {category!r}")
    return source.where(F.contains(F.lower("name"), F.lit(query.lower()))).select("name", "subtitle", "uri").orderBy("name", "uri").limit(limit)


def contactable(described: DataFrame) -> DataFrame:
    """Rows whose description holds an @."""
    return described.where(F.contains("description", F.lit("@")))
