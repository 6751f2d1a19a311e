"""Catalogues, song records, radial profiles and playlist averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MODE_DIV_RADIAL, TEMPO_DIV

FEATURES = ["danceability", "energy", "mode", "valence", "tempo", "popularity"]


def catalog(items: DataFrame) -> DataFrame:
    """(pid, pos, name, uri) -> one row per name: its first position, its last uri."""
    return items.groupBy("pid", "name").agg(F.min("pos").alias("pos"), F.max_by("uri", "pos").alias("uri"))


def song_properties(songs: DataFrame, artists: DataFrame) -> DataFrame:
    """The song record; tempo is divided by 100."""
    features = F.struct("danceability", "energy", "mode", "valence", (F.col("tempo") / 100).alias("tempo"), "uri", "key", "popularity", "genre")
    return songs.join(artists, "artist_id").select("song_id", "name", "artist", features.alias("features"))


def radial_profile(songs: DataFrame) -> DataFrame:
    """name, place, category, r: the five named axes and the closing point, which repeats the first."""
    axes = [("danceability", F.col("danceability")), ("energy", F.col("energy")), ("mode", F.col("mode") / float(MODE_DIV_RADIAL)), ("valence", F.col("valence")), ("tempo", F.col("tempo") / float(TEMPO_DIV))]
    points = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("category"), c.cast("double").alias("r")) for i, (n, c) in enumerate([*axes, axes[0]])))
    return songs.select("name", F.explode(points).alias("p")).select("name", "p.*")


def playlist_means(items: DataFrame, songs: DataFrame) -> DataFrame:
    """The mean of each feature by playlist; sums are of millionths, so the order of rows doesn't matter."""
    return items.join(songs, "song_id").groupBy("pid").agg(*((F.sum(F.round(F.col(c) * 1_000_000).cast("long")) / (F.count("*") * 1_000_000.0)).alias(f"avg_{c}") for c in FEATURES))


def featured_on(items: DataFrame, songs: DataFrame) -> DataFrame:
    """Which artists stand on which playlists."""
    return items.join(songs.select("song_id", "artist_id"), "song_id").select("artist_id", F.col("pid").alias("playlist_id")).distinct()


def overlay(songs: DataFrame, first: str, second: str) -> DataFrame:
    """The radial profiles of two songs side by side: place, category, first, second."""
    r = radial_profile(songs.where(F.col("name").isin(first, second)))
    one = lambda name: F.max(F.when(F.col("name") == name, F.col("r")))
    return r.groupBy("place", "category").agg(one(first).alias("first"), one(second).alias("second"))
