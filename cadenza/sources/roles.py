"""The playlist model over the test tables: songs, artists, playlists and their links.

Averages are ratios of integer sums, so they don't depend on the order in which rows are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda c, k: F.sum(F.round(F.col(c) * k).cast("long"))
    stats = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("song_id")).agg(
        F.count("*").alias("n"), whole("l_discount", 100).alias("sd"), whole("l_tax", 100).alias("st"), whole("l_quantity", 1).alias("sq"), F.min("l_suppkey").alias("artist_id")
    )
    part = table(spark, sf_dir, "part")
    return stats.join(part, stats.song_id == part.p_partkey).select(
        "song_id", F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_name").alias("title"),
        F.round(F.col("sd") / (F.col("n") * 10.0), 6).alias("danceability"), F.round(F.col("st") / (F.col("n") * 8.0), 6).alias("energy"),
        (F.col("p_size") % 2).alias("mode"), F.round(F.col("p_size") / 50.0, 6).alias("valence"), (F.col("p_retailprice") / 10).alias("tempo"),
        F.concat(F.lit("song:"), F.col("p_partkey").cast("string")).alias("uri"), (F.col("p_size") % 12).alias("key"),
        F.round(F.col("sq") * 2.0 / F.col("n")).cast("int").alias("popularity"), F.col("p_type").alias("genre"), "artist_id",
    )


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("artist"), F.concat(F.lit("artist:"), F.col("s_suppkey").cast("string")).alias("artist_uri"))


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pid"), F.col("c_name").alias("playlist"),
        F.to_json(F.array("c_name", F.concat(F.lit("u:"), F.col("c_custkey").cast("string")))).alias("owner"),
        F.col("c_mktsegment").alias("description"),
    )


def playlist_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, song_id, pos): where a song first stands in a playlist."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("pid"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("song_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("pid", "song_id").agg(F.min("pos").alias("pos"))


def enumerated(items: DataFrame) -> DataFrame:
    """+ r: 0-based place of a song in its playlist."""
    return items.withColumn("r", F.row_number().over(Window.partitionBy("pid").orderBy("pos", "song_id")) - 1)


def artist_items(spark: SparkSession, sf_dir: str, most: int = 50) -> DataFrame:
    """(pid, song_id, pos) of an artist's most popular songs; pid is the artist."""
    own = songs(spark, sf_dir).select(F.col("artist_id").alias("pid"), "song_id", "popularity")
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("popularity"), "song_id"))
    return own.withColumn("pos", rank.cast("long")).where(F.col("pos") <= most).select("pid", "song_id", "pos")
