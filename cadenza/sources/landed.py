"""Landed API documents (JSON) as typed rows, and writers of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import quoted_list

ITEMS = "items array<struct<track: struct<name: string, uri: string>>>"
TOP_TRACKS = "tracks array<struct<name: string, uri: string>>"
HEADER = "name string, owner struct<display_name: string, uri: string>, followers struct<total: int>, description string, images array<struct<url: string>>"


SEARCH = "tracks struct<items: array<struct<name: string, uri: string, artists: array<struct<name: string, uri: string>>>>>, artists struct<items: array<struct<name: string, uri: string, genres: array<string>>>>, playlists struct<items: array<struct<name: string, uri: string, owner: struct<display_name: string, uri: string>>>>"
FEATURES = "uri string, danceability double, energy double, mode int, valence double, tempo double, key int"
TRACK = "uri string, name string, popularity int, artists array<struct<name: string, uri: string>>"
ARTIST = "uri string, name string, genres array<string>"
CATEGORIES = "categories struct<items: array<struct<id: string, name: string>>>"
PLAYLISTS = "playlists struct<items: array<struct<name: string, uri: string, description: string>>>"
GRAPH = "nodes array<struct<id: string>>, links array<struct<source: string, target: string, value: double>>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def playlist_tracks(doc: DataFrame) -> DataFrame:
    """pos, name, uri of an items document; items without a track are left out."""
    return doc.select(F.posexplode("items").alias("pos", "item")).where("item.track is not null").select("pos", "item.track.name", "item.track.uri")


def top_tracks(doc: DataFrame, most: int = 50) -> DataFrame:
    return doc.select(F.posexplode(F.slice("tracks", 1, most)).alias("pos", "t")).select("pos", "t.name", "t.uri")


def header(doc: DataFrame) -> DataFrame:
    """name, owner (a JSON array), follow_count, description, cover_image (the first)."""
    return doc.select("name", F.to_json(F.array("owner.display_name", "owner.uri")).alias("owner"), F.col("followers.total").alias("follow_count"), "description", F.try_element_at("images", F.lit(1)).getField("url").alias("cover_image"))


def search_hits(doc: DataFrame, category: str) -> DataFrame:
    """pos, name, subtitle, uri of a search document: the first artist of a track, the genres of an artist, the owner of a playlist."""
    subtitle = {"track": F.try_element_at("hit.artists", F.lit(1)).getField("name"), "artist": F.array_join("hit.genres", ", "), "playlist": F.col("hit.owner.display_name")}
    if category not in subtitle:
        raise ValueError(f"unknown category {category}")
    return doc.select(F.posexplode(f"{category}s.items").alias("pos", "hit")).where("hit is not null").select("pos", "hit.name", subtitle[category].alias("subtitle"), "hit.uri")


def track_details(doc: DataFrame) -> DataFrame:
    """uri, name, popularity, artist_uri: the first artist."""
    return doc.select("uri", "name", "popularity", F.try_element_at("artists", F.lit(1)).getField("uri").alias("artist_uri"))


def artist_details(doc: DataFrame) -> DataFrame:
    """artist_uri, artist, genres (as text)."""
    return doc.select(F.col("uri").alias("artist_uri"), F.col("name").alias("artist"), quoted_list(F.coalesce("genres", F.array())).alias("genres"))


def audio_features(doc: DataFrame) -> DataFrame:
    """uri and the features of a track, tempo by 100."""
    return doc.where("uri is not null").select("uri", "danceability", "energy", "mode", "valence", (F.col("tempo") / 100).alias("tempo"), "key")


def categories(doc: DataFrame) -> DataFrame:
    return doc.select(F.posexplode("categories.items").alias("pos", "c")).select("pos", "c.id", "c.name")


def listed_playlists(doc: DataFrame) -> DataFrame:
    """pos, name, uri, description of a featured or category document."""
    return doc.select(F.posexplode("playlists.items").alias("pos", "p")).where("p is not null").select("pos", "p.name", "p.uri", "p.description")


def graph_nodes(doc: DataFrame) -> DataFrame:
    return doc.select(F.explode("nodes").alias("n")).select("n.id")


def graph_links(doc: DataFrame) -> DataFrame:
    return doc.select(F.explode("links").alias("l")).select("l.source", "l.target", "l.value")


def literal_list(spark: SparkSession, names: list[str]) -> DataFrame:
    """A given list as rows: pos, name."""
    return spark.createDataFrame(list(enumerate(names)), "pos int, name string")


def jdbc_table(spark: SparkSession, url: str, table: str, *, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A table of a relational database; with a numeric key and its bounds it is read by several tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def read_edges(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """a, b of an edge list; lines that begin with # are comments."""
    return spark.read.schema("a string, b string").option("sep", sep).option("comment", "#").csv(path)


def write_edges(edges: DataFrame, path: str, sep: str = " ") -> None:
    edges.select("a", "b").write.option("sep", sep).csv(path)


def adjacency_lines(arcs: DataFrame, most: int = 1000) -> DataFrame:
    """line: each node with arcs (a -> b) and its targets, by blanks, ascending; a node of more than `most` targets has
    several lines of about as many."""
    size = arcs.groupBy("a").agg(F.ceil(F.count("*") / most).alias("lines"))
    dealt = arcs.join(size, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("lines")))
    return dealt.groupBy("a", "part").agg(F.array_sort(F.collect_list("b")).alias("bs")).select(F.concat_ws(" ", F.col("a").cast("string"), F.col("bs").cast("array<string>")).alias("line"))


def numbered_lines(texts: DataFrame) -> DataFrame:
    """(text) -> head, tail: arcs of lines `number name:tail tail ...`.

    Lines that begin with * are comments. A line that ends with a backslash goes on with the next, and one that begins
    with a blank continues the one before. Arcs from a number to itself stay; see self_loops().
    """
    joined = F.regexp_replace(F.regexp_replace("text", r"(?m)^\*.*(\r?\n|$)", ""), r"\\?\r?\n(?= )|\\\r?\n", "")
    line = texts.select(F.explode(F.split(joined, r"\r?\n")).alias("line")).where(F.contains("line", F.lit(":")))
    head = F.regexp_extract("line", r"^([0-9]+)", 1)
    tails = F.filter(F.split(F.substring_index("line", ":", -1), r"\s+"), lambda t: t != "")
    return line.select(head.alias("head"), F.explode(tails).alias("tail")).where("head <> ''")


def self_loops(arcs: DataFrame) -> DataFrame:
    return arcs.where("head = tail")


#: Fixed value: the headers of a message that name recipients.
RECIPIENTS = ("to", "cc", "resent-to", "resent-cc")
ADDRESS = r"[A-Za-z0-9._%+'-]+@[A-Za-z0-9.-]+"


def mail_arcs(messages: DataFrame) -> DataFrame:
    """(text of a message) -> sender, recipient, subject: an arc for each recipient, as often as it is named."""
    head = F.regexp_replace(F.substring_index(F.regexp_replace("text", r"\r\n", "\n"), "\n\n", 1), r"\n[ \t]+", " ")
    field = lambda name: F.regexp_extract_all(head, F.lit(f"(?im)^{name}:(.*)$"), F.lit(1))
    sender = F.try_element_at(F.regexp_extract_all(F.array_join(field("from"), " "), F.lit(ADDRESS), F.lit(0)), F.lit(1))
    to = F.regexp_extract_all(F.array_join(F.concat(*(field(n) for n in RECIPIENTS)), ", "), F.lit(ADDRESS), F.lit(0))
    return messages.select(sender.alias("sender"), F.explode(to).alias("recipient"), F.trim(F.try_element_at(field("subject"), F.lit(1))).alias("subject"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path: the files of a folder in ascending order."""
    return spark.read.format("binaryFile").load(folder).select("path").orderBy("path")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)
