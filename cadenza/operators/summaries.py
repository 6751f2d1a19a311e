"""Smaller graphs that keep a graph's structure: attribute and relation summaries, and compressor nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, drop
from .graph import both_ways


def set_digest(*cols: str) -> list[Column]:
    """Two aggregates that stand for a group's set of (different) rows by 128 bits, in any order and without a list."""
    return [F.bit_xor(F.xxhash64(F.lit(salt), *cols)).alias(f"h{salt}") for salt in (1, 2)]


def snap_groups(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, type) and (node, label) -> node, part: the fewest groups of nodes of one label of which all members have
    edges of the same types into the same groups. A part is named by its smallest node.

    Groups are split by the set of (edge type, group) pairs that a node meets, until none splits.
    """
    ways = cut(edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("v"), "type"), F.struct(F.col("b").alias("node"), F.col("a").alias("v"), "type"))).alias("w")).select("w.*").distinct())
    first = labels.groupBy("label").agg(F.min("node").alias("part"))
    part = cut(labels.join(first, "label").select("node", "part"))
    n = first.count()
    while True:
        met = ways.join(part.select(F.col("node").alias("v"), F.col("part").alias("to")), "v").select("node", "type", "to").distinct()
        signed = part.join(met.groupBy("node").agg(*set_digest("type", "to"), F.count("*").alias("size")), "node", "left")
        keys = ["part", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("h1", "h2", "size"))]
        signed = cut(signed.select("node", *keys))
        names = signed.groupBy("part", "h1", "h2", "size").agg(F.min("node").alias("name"))
        old, part = part, cut(signed.join(names, ["part", "h1", "h2", "size"]).select("node", F.col("name").alias("part")))
        drop(old, signed)
        now = part.select("part").distinct().count()
        if now == n:
            drop(ways)
            return part
        n = now


def snap_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b, type, n: the summary's edges between groups (a <= b), with how many edges each stands for."""
    one = lambda c: groups.select(F.col("node").alias(c), F.col("part").alias("p" + c))
    ends = edges.join(one("a"), "a").join(one("b"), "b")
    return ends.groupBy(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), "type").agg(F.count("*").alias("n"))


def dedensify(arcs: DataFrame, threshold: int) -> DataFrame:
    """(a -> b) -> kind, a, b with compressor nodes for sources that share their targets of an in-degree above `threshold`.

    Sources with one set of such targets form a group; where s sources and t targets have s * t > s + t, the arcs between
    them become s + t: 'in' from a source to the compressor and 'out' from the compressor to a target. A compressor is
    named by its smallest source. All other arcs stay ('kept').
    """
    e = cut(arcs.select("a", "b").distinct())
    high = e.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > threshold).select("b")
    dense = cut(e.join(high, "b").select("a", "b"))
    sets = cut(dense.groupBy("a").agg(*set_digest("b"), F.count("*").alias("t")))
    groups = sets.groupBy("h1", "h2", "t").agg(F.count("*").alias("s"), F.min("a").alias("compressor")).where("s * t > s + t")
    member = cut(sets.join(groups, ["h1", "h2", "t"]).select("a", "compressor"))
    gone = dense.join(member, "a", "left_semi")
    kept = e.join(gone, ["a", "b"], "left_anti").select(F.lit("kept").alias("kind"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    into = member.select(F.lit("in").alias("kind"), F.col("a").cast("string").alias("a"), F.col("compressor").cast("string").alias("b"))
    out = dense.join(member.where("a = compressor").select("a"), "a", "left_semi").select(F.lit("out").alias("kind"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    return kept.unionByName(into).unionByName(out)


def densify(small: DataFrame) -> DataFrame:
    """The arcs (a -> b, as strings) that a graph of dedensify() stands for."""
    pair = small.where("kind = 'in'").select("a", F.col("b").alias("c")).join(small.where("kind = 'out'").select(F.col("a").alias("c"), "b"), "c").select("a", "b")
    return small.where("kind = 'kept'").select("a", "b").unionByName(pair)
