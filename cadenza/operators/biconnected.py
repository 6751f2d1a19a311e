"""Biconnected components, articulation points and bridges of undirected edge tables (a < b, no loops or repeats).

A breadth-first forest with preorder numbers tells ancestors apart; lows and highs say how far a subtree reaches by
edges outside the forest. An auxiliary graph joins forest edges that lie on a common cycle, and its connected components
are the blocks. All steps are joins, level by level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut, drop
from .graph import both_ways, components

#: Parts into which the children of a node are dealt, so that a hub's don't meet in one task.
PARTS = 64


def forest(edges: DataFrame) -> list[DataFrame]:
    """(node, parent) by depth, from each component's smallest node (parent null); the smallest of possible parents."""
    ways = cut(both_ways(edges))
    found = [cut(components(edges).select(F.col("component").alias("node")).distinct().withColumn("parent", F.lit(None).cast("long")))]
    while True:
        met = found[-1].select(F.col("node").alias("u")).join(ways, "u").groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"))
        for seen in found[-2:]:  # neighbours of a level lie in it or next to it
            met = met.join(seen.select("node"), "node", "left_anti")
        met = cut(met)
        if met.isEmpty():
            drop(met, ways)
            return found
        found.append(met)


def _sizes(levels: list[DataFrame]) -> list[DataFrame]:
    """+ size: nodes of the subtree, by depth."""
    out: list[DataFrame] = []
    for level in reversed(levels):
        sized = level.withColumn("size", F.lit(1).cast("long"))
        if out:
            own = out[-1].groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("below"))
            sized = level.join(own, "node", "left").select("node", "parent", (F.coalesce("below", F.lit(0)) + 1).alias("size"))
        out.append(cut(sized))
    return out[::-1]


def preorder(levels: list[DataFrame]) -> DataFrame:
    """node, parent, depth, root, size, pre: numbers from 0 in each tree, a subtree's being consecutive."""
    sized, out = _sizes(levels), []
    for k, level in enumerate(sized):
        if not k:
            placed = level.select("node", "parent", F.lit(0).alias("depth"), F.col("node").alias("root"), "size", F.lit(0).cast("long").alias("pre"))
        else:
            # sizes of smaller siblings: running sums inside a part of the children, and sums of the parts before
            dealt = level.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)))
            inside = F.sum("size").over(Window.partitionBy("parent", "part").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
            parts = dealt.groupBy("parent", "part").agg(F.sum("size").alias("total"))
            earlier = parts.select("parent", "part", F.sum("total").over(Window.partitionBy("parent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
            above = out[-1].select(F.col("node").alias("parent"), "root", F.col("pre").alias("up"))
            pre = F.col("up") + 1 + F.coalesce("inside", F.lit(0)) + F.coalesce("earlier", F.lit(0))
            placed = dealt.withColumn("inside", inside).join(earlier, ["parent", "part"]).join(above, "parent").select("node", "parent", F.lit(k).alias("depth"), "root", "size", pre.alias("pre"))
        out.append(cut(placed))
    drop(*sized)
    whole = cut(_union(out))
    drop(*out)
    return whole


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _reach(tree: DataFrame, others: DataFrame, depth: int) -> DataFrame:
    """node, low, high: least and largest preorder number that a subtree, or an edge outside the forest (u, v) of it, meets."""
    name = lambda c, p: tree.select(F.col("node").alias(c), F.col("pre").alias(p))
    met = others.join(name("v", "other"), "v").groupBy(F.col("u").alias("node")).agg(F.min("other").alias("l"), F.max("other").alias("h"))
    own = cut(tree.join(met, "node", "left").select("node", "parent", "depth", F.least("pre", F.coalesce("l", "pre")).alias("low"), F.greatest("pre", F.coalesce("h", "pre")).alias("high")))
    out: list[DataFrame] = []
    for k in range(depth, -1, -1):
        here = own.where(F.col("depth") == k)
        if out:
            below = out[-1].groupBy(F.col("parent").alias("node")).agg(F.min("low").alias("l"), F.max("high").alias("h"))
            here = here.join(below, "node", "left").select("node", "parent", F.least("low", F.coalesce("l", "low")).alias("low"), F.greatest("high", F.coalesce("h", "high")).alias("high"))
        out.append(cut(here.select("node", "parent", "low", "high")))
    whole = cut(_union(out).select("node", "low", "high"))
    drop(own, *out)
    return whole


def blocks(edges: DataFrame) -> DataFrame:
    """a, b, block_a, block_b: each edge with the smallest edge of its biconnected component."""
    e = cut(edges.select("a", "b"))
    levels = forest(e)
    tree = preorder(levels)
    drop(*levels)
    info = lambda c: tree.select(F.col("node").alias(c), F.col("parent").alias("p" + c), F.col("pre").alias("n" + c), F.col("size").alias("s" + c))
    known = cut(e.join(info("a"), "a").join(info("b"), "b"))
    in_forest = F.coalesce(F.col("pa") == F.col("b"), F.lit(False)) | F.coalesce(F.col("pb") == F.col("a"), F.lit(False))
    others = known.where(~in_forest)
    reach = _reach(tree, both_ways(others), len(levels) - 1)
    # a node stands for the forest edge to its parent
    apart = (F.col("na") + F.col("sa") <= F.col("nb")) | (F.col("nb") + F.col("sb") <= F.col("na"))
    across = others.where(apart).select("a", "b")
    above = tree.select(F.col("node").alias("parent"), F.col("parent").alias("grand"), F.col("pre").alias("from"), (F.col("pre") + F.col("size")).alias("to"))
    along = tree.join(reach, "node").join(above, "parent").where("grand is not null and (low < from or high >= to)").select(F.col("parent").alias("a"), F.col("node").alias("b"))
    linked = across.unionByName(along).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    part = cut(components(linked))
    # the deeper end of a forest edge, and the later end of any other, lies below it
    lower = F.when(F.coalesce(F.col("pb") == F.col("a"), F.lit(False)), F.col("b")).when(F.coalesce(F.col("pa") == F.col("b"), F.lit(False)), F.col("a")).when(F.col("na") < F.col("nb"), F.col("b")).otherwise(F.col("a"))
    named = cut(known.select("a", "b", lower.alias("node")).join(part, "node", "left").select("a", "b", F.coalesce("component", "node").alias("name")))
    first = named.groupBy("name").agg(F.min(F.struct("a", "b")).alias("first"))
    out = cut(named.join(first, "name").select("a", "b", F.col("first.a").alias("block_a"), F.col("first.b").alias("block_b")))
    drop(known, reach, part, named, tree, e)
    return out


def articulation_points(blocks: DataFrame) -> DataFrame:
    """node, blocks: nodes that lie in more than one block, and in how many."""
    ends = blocks.select(F.explode(F.array("a", "b")).alias("node"), "block_a", "block_b").distinct()
    return ends.groupBy("node").agg(F.count("*").alias("blocks")).where("blocks > 1")


def bridges(blocks: DataFrame) -> DataFrame:
    """a, b: edges that are a block of their own."""
    return blocks.groupBy("block_a", "block_b").agg(F.count("*").alias("n")).where("n = 1").select(F.col("block_a").alias("a"), F.col("block_b").alias("b"))
