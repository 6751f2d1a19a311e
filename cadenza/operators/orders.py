"""Orders and selections of nodes of undirected edge tables (a < b, no loops or repeats)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut, drop, ranked
from .graph import both_ways, components, degrees


def _depths(ways: DataFrame, starts: DataFrame) -> list[DataFrame]:
    """(component, node) by distance from each component's start."""
    found = [cut(starts)]
    while True:
        met = found[-1].join(ways, F.col("node") == F.col("u")).select("component", F.col("v").alias("node")).distinct()
        for seen in found[-2:]:
            met = met.join(seen.select("node"), "node", "left_anti")
        met = cut(met.select("component", "node"))
        if met.isEmpty():
            drop(met)
            return found
        found.append(met)


def far_ends(edges: DataFrame, part: DataFrame) -> DataFrame:
    """component, node: a node at the end of a long shortest path of each component (node, component).

    From the smallest node on, each round goes to a farthest node, of the lowest degree (ties: smallest), as long as
    that makes the component's search deeper.
    """
    ways, d = cut(both_ways(edges)), cut(degrees(edges))
    best = cut(part.select("component").distinct().select("component", F.col("component").alias("node"), F.lit(0).alias("depth")))
    moving = best
    while True:
        found = _depths(ways, moving.select("component", "node"))
        last = None
        for k, level in enumerate(found):
            row = level.join(d, "node").groupBy("component").agg(F.min(F.struct("degree", "node")).alias("end")).withColumn("reach", F.lit(k))
            last = row if last is None else last.unionByName(row)
        deepest = last.groupBy("component").agg(F.max_by("end", "reach").alias("end"), F.max("reach").alias("reach"))
        moved = cut(deepest.join(moving.select("component", "depth"), "component").where("reach > depth").select("component", F.col("end.node").alias("node"), F.col("reach").alias("depth")))
        drop(*found)
        if moved.isEmpty():
            drop(moved, ways, d)
            return best.select("component", "node")
        best = cut(moved.unionByName(best.join(moved, "component", "left_anti")))
        moving = moved


def reverse_cuthill_mckee(edges: DataFrame) -> DataFrame:
    """node, place: 0-based, components by their smallest node; in each, breadth-first from far_ends() with neighbours by
    degree (ties: id), the other way round.

    A level is ordered by the first place among a node's neighbours of the level before, then its degree, then its id.
    """
    part = cut(components(edges))
    ways, d = cut(both_ways(edges)), cut(degrees(edges))
    level = cut(far_ends(edges, part).withColumn("at", F.lit(0).cast("long")))
    placed, seen, k = level.withColumn("level", F.lit(0)), [level], 0
    while True:
        met = seen[-1].join(ways, F.col("node") == F.col("u")).groupBy("component", F.col("v").alias("node")).agg(F.min("at").alias("before"))
        for s in seen[-2:]:
            met = met.join(s.select("node"), "node", "left_anti")
        met = cut(met.join(d, "node"))
        if met.isEmpty():
            break
        k += 1
        seen.append(cut(ranked(met, ["component", "before", "degree", "node"], "at").select("component", "node", "at")))
        drop(met)
        placed = placed.unionByName(seen[-1].withColumn("level", F.lit(k)))
    out = cut(ranked(placed, ["component", F.desc("level"), F.desc("at")], "place").select("node", "place"))
    drop(part, ways, d, *seen)
    return out


def bandwidth(edges: DataFrame, order: DataFrame) -> DataFrame:
    """One row: the bandwidth of the Laplacian (both sides of the diagonal and itself) in an order (node, place)."""
    one = lambda c: order.select(F.col("node").alias(c), F.col("place").alias("p" + c))
    return edges.join(one("a"), "a").join(one("b"), "b").agg((F.coalesce(F.max(F.abs(F.col("pa") - F.col("pb"))), F.lit(0)) * 2 + 1).alias("bandwidth"))


def independent_set(edges: DataFrame, nodes: DataFrame, seed: int = 0) -> DataFrame:
    """node: a maximal set of nodes without an edge between two, by rounds: a node whose keyed hash is less than those of
    all neighbours that are left joins, and its neighbours go. Which nodes it has follows from the seed alone."""
    key = F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col("node").cast("string"))).alias("h"), F.col("node").alias("n"))
    left = cut(nodes.select("node").distinct().withColumn("key", key))
    ways = cut(both_ways(edges))
    out = None
    while not left.isEmpty():
        near = ways.join(left.select(F.col("node").alias("v"), F.col("key").alias("other")), "v").groupBy(F.col("u").alias("node")).agg(F.min("other").alias("least"))
        taken = cut(left.join(near, "node", "left").where("least is null or key < least").select("node"))
        out = taken if out is None else out.unionByName(taken)
        gone = taken.unionByName(ways.join(taken.withColumnRenamed("node", "u"), "u", "left_semi").select(F.col("v").alias("node"))).distinct()
        old, old_ways = left, ways
        left = cut(left.join(gone, "node", "left_anti"))
        ways = cut(ways.join(left.select(F.col("node").alias("u")), "u", "left_semi").join(left.select(F.col("node").alias("v")), "v", "left_semi"))
        drop(old, old_ways)
    return out if out is not None else left.select("node")


def beam_search(edges: DataFrame, values: DataFrame, source: int, width: int, per_level: bool = False) -> DataFrame:
    """step, node: breadth-first from the source, along the edges to each node's `width` best neighbours by (node, value),
    higher first (ties: smallest); with `per_level` keeping the `width` best new nodes of each level instead."""
    ways = both_ways(edges).join(values.select(F.col("node").alias("v"), "value"), "v")
    if not per_level:  # Spark keeps the best of each task before it shuffles
        ways = ways.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("value"), "v"))).where(F.col("k") <= width)
    ways = cut(ways.select("u", "v", "value"))
    here = cut(values.where(F.col("node") == source).select(F.lit(0).alias("step"), "node"))
    seen, step = here, 0
    while not here.isEmpty():
        step += 1
        met = here.join(ways, F.col("node") == F.col("u")).select(F.col("v").alias("n"), "value").distinct().join(seen.select(F.col("node").alias("n")), "n", "left_anti")
        best = met.orderBy(F.desc("value"), "n").limit(width) if per_level else met
        here = cut(best.select(F.lit(step).alias("step"), F.col("n").alias("node")))
        seen = seen.unionByName(here)
    drop(ways)
    return seen


def widening_search(edges: DataFrame, values: DataFrame, source: int, least: float, width: int = 1, per_level: bool = False) -> DataFrame:
    """One row (width, step, node, value): the first node whose value is at least `least`, by beam searches of doubled
    width until one finds it; the earliest step, then the highest value, then the smallest node. A width as large as the
    graph searches all of it, so no row means that no node that can be reached is good enough."""
    n = values.count()
    while True:
        found = beam_search(edges, values, source, width, per_level).join(values, "node").where(F.col("value") >= least)
        row = cut(found.orderBy("step", F.desc("value"), "node").limit(1).select(F.lit(width).cast("long").alias("width"), "step", "node", "value"))
        if width >= n or not row.isEmpty():
            return row
        width *= 2
