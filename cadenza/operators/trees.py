"""Prefix trees of words, and acyclic graphs unfolded into trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, drop


def node_name(prefix: str):
    """128 bits that stand for a prefix."""
    return F.substring(F.sha2(F.col(prefix), 256), 1, 32)


def prefix_tree(words: DataFrame) -> DataFrame:
    """(word) -> node, parent, symbol, depth, words, is_word: the nodes of the tree of all different words but its root.

    A node is named by a hash of its prefix, its parent by that of the prefix less a symbol (the root's is that of the
    empty one); words counts those in its subtree. Each word gives a row for each of its prefixes, which are combined
    before and after the shuffle.
    """
    w = words.select("word").where(F.length("word") > 0).distinct()
    each = w.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("depth"))
    prefix = each.select(F.substring("word", F.lit(1), F.col("depth")).alias("prefix"), "depth", (F.length("word") == F.col("depth")).alias("ends"))
    nodes = prefix.groupBy("prefix", "depth").agg(F.count("*").alias("words"), F.max("ends").alias("is_word"))
    above = nodes.withColumn("above", F.substring("prefix", F.lit(1), F.col("depth") - 1))
    return above.select(node_name("prefix").alias("node"), node_name("above").alias("parent"), F.substring("prefix", -1, 1).alias("symbol"), "depth", "words", "is_word")


def root_paths(tree: DataFrame) -> DataFrame:
    """node, path: the symbols from the root to each node. Each round doubles how far up a node has read."""
    known = cut(tree.select("node", F.col("parent").alias("up"), F.col("symbol").alias("path")))
    while True:
        above = known.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"))
        met = cut(known.join(above, "up", "left").select("node", F.coalesce("next", "up").alias("up"), F.concat(F.coalesce("before", F.lit("")), F.col("path")).alias("path"), F.col("next").isNotNull().alias("moved")))
        drop(known)
        known = met
        if known.where("moved").isEmpty():
            return known.select("node", "path")
        known = met.drop("moved")
        known._cut_path = met._cut_path


def path_counts(arcs: DataFrame) -> DataFrame:
    """(a -> b) of an acyclic graph -> node, copies: paths that lead from sources (nodes without incoming arcs) to it.

    Counts run from the sources on, a level of paths of equal length at a time; a cycle raises ValueError.
    """
    e = cut(arcs.select("a", "b").distinct())
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    n = nodes.count()
    here = cut(nodes.join(e.select(F.col("b").alias("node")), "node", "left_anti").withColumn("paths", F.lit(1).cast("decimal(38,0)")))
    levels = []
    while not here.isEmpty():
        levels.append(here)
        if len(levels) > n:
            raise ValueError("the graph has a cycle")
        here = cut(here.withColumnRenamed("node", "a").join(e, "a").groupBy(F.col("b").alias("node")).agg(F.sum("paths").cast("decimal(38,0)").alias("paths")))
    if not levels and n:
        raise ValueError("the graph has a cycle")
    drop(here)
    out = levels[0] if levels else nodes.withColumn("paths", F.lit(0).cast("decimal(38,0)"))
    for level in levels[1:]:
        out = out.unionByName(level)
    total = cut(out.groupBy("node").agg(F.sum("paths").cast("decimal(38,0)").alias("copies")))
    reached = total.count()
    drop(*levels)
    if reached < n:
        raise ValueError("the graph has a cycle")
    return total


def branching(arcs: DataFrame, most: int | None = None) -> DataFrame:
    """(a -> b) of an acyclic graph -> copy, parent, node, depth: a forest in which a node has a copy for each path that
    leads to it from a source. A copy is named by its path; parent is null at the roots.

    More than `most` copies in all, where it is given, raise ValueError, before any is made.
    """
    copies = path_counts(arcs)
    total = copies.agg(F.sum("copies")).first()[0] or 0
    if most is not None and total > most:
        raise ValueError(f"{total} copies, more than {most}")
    e = cut(arcs.select(F.col("a").alias("node"), "b").distinct())
    roots = copies.select("node").join(e.select(F.col("b").alias("node")), "node", "left_anti")
    here = cut(roots.select(F.col("node").cast("string").alias("copy"), F.lit(None).cast("string").alias("parent"), "node", F.lit(0).alias("depth")))
    out, depth = here, 0
    while not here.isEmpty():
        depth += 1
        here = cut(here.select(F.col("copy").alias("parent"), "node").join(e, "node").select(F.concat("parent", F.lit(">"), F.col("b").cast("string")).alias("copy"), "parent", F.col("b").alias("node"), F.lit(depth).alias("depth")))
        out = out.unionByName(here)
    drop(e, copies)
    return out


def formulas(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """copy, formula of each root of branching(): labels (node, label), with the children's formulas, sorted, after a
    label of one child and around the label of several."""
    named = cut(tree.join(labels, "node").select("copy", "parent", "depth", "label"))
    deepest = named.agg(F.max("depth")).first()[0]
    below = None
    for k in range(deepest if deepest is not None else -1, -1, -1):
        here = named.where(F.col("depth") == k)
        if below is None:
            here = here.withColumn("formula", F.col("label"))
        else:
            kids = below.groupBy(F.col("parent").alias("copy")).agg(F.array_sort(F.collect_list("formula")).alias("parts"))  # operands of one operator
            text = F.when(F.col("parts").isNull(), F.col("label")).when(F.size("parts") == 1, F.concat("label", F.lit("("), F.element_at("parts", 1), F.lit(")")))
            several = F.concat(F.lit("("), F.array_join(F.transform("parts", lambda p, i: F.when(i > 0, F.concat(F.lit(" "), F.col("label"), F.lit(" "), p)).otherwise(p)), ""), F.lit(")"))
            here = here.join(kids, "copy", "left").withColumn("formula", text.otherwise(several))
        below = cut(here.select("copy", "parent", "formula"))
    return below.select("copy", "formula") if below is not None else named.select("copy", F.col("label").alias("formula"))
