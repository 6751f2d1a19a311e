"""Graph analytics on undirected edge tables (a < b, and optionally a weight)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v) for either direction of (a, b)."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("n"))


def graphical(sequences: DataFrame) -> DataFrame:
    """(key, degree) -> key, n, total, graphical: whether a simple graph with these degrees exists.

    The total must be even, and for each k the k largest degrees may not exceed k(k - 1) and what the other nodes can
    take, least(degree, k) each (Erdos and Gallai); it is enough to ask where a run of equal degrees ends. A key is
    counted by degree before anything is ordered, so its windows go over distinct degrees only: a total of t has at
    most about the square root of 2t. Negative degrees aren't graphical; null degrees are left out.
    """
    counted = sequences.where("degree is not null").groupBy("key", F.col("degree").cast("long").alias("degree")).agg(F.count("*").alias("n"))
    down = Window.partitionBy("key").orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("key")
    size, mass = F.col("n"), F.col("n") * F.col("degree")
    runs = counted.select("key", "degree", "n", F.sum(size).over(down).alias("k"), F.sum(mass).over(down).alias("top"), F.sum(size).over(every).alias("nodes"), F.sum(mass).over(every).alias("total"), F.min("degree").over(every).alias("lowest"))
    # the degrees below k meet it by one order of both; a k stands before the degree that equals it
    row = lambda at, probe, n, mass: F.struct(at.alias("at"), F.lit(probe).alias("value"), n.alias("n"), mass.alias("mass"))
    none = F.lit(0).cast("long")
    both = runs.withColumn("r", F.explode(F.array(row(F.col("k"), 0, none, none), row(F.col("degree"), 1, size, mass)))).select("key", "k", "top", "nodes", "total", "lowest", "r.*")
    up = Window.partitionBy("key").orderBy("at", "value").rowsBetween(Window.unboundedPreceding, 0)
    below = both.withColumn("low_n", F.sum("n").over(up)).withColumn("low_mass", F.sum("mass").over(up)).where("value = 0")
    high = F.col("nodes") - F.col("low_n")
    others = F.when(F.col("k") <= high, F.col("k") * (high - F.col("k")) + F.col("low_mass")).otherwise(F.col("total") - F.col("top"))
    fits = below.select("key", "nodes", "total", ((F.col("top") <= F.col("k") * (F.col("k") - 1) + others) & (F.col("lowest") >= 0) & (F.col("total") % 2 == 0)).alias("fits"))
    return fits.groupBy("key").agg(F.max("nodes").alias("n"), F.max("total").alias("total"), F.min("fits").alias("graphical"))


def density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes, edges, density = 2m / n(n - 1)."""
    n, m = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    return n.join(F.broadcast(m)).select("nodes", "edges", F.round(F.coalesce(F.try_divide(F.col("edges") * 2.0, F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0)), 9).alias("density"))


def triangles(edges: DataFrame) -> DataFrame:
    """x, y, z of each triangle, once. Edges run from the node of the lower degree (ties: id) to the higher, so no node
    has more than about the square root of 2m edges that begin wedges, however many neighbours a hub has."""
    d = degrees(edges)
    one = lambda c: d.select(F.col("node").alias(c), F.struct("degree", "node").alias("o" + c))
    sized = edges.select("a", "b").join(one("a"), "a").join(one("b"), "b")
    up = F.col("oa") < F.col("ob")
    arcs = cut(sized.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.struct("ob.degree", "b")).otherwise(F.struct("oa.degree", F.col("a").alias("b"))).alias("o")))
    wedges = arcs.select("x", F.col("o").alias("oy")).join(arcs.select("x", F.col("o").alias("oz")), "x").where("oy < oz")
    closed = wedges.select("x", F.col("oy.b").alias("y"), F.col("oz.b").alias("z"))
    return closed.join(arcs.select(F.col("x").alias("y"), F.col("o.b").alias("z")), ["y", "z"], "left_semi").select("x", "y", "z")


def clustering(edges: DataFrame) -> DataFrame:
    """Local clustering coefficient: linked pairs of neighbours by all pairs of neighbours."""
    count = triangles(edges).select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    d, t = F.col("degree"), F.coalesce("triangles", F.lit(0))
    return degrees(edges).join(count, "node", "left").select("node", d, t.alias("triangles"), F.round(F.coalesce(F.try_divide(t * 2.0, d * (d - 1)), F.lit(0.0)), 9).alias("clustering"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): hook to the smallest neighbour, follow hooks, contract, repeat."""
    e, found = cut(edges.select("a", "b").distinct()), None
    while True:
        hook = both_ways(e).groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        hook = cut(hook)
        jumped = cut(hook.join(hook.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p")))
        step = jumped.select(F.col("u").alias("component"), "p")
        found = jumped.select(F.col("u").alias("node"), F.col("p").alias("component")) if found is None else found.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        found = cut(found)
        names = lambda s: jumped.select(F.col("u").alias(s), F.col("p").alias("p" + s))  # noqa: B023, E731
        e = cut(e.join(names("a"), "a").join(names("b"), "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if e.isEmpty():
            return found


def path_lengths(edges: DataFrame, source: int) -> DataFrame:
    """node, distance from one source, by expanding the frontier."""
    ways = cut(both_ways(edges).distinct())
    seen = cut(ways.sparkSession.createDataFrame([(source, 0)], "node long, distance int"))
    frontier, k = seen, 0
    while not frontier.isEmpty():
        k += 1
        frontier = cut(frontier.join(ways, frontier.node == ways.u).select(F.col("v").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("distance", F.lit(k)))
        seen = seen.unionByName(frontier)
    return seen


def ego(links: DataFrame, node: str) -> DataFrame:
    """The neighbours of a node in links (source, target, value), with the value of the link."""
    out = links.where(F.col("source") == node).select(F.col("target").alias("neighbour"), "value")
    return out.unionByName(links.where(F.col("target") == node).select(F.col("source").alias("neighbour"), "value"))


def opacity(nodes: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """id, opacity: 1 for the node and its neighbours, 0.2 for all others."""
    near = ego(links, node).select(F.col("neighbour").alias("id")).distinct().withColumn("near", F.lit(True))
    return nodes.select("id").join(near, "id", "left").select("id", F.when(F.col("near") | (F.col("id") == node), 1.0).otherwise(0.2).alias("opacity"))


def projection(pairs: DataFrame) -> DataFrame:
    """(left, right) memberships -> left nodes that share right ones: a < b, weight."""
    p = pairs.select("left", "right").distinct()
    return p.select(F.col("left").alias("a"), "right").join(p.select(F.col("left").alias("b"), "right"), "right").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


#: Members of a right node that one row carries.
SLICE = 1024


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def _best_of(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (u, others) sorted by u -> u, v, weight, k: the `most` values that a u meets most often in its lists."""

    def ranked(us: np.ndarray, vs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Different (u, v) in order, with their counts."""
        starts = np.flatnonzero(np.r_[True, us[1:] != us[:-1]])
        sizes, n, out = np.diff(np.r_[starts, len(us)]), n.copy(), []
        for k in range(1, most + 1):
            top = np.maximum.reduceat(n, starts)
            at = np.flatnonzero(n == np.repeat(top, sizes))
            at = at[np.searchsorted(at, starts)][top > 0]  # the first of a u's equal ones is the smallest v
            out.append((us[at], vs[at], n[at], np.full(len(at), k, np.int32)))
            n[at] = 0
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["u", "v", "weight", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for us, vs, n in _counted(batches):
            yield ranked(us, vs, n)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[Counts]:
    """Batches of (u, others) sorted by u -> different (u, v) in order, with their counts; a u isn't divided."""

    def counted(us: np.ndarray, vs: np.ndarray, n: np.ndarray) -> Counts:
        order = np.lexsort((vs, us))
        us, vs, n = us[order], vs[order], n[order]
        starts = np.flatnonzero(np.r_[True, (us[1:] != us[:-1]) | (vs[1:] != vs[:-1])])
        return us[starts], vs[starts], np.add.reduceat(n, starts)

    def met(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different (u, v) of a batch, with their counts."""
        own, lists = batch.column(0).to_numpy(), batch.column(1)
        vs, place = lists.flatten().to_numpy(), np.repeat(np.cumsum(np.r_[0, own[1:] != own[:-1]]), lists.value_lengths().to_numpy())
        names = own[np.r_[True, own[1:] != own[:-1]]]
        other = vs != names[place]
        vs, place = vs[other], place[other]
        if not len(vs):
            return place, vs, place
        low, span = int(vs.min()), int(vs.max()) - int(vs.min()) + 1
        if len(names) * span >= 1 << 62:
            return counted(names[place], vs, np.ones(len(vs), np.int64))
        keys = np.sort(place * span + (vs - low))  # one number for both
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return names[keys[starts] // span], keys[starts] % span + low, np.diff(np.r_[starts, len(keys)])

    held = None  # what is counted of a u that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        now = met(batch)
        if not len(now[0]):
            continue
        if held is not None and held[0][0] != now[0][0]:
            yield held
        elif held is not None:
            now = counted(*(np.concatenate(c) for c in zip(held, now, strict=True)))
        last = np.searchsorted(now[0], now[0][-1])
        if last:
            yield tuple(c[:last] for c in now)
        held = tuple(c[last:] for c in now)
    if held is not None:
        yield held


#: Edges that a task collects before those that close a circle go, and edges of its forest from which on it begins another.
GATHERED = 4_000_000
KEPT = 2_000_000


def _forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The places of the edges of the minimum spanning forest, ties by ends, in order: each part joins by its first edge."""
    order = np.lexsort((b, a, weight))
    names, at = np.unique(np.r_[a[order], b[order]], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    left, part, chosen = np.arange(len(a)), np.arange(len(names)), [np.zeros(0, np.int64)]
    while len(left):
        first = np.full(len(names), len(a))
        first[x[left[::-1]]] = left[::-1]  # the last that is written is the first edge
        second = np.full(len(names), len(a))
        second[y[left[::-1]]] = left[::-1]
        first = np.minimum(first, second)
        roots = np.flatnonzero(first < len(a))
        best = first[roots]
        to = np.arange(len(names))
        to[roots] = x[best] + y[best] - roots
        back = (to[to] == np.arange(len(names))) & (to > np.arange(len(names)))  # both chose one edge: the smaller is the root
        to[back] = np.flatnonzero(back)
        while (to[to] != to).any():
            to = to[to]
        chosen.append(np.unique(best))
        part = to
        x, y = part[x], part[y]
        left = left[x[left] != y[left]]
    return order[np.sort(np.concatenate(chosen))]


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (u, others) sorted by u -> a, b, weight: the pairs, less those that are the last of a circle of the task's."""
    kept, size = [], 0
    for now in chain(_counted(batches), [None]):
        if now is not None:
            kept.append(now)
            size += len(now[0])
        if kept and (now is None or size > GATHERED):
            a, b, weight = (np.concatenate(c) for c in zip(*kept, strict=True))
            at = _forest(a, b, weight)
            kept, size = [(a[at], b[at], weight[at])], len(at)
            if now is None or size > KEPT:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept[0]], ["a", "b", "weight"])
                kept, size = [], 0


def light_projection(pairs: DataFrame) -> DataFrame:
    """(left, right) memberships, numbered -> a < b, weight: edges of projection(), among which are all of its minimum
    spanning forest (ties by ends). The last edge of a circle is in none, so a task that counts the pairs of its left nodes
    keeps a forest of them; the projection is neither shuffled nor held."""
    return _lists(pairs, after=True).mapInArrow(_light, "a long, b long, weight long")


def partners(pairs: DataFrame, most: int) -> DataFrame:
    """(left, right) memberships, numbered -> u, v, weight, k: the `most` other left nodes with whom a left node u shares
    most right ones (ties: smallest), k from 1 on.

    Each left node gets the members of its right ones, sorted by node, and counts them in its task, so the pairs of
    projection() are neither shuffled nor held. Members of one right node go in slices of up to SLICE.
    """
    return _lists(pairs).mapInArrow(_best_of(most), "u long, v long, weight long, k int")


def _lists(pairs: DataFrame, after: bool = False) -> DataFrame:
    """u, some: the members of each right node of u, or those after u only, sorted by u."""
    members = pairs.select(F.col("left").cast("long").alias("left"), "right").where("left is not null and right is not null").groupBy("right").agg(F.collect_set("left").alias("others"))
    if after:
        mine = members.where(F.size("others") > 1).select(F.posexplode(F.array_sort("others")).alias("i", "u"), F.array_sort("others").alias("others"))
        rest = mine.where(F.col("i") < F.size("others") - 1).select("u", F.slice("others", F.col("i") + 2, F.size("others")).alias("rest"))
        starts = F.sequence(F.lit(1), F.size("rest"), F.lit(SLICE))
        return rest.select("u", F.explode(F.transform(starts, lambda i: F.slice("rest", i, SLICE))).alias("some")).repartition("u").sortWithinPartitions("u")
    starts = F.sequence(F.lit(1), F.size("others"), F.lit(SLICE))
    slices = F.when(F.size("others") <= SLICE, F.array("others")).otherwise(F.transform(starts, lambda i: F.slice("others", i, SLICE)))
    lists = members.where(F.size("others") > 1).select("others", F.explode(slices).alias("some")).select(F.explode("others").alias("u"), "some")
    return lists.repartition("u").sortWithinPartitions("u")


def boundary(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Nodes outside a set (column node) with a neighbour in it."""
    w = both_ways(edges)
    return w.join(inside.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("v").alias("node")).distinct().join(inside, "node", "left_anti")


def induced(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Edges with both ends in a set."""
    return edges.join(inside.select(F.col("node").alias("a")), "a", "left_semi").join(inside.select(F.col("node").alias("b")), "b", "left_semi")


def complement_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degrees in the complement graph: n - 1 - degree; the complement itself is never made."""
    n = F.broadcast(nodes.agg(F.count("*").alias("n")))
    return nodes.select("node").join(degrees(edges), "node", "left").join(n).select("node", (F.col("n") - 1 - F.coalesce("degree", F.lit(0))).alias("degree"))


def word_graph(words: DataFrame) -> DataFrame:
    """(word) -> pairs a < b that differ in one letter: words meet by their patterns with one letter left out."""
    w = words.select("word").distinct()
    keyed = w.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")).select("word", F.concat_ws("|", F.col("i").cast("string"), F.expr("overlay(word placing '_' from i for 1)")).alias("k"))
    return keyed.select(F.col("word").alias("a"), "k").join(keyed.select(F.col("word").alias("b"), "k"), "k").where("a < b").select("a", "b").distinct()


def generations(arcs: DataFrame) -> DataFrame:
    """(a -> b) of an acyclic graph -> node, generation, by peeling nodes without incoming arcs. Cycles raise ValueError."""
    left = cut(arcs.select("a", "b").distinct())
    nodes = cut(left.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    out, k = None, 0
    while not nodes.isEmpty():
        top = cut(nodes.join(left.select(F.col("b").alias("node")), "node", "left_anti"))
        if top.isEmpty():
            raise ValueError("the graph has a cycle")
        rows = top.withColumn("generation", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
        nodes, left, k = cut(nodes.join(top, "node", "left_anti")), cut(left.join(top.select(F.col("node").alias("a")), "a", "left_anti")), k + 1
    return out if out is not None else nodes.withColumn("generation", F.lit(0))


def weight_split(edges: DataFrame, at: float) -> DataFrame:
    """a, b, weight, heavy: whether the weight is above `at`."""
    return edges.withColumn("heavy", F.col("weight") > at)


def component_sizes(edges: DataFrame) -> DataFrame:
    """component, n, largest: sizes of the components, and which is the largest (the smallest name of equal ones)."""
    sizes = components(edges).groupBy("component").agg(F.count("*").alias("n"))
    best = F.broadcast(sizes.agg(F.max_by("component", F.struct("n", (-F.col("component")).alias("o"))).alias("best")))
    return sizes.join(best).select("component", "n", (F.col("component") == F.col("best")).alias("largest"))


def hub(edges: DataFrame) -> DataFrame:
    """The node of the highest degree, the smallest of equal ones."""
    return degrees(edges).agg(F.max_by("node", F.struct("degree", (-F.col("node")).alias("o"))).alias("node"), F.max("degree").alias("degree"))


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: the modularity of a partition (node, part)."""
    part = lambda c: groups.select(F.col("node").alias(c), F.col("part").alias("p" + c))
    inside = edges.join(part("a"), "a").join(part("b"), "b").where("pa = pb").groupBy(F.col("pa").alias("part")).agg(F.count("*").alias("l"))
    total = F.broadcast(edges.agg(F.count("*").alias("m")))
    ends = degrees(edges).join(groups, "node").groupBy("part").agg(F.sum("degree").alias("d"))
    term = F.coalesce("l", F.lit(0)) / F.col("m") - (F.col("d") / (2.0 * F.col("m"))) * (F.col("d") / (2.0 * F.col("m")))
    return ends.join(inside, "part", "left").join(total).agg(F.round(F.sum(term), 6).alias("modularity"))


def same_label(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges whose ends have one label (node, label)."""
    one = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias("l" + c))
    return edges.join(one("a"), "a").join(one("b"), "b").where("la = lb").select("a", "b")


def quotient(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b, n: the edges between parts (node, part), the smaller part first; edges within a part too."""
    one = lambda c: groups.select(F.col("node").alias(c), F.col("part").alias("p" + c))
    ends = edges.join(one("a"), "a").join(one("b"), "b")
    return ends.groupBy(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).agg(F.count("*").alias("n"))


def multiplicity(edges: DataFrame) -> DataFrame:
    """a, b, n of a multigraph: parallel edges counted, whichever way they run."""
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))


def digit_squares(numbers: DataFrame) -> DataFrame:
    """n, image, fixed: the sum of the squares of n's decimal digits, and whether it is n."""
    digits = F.transform(F.regexp_extract_all(F.col("n").cast("string"), F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("long") * d.cast("long"))
    image = F.aggregate(digits, F.lit(0).cast("long"), lambda s, x: s + x)
    return numbers.select("n", image.alias("image")).withColumn("fixed", F.col("n") == F.col("image"))


def circular_distance(edges: DataFrame, size: int) -> DataFrame:
    """a, b, distance: steps between the ends on a circle of `size` nodes."""
    d = F.pmod(F.abs(F.col("a") - F.col("b")), F.lit(size))
    return edges.select("a", "b", F.least(d, F.lit(size) - d).alias("distance"))


def nearest(points: DataFrame, x: float, y: float) -> DataFrame:
    """The node (node, x, y) nearest to a point, the smallest of equal ones."""
    d = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return points.agg(F.min_by("node", F.struct(d, "node")).alias("node"))


def distances_from_nearest(edges: DataFrame, points: DataFrame, x: float, y: float) -> DataFrame:
    """node, distance: steps from the node nearest to a point, for colouring."""
    return path_lengths(edges, nearest(points, x, y).first()["node"])


def closer_than(edges: DataFrame, nodes: DataFrame, limit: float) -> DataFrame:
    """node, degree in the graph of all nodes and the edges of a weight below `limit`."""
    return nodes.select("node").join(degrees(edges.where(F.col("weight") < limit)), "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def removed(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """The edges that a graph lacks."""
    return edges.select("a", "b").join(kept.select("a", "b"), ["a", "b"], "left_anti")


def compose(*graphs: DataFrame) -> DataFrame:
    """All edges of several graphs, once."""
    out = graphs[0].select("a", "b")
    for g in graphs[1:]:
        out = out.unionByName(g.select("a", "b"))
    return out.distinct()


def label_subgraphs(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label, component: the connected parts that are left when edges between labels (node, label) go."""
    part = components(same_label(edges, labels))
    return labels.join(part, "node", "left").select("node", "label", F.coalesce("component", "node").alias("component"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """node, label after so many rounds: each node takes the most frequent label of its neighbours, the smallest of equal ones."""
    both = cut(both_ways(edges))
    now = cut(both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(rounds):
        votes = both.join(now.withColumnRenamed("node", "v"), "v").groupBy("u", "label").agg(F.count("*").alias("n"))
        now = cut(votes.groupBy(F.col("u").alias("node")).agg(F.max_by("label", F.struct("n", (-F.col("label")).alias("o"))).alias("label")))
    return now


def eigenvector(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, centrality by power iteration of the adjacency and the identity, of length 1."""
    both = cut(both_ways(edges))
    now = cut(both.select(F.col("u").alias("node")).distinct().withColumn("x", F.lit(1.0)))
    for _ in range(rounds):
        got = both.join(now.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("x").alias("s"))
        new = now.join(got, "node").select("node", (F.col("x") + F.col("s")).alias("x"))
        norm = F.broadcast(new.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")))
        now = cut(new.join(norm).select("node", (F.col("x") / F.col("norm")).alias("x")))
    return now.select("node", F.round("x", 6).alias("centrality"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """a, b, weight of a minimum spanning forest: each round joins every part to another by its lightest edge; ties go by ends."""
    left = cut(edges.select("a", "b", "weight", F.col("a").alias("pa"), F.col("b").alias("pb")))
    chosen = None
    while not left.isEmpty():
        ways = left.select("pa", "a", "b", "weight").unionByName(left.select(F.col("pb").alias("pa"), "a", "b", "weight"))
        best = ways.groupBy("pa").agg(F.min(F.struct("weight", "a", "b")).alias("e")).select("e.a", "e.b", "e.weight").distinct()
        chosen = cut(best if chosen is None else chosen.unionByName(best).distinct())
        part = cut(components(chosen.select("a", "b")))
        one = lambda c: part.select(F.col("node").alias(c), F.col("component").alias("p" + c))  # noqa: B023, E731
        left = cut(left.select("a", "b", "weight").join(one("a"), "a", "left").join(one("b"), "b", "left").select("a", "b", "weight", F.coalesce("pa", "a").alias("pa"), F.coalesce("pb", "b").alias("pb")).where("pa <> pb"))
    return chosen if chosen is not None else edges.select("a", "b", "weight")


def path_between(edges: DataFrame, source: int, target: int) -> DataFrame:
    """step, node of a shortest path, by smallest predecessors; no rows where there is none."""
    far = cut(path_lengths(edges, source))
    back = both_ways(edges).join(far.select(F.col("node").alias("u"), F.col("distance").alias("d")), "u")
    before = cut(back.join(far.select(F.col("node").alias("v"), F.col("distance").alias("dv")), "v").where("d = dv - 1").groupBy("v").agg(F.min("u").alias("u")))
    here = far.where(F.col("node") == target).select(F.col("distance").cast("int").alias("step"), "node")
    out = here = cut(here)
    while not here.isEmpty():
        here = cut(here.join(before, F.col("node") == F.col("v")).select((F.col("step") - 1).alias("step"), F.col("u").alias("node")))
        out = out.unionByName(here)
    return out
