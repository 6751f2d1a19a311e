"""The triad census of directed graphs: how many of all triples of nodes are of each of the 16 kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut
from .graph import triangles

#: The kinds, with their one-way and mutual pairs.
KINDS = {
    "003": (0, 0), "012": (1, 0), "102": (0, 1), "021D": (2, 0), "021U": (2, 0), "021C": (2, 0), "111D": (1, 1), "111U": (1, 1),
    "030T": (3, 0), "030C": (3, 0), "201": (0, 2), "120D": (2, 1), "120U": (2, 1), "120C": (2, 1), "210": (1, 2), "300": (0, 3),
}
#: A pair seen from one end: the arc goes out, comes in, or both.
OUT, IN, BOTH = 1, 2, 3


def dyads(arcs: DataFrame) -> DataFrame:
    """a < b, code: which arcs join them, seen from a. Loops and repeated arcs don't count."""
    up = F.col("a") < F.col("b")
    pairs = arcs.where("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.when(up, OUT).otherwise(IN).alias("code"))
    return pairs.groupBy("x", "y").agg(F.bit_or("code").cast("int").alias("code")).select(F.col("x").alias("a"), F.col("y").alias("b"), "code")


def seen_from(code: Column, other_end: Column) -> Column:
    """A pair's code from its other end, where that is asked for."""
    return F.when(other_end & (code < BOTH), 3 - code).otherwise(code)


def _wedge(p: Column, q: Column) -> Column:
    """The kind of two pairs, seen from the node that they share, if the third pair has no arc."""
    low, high = F.least(p, q), F.greatest(p, q)
    kinds = {(OUT, OUT): "021D", (IN, IN): "021U", (OUT, IN): "021C", (IN, BOTH): "111D", (OUT, BOTH): "111U", (BOTH, BOTH): "201"}
    out = F.lit(None).cast("string")
    for (x, y), kind in kinds.items():
        out = F.when((low == x) & (high == y), kind).otherwise(out)
    return out


def census(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """kind, n for all 16 kinds over all triples of nodes (column node, every end of an arc among them).

    Pairs of arcs at a node are counted from its numbers of outgoing, incoming and mutual partners and never listed;
    those that the third pair closes are found from degree-ordered triangles and taken off; triples with one pair or
    none follow by subtraction.
    """
    d = cut(dyads(arcs))
    ends = d.select("a", "code").unionByName(d.select(F.col("b").alias("a"), seen_from(F.col("code"), F.lit(True)).alias("code")))
    count = lambda c: F.count_if(F.col("code") == c).cast("decimal(38,0)")
    o, i, m = (F.col(c) for c in "oim")
    two = lambda c: c * (c - 1) / 2
    at = ends.groupBy("a").agg(count(OUT).alias("o"), count(IN).alias("i"), count(BOTH).alias("m"))
    pairs = {"021D": two(o), "021U": two(i), "021C": o * i, "111D": m * i, "111U": m * o, "201": two(m)}
    wedges = at.agg(*(F.sum(v).alias(k) for k, v in pairs.items())).first()

    found = triangles(d.select("a", "b"))
    for p, q in (("x", "y"), ("y", "z"), ("x", "z")):
        pair = d.select(F.col("a").alias("low"), F.col("b").alias("high"), F.col("code").alias("c"))
        met = found.withColumn("low", F.least(p, q)).withColumn("high", F.greatest(p, q)).join(pair, ["low", "high"])
        found = met.withColumn(p + q, seen_from(F.col("c"), F.col(p) > F.col(q))).drop("low", "high", "c")
    xy, yz, xz = F.col("xy"), F.col("yz"), F.col("xz")
    flip = lambda c: seen_from(c, F.lit(True))
    corners = [(xy, xz), (flip(xy), yz), (flip(xz), flip(yz))]
    mutual = sum(((c == BOTH).cast("int") for c in (xy, yz, xz)), F.lit(0))
    goes = lambda c: c.bitwiseAND(OUT)
    comes = lambda c: F.shiftright(c, 1)
    outs = [goes(p) + goes(q) for p, q in corners]
    least_out, least_in, most_out = F.least(*outs), F.least(*(comes(p) + comes(q) for p, q in corners)), F.greatest(*outs)
    one = F.when(least_in == 0, "120D").when(least_out == 0, "120U").otherwise("120C")
    kind = F.when(mutual == 3, "300").when(mutual == 2, "210").when(mutual == 1, one).when(most_out == 2, "030T").otherwise("030C")
    sums = found.groupBy(kind.alias("kind"), *(_wedge(p, q).alias(f"w{k}") for k, (p, q) in enumerate(corners))).agg(F.count("*").alias("n")).collect()  # 7 kinds, 6 wedges a corner

    n = nodes.select("node").distinct().count()
    total = dict.fromkeys(KINDS, 0) | {k: int(wedges[k] or 0) for k in pairs}
    for r in sums:
        total[r["kind"]] += r["n"]
        for k in range(3):
            total[r[f"w{k}"]] -= r["n"]
    joined = d.agg(F.count_if(F.col("code") < BOTH).alias("one"), F.count_if(F.col("code") == BOTH).alias("both")).first()
    for k, which in (("012", 0), ("102", 1)):
        total[k] = joined[which] * (n - 2) - sum(v * KINDS[kind][which] for kind, v in total.items())
    total["003"] = n * (n - 1) * (n - 2) // 6 - sum(total.values())
    return arcs.sparkSession.createDataFrame([(k, total[k]) for k in KINDS], "kind string, n long")
