"""Iterated maps: the digraph of a function on numbers, its cycles, and each number's way to one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, drop


def digit_powers(power: int) -> Callable[[Column], Column]:
    """The sum of a number's decimal digits, each to a power."""

    def of(n: Column) -> Column:
        digits = F.transform(F.regexp_extract_all(n.cast("string"), F.lit("[0-9]"), F.lit(0)), lambda d: F.pow(d.cast("double"), power).cast("long"))
        return F.aggregate(digits, F.lit(0).cast("long"), lambda s, x: s + x)

    return of


def collatz(n: Column) -> Column:
    return F.when(n % 2 == 0, F.floor(n / 2)).otherwise(3 * n + 1).cast("long")


def digraph(starts: DataFrame, image: Callable[[Column], Column], most: int = 1000) -> DataFrame:
    """(n) -> n, image: all numbers that iterating the map meets, each once. ValueError after `most` rounds of new ones."""
    new = cut(starts.select(F.col("n").cast("long").alias("n")).distinct())
    out = new.select("n", image(F.col("n")).alias("image"))
    for _ in range(most):
        met = cut(out.select(F.col("image").alias("n")).distinct().join(out.select("n"), "n", "left_anti"))
        if met.isEmpty():
            drop(met)
            return cut(out)
        out = out.unionByName(met.select("n", image(F.col("n")).alias("image")))
    raise ValueError(f"still new numbers after {most} rounds")


def orbits(arcs: DataFrame) -> DataFrame:
    """(n, image), closed under the map -> n, tail, cycle, length: steps to the first number of a cycle, that cycle's
    smallest number, and how many it has.

    Pointer doubling: round k knows where 2**k steps lead. What as many steps as there are numbers lead to lies on a
    cycle; tails are read off from the longest jump to the shortest, as far as a jump still ends outside the cycles.
    """
    jumps = [cut(arcs.select("n", F.col("image").alias("to"), F.least("n", "image").alias("low")))]
    n = jumps[0].count()
    while 1 << (len(jumps) - 1) < n:
        j = jumps[-1]
        ahead = j.select(F.col("n").alias("to"), F.col("to").alias("far"), F.col("low").alias("then"))
        jumps.append(cut(j.join(ahead, "to").select("n", F.col("far").alias("to"), F.least("low", "then").alias("low"))))
    on = cut(jumps[-1].select(F.col("to").alias("n")).distinct())
    # a jump of n steps or more passes the whole cycle of a number on one
    cycles = cut(jumps[-1].join(on, "n", "left_semi").select("n", F.col("low").alias("cycle")))
    sizes = cycles.groupBy("cycle").agg(F.count("*").alias("length"))
    flag = on.withColumn("on", F.lit(True))
    here = cut(arcs.select("n").join(flag, "n", "left").select("n", F.col("n").alias("at"), F.when(F.col("on"), 0).otherwise(1).cast("long").alias("tail")))
    for k in range(len(jumps) - 1, -1, -1):
        ahead = jumps[k].select(F.col("n").alias("at"), "to").join(flag.withColumnRenamed("n", "to"), "to", "left").select("at", "to", "on")
        free = F.col("on").isNull() & (F.col("tail") > 0)  # the jump ends outside the cycles
        moved = cut(here.join(ahead, "at").select("n", F.when(free, F.col("to")).otherwise(F.col("at")).alias("at"), (F.col("tail") + F.when(free, 1 << k).otherwise(0)).alias("tail")))
        drop(here)
        here = moved
    last = here.join(jumps[0].select(F.col("n").alias("at"), "to"), "at").select("n", "tail", F.when(F.col("tail") > 0, F.col("to")).otherwise(F.col("n")).alias("first"))
    out = cut(last.join(cycles.select(F.col("n").alias("first"), "cycle"), "first").join(sizes, "cycle").select("n", "tail", "cycle", "length"))
    drop(here, on, cycles, *jumps)
    return out
