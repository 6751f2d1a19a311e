"""Cutting the lineage of iterative plans with tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that monotonically_increasing_id leaves for a row's place in its partition.
IN_PARTITION = 33


def cut(df: DataFrame) -> DataFrame:
    """df as read back from a table in spark.checkpoint.dir, or in the warehouse where that is unset."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    path = f"{root.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables that cut() made and no later plan reads."""
    for t in tables:
        if t is not None:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(t._cut_path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ranked(df: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """df with each row's place (0-based, long) in the order of keys, which is total. Rows are dealt by ranges of the
    keys and numbered in each; only the number of rows of each partition meets in one place."""
    numbered = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id()))
    part, inside = F.shiftright(name, IN_PARTITION), F.col(name).bitwiseAND((1 << IN_PARTITION) - 1)
    sizes = {r["p"]: r["n"] for r in numbered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    table = df.sparkSession.createDataFrame(starts, "__p long, __first long")
    return numbered.withColumn("__p", part).join(F.broadcast(table), "__p").withColumn(name, F.col("__first") + inside).drop("__p", "__first")
