"""Iterated joins: closures and fixpoints whose lineage is cut in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written where all executors can read it (spark.checkpoint.dir; a folder of our own only where none is set and Spark is local)."""
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.sparkContext.setCheckpointDir(path)
    at = f"{path.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def fixpoint(start: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Semi-naive iteration: step(delta, all) gives new rows; rows already known are taken out; ends when none is new."""
    known = delta = cut(start.distinct())
    while True:
        new = step(delta, known).select(*start.columns).distinct()
        old = known.select(*(F.col(c).alias(f"_old_{c}") for c in start.columns))
        same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in start.columns))
        delta = cut(new.join(old, same, "left_anti"))
        if delta.isEmpty():
            break
        known = cut(known.unionByName(delta))
    return known


def closure(pairs: DataFrame) -> DataFrame:
    """The transitive closure of pairs (a, b)."""

    def step(delta: DataFrame, known: DataFrame) -> DataFrame:
        return delta.join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))

    return fixpoint(pairs.select("a", "b").where("a is not null and b is not null"), step)


def depths(edges: DataFrame) -> DataFrame:
    """node, depth: the longest chain of edges (child, parent) above each node; null for nodes on or below a cycle, which have no longest one."""
    left = cut(edges.select("child", "parent").where("child is not null and parent is not null").distinct())
    nodes = cut(edges.select(F.col("child").alias("node")).union(edges.select(F.col("parent").alias("node"))).where("node is not null").distinct())
    level = cut(nodes.join(left, nodes.node == left.child, "left_anti"))
    best, depth = cut(level.withColumn("depth", F.lit(0))), 0
    while not level.isEmpty():
        # A node follows the last of its parents.
        freed = left.join(level, left.parent == level.node).select(F.col("child").alias("node")).distinct()
        left = cut(left.join(level, left.parent == level.node, "left_anti"))
        level, depth = cut(freed.join(left, freed.node == left.child, "left_anti")), depth + 1
        best = cut(best.unionByName(level.withColumn("depth", F.lit(depth))))
    return nodes.join(best, "node", "left")
