"""Graph and feature operators over triples: partitioning, indexing, paths, ranking, similarity, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import cut
from .pairs import pairs, shares


def find(t: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            t = t.where(F.col(name) == value)
    return t


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(*a.columns))


def property_table(t: DataFrame, predicates: list[str]) -> DataFrame:
    """One wide row a subject, an array of values for each predicate."""
    return t.where(F.col("p").isin(*predicates)).groupBy("s").pivot("p", predicates).agg(F.sort_array(F.collect_set("o")))


def semantic_partition(t: DataFrame) -> DataFrame:
    return t.groupBy("s").agg(F.sort_array(F.collect_set(F.struct("p", "o"))).alias("edges"))


def write_vertical(t: DataFrame, path: str) -> None:
    """One directory a predicate in a single pass; readers prune to the predicates they ask for."""
    t.withColumn("predicate", F.col("p")).write.partitionBy("predicate").parquet(path)


def dictionary(terms: DataFrame, column: str) -> DataFrame:
    """Terms with dense ids in order of fall in frequency, without a global sort in one task: counts by range partition give each its offset."""
    counts = cut(terms.groupBy(F.col(column).alias("term")).agg(F.count("*").alias("n")).repartitionByRange(F.desc("n"), "term").sortWithinPartitions(F.desc("n"), "term").withColumn("part", F.spark_partition_id()))
    offsets = counts.groupBy("part").agg(F.count("*").alias("size")).withColumn("before", F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "term"))
    return counts.join(F.broadcast(offsets), "part").select("term", "n", (inside - 1 + F.coalesce("before", F.lit(0))).cast("long").alias("id"))


def shortest_paths(edges: DataFrame, landmarks: list[str]) -> DataFrame:
    """node, landmark, hops along edges (src, dst) towards each landmark."""
    spark = edges.sparkSession
    best = level = cut(spark.createDataFrame([(x, x, 0) for x in landmarks], "node string, landmark string, hops int"))
    while True:
        ahead = level.join(edges, level.node == edges.dst).select(F.col("src").alias("node"), "landmark", (F.col("hops") + 1).alias("hops")).distinct()
        level = cut(ahead.join(best, ["node", "landmark"], "left_anti"))
        if level.isEmpty():
            break
        best = cut(best.unionByName(level))
    return best


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = cut(edges.join(out, "src"))
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct())
    ranks = nodes.withColumn("rank", F.lit(1.0))
    for _ in range(rounds):
        given = links.join(ranks, links.src == ranks.node).groupBy(F.col("dst").alias("into")).agg(F.sum(F.col("rank") / F.col("out")).alias("sum"))
        ranks = cut(nodes.join(given, nodes.node == given.into, "left").select("node", (F.lit(1 - damping) + damping * F.coalesce("sum", F.lit(0.0))).alias("rank")))
    return ranks


def features(t: DataFrame, mode: str = "at") -> DataFrame:
    """Each entity's feature set: a letter for each place looked at, i incoming, o outgoing; n neighbours, r relations, a both together ("at": all terms)."""
    out = t.select(F.col("s").alias("entity"), F.concat_ws("|", "p", "o").alias("feature"))
    back = t.where("t <> 2").select(F.col("o").alias("entity"), F.concat_ws("|", F.lit("in"), "p", "s").alias("feature"))
    return (out if mode == "os" else back if mode == "is" else out.unionByName(back)).groupBy("entity").agg(F.collect_set("feature").alias("features"))


def similarity(a: DataFrame, b: DataFrame, measure: str = "jaccard", threshold: float = 0.0) -> DataFrame:
    """Pairs of entities that share a feature, with a set similarity: jaccard, dice, simpson, ochiai, braun_blanquet or tversky.  Equal sets are one, and meet on their rarest features alone."""

    def value(n: Column, m: Column, c: Column) -> Column:
        return {"jaccard": c / (n + m - c), "dice": 2 * c / (n + m), "simpson": c / F.least(n, m), "ochiai": c / F.sqrt(n * m), "braun_blanquet": c / F.greatest(n, m), "tversky": c / (c + 0.5 * (n - c) + 0.5 * (m - c))}[measure]

    return pairs(a, b, value, lambda v: v >= threshold, shares(measure, threshold)).withColumnRenamed("value", "similarity")


def outliers(t: DataFrame, method: str = "iqr", factor: float = 1.5) -> DataFrame:
    """Numeric literals that lie far from the others of their predicate: iqr, mad or zscore."""
    rows = t.where("t = 2").select("s", "p", F.expr("try_cast(o as double)").alias("v")).where("v is not null")
    if method == "iqr":
        box = rows.groupBy("p").agg(F.percentile("v", F.lit(0.25)).alias("q1"), F.percentile("v", F.lit(0.75)).alias("q3"))
        test = (F.col("v") < F.col("q1") - factor * (F.col("q3") - F.col("q1"))) | (F.col("v") > F.col("q3") + factor * (F.col("q3") - F.col("q1")))
    elif method == "mad":
        mid = rows.groupBy("p").agg(F.median("v").alias("mid"))
        box = rows.join(mid, "p").groupBy("p", "mid").agg(F.median(F.abs(F.col("v") - F.col("mid"))).alias("mad"))
        test = F.abs(F.col("v") - F.col("mid")) > factor * 1.4826 * F.col("mad")
    else:
        box = rows.groupBy("p").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
        test = F.abs(F.col("v") - F.col("mean")) > factor * F.col("sd")
    return rows.join(box, "p").where(test).select("s", "p", "v")
