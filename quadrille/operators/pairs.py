"""Pairs of entities with like feature sets: distinct sets meet, once each, and their members are put in afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import cut

#: So many members of a set are put in at once: a row of two blocks becomes the square of it at most.
BLOCK = 500


def shares(measure: str, threshold: float, alpha: float = 0.5, beta: float = 0.5) -> tuple[float, float]:
    """What two sets must have in common at least to reach the threshold, as a share of the smaller and of the larger one's size; 0 where nothing is known."""
    if measure in ("jaccard", "dice"):
        alpha = beta = 1.0 if measure == "jaccard" else 0.5
    t = min(max(threshold, 0.0), 1.0)
    if measure == "braun_blanquet":
        return t, t
    if measure == "ochiai":
        return t, t * t
    if measure == "simpson":
        return t, 0.0
    if measure in ("jaccard", "dice", "tversky") and min(alpha, beta) >= 0 and (alpha + beta) * t > 0:
        low = min(alpha, beta)
        return t * (alpha + beta) / (1 - t + t * (alpha + beta)), t * low / (1 - t + t * low) if low else 0.0
    return 0.0, 0.0


def _members(df: DataFrame) -> DataFrame:
    items = F.sort_array("features")
    return cut(df.where(F.size("features") > 0).select("entity", items.alias("items"), F.unhex(F.md5(F.to_json(items).cast("binary"))).alias("id")))


def _sets(members: DataFrame) -> DataFrame:
    rows = members.groupBy("id", "items").agg(F.count("*").alias("members"))
    return cut(rows.select("id", "items", F.size("items").alias("n"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")))


def _blocks(members: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The entities of each set in blocks of about one size.  Sets of more than one block are a BLOCKth of the entities at most."""
    large = F.broadcast(sets.where("blocks > 1").select("id", "blocks"))
    block = F.pmod(F.xxhash64("entity"), F.coalesce("blocks", F.lit(1))).cast("int")
    rows = members.select("entity", "id").join(large, "id", "left").select("id", block.alias("block"), "entity")
    return rows.groupBy(F.col("id").alias(f"id_{name}"), F.col("block").alias(f"block_{name}")).agg(F.collect_list("entity").alias(f"all_{name}"))


def _near(probe: DataFrame, index: DataFrame, ties: bool, small: float, large: float) -> DataFrame:
    """x, y: sets of probe and index that may be like each other; y is the larger, or with ties as large."""
    often = probe.select(F.explode("items").alias("f")).unionByName(index.select(F.explode("items").alias("f"))).groupBy("f").agg(F.count("*").alias("often"))
    need = lambda n, share: F.greatest(F.ceil(n * share - 1e-9), F.lit(1))

    def keys(df: DataFrame, id: str, n: str, k: str, share: float) -> DataFrame:
        rows = df.select(F.col("id").alias(id), F.col("n").alias(n), F.explode("items").alias("f"))
        if small <= 0:
            return rows.withColumn(k, F.lit(1))
        place = F.row_number().over(Window.partitionBy(id).orderBy("often", "f"))
        return rows.join(often, "f").withColumn(k, place).where(F.col(k) <= F.col(n) - need(F.col(n), share) + 1).select(id, n, "f", k)

    met = keys(probe, "x", "n", "j", small).join(keys(index, "y", "m", "k", large), "f").where("n <= m" if ties else "n < m")
    if small > 0:
        # What they share after their first common key is no more than what is left of either.
        met = met.where(F.least(F.col("n") - F.col("j"), F.col("m") - F.col("k")) + 1 >= F.greatest(F.col("n") * small, F.col("m") * large) - 1e-9)
    return met.select("x", "y").distinct()


def pairs(a: DataFrame, b: DataFrame | None, value: Callable[[Column, Column, Column], Column], keep: Callable[[Column], Column], shares: tuple[float, float] = (0.0, 0.0), ordered: bool = True) -> DataFrame:
    """left, right, value: entities of a and b (or of a alone) that share a feature and whose value, made of the sizes of both sets and what they share, is kept.
    ordered: left < right alone, else all that differ.

    Entities of equal sets have the same partners, so the work is that of the distinct sets, and a step over blocks of entities for each row of the result."""
    of_a = _members(a)
    sets_a = _sets(of_a)
    of_b, sets_b = (of_a, sets_a) if b is None else (of_b := _members(b), _sets(of_b))
    x, y = (s.select(F.col("id").alias(k), F.col("items").alias(f"items_{k}"), F.col("n").alias(f"n_{k}"), F.col("blocks").alias(f"blocks_{k}")) for s, k in ((sets_a, "x"), (sets_b, "y")))
    near = _near(sets_a, sets_b, True, *shares)
    back = near.join(x.select("x", "n_x"), "x").join(y.select("y", "n_y"), "y").where("n_x < n_y") if b is None else _near(sets_b, sets_a, False, *shares)
    near = near.unionByName(back.select(F.col("y").alias("x"), F.col("x").alias("y")))
    c = F.size(F.array_intersect("items_x", "items_y"))
    both = near.join(x, "x").join(y, "y").select("x", "y", value(F.col("n_x"), F.col("n_y"), c).alias("value"), "blocks_x", "blocks_y").where(keep(F.col("value")))
    for k in ("x", "y"):
        both = both.withColumn(f"block_{k}", F.explode(F.sequence(F.lit(0), F.col(f"blocks_{k}") - 1)))
    for k, members, sets in (("x", of_a, sets_a), ("y", of_b, sets_b)):
        both = both.withColumnRenamed(k, f"id_{k}").join(_blocks(members, sets, k), [f"id_{k}", f"block_{k}"])
    # Rows are few and short beside what they become, so their number of partitions is given.
    width = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * a.sparkSession.sparkContext.defaultParallelism)
    wide = both.select("value", "all_x", "all_y").repartition(width)
    rows = wide.select("value", "all_y", F.explode("all_x").alias("left")).select("value", "left", F.explode("all_y").alias("right"))
    return rows.where("left < right" if ordered else "left <> right").select("left", "right", "value")
