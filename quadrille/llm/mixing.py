"""Operator 10: mixing sources to target weights by capped water-filling.

Every source gets its weight's share of all words; a target stops at max_epochs times its source's size and the excess goes to the others by weight
until none is above.  With sources in order of size a weight, the level at which the water stands is found from running sums.  A document is
taken whole floor(target / size) times; for the fraction left, documents in seeded order are taken once more while the middle of their words lies below it.

Only one table of narrow rows is kept.  Sums go by source and slice of the seeded order, so a source with a third of all rows is added up in
many tasks, and rows are sorted only in the slice where the fraction ends.  The number of sources is taken to be small next to the rows: sources
alone (not documents) meet in one task.

Null source: a source of its own, last.  Null text: size 0, taken 0 words.  Ties in the seeded order go by id.  Repeated rows count each.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, free_name, small, table

MAX_EPOCHS = 3
WEIGHTS = 3
PLACE_BITS = 48
SLICE_BITS = 12
SEED = "mix-1"


def targets(sources: DataFrame, weights: int = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sources: source, source_size.  Adds weight and target."""
    everything = Window.partitionBy()
    ranked = sources.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % weights + 1).cast("double"))
    w = ranked.withColumns({"cap": F.col("source_size") * F.lit(float(max_epochs)), "total": F.sum("source_size").over(everything).cast("double"), "all_weight": F.sum("weight").over(everything)})
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = w.withColumns({"caps": F.sum("cap").over(up), "weights": F.sum("weight").over(up)})
    # The level if just the sources before this one are at their caps: it rises up to the source at which the filling ends, then falls.
    w = w.withColumn("level", (F.col("total") - (F.col("caps") - F.col("cap"))) / (F.col("all_weight") - (F.col("weights") - F.col("weight"))))
    return w.select("source", "source_size", "weight", F.least("cap", F.max("level").over(everything) * F.col("weight")).alias("target"))


def place(doc_id, seed: str = SEED):
    """A document's place in the seeded order, of PLACE_BITS bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(doc_id).cast("string"))), 1, PLACE_BITS // 4), 16, 10).cast("long")


def levels(sized: DataFrame, weights: int = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row a source of sized (source, doc_id, size, place): its size and target, the whole copies, and the last place and id taken once more."""
    shift = PLACE_BITS - SLICE_BITS
    slices = sized.groupBy("source", F.shiftright("place", shift).alias("slice")).agg(F.sum("size").alias("words"))
    target = targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    target = target.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    target = cut(target.withColumn("more", F.col("target") - F.col("whole") * F.col("source_size")))
    more = small(target.select(F.col("source").alias("s"), "more"))
    up = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = slices.withColumn("below", F.sum("words").over(up) - F.col("words")).join(more, F.col("source").eqNullSafe(F.col("s")))
    edge = cut(ends.where((F.col("below") <= F.col("more")) & (F.col("below") + F.col("words") > F.col("more"))).select("s", F.col("slice").alias("edge"), "below", "more"))
    order = Window.partitionBy("s").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = sized.join(small(edge), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("place", shift) == F.col("edge")))
    inside = inside.withColumn("middle", F.col("below") + F.sum("size").over(order) - F.col("size") / 2).where("middle < more")
    last = inside.groupBy("s").agg(F.max(F.struct("place", "doc_id")).alias("last"))
    last = edge.join(last.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left").select(F.col("s"), F.coalesce("last.place", F.shiftleft("edge", shift) - 1).alias("last_place"), F.col("last.doc_id").alias("last_id"))
    return cut(target.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("level_of"), "source_size", "target", "whole", "last_place", "last_id"))


def copies(doc_id: str):
    """How often a row with its place and its source's level is taken."""
    before = (F.col("place") < F.col("last_place")) | ((F.col("place") == F.col("last_place")) & F.coalesce(F.col(doc_id) <= F.col("last_id"), F.lit(True)))
    return F.col("whole") + F.coalesce(before, F.lit(False)).cast("long")


def plan_mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: int = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often each document is taken."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), place(doc_id, seed).alias("place")))
    rows = sized.join(small(levels(sized, weights, max_epochs)), F.col("source").eqNullSafe(F.col("level_of")))
    return rows.select("doc_id", "source", "size", "source_size", "target", copies("doc_id").alias("copies"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: int = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken.  Texts are never shuffled; a row needs its source's level alone."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), place(doc_id, seed).alias("place")))
    level = levels(sized, weights, max_epochs).select(F.struct("level_of", "whole", "last_place", "last_id").alias(free_name(docs, "level")))
    of = level.columns[0]
    rows = docs.join(small(level), docs[source].eqNullSafe(F.col(of)["level_of"]))
    here, last = place(doc_id, seed), F.col(of)["last_place"]
    once = F.coalesce((here < last) | ((here == last) & F.coalesce(docs[doc_id] <= F.col(of)["last_id"], F.lit(True))), F.lit(False))
    times = (F.col(of)["whole"] + once.cast("long")).cast("int")
    extra = free_name(docs, "copy")
    return rows.withColumn(extra, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select(*(docs[c] for c in docs.columns))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that it doesn't take go."""
    return mix(docs)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan_mix(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


OP10_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('mix-1|' || doc_id), 1, 12) AS BIGINT) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size)::DOUBLE FROM w) - (sum(cap) OVER u - cap)) / ((SELECT sum(weight) FROM w) - (sum(weight) OVER u - weight)) AS level
  FROM w WINDOW u AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, least(cap, weight * (SELECT max(level) FROM l)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.source, d.size, r.source_size, r.target, r.whole,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) - d.size / 2.0 AS middle FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT *, CAST(whole + CASE WHEN middle < target - whole * source_size THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, copies FROM k
"""
