"""Operator 9: near-duplicates by ProbMinHash, banding and verification.

A text's five-word shingles, weighted 1 + ln(count), send exponential arrivals to the registers of a sketch; a shingle's process stops once it is
later than all registers (early termination).  Two registers agree with the probability Jaccard similarity of the texts.  Bands of registers make buckets; in a
bucket texts are compared with leaders, not with each other, and a pair counts if the Jaccard similarity of its shingle sets is 0.8 or more.  Classes are
the connected components of such links.

Copies of a text count once.  Leaders are the texts that stand in the largest buckets, so the text that others are variants of leads.
Texts that are then still in different classes meet, in any bucket, where their sizes and their rarest shingles allow the similarity at all (prefix and position filter):
an exact bound, no cap.

Null texts and texts without a word: a class each of their own.  Shorter texts than five words: one shingle.  Ties between leaders: the smaller id.  Rows that repeat
an id and text fall together.  Shingles are compared by 32-bit hashes.  Null ids are in no class.  An empty table: no rows.  Very long texts: linear work, ten numbers a word at a time.
Extra columns, whatever their names, are ignored.
"""

import numpy as np
import pyarrow as pa
import re
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Memo
from .common import WORD, stored, struct_udf, table

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 4
REGISTERS = BANDS * ROWS
#: Sizes of a class differ by this factor at most.
WIDTH = 1.05
#: Bounds are widened by this, so that rounding never excludes a pair.
SLACK = 1e-3
#: Bytes of text whose shingles a worker holds at a time: some ten 64-bit numbers a word, besides the words themselves.
SLICE_BYTES = 1 << 20

WORDS = re.compile(WORD).findall
PRIME = np.uint64(0x100000001B3)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self):
        self.hash = Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "replace")), 1 << 17, longest=64)

    def shingles(self, texts: list[str | None]):
        """Distinct shingle hashes of all texts (sorted within each), their counts, and each text's number of them."""
        lists = [WORDS(t) if t else [] for t in texts]
        n_words = np.array([len(x) for x in lists], np.int64)
        words = np.fromiter((h for x in lists for h in map(self.hash.__getitem__, x)), np.uint64, int(n_words.sum()))
        words = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
        n = np.maximum(n_words - SHINGLE + 1, (n_words > 0).astype(np.int64))
        begin = np.concatenate([[0], np.cumsum(n_words)[:-1]]) if len(lists) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(lists)), n)
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(lists) else begin, n) + np.arange(len(doc))
        end = np.repeat(begin + n_words, n)
        h = np.zeros(len(doc), np.uint64)
        for k in range(SHINGLE):
            h = h * PRIME + np.where(at + k < end, words[np.minimum(at + k, len(words) - 1)], np.uint64(0))
        h = mix(h)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(h)))
        return h[starts], doc[starts], counts, np.bincount(doc[starts], minlength=len(lists))


def sketch(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """The element that came first at each register, for each document (0 for one without elements).

    Element h of weight w arrives at times of a Poisson process of rate w that h alone seeds, each time at a register drawn from h too.  All processes advance by
    one arrival at a time; those past the latest register of their document have ended.
    """
    time = np.full(docs * registers, np.inf)
    out = np.zeros(docs * registers, np.uint64)
    now = np.zeros(len(h))
    step = 0
    while len(h):
        step += 1
        bits = mix(h + np.uint64(int(GOLDEN) * step % (1 << 64)))
        now = now - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight
        late = time.reshape(docs, registers).max(1)
        alive = now < late[doc]
        if not alive.all():
            h, doc, weight, now, bits = h[alive], doc[alive], weight[alive], now[alive], bits[alive]
        at = doc * registers + (mix(bits ^ GOLDEN) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, at, now)
        won = time[at] == now
        out[at[won]] = h[won]
    return out.reshape(docs, registers)


def band_keys(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = sketches.reshape(len(sketches), -1, rows)
    key = np.arange(parts.shape[1], dtype=np.uint64)[None, :] + GOLDEN
    for k in range(rows):
        key = mix(key * PRIME + parts[:, :, k])
    return key


def _sketcher():
    s = Shingler()

    def work(texts: pa.Array):
        lists = texts.to_pylist()
        h, doc, counts, sizes = s.shingles(lists)
        keys = band_keys(sketch(h, doc, 1 + np.log(counts), len(lists))).view(np.int64)
        offsets = np.arange(len(lists) + 1, dtype=np.int32) * keys.shape[1]
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1))), sizes.tolist()]

    return work


def _setter():
    s = Shingler()

    def work(texts: pa.Array):
        h, _, _, sizes = s.shingles(texts.to_pylist())
        values = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))]

    return work


def components(links: DataFrame, work=stored) -> DataFrame:
    """node, class: the smallest node connected with it, for all nodes of links (a, b).

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the smallest it knows, until nothing changes.
    """
    edges = work(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("class"))).distinct()
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least").withColumnRenamed("u", "of")
        large = both.join(least, F.col("u") == F.col("of")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = work(large, "edges")
        least = work(edges.groupBy("u").agg(F.min("v").alias("m")), "least").withColumnRenamed("u", "of")
        small = edges.join(least, F.col("u") == F.col("of")).select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).where("a <> b")
        edges = work(small.unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b"))).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (member, leader) with the number of shingles that both hold, and whether they are similar enough."""
    one = pairs.join(sets.select(F.col("id").alias("i"), F.col("shingles").alias("x")), F.col("member") == F.col("i")).drop("i")
    two = one.join(sets.select(F.col("id").alias("j"), F.col("shingles").alias("y")), F.col("leader") == F.col("j"))
    two = two.select("member", "leader", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sizes"))
    return two.select("member", "leader", "both", (F.col("both") >= F.lit(similarity) * (F.col("sizes") - F.col("both"))).alias("linked"))


def size_class(n):
    return F.floor(F.log(n) / F.log(F.lit(WIDTH)) + 1e-9).cast("int")


def possible(sets: DataFrame, of: DataFrame, similarity: float) -> DataFrame:
    """Pairs (member, leader) of texts of different classes, so far, that can reach the similarity.  of: node, class; who is in none is a class.

    Shingles are ordered, rare ones first.  Texts of n and m shingles that share t = (n + m) * s / (1 + s) of them, as they must, have their first common one among the
    first n - t + 1 and m - t + 1: so texts are joined on those, for each pair of size classes.  Where a shingle's texts are mostly of one class, those don't meet each other.
    """
    part = similarity / (1 + similarity)
    each = sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    texts = each.groupBy("shingle", F.lit(0).alias("_")).agg(F.count("*").alias("texts")).select(F.col("shingle").alias("s"), "texts")
    place = F.row_number().over(Window.partitionBy("id").orderBy("texts", "shingle"))
    first = each.join(texts, F.col("shingle") == F.col("s")).withColumn("place", place).where((F.col("texts") > 1) & (F.col("place") <= (1 - similarity) * F.col("n") + 1 + SLACK))
    first = stored(first.select("id", "n", "shingle", "place"), "first")
    size = of.groupBy("class").agg(F.count("*").alias("members")).withColumnRenamed("class", "c")
    named = stored(of.join(size, F.col("class") == F.col("c")).select("node", "class", "members"), "named")
    first = first.join(named, F.col("id") == F.col("node"), "left").select("id", "n", "shingle", "place", F.coalesce("class", "id").alias("class"), F.coalesce("members", F.lit(1)).alias("members"))
    first = first.withColumn("own", size_class(F.col("n")))

    def role(low, high, larger, smaller):
        rows = first.withColumn("other", F.explode(F.sequence(low, high)))
        least = F.greatest(F.pow(F.lit(WIDTH), F.col("other")) - SLACK, F.col("n") * F.lit(similarity))
        rows = rows.where(F.col("place") <= F.col("n") - part * (F.col("n") + least) + 1 + SLACK)
        return rows.select("id", "n", "shingle", "place", "class", "members", F.col(larger).alias("larger"), F.col(smaller).alias("smaller"))

    above = role(size_class(F.greatest(F.lit(similarity) * F.col("n") - 1e-6, F.lit(1))), F.col("own"), "own", "other")
    below = role(F.col("own"), size_class(F.col("n") / similarity + 1e-6), "other", "own")
    key = ["shingle", "larger", "smaller"]
    groups = above.unionByName(below).groupBy(*key, F.lit(0).alias("_")).agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max(F.struct("members", "class")).alias("big")).where("low <> high")
    groups = stored(groups.select(F.xxhash64(*key).alias("g"), F.col("big.class").alias("big")), "groups")

    def met(rows):
        return rows.withColumn("group", F.xxhash64(*key)).join(groups, F.col("group") == F.col("g")).select("group", "id", "n", "place", "class", (F.col("class") == F.col("big")).alias("big"))

    xs, ys = stored(met(above), "above"), stored(met(below), "below").withColumnsRenamed({"group": "h", "id": "j", "n": "m", "place": "at", "class": "d", "big": "most"})
    fits = (F.col("class") != F.col("d")) & (1 + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")) >= part * (F.col("n") + F.col("m")) - SLACK)
    on = (F.col("group") == F.col("h")) & fits
    pairs = xs.where("not big").join(ys, on).select("id", "j").unionByName(xs.where("big").join(ys.where("not most"), on).select("id", "j"))
    return stored(pairs.select(F.greatest("id", "j").alias("member"), F.least("id", "j").alias("leader")).distinct(), "possible")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest id of its class), one row for each of docs."""
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    key = F.when(F.col("text").rlike(WORD), F.md5("text"))
    rows = stored(texts.withColumn("s", struct_udf(_sketcher, [("bands", pa.list_(pa.int64())), ("n", pa.int32())], SLICE_BYTES)(F.col("text"))).select("id", key.alias("key"), F.col("s")["bands"].alias("bands"), F.col("s")["n"].alias("n")), "sketches")
    unique = stored(rows.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("rep")), "unique")
    reps = rows.select("id", "bands", "n").join(unique.select("rep"), F.col("id") == F.col("rep"), "left_semi").dropDuplicates(["id"])
    every = reps.select(F.col("id").alias("member"), "n", F.explode("bands").alias("bucket"))
    sizes = every.groupBy("bucket").agg(F.count("*").alias("size"), F.min("n").alias("least")).where("size > 1").select(F.col("bucket").alias("b"), "size")
    members = stored(every.join(stored(sizes, "sizes"), F.col("bucket") == F.col("b")).select("bucket", "member", "n", F.log2(F.col("size").cast("double")).alias("weight")), "members")
    central = stored(members.groupBy("member").agg(F.round(F.sum("weight"), 6).alias("rank")), "central")
    members = stored(members.join(central.withColumnRenamed("member", "m"), F.col("member") == F.col("m")).select("bucket", "member", "n", "rank"), "members")
    involved = central.select(F.col("member").alias("id"))
    sets = stored(texts.join(involved, "id", "left_semi").dropDuplicates(["id"]).select("id", struct_udf(_setter, [("shingles", pa.list_(pa.int32()))], SLICE_BYTES)(F.col("text"))["shingles"].alias("shingles")), "sets")

    # First round: everyone in a bucket meets its leader.  Grouped by one key more than the join has, so that the join deals both sides anew and can split hot buckets.
    lead = members.groupBy("bucket", F.lit(0).alias("_")).agg(F.max(F.struct("rank", (-F.col("member")).alias("order"), "n")).alias("lead"))
    lead = stored(lead.select(F.col("bucket").alias("b"), (-F.col("lead.order")).alias("leader"), F.col("lead.n").alias("leader_n")), "leaders")
    met = members.join(lead, F.col("bucket") == F.col("b"))
    size_ok = (F.col("member") != F.col("leader")) & (F.least("n", "leader_n") >= F.lit(similarity) * F.greatest("n", "leader_n"))
    tried = stored(compared(met.where(size_ok).select("member", "leader").distinct(), sets, similarity), "compared")
    links = tried.where("linked")

    # Second: those that are still in different classes, wherever they can be similar enough at all.
    of = components(links.select(F.col("member").alias("a"), F.col("leader").alias("b")))
    more = stored(compared(possible(sets, of, similarity), sets, similarity), "compared").where("linked")
    of = components(more.select(F.col("member").alias("a"), F.col("leader").alias("b")).unionByName(of.select(F.col("node").alias("a"), F.col("class").alias("b"))))
    named = stored(unique.join(of, F.col("rep") == F.col("node"), "left").select(F.col("key").alias("k"), F.coalesce("class", "rep").alias("class_id")), "classes")
    return rows.select("id", "key").join(named, F.col("key") == F.col("k"), "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its class (the smallest doc_id in it) and whether it stays, as one of each class does."""
    got = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("stays"))


def stage_near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that with the smallest id."""
    keep = classes(docs).where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("kept_id"))
    kept = docs.join(keep, docs.doc_id == keep.kept_id, "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(docs.doc_id.isNull()))
