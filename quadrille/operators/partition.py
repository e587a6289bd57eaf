"""Placing a graph's triples: by hashes of their ends, by paths, as vertical tables, as dictionaries of ids, and measures of a placement."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import TYPE
from ..plans.fixpoint import closure, cut
from .graph import dictionary

def place_of(node: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(n)).cast("int")


def by_subject(t: DataFrame, n: int, hops: int = 1) -> DataFrame:
    """t with part: a triple goes where its subject goes; with more hops, also to the partitions of subjects that reach it in so many steps."""
    rows = frontier = t.withColumn("part", place_of(F.col("s"), n))
    for _ in range(hops - 1):
        # Partitions that hold an edge into a node get the node's own triples.
        wanted = frontier.where("t < 2").select(F.col("o").alias("node"), "part").distinct()
        frontier = t.join(wanted, F.col("s") == F.col("node")).drop("node")
        rows = rows.unionByName(frontier)
    return rows.distinct() if hops > 1 else rows


def by_object(t: DataFrame, n: int) -> DataFrame:
    return t.withColumn("part", place_of(F.col("o"), n))


def by_both(t: DataFrame, n: int) -> DataFrame:
    """A triple goes where its subject goes and where its object goes: twice, unless that is the same."""
    return t.withColumn("part", F.explode(F.array_distinct(F.array(place_of(F.col("s"), n), place_of(F.col("o"), n)))))


def by_path(t: DataFrame, n: int) -> DataFrame:
    """All triples that a source (a node without edges into it) reaches go where it goes; those on cycles that no source reaches go by their subject."""
    edges = cut(t.where("t < 2").select(F.col("s").alias("a"), F.col("o").alias("b")).distinct())
    sources = t.select(F.col("s").alias("a")).distinct().join(edges.select(F.col("b").alias("a")), "a", "left_anti")
    reach = closure(edges).join(sources, "a", "left_semi").unionByName(sources.select("a", F.col("a").alias("b")))
    places = reach.select(F.col("b").alias("node"), place_of(F.col("a"), n).alias("part")).distinct()
    rows = t.join(places, F.col("s") == F.col("node"), "left").drop("node")
    return rows.withColumn("part", F.coalesce("part", place_of(F.col("s"), n)))


def measures(placed: DataFrame, n: int) -> DataFrame:
    """duplication (placed triples a triple), balance (the largest partition over the mean) and efficiency (the mean over the largest, for each copy)."""
    keys = [c for c in placed.columns if c != "part"]
    total = placed.select(*keys).distinct().agg(F.count("*").alias("once"))
    sizes = placed.groupBy("part").agg(F.count("*").alias("size")).agg(F.sum("size").alias("all"), F.max("size").alias("most"))
    both = sizes.crossJoin(total)  # one row each
    balance = F.col("most") * n / F.col("all")
    return both.select((F.col("all") / F.col("once")).alias("duplication"), balance.alias("balance"), (F.col("once") / F.col("all") / balance).alias("efficiency"))


def vertices(t: DataFrame) -> DataFrame:
    """Every node, with a dense id in order of fall in frequency."""
    nodes = t.select(F.explode(F.array(F.col("s"), F.when(F.col("t") < 2, F.col("o")).otherwise(F.concat(F.lit('"'), "o", F.lit('"'))))).alias("node"))
    return dictionary(nodes, "node").select(F.col("term").alias("node"), "id")


def hashed_graph(t: DataFrame) -> DataFrame:
    """Edges of 64-bit hashes, without a dictionary."""
    return t.select(F.xxhash64("s").alias("src"), F.col("p").alias("relation"), F.xxhash64(F.when(F.col("t") < 2, F.col("o")).otherwise(F.concat(F.lit('"'), "o", F.lit('"')))).alias("dst"))


def encode(t: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The triples as ids, and the dictionary (term, n, id) of each place."""
    books = {place: cut(dictionary(t, place)) for place in "spo"}
    out = t.select("s", "p", "o")
    for place, book in books.items():
        out = out.join(book.select(F.col("term").alias(place), F.col("id").alias(f"{place}_id")), place)
    return out.select("s_id", "p_id", "o_id"), books


def decode(coded: DataFrame, books: dict[str, DataFrame]) -> DataFrame:
    for place, book in books.items():
        coded = coded.join(book.select(F.col("term").alias(place), F.col("id").alias(f"{place}_id")), f"{place}_id")
    return coded.select("s", "p", "o")


def tensor(t: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between resources as (head, relation, tail) ids from 1 on, with the entities and the relations."""
    links = t.where("t < 2")
    entities = cut(dictionary(links.select(F.explode(F.array("s", "o")).alias("node")), "node").select(F.col("term").alias("entity"), (F.col("id") + 1).alias("id")))
    relations = cut(dictionary(links, "p").select(F.col("term").alias("relation"), (F.col("id") + 1).alias("id")))
    name = lambda df, c, place, out: df.select(F.col(c).alias(place), F.col("id").alias(out))
    coded = links.join(name(entities, "entity", "s", "head"), "s").join(name(relations, "relation", "p", "r"), "p").join(name(entities, "entity", "o", "tail"), "o")
    return coded.select("head", F.col("r").alias("relation"), "tail"), entities, relations


def save_tables(coded: DataFrame, books: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Triples and dictionaries as folders of CSV."""
    coded.write.mode(mode).csv(f"{path}/triples", header=True)
    for place, name in zip("spo", ("subject", "predicate", "object")):
        books[place].write.mode(mode).csv(f"{path}/{name}", header=True, escape='"')


def read_tables(spark, path: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    coded = spark.read.csv(f"{path}/triples", header=True, schema="s_id long, p_id long, o_id long")
    books = {p: spark.read.csv(f"{path}/{n}", header=True, schema="term string, n long, id long", escape='"', multiLine=True) for p, n in zip("spo", ("subject", "predicate", "object"))}
    return coded, books


def table_name(predicate: str, suffix: str = "") -> str:
    """A predicate as a table's name: its letters and digits, and a hash of it."""
    return re.sub(r"\W+", "_", predicate.rstrip("/").rsplit("/", 1)[-1].rsplit("#", 1)[-1]).lower() + "_" + hashlib.md5(predicate.encode()).hexdigest()[:8] + suffix


def vertical_sql(predicates: list[str]) -> dict[str, str]:
    """For each predicate the SQL of its table of subjects and objects, over a table triples."""
    return {p: "CREATE OR REPLACE TEMPORARY VIEW `{}` AS SELECT s, o, dt, lang AS l FROM triples WHERE p = '{}'".format(table_name(p), p.replace("'", "''")) for p in predicates}


def register_vertical(t: DataFrame) -> dict[str, str]:
    """A view for each predicate (a vocabulary, not the rows, comes to the driver); the views' names by predicate."""
    spark = t.sparkSession
    t.createOrReplaceTempView("triples")
    names = [r.p for r in t.select("p").distinct().orderBy("p").collect()]
    for sql in vertical_sql(names).values():
        spark.sql(sql)
    return {p: table_name(p) for p in names}


def vertical_mapping(predicates: list[str], literal: dict[str, str | None]) -> str:
    """R2RML, in Turtle, of such views: literal gives the datatype of predicates whose objects are literals."""
    out = ["@prefix rr: <http://www.w3.org/ns/r2rml#> ."]
    for p in predicates:
        kind = f"rr:termType rr:Literal; rr:datatype <{literal[p]}>" if literal.get(p) else "rr:termType rr:Literal" if p in literal else "rr:termType rr:IRI"
        out.append(f'[] rr:logicalTable [ rr:tableName "{table_name(p)}" ] ; rr:subjectMap [ rr:column "s"; rr:termType rr:IRI ] ; rr:predicateObjectMap [ rr:predicate <{p}> ; rr:objectMap [ rr:column "o"; {kind} ] ] .')
    return "\n".join(out)


def persist_vertical(t: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder a predicate and language."""
    t.withColumns({"predicate": F.col("p"), "language": F.coalesce("lang", F.lit(""))}).write.mode(mode).partitionBy("predicate", "language").parquet(path)


def persist_property_table(t: DataFrame, path: str, predicates: list[str], mode: str = "errorifexists", only_typed: bool = False) -> None:
    """One row a subject with an array a predicate."""
    from .graph import property_table

    rows = t.join(t.where(F.col("p") == TYPE).select("s").distinct(), "s", "left_semi") if only_typed else t
    table = property_table(rows, predicates)
    table.toDF("s", *(table_name(p) for p in predicates)).write.mode(mode).parquet(path)


def graph_json(t: DataFrame) -> DataFrame:
    """value: a JSON object for each node and each link."""
    node = F.to_json(F.struct(F.col("node").alias("id")))
    nodes = t.select(F.explode(F.array("s", "o")).alias("node")).distinct().select(F.to_json(F.struct(F.lit("node").alias("kind"), F.from_json(node, "id string").alias("value"))).alias("value"))
    link = F.struct(F.col("s").alias("source"), F.col("o").alias("target"), F.col("p").alias("value"))
    return nodes.unionByName(t.select(F.to_json(F.struct(F.lit("link").alias("kind"), link.alias("value"))).alias("value")))


def paths(edges: DataFrame, most: int) -> DataFrame:
    """path: the simple paths (arrays of nodes) of one to most edges (src, dst)."""
    level = out = edges.select(F.array("src", "dst").alias("path")).where("path[0] <> path[1]")
    for _ in range(most - 1):
        level = level.join(edges, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        out = out.unionByName(level)
    return out
