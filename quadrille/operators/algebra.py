"""Operations on sets and bags of triples and quads, and SPARQL for each named graph at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import COLUMNS, triples
from ..plans.sparql import Compiler, SparqlError, query
from ..plans.sparql_parser import parse
from ..sources import ntriples

#: Statements of one record of a group; larger groups have several.
RECORD = 10_000


def subjects(t: DataFrame) -> DataFrame:
    return t.select("s")


def predicates(t: DataFrame) -> DataFrame:
    return t.select("p")


def objects(t: DataFrame) -> DataFrame:
    return t.select("o", "t", "dt", "lang")


def filter_place(t: DataFrame, place: str, test) -> DataFrame:
    """The triples whose subject, predicate or object (s, p or o) passes: test is a function of the column, or a collection of terms, which reaches the scan."""
    return t.where(test(F.col(place)) if callable(test) else F.col(place).isin(*test))


def find(t: DataFrame, s=None, p=None, o=None) -> DataFrame:
    """A triple pattern; None is any term."""
    for place, value in (("s", s), ("p", p), ("o", o)):
        t = t if value is None else t.where(F.col(place) == value)
    return t


def find_sql(s=None, p=None, o=None, table: str = "triples") -> str:
    """The same as SQL text."""
    where = ["{} = '{}'".format(k, v.replace("'", "''")) for k, v in (("s", s), ("p", p), ("o", o)) if v is not None]
    return f"SELECT s, p, o FROM {table}" + (" WHERE " + " AND ".join(where) if where else "")


def _same(a: DataFrame, b: DataFrame) -> tuple[DataFrame, Column]:
    names = [c for c in a.columns if c in b.columns]
    other = b.select(*(F.col(c).alias(f"_{c}") for c in names))
    return other, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names))


def contains(t: DataFrame, s=None, p=None, o=None) -> bool:
    return not find(t, s, p, o).isEmpty()


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of a that b holds too; a's repeats stay."""
    other, same = _same(a, b)
    return a.join(other, same, "left_semi")


def missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of a that b does not hold; a's repeats stay."""
    other, same = _same(a, b)
    return a.join(other, same, "left_anti")


def contains_any(a: DataFrame, b: DataFrame) -> bool:
    return not common(a, b).isEmpty()


def contains_all(a: DataFrame, b: DataFrame) -> bool:
    return missing(b, a).isEmpty()


def union_all(*ts: DataFrame) -> DataFrame:
    """A bag; one frame comes back as it is."""
    return reduce(DataFrame.unionByName, ts)


def add(t: DataFrame, rows: list[tuple]) -> DataFrame:
    return t.unionByName(triples(t.sparkSession, rows), allowMissingColumns=True)


def remove(t: DataFrame, rows: list[tuple]) -> DataFrame:
    return missing(t, triples(t.sparkSession, rows))


def into_graph(t: DataFrame, graph: str | None) -> DataFrame:
    """All triples, or quads, in one graph (None: the default one)."""
    return t.withColumn("g", F.lit(graph).cast("string"))


def out_of_graphs(quads: DataFrame) -> DataFrame:
    return quads.drop("g")


def natural_resources(quads: DataFrame) -> DataFrame:
    """The resources that are named as the graph they stand in."""
    return quads.where(F.col("s") == F.col("g")).select("s").distinct()


def records(t: DataFrame, key: str, size: int = RECORD) -> DataFrame:
    """key, record, n, statements: the triples grouped by s, p, o or g as N-Triples texts; a group of more statements has more records, so none outgrows a task."""
    counts = t.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("all"))
    rows = t.join(counts, F.col(key) == F.col("key"))
    share = F.pmod(F.xxhash64("s", "p", "o", F.coalesce("dt", "lang")), F.ceil(F.col("all") / size)).cast("long")
    made = rows.select("key", share.alias("record"), ntriples.surface().alias("line"))
    return made.groupBy("key", "record").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("statements"))


def statements(records_: DataFrame) -> DataFrame:
    """The triples of such texts."""
    return ntriples.parse(records_.select(F.explode(F.split("statements", "\n")).alias("value"))).select(*COLUMNS)


def to_graph(t: DataFrame, most: int = 100_000) -> list[tuple]:
    """The triples in the driver; more than most are refused."""
    rows = t.select(*COLUMNS).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} triples")
    return [tuple(r) for r in rows]


def _wrapped(text: str, graph: str = "__g"):
    q = parse(text)
    if q[0] == "from":
        raise SparqlError("FROM has no meaning for each graph")
    inside = lambda where: ("group", [("graph", ("var", graph), where)])
    return q, inside


def each_graph(quads: DataFrame, text: str) -> DataFrame:
    """A SELECT for each named graph by itself, with the graph in a first column g: it is part of every join and every group, so no graph is handled alone."""
    (_, items, distinct, where, group, having, order, limit, offset), inside = _wrapped(text)
    if limit is not None or offset:
        raise SparqlError("LIMIT and OFFSET for each graph are not supported")
    compiler = Compiler(quads)
    if items is None:
        items = [(v, None) for v in compiler.group(inside(where)).vars if not v.startswith("__")]
    plain = not group and not any("agg" in repr(e) for _, e in items)
    group = group if plain else [("__g", ("var", "__g")), *group]
    rel = compiler.select(("select", [("__g", None), *items], distinct, inside(where), group, having, order, None, 0))
    return rel.df.select(F.col("__g")["v"].alias("g"), *(v for v, _ in items))


def construct_each(quads: DataFrame, text: str) -> DataFrame:
    """A CONSTRUCT for each named graph by itself; the new quads are in the graph they come from."""
    q, inside = _wrapped(text)
    template = [(*x[:3], ("var", "__g")) for x in q[1]]
    select = ("select", None, False, inside(q[2][3]), [], [], [], None, 0)
    compiler = Compiler(quads)
    variables = [(v, None) for v in compiler.group(inside(q[2][3])).vars]
    return compiler.construct(("construct", template, (select[0], variables, *select[2:])))


def graphs_where(quads: DataFrame, text: str, drop: bool = False) -> DataFrame:
    """The quads of the graphs for which an ASK query holds, or of all others."""
    q, inside = _wrapped(text)
    hit = Compiler(quads).group(inside(q[1])).df.select(F.col("__g")["v"].alias("_hit")).distinct()
    return quads.where("g is not null").join(hit, F.col("g") == F.col("_hit"), "left_anti" if drop else "left_semi")


def graphs_by(quads: DataFrame, text: str, descending: bool = False) -> DataFrame:
    """g, key: the named graphs in the order of a SELECT's first variable for each (its least value; graphs without one come first)."""
    keys = each_graph(quads, text)
    value = F.col(keys.columns[1])["v"]
    least = keys.groupBy("g").agg(F.min(F.struct(value.try_cast("double").alias("n"), value.alias("key"))).alias("k"))
    rows = quads.where("g is not null").select("g").distinct().join(least, "g", "left").select("g", F.col("k.n").alias("n"), F.col("k.key").alias("key"))
    order = [F.col(c).desc() if descending else F.col(c) for c in ("n", "key", "g")]
    return rows.orderBy(*order).select("g", "key")


def each_partition(quads: DataFrame, text: str) -> DataFrame:
    """A SELECT for each partition's triples by themselves: the partition's number plays the graph."""
    part = quads.drop("g").withColumn("g", F.concat(F.lit("urn:partition:"), F.spark_partition_id().cast("string")))
    return each_graph(part, text)


def update(t: DataFrame, construct: str) -> DataFrame:
    """t and what a CONSTRUCT adds to it."""
    return t.unionByName(query(t, construct), allowMissingColumns=True).distinct()
