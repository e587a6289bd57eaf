"""Forward chaining over triples: RDFS, OWL Horst and EL rules as joins, schema first, then semi-naive fixpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import OWL, RDFS, TYPE
from ..plans.fixpoint import closure, cut
from .rulesets import reason

KEYS = ["s", "p", "o", "t", "dt", "lang"]
SUB_CLASS, SUB_PROPERTY = RDFS + "subClassOf", RDFS + "subPropertyOf"


def _pairs(t: DataFrame, predicate: str) -> DataFrame:
    return t.where(F.col("p") == predicate).select(F.col("s").alias("a"), F.col("o").alias("b"))


def _made(df: DataFrame, s, p, o, like: DataFrame | None = None) -> DataFrame:
    """Triples with IRI objects."""
    lit = lambda x: F.lit(x) if isinstance(x, str) and ":" in x else F.col(x) if isinstance(x, str) else x
    none = F.lit(None).cast("string")
    return df.select(lit(s).alias("s"), lit(p).alias("p"), lit(o).alias("o"), F.lit(1).alias("t"), none.alias("dt"), none.alias("lang"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _distinct(t: DataFrame) -> DataFrame:
    return t.select(*KEYS).distinct()


def _schema(t: DataFrame) -> dict[str, DataFrame]:
    """What the rules look up: closed hierarchies, domains and ranges, computed once."""
    pick = lambda name: cut(t.where(F.col("p") == RDFS + name).select(F.col("s").alias("p"), F.col("o").alias("c")))
    return {"classes": closure(_pairs(t, SUB_CLASS)), "properties": closure(_pairs(t, SUB_PROPERTY)), "domain": pick("domain"), "range": pick("range")}


def _facts(t: DataFrame, schema: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rules 7, 2, 3 and 9 against a closed schema: all statements, and all types (s, c)."""
    up = schema["properties"].where("a <> b").select(F.col("a").alias("p"), F.col("b").alias("q"))
    facts = t.unionByName(t.join(up, "p").select("s", F.col("q").alias("p"), "o", "t", "dt", "lang"))
    typed = union([
        facts.where(F.col("p") == TYPE).select("s", F.col("o").alias("c")),
        facts.join(schema["domain"], "p").select("s", "c"),
        facts.where("t <> 2").join(schema["range"], "p").select(F.col("o").alias("s"), "c"),
    ])
    above = typed.join(schema["classes"].select(F.col("a").alias("c"), F.col("b").alias("d")), "c").select("s", F.col("d").alias("c"))
    return facts, typed.unionByName(above)


def rdfs(t: DataFrame, simple: bool = True) -> DataFrame:
    """All triples that the RDFS rules add up to; the axiomatic ones (4, 6, 8, 10) only if not simple.

    Schema closures (5, 11) come first; then one pass each of 7, 2, 3 and 9 is complete, as the closures hold all steps.
    """
    t = t.select(*KEYS)
    schema = _schema(t)
    classes, properties = schema["classes"], schema["properties"]
    facts, typed = _facts(t, schema)
    parts = [facts, _made(typed, "s", TYPE, F.col("c")), _made(classes, F.col("a"), SUB_CLASS, F.col("b")), _made(properties, F.col("a"), SUB_PROPERTY, F.col("b"))]
    if not simple:
        resources = t.select(F.col("s").alias("x")).union(t.where("t <> 2").select(F.col("o").alias("x"))).distinct()
        is_class = t.where((F.col("p") == TYPE) & (F.col("o") == RDFS + "Class")).select(F.col("s").alias("x"))
        is_property = t.where((F.col("p") == TYPE) & F.col("o").endswith("Property")).select(F.col("s").alias("x"))
        parts += [_made(resources, "x", TYPE, F.lit(RDFS + "Resource")), _made(is_class, "x", SUB_CLASS, F.lit(RDFS + "Resource")), _made(is_class, "x", SUB_CLASS, F.col("x")), _made(is_property, "x", SUB_PROPERTY, F.col("x"))]
    return _distinct(union(parts))


def owl_horst(t: DataFrame) -> DataFrame:
    """RDFS with equivalence, inverse, symmetric, transitive and functional properties, and restrictions, to a fixpoint."""
    return reason(t.select(*KEYS), "owl-horst")


def same_as(t: DataFrame, functional: DataFrame, inverse_functional: DataFrame) -> DataFrame:
    """sameAs links, symmetric and transitive: everything that shares a functional value is tied to the smallest, not to each other, before closing."""
    nodes = t.where("t <> 2")

    def star(df: DataFrame, key: list[str], value: str) -> DataFrame:
        least = df.groupBy(*key).agg(F.min(value).alias("b"))
        return df.join(least, key).where(F.col(value) != F.col("b")).select(F.col(value).alias("a"), "b")

    found = star(nodes.join(functional, "p"), ["s", "p"], "o").union(star(nodes.join(inverse_functional, "p"), ["o", "p"], "s")).union(_pairs(t, OWL + "sameAs"))
    pairs = closure(found.union(found.select("b", "a")).distinct()).where("a <> b")
    return _made(pairs, F.col("a"), OWL + "sameAs", F.col("b"))


def is_entailed(t: DataFrame, statement: tuple[str, str, str], reasoner=rdfs) -> bool:
    s, p, o = statement
    return not reasoner(t).where((F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o)).isEmpty()
