"""Figures of an ontology from its axioms (kind, args)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NUMERIC, RDFS, namespace
from ..plans.fixpoint import depths

IRI = r"<([^>]*)>"
ASSERTIONS = ["ClassAssertion", "ObjectPropertyAssertion", "DataPropertyAssertion", "AnnotationAssertion", "DifferentIndividuals", "SameIndividual"]
DATA = r'^"(.*)"(?:\^\^<(.*)>|@(.*))?$'


def _arg(k: int):
    return F.get("args", F.lit(k))


def _iri(col):
    return F.regexp_extract(col, "^" + IRI + "$", 1)


def axiom_counts(axioms: DataFrame) -> DataFrame:
    """kind, n"""
    return axioms.groupBy("kind").agg(F.count("*").alias("n"))


def hierarchy_depth(axioms: DataFrame, kind: str = "SubClassOf") -> DataFrame:
    """node, depth of named classes (SubClassOf) or properties (SubObjectPropertyOf, SubDataPropertyOf)."""
    rows = axioms.where((F.col("kind") == kind) & _arg(0).startswith("<") & _arg(1).startswith("<"))
    return depths(rows.select(_iri(_arg(0)).alias("child"), _iri(_arg(1)).alias("parent")).distinct())


def mentions(axioms: DataFrame) -> DataFrame:
    """iri: every name in every axiom, once a mention."""
    return axioms.select(F.explode(F.regexp_extract_all(F.array_join("args", " "), F.lit(IRI), F.lit(1))).alias("iri"))


def entities(axioms: DataFrame) -> DataFrame:
    return mentions(axioms).agg(F.countDistinct("iri").alias("entities"), F.count("*").alias("mentions"))


def _assertions(axioms: DataFrame) -> DataFrame:
    """s, p, o of object, data and annotation assertions."""
    return axioms.where(F.col("kind").isin("ObjectPropertyAssertion", "DataPropertyAssertion", "AnnotationAssertion")).select("kind", _iri(_arg(1)).alias("s"), _iri(_arg(0)).alias("p"), _arg(2).alias("o"))


def degrees(axioms: DataFrame) -> DataFrame:
    """iri, outgoing, incoming: object assertions of each individual."""
    rows = _assertions(axioms).where("kind = 'ObjectPropertyAssertion'")
    both = rows.select(F.col("s").alias("iri"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(rows.select(_iri(F.col("o")).alias("iri"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy("iri").agg(F.sum("a").alias("outgoing"), F.sum("b").alias("incoming"))


def properties_per_subject(axioms: DataFrame) -> DataFrame:
    return _assertions(axioms).groupBy(F.col("s").alias("node")).agg(F.countDistinct("p").alias("n"))


def literals(axioms: DataFrame) -> DataFrame:
    """One row: literals, and mean lengths of typed and untyped ones."""
    o, rows = F.col("o"), _assertions(axioms).where(F.col("o").startswith('"'))
    value, dt = F.regexp_extract(o, "(?s)" + DATA, 1), F.regexp_extract(o, "(?s)" + DATA, 2)
    return rows.agg(F.count("*").alias("literals"), F.avg(F.when(dt.endswith("#string"), F.length(value))).alias("typed_string_length"), F.avg(F.when(dt == "", F.length(value))).alias("untyped_string_length"))


def datatypes(axioms: DataFrame) -> DataFrame:
    return _assertions(axioms).where(F.col("o").startswith('"')).select(F.regexp_extract("o", "(?s)" + DATA, 2).alias("dt")).where("dt <> ''").groupBy("dt").agg(F.count("*").alias("n"))


def languages(axioms: DataFrame) -> DataFrame:
    return _assertions(axioms).where(F.col("o").startswith('"')).select(F.regexp_extract("o", "(?s)" + DATA, 3).alias("lang")).where("lang <> ''").groupBy("lang").agg(F.count("*").alias("n"))


def typed_subjects(axioms: DataFrame) -> DataFrame:
    return axioms.where("kind = 'ClassAssertion'").select(_iri(_arg(1)).alias("s")).distinct()


def labeled_subjects(axioms: DataFrame) -> DataFrame:
    return _assertions(axioms).where(F.col("p") == RDFS + "label").select("s").distinct()


def links(axioms: DataFrame) -> DataFrame:
    """from_ns, to_ns, n: object assertions between namespaces."""
    rows = _assertions(axioms).where("kind = 'ObjectPropertyAssertion'").select(namespace(F.col("s")).alias("from_ns"), namespace(_iri(F.col("o"))).alias("to_ns"))
    return rows.where("from_ns <> to_ns").groupBy("from_ns", "to_ns").agg(F.count("*").alias("n"))


def value_per_property(axioms: DataFrame) -> DataFrame:
    """property, largest, mean of numeric data assertions."""
    rows = _assertions(axioms).where("kind = 'DataPropertyAssertion'").select("p", F.regexp_extract("o", "(?s)" + DATA, 1).try_cast("double").alias("v"), F.regexp_extract("o", "(?s)" + DATA, 2).alias("dt"))
    return rows.where(F.col("dt").isin(*NUMERIC) & F.col("v").isNotNull()).groupBy(F.col("p").alias("property")).agg(F.max("v").alias("largest"), F.avg("v").alias("mean"))


def vocabularies(axioms: DataFrame, place: str) -> DataFrame:
    """ns, n of the subjects, predicates or objects (s, p or o) of assertions."""
    rows = _assertions(axioms)
    name = _iri(F.col("o")) if place == "o" else F.col(place)
    return rows.select(namespace(name).alias("ns")).where("ns <> ''").groupBy("ns").agg(F.count("*").alias("n"))


def declared(axioms: DataFrame, kind: str) -> DataFrame:
    """iri: declared things of a kind (Class, ObjectProperty, DataProperty, AnnotationProperty, NamedIndividual, Datatype)."""
    return axioms.where((F.col("kind") == "Declaration") & _arg(0).startswith(kind + "(")).select(F.regexp_extract(_arg(0), IRI, 1).alias("iri")).distinct()


def used_classes(axioms: DataFrame) -> DataFrame:
    """class, n: named classes of class assertions."""
    return axioms.where((F.col("kind") == "ClassAssertion") & _arg(0).startswith("<")).groupBy(_iri(_arg(0)).alias("class")).agg(F.count("*").alias("n"))


def used_properties(axioms: DataFrame, kind: str) -> DataFrame:
    """property, n of Object, Data or Annotation assertions."""
    name = "AnnotationAssertion" if kind == "Annotation" else f"{kind}PropertyAssertion"
    return axioms.where(F.col("kind") == name).groupBy(_iri(_arg(0)).alias("property")).agg(F.count("*").alias("n"))


def class_expressions(axioms: DataFrame, kind: str) -> DataFrame:
    """expression: the arguments of axioms that are, or begin, a class expression of a kind, such as ObjectUnionOf."""
    return axioms.select(F.explode("args").alias("expression")).where(F.col("expression").startswith(kind + "(")).distinct()


def summary(axioms: DataFrame) -> DataFrame:
    """criterion, n: all counts in one frame."""
    one = entities(axioms).select(F.explode(F.create_map(F.lit("entities"), F.col("entities"), F.lit("mentions"), F.col("mentions"))).alias("criterion", "n"))
    out = axiom_counts(axioms).select(F.col("kind").alias("criterion"), "n").unionByName(one)
    for name, df in (("typed subjects", typed_subjects(axioms)), ("labeled subjects", labeled_subjects(axioms)), ("classes", declared(axioms, "Class")), ("object properties", declared(axioms, "ObjectProperty")), ("data properties", declared(axioms, "DataProperty"))):
        out = out.unionByName(df.agg(F.lit(name).alias("criterion"), F.count("*").alias("n")))
    return out
