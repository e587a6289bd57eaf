"""Dataset statistics over triples: one DataFrame a criterion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NUMERIC, OWL, RDF, RDFS, TYPE, XSD, is_iri, namespace
from ..plans.fixpoint import depths


def used_classes(t: DataFrame) -> DataFrame:
    return t.where((F.col("p") == TYPE) & (F.col("t") == 1)).groupBy(F.col("o").alias("class")).agg(F.count("*").alias("n"))


def classes_defined(t: DataFrame) -> DataFrame:
    return t.where((F.col("p") == TYPE) & F.col("o").isin(RDFS + "Class", OWL + "Class")).select(F.col("s").alias("class")).distinct()


def properties_defined(t: DataFrame) -> DataFrame:
    kinds = [RDF + "Property", OWL + "ObjectProperty", OWL + "DatatypeProperty"]
    return t.where((F.col("p") == TYPE) & F.col("o").isin(*kinds)).select(F.col("s").alias("property")).distinct()


def property_usage(t: DataFrame) -> DataFrame:
    return t.groupBy(F.col("p").alias("property")).agg(F.count("*").alias("n"))


def mentions(t: DataFrame) -> DataFrame:
    """Every IRI in every place, once a mention."""
    terms = F.array(F.when(is_iri(F.col("s")), F.col("s")), F.col("p"), F.when(F.col("t") == 1, F.col("o")))
    return t.select(F.explode(terms).alias("iri")).where("iri is not null")


def counts(t: DataFrame) -> DataFrame:
    """The criteria that are one number each, in one pass."""
    o, lit, typed = F.col("o"), F.col("t") == 2, F.col("p") == TYPE
    one = t.agg(
        F.count("*").alias("triples"),
        F.countDistinct(F.when(is_iri(F.col("s")), F.col("s"))).alias("distinct_subjects"),
        F.countDistinct(F.when(F.col("t") == 1, o)).alias("distinct_objects"),
        F.count(F.when(lit, 1)).alias("literals"),
        F.count(F.when(~is_iri(F.col("s")), 1)).alias("blanks_as_subject"),
        F.count(F.when(F.col("t") == 0, 1)).alias("blanks_as_object"),
        F.avg(F.when(lit & (F.col("dt") == XSD + "string"), F.length("o"))).alias("avg_typed_string_length"),
        F.avg(F.when(lit & F.col("lang").isNotNull(), F.length("o"))).alias("avg_untyped_string_length"),
        F.count(F.when(typed, 1)).alias("typed_subjects"),
        F.count(F.when(F.col("p") == RDFS + "label", 1)).alias("labeled_subjects"),
        F.count(F.when(F.col("p") == OWL + "sameAs", 1)).alias("same_as"),
        F.count(F.when(F.col("p") == RDFS + "subClassOf", 1)).alias("subclass_usage"),
    )
    return one


def distinct_entities(t: DataFrame) -> DataFrame:
    return mentions(t).agg(F.countDistinct("iri").alias("entities"), F.count("*").alias("mentions"))


def datatypes(t: DataFrame) -> DataFrame:
    return t.where("t = 2 and dt is not null").groupBy("dt").agg(F.count("*").alias("n"))


def languages(t: DataFrame) -> DataFrame:
    return t.where("t = 2 and lang is not null").groupBy("lang").agg(F.count("*").alias("n"))


def vocabularies(t: DataFrame, place: str) -> DataFrame:
    """Namespaces of subjects, predicates or objects (s, p or o)."""
    rows = t.where(F.col("t") == 1) if place == "o" else t
    return rows.groupBy(namespace(F.col(place)).alias("ns")).agg(F.count("*").alias("n"))


def links(t: DataFrame) -> DataFrame:
    rows = t.where((F.col("t") == 1) & is_iri(F.col("s"))).select(namespace(F.col("s")).alias("from_ns"), namespace(F.col("o")).alias("to_ns"))
    return rows.where("from_ns <> to_ns").groupBy("from_ns", "to_ns").agg(F.count("*").alias("n"))


#: Up to so many properties, the sets of them are kept as the bits of numbers.
MASKED = 256


def properties_per(t: DataFrame, place: str) -> DataFrame:
    """How many distinct properties each subject or object (s or o) has.  The properties are counted first; while they are few, a node's set is a few numbers that tasks
    put together before anything is sent, where rows of node and property would all be."""
    names = [r.p for r in t.where("p is not null").select("p").distinct().limit(MASKED + 1).orderBy("p").collect()]  # a vocabulary
    node = t.groupBy(F.col(place).alias("node"))
    if not 0 < len(names) <= MASKED:
        return node.agg(F.countDistinct("p").alias("n"))
    groups = [names[k : k + 63] for k in range(0, len(names), 63)]
    bits = [f"CASE p {' '.join(f'WHEN {_quoted(x)} THEN {1 << k}L' for k, x in enumerate(group))} ELSE 0L END" for group in groups]
    masks = node.agg(*(F.expr(f"bit_or({b})").alias(f"mask{k}") for k, b in enumerate(bits)))
    return masks.select("node", reduce(lambda x, y: x + y, (F.bit_count(f"mask{k}").cast("long") for k in range(len(groups)))).alias("n"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def value_per_property(t: DataFrame) -> DataFrame:
    """Maximum and mean of each property's numeric literals."""
    rows = t.where((F.col("t") == 2) & F.col("dt").isin(*NUMERIC)).select("p", F.expr("try_cast(o as double)").alias("v"))
    return rows.groupBy(F.col("p").alias("property")).agg(F.max("v").alias("largest"), F.avg("v").alias("mean"))


def hierarchy_depth(t: DataFrame, relation: str = RDFS + "subClassOf") -> DataFrame:
    return depths(t.where(F.col("p") == relation).select(F.col("s").alias("child"), F.col("o").alias("parent")).where("child <> parent").distinct())


def quality(t: DataFrame, internal: str, short: int = 95) -> DataFrame:
    """Quality metrics in one pass.  internal: the prefix of the dataset's own IRIs."""
    s, p, o, iri = F.col("s"), F.col("p"), F.col("o"), F.col("t") == 1

    def of_iris(test) -> F.Column:
        return F.count(F.when(test(s), 1)) + F.count(F.when(test(p), 1)) + F.count(F.when(iri & test(o), 1))

    n = F.count("*")
    licence = (RDF + "license", "http://purl.org/dc/terms/license", "http://creativecommons.org/ns#license", "http://purl.org/dc/terms/rights")
    crossing = iri & (s.startswith(internal) != o.startswith(internal))
    return t.agg(
        n.alias("triples"),
        F.when(n >= 10**9, 1.0).when(n >= 10**7, 0.75).when(n >= 5 * 10**5, 0.5).when(n >= 10**4, 0.25).otherwise(0.0).alias("amount_of_triples"),
        (F.countDistinct("p") / n).alias("coverage_detail"),
        (F.countDistinct(F.when(p == TYPE, s)) / n).alias("coverage_scope"),
        (of_iris(lambda x: x.contains("#")) / n).alias("hash_uris"),
        (of_iris(lambda x: x.contains("?")) / n).alias("query_uris"),
        (of_iris(lambda x: F.length(x) < short) / n).alias("short_uris"),
        (F.count(F.when(crossing, 1)) / n).alias("interlinking"),
        (F.count(F.when(crossing & (p == OWL + "sameAs"), 1)) / n).alias("external_same_as"),
        F.max(F.when(p.isin(*licence), 1.0).otherwise(0.0)).alias("machine_readable_license"),
        F.max(F.when(p.isin(RDFS + "label", RDFS + "comment") & o.rlike("(?i)licen[sc]e"), 1.0).otherwise(0.0)).alias("human_readable_license"),
        (F.count(F.when((p == RDFS + "label") & s.startswith(internal), 1)) / n).alias("labeled_resources"),
    )


def extensional_conciseness(t: DataFrame) -> DataFrame:
    """Share of subjects whose set of statements is theirs alone."""
    sets = t.groupBy("s").agg(F.sort_array(F.collect_set(F.struct("p", "o"))).alias("x")).groupBy(F.xxhash64("x").alias("h")).agg(F.count("*").alias("n"))
    return sets.agg((F.sum(F.when(F.col("n") == 1, 1).otherwise(0)) / F.sum("n")).alias("extensional_conciseness"))


#: What the text of a literal has to look like to be one of its datatype.
LEXICAL = {
    "boolean": r"true|false|0|1", "integer": r"[+-]?\d+", "int": r"[+-]?\d+", "long": r"[+-]?\d+", "short": r"[+-]?\d+", "byte": r"[+-]?\d+", "nonNegativeInteger": r"\+?\d+|-0+", "positiveInteger": r"\+?0*[1-9]\d*",
    "decimal": r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)", "double": r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|[+-]?INF|NaN", "float": r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|[+-]?INF|NaN",
    "date": r"-?\d{4,}-\d\d-\d\d(?:Z|[+-]\d\d:\d\d)?", "dateTime": r"-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)?", "time": r"\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)?",
    "gYear": r"-?\d{4,}(?:Z|[+-]\d\d:\d\d)?", "anyURI": r"\S*", "hexBinary": r"(?:[0-9A-Fa-f]{2})*",
}


def _valid():
    test = F.lit(True)
    for name, pattern in LEXICAL.items():
        test = F.when(F.col("dt") == XSD + name, F.col("o").rlike(f"^(?:{pattern})$")).otherwise(test)
    return test


def valid_literals(t: DataFrame) -> DataFrame:
    """dt, valid, wrong: distinct literals that fit their datatype, and that don't."""
    rows = t.where("t = 2 and dt is not null").select("o", "dt").distinct().withColumn("ok", _valid())
    return rows.groupBy("dt").agg(F.count(F.when(F.col("ok"), 1)).alias("valid"), F.count(F.when(~F.col("ok"), 1)).alias("wrong"))


def numeric_range(t: DataFrame, predicate: str, low: float, high: float) -> DataFrame:
    """share: how many of a predicate's numeric values lie between low and high."""
    v = F.expr("try_cast(o as double)")
    rows = t.where((F.col("p") == predicate) & (F.col("t") == 2)).select(v.alias("v")).where("v is not null")
    return rows.agg(F.count("*").alias("n"), (F.count(F.when((F.col("v") > low) & (F.col("v") < high), 1)) / F.count("*")).alias("share"))


def property_completeness(t: DataFrame, kind: str, predicate: str) -> DataFrame:
    """share: how many things of a class have a property."""
    things = t.where((F.col("p") == TYPE) & (F.col("o") == kind)).select("s").distinct()
    having = t.where(F.col("p") == predicate).select(F.col("s").alias("h")).distinct()
    both = things.join(having, things.s == having.h, "left")
    return both.agg(F.count("*").alias("things"), (F.count("h") / F.count("*")).alias("share"))


def schema_completeness(t: DataFrame) -> DataFrame:
    """share: how many of the classes and properties that the schema declares are used."""
    kinds = [RDFS + "Class", OWL + "Class", RDF + "Property", OWL + "ObjectProperty", OWL + "DatatypeProperty"]
    declared = t.where((F.col("p") == TYPE) & F.col("o").isin(*kinds)).select(F.col("s").alias("x")).distinct()
    used = t.select("p").union(t.where((F.col("p") == TYPE) & ~F.col("o").isin(*kinds)).select("o")).distinct().select(F.col("p").alias("u"))
    return declared.join(used, declared.x == used.u, "left").agg(F.count("*").alias("declared"), (F.count("u") / F.count("*")).alias("share"))


def dereferenceable(t: DataFrame, place: str, internal: str, alive) -> DataFrame:
    """share: how many distinct internal IRIs of a place can be fetched.  alive: a function from a list of IRIs to booleans, called on the executors for batches."""
    import pyarrow as pa

    iris = t.where(F.col("t") == 1) if place == "o" else t
    distinct = iris.select(F.col(place).alias("iri")).where(F.col("iri").startswith(internal)).distinct()

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bool(x) for x in alive(b.column("iri").to_pylist())], pa.bool_())], names=["ok"])

    return distinct.mapInArrow(work, "ok boolean").agg(F.count("*").alias("iris"), (F.count(F.when(F.col("ok"), 1)) / F.count("*")).alias("share"))


VOID = "http://rdfs.org/ns/void#"


def describe(t: DataFrame) -> DataFrame:
    """criterion, key, n: the figures of a dataset's description in one frame of small ones.  Two passes: one over terms, with the places of each as bits, and one over
    properties, classes and datatypes, whose few counts give all the others."""
    key = lambda c: F.col(c) if c else F.lit(None).cast("string")
    rows = lambda *cs: F.explode(F.array(*(F.struct(F.lit(name).alias("criterion"), k.alias("key"), F.col(n).alias("n")) for name, k, n in cs))).alias("x")
    iri = lambda c, place: F.struct(c.alias("iri"), F.lit(place).alias("place"))
    places = F.array(iri(F.when(is_iri(F.col("s")), F.col("s")), 1), iri(F.col("p"), 2), iri(F.when(F.col("t") == 1, F.col("o")), 4))
    terms = t.select(F.explode(places).alias("x")).select("x.iri", "x.place").where("iri is not null").groupBy("iri").agg(F.bit_or("place").alias("places"))
    in_place = lambda bit: F.count(F.when(F.col("places").bitwiseAND(bit) > 0, 1))
    of_terms = terms.agg(F.count("*").alias("entities"), in_place(1).alias("subjects"), in_place(4).alias("objects"))
    of_terms = of_terms.select(rows(("distinctSubjects", key(None), "subjects"), ("distinctObjects", key(None), "objects"), ("entities", key(None), "entities"))).select("x.*")
    few = t.groupBy("p", F.when((F.col("p") == TYPE) & (F.col("t") == 1), F.col("o")).alias("class"), F.when(F.col("t") == 2, F.col("dt")).alias("datatype")).agg(F.count("*").alias("n"))
    parts = few.select(rows(("triples", key(None), "n"), ("classPartition", key("class"), "n"), ("propertyPartition", key("p"), "n"), ("vocabulary", namespace(F.col("p")), "n"), ("datatype", key("datatype"), "n"))).select("x.*")
    none = t.sparkSession.range(1).select(F.lit("triples").alias("criterion"), key(None).alias("key"), F.lit(0).cast("long").alias("n"))  # where there are none
    parts = parts.where("criterion = 'triples' or key is not null").unionByName(none).groupBy("criterion", "key").agg(F.sum("n").alias("n"))
    return of_terms.unionByName(parts)


def void_description(t: DataFrame, dataset: str) -> DataFrame:
    """The same as lines of Turtle about a dataset."""
    c, key, n = F.col("criterion"), F.col("key"), F.col("n").cast("string")
    head = f"<{dataset}> <{VOID}"
    part = lambda kind, of: F.concat(F.lit(f"{head}{kind}> [ <{VOID}{of}> <"), key, F.lit(f"> ; <{VOID}{'entities' if of == 'class' else 'triples'}> "), n, F.lit(" ] ."))
    line = F.when(c == "classPartition", part("classPartition", "class")).when(c == "propertyPartition", part("propertyPartition", "property")).when(c == "vocabulary", F.concat(F.lit(f"{head}vocabulary> <"), key, F.lit("> .")))
    return describe(t).where("criterion <> 'datatype'").select(line.otherwise(F.concat(F.lit(head), c, F.lit("> "), n, F.lit(" ."))).alias("value"))
