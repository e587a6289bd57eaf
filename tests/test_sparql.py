"""SPARQL semantics on small graphs, each case against the value that the specification gives."""

import pytest

from quadrille.model import XSD, MappedTables, triples
from quadrille.plans.sparql import plain, query

from .conftest import DATA

INT, DEC, DT = XSD + "integer", XSD + "decimal", XSD + "dateTime"
G = [("urn:a", "urn:v", "1", 2, INT), ("urn:b", "urn:v", "1", 2, INT), ("urn:c", "urn:v", "4", 2, INT), ("urn:a", "urn:w", "2.50", 2, DEC), ("urn:a", "urn:at", "2020-03-04T05:06:07.5+05:30", 2, DT),
     ("urn:a", "urn:k", "urn:b"), ("urn:b", "urn:k", "urn:c"), ("urn:c", "urn:name", "Chat", 2, None, "fr"), ("urn:a", "urn:name", "a GRAPH x", 2, XSD + "string")]


@pytest.fixture(scope="module")
def graph(spark):
    return triples(spark, G).cache()


def rows(df):
    return sorted(tuple(r) for r in plain(df).collect())


def one(graph, expression):
    return plain(query(graph, "SELECT (" + expression + " AS ?x) WHERE { <urn:a> <urn:at> ?d . <urn:a> <urn:w> ?w . <urn:c> <urn:name> ?n }")).first().x


@pytest.mark.parametrize(
    "expression, want",
    [("ROUND(-2.5)", "-2"), ("ROUND(?w)", "3"), ("CEIL(?w)", "3"), ("FLOOR(-2.5)", "-3"), ("ABS(-2)", "2"), ("HOURS(?d)", "5"), ("MINUTES(?d)", "6"), ("SECONDS(?d)", "7.5"), ("YEAR(?d)", "2020"), ("TZ(?d)", "+05:30"),
     ("STR(TIMEZONE(?d))", "PT5H30M"), ("LANG(?n)", "fr"), ("STR(DATATYPE(?w))", DEC), ("IF(?w > 2, 'y', 'n')", "y"), ("COALESCE(?none, 'z')", "z"), ("STRBEFORE('abc', 'b')", "a"), ("REPLACE('abab', 'b', 'Z')", "aZaZ"),
     ("ENCODE_FOR_URI('a b/c')", "a%20b%2Fc"), ("CONTAINS('abc', 'bc')", "true"), ("STRSTARTS('abc', 'b')", "false"), ("MD5('abc')", "900150983cd24fb0d6963f7d28e17f72"), ("LANGMATCHES(LANG(?n), '*')", "true"), ("isNumeric(?w)", "true"),
     ("STRLEN(STRUUID())", "36"), ("STRLEN(STR(UUID()))", "45"), ("isBlank(BNODE())", "true"), ("RAND() < 1", "true"), ("YEAR(NOW()) > 2000", "true"), ("1 IN (2, 1)", "true"), ("1 NOT IN (2, 3)", "true"), ("STR(STRDT('5', <urn:t>))", "5"), ("SHA256('')", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")],
)
def test_functions(graph, expression, want):
    assert one(graph, expression) == want


def test_aggregates(graph):
    got = query(graph, "SELECT (SUM(?v) AS ?s) (AVG(DISTINCT ?v) AS ?a) (SUM(DISTINCT ?v) AS ?d) (MIN(?v) AS ?m) (COUNT(DISTINCT ?v) AS ?n) (GROUP_CONCAT(?v; SEPARATOR='+') AS ?g) (SAMPLE(?v) AS ?p) WHERE { ?x <urn:v> ?v }").first()
    assert (got.s.v, got.s.dt, got.a.v, got.a.dt, got.d.v, got.m.v, got.n.v, got.g.v) == ("6", INT, "2.5", DEC, "5", "1", "2", "1+1+4") and got.p.v in "14"
    mixed = query(graph, "SELECT (SUM(?v) AS ?s) (AVG(?none) AS ?a) WHERE { ?x <urn:v>|<urn:w> ?v }").first()
    assert (mixed.s.v, mixed.s.dt, mixed.a.v) == ("8.5", DEC, "0")


def test_exists_anywhere_and_lateral(graph):
    assert rows(query(graph, "SELECT ?x WHERE { ?x <urn:v> ?v FILTER(?v > 3 || EXISTS { ?x <urn:k> <urn:b> }) }")) == [("urn:a",), ("urn:c",)]
    assert rows(query(graph, "SELECT ?x WHERE { ?x <urn:v> ?v FILTER(!(EXISTS { ?x <urn:k> ?y } && ?v = 1)) }")) == [("urn:c",)]
    assert rows(query(graph, "SELECT ?x ?y WHERE { ?x <urn:v> ?v LATERAL { BIND(?v + 1 AS ?y) FILTER(?y > 2) } }")) == [("urn:c", "5")]
    assert rows(query(graph, "SELECT ?x WHERE { SERVICE <rdd:cache> { ?x <urn:v> 4 } }")) == [("urn:c",)]
    assert rows(query(graph, "SELECT ?x ?z WHERE { ?x <urn:k> ?y SERVICE <rdd:broadcastJoin> { ?y <urn:k> ?z } }")) == [("urn:a", "urn:c")]


def test_unbound_joins(graph):
    text = "SELECT ?x ?y ?v WHERE { ?x <urn:v> ?o OPTIONAL { ?x <urn:k> ?y } ?y <urn:v> ?v }"
    assert rows(query(graph, text)) == sorted([("urn:a", "urn:b", "1"), ("urn:b", "urn:c", "4"), *(("urn:c", y, v) for y, v in (("urn:a", "1"), ("urn:b", "1"), ("urn:c", "4")))])
    assert rows(query(graph, "SELECT ?x ?y WHERE { VALUES (?x ?y) { (<urn:a> UNDEF) (UNDEF <urn:c>) } ?x <urn:k> ?y }")) == [("urn:a", "urn:b"), ("urn:b", "urn:c")]


def test_paths(graph):
    assert rows(query(graph, "SELECT ?y WHERE { <urn:a> <urn:k>+ ?y }")) == [("urn:b",), ("urn:c",)]
    assert rows(query(graph, "SELECT ?y WHERE { <urn:a> <urn:k>* ?y }")) == [("urn:a",), ("urn:b",), ("urn:c",)]
    assert rows(query(graph, "SELECT ?x WHERE { <urn:c> ^<urn:k>/^<urn:k> ?x }")) == [("urn:a",)]
    assert rows(query(graph, "SELECT ?y WHERE { <urn:b> !(<urn:v>|<urn:name>) ?y }")) == [("urn:c",)]
    assert rows(query(graph, "SELECT ?x WHERE { [] <urn:k> ?x }")) == [("urn:b",), ("urn:c",)]


def test_graphs(spark):
    schema = "s string, p string, o string, t int, dt string, lang string, g string"
    quads = spark.createDataFrame([("urn:a", "urn:k", "urn:b", 1, None, None, None), ("urn:c", "urn:k", "urn:d", 1, None, None, "urn:g1"), ("urn:e", "urn:k", "urn:f", 1, None, None, "urn:g2"), ("urn:a", "urn:n", "a GRAPH x", 2, XSD + "string", None, None)], schema)
    assert rows(query(quads, "SELECT ?x WHERE { ?x <urn:k> ?y }")) == [("urn:a",)]
    assert rows(query(quads, "SELECT ?x WHERE { ?x <urn:n> 'a GRAPH x' }")) == [("urn:a",)]
    assert rows(query(quads, "SELECT ?g ?x WHERE { GRAPH ?g { ?x <urn:k> ?y } }")) == [("urn:g1", "urn:c"), ("urn:g2", "urn:e")]
    assert rows(query(quads, "SELECT ?x FROM <urn:g1> FROM <urn:g2> WHERE { ?x <urn:k> ?y }")) == [("urn:c",), ("urn:e",)]
    assert rows(query(quads, "SELECT ?x FROM NAMED <urn:g2> WHERE { GRAPH ?g { ?x <urn:k> ?y } }")) == [("urn:e",)]
    assert rows(query(quads, "SELECT ?x FROM <urn:g1> WHERE { GRAPH ?g { ?x <urn:k> ?y } }")) == []
    made = query(quads, "CONSTRUCT { ?y <urn:i> ?x . GRAPH ?g { ?x <urn:j> ?y } } WHERE { GRAPH ?g { ?x <urn:k> ?y } }").collect()
    assert {(r.s, r.p, r.g) for r in made} == {("urn:d", "urn:i", None), ("urn:f", "urn:i", None), ("urn:c", "urn:j", "urn:g1"), ("urn:e", "urn:j", "urn:g2")}
    assert {r.s for r in query(quads, "DESCRIBE <urn:a>").collect()} == {"urn:a"}


def test_mapped_tables_scan_once(spark):
    tables = MappedTables(spark, DATA, ["customer", "nation"])
    df = query(tables, "SELECT ?c ?m WHERE { ?c <urn:customer#c_mktsegment> ?m ; <urn:customer#c_nationkey> <urn:nation:3> ; a <urn:class:customer> ; <urn:customer#c_mktsegment> 'BUILDING' }")
    plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("FileScan") == 1 and "EqualTo(c_nationkey,3)" in plan and "EqualTo(c_mktsegment,BU" in plan and "Explode" not in plan and "generate" not in plan.lower()
    assert rows(query(tables, "SELECT ?p ?o WHERE { <urn:nation:3> ?p ?o }"))[0][0].startswith("http://www.w3.org")


def test_optional_parts_of_unbound_variables(spark):
    """What may be unbound meets by equality where it is bound; before, all rows met all in one comparison."""
    rows = [("urn:a", "urn:k", "urn:x"), ("urn:a", "urn:k", "urn:y"), ("urn:b", "urn:j", "urn:y"), ("urn:c", "urn:t", "urn:d"), ("urn:a", "urn:t", "urn:d"), ("urn:b", "urn:t", "urn:d"), ("urn:x", "urn:v", "urn:1"), ("urn:z", "urn:v", "urn:2"), ("urn:b", "urn:w", "urn:y")]
    t = triples(spark, rows)
    ask = lambda text: {tuple((x or "").removeprefix("urn:") for x in r) for r in plain(query(t, text)).collect()}
    first = "SELECT ?n ?s ?v WHERE { ?n <urn:t> ?d OPTIONAL { ?n <urn:k> ?s } "
    every = {("b", "x", "1"), ("b", "z", "2"), ("c", "x", "1"), ("c", "z", "2")}
    assert ask(first + "OPTIONAL { ?s <urn:v> ?v } }") == {("a", "x", "1"), ("a", "y", "")} | every
    assert ask(first + "OPTIONAL { ?s <urn:none> ?v } }") == {("a", "x", ""), ("a", "y", ""), ("b", "", ""), ("c", "", "")}
    assert ask(first + "OPTIONAL { ?s <urn:v> ?v FILTER(?v = <urn:2>) } }") == {("a", "x", ""), ("a", "y", ""), ("b", "z", "2"), ("c", "z", "2")}
    assert ask("SELECT ?n ?s ?u WHERE { ?n <urn:t> ?d OPTIONAL { ?n <urn:k> ?s } OPTIONAL { ?n <urn:j> ?u } OPTIONAL { ?s <urn:w> ?u } }") == {("a", "x", ""), ("a", "y", ""), ("b", "b", "y"), ("c", "b", "y")}
    plan = query(t, first + "OPTIONAL { ?s <urn:v> ?v } }")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join LeftOuter" in x and " OR " in x.upper()]
