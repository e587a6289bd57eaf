"""SPARQL, readers, inference and statistics on small graphs."""

import duckdb
import pytest

from quadrille import catalog
from quadrille.model import OWL, RDFS, TYPE, XSD, triples
from quadrille.operators import graph, inference, statistics
from quadrille.plans.fixpoint import depths
from quadrille.plans.sparql import plain, query
from quadrille.sources import ntriples

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(catalog.SPARQL))
def test_sparql_against_sql(spark, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    con = duckdb.connect()
    for t in catalog.SPARQL[name][0]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
    assert sorted(got.columns) == cols and rows(got) == rows(want)


def test_ntriples_round_trip(spark):
    lines = ['<urn:a> <urn:p> "x\\"y\\n\\u00e9\\U0001F600\\\\u0041" .', "_:b <urn:p> _:c . # note", f'<urn:a> <urn:q> "5"^^<{XSD}integer> .', '<urn:a> <urn:l> "hi"@en <urn:g> .', "bad", ""]
    df = ntriples.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    rows = {(r.s, r.o, r.t, r.lang, r.g) for r in df.collect()}
    assert rows == {("urn:a", 'x"y\né😀\\u0041', 2, None, None), ("_:b", "_:c", 0, None, None), ("urn:a", "5", 2, None, None), ("urn:a", "hi", 2, "en", "urn:g")}
    again = ntriples.parse(df.select(ntriples.surface(True).alias("value")))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in df.collect()}
    with pytest.raises(Exception, match="bad statement"):
        ntriples.parse(spark.createDataFrame([("bad",)], "value string"), "stop").collect()


def test_rdfs_rules(spark):
    t = triples(spark, [("urn:A", RDFS + "subClassOf", "urn:B"), ("urn:B", RDFS + "subClassOf", "urn:C"), ("urn:x", TYPE, "urn:A"), ("urn:p", RDFS + "domain", "urn:A"), ("urn:q", RDFS + "subPropertyOf", "urn:p"), ("urn:y", "urn:q", "urn:z")])
    got = {(r.s, r.p, r.o) for r in inference.rdfs(t).collect()}
    assert {("urn:x", TYPE, "urn:C"), ("urn:y", TYPE, "urn:C"), ("urn:y", "urn:p", "urn:z"), ("urn:A", RDFS + "subClassOf", "urn:C")} <= got


def test_owl_horst_rules(spark):
    t = triples(spark, [("urn:t", TYPE, OWL + "TransitiveProperty"), ("urn:a", "urn:t", "urn:b"), ("urn:b", "urn:t", "urn:c"), ("urn:f", TYPE, OWL + "FunctionalProperty"), ("urn:a", "urn:f", "urn:u"), ("urn:a", "urn:f", "urn:v")])
    got = {(r.s, r.p, r.o) for r in inference.owl_horst(t).collect()}
    assert {("urn:a", "urn:t", "urn:c"), ("urn:u", OWL + "sameAs", "urn:v"), ("urn:v", OWL + "sameAs", "urn:u")} <= got


def test_path_closure_and_construct(spark):
    t = triples(spark, [("urn:a", "urn:n", "urn:b"), ("urn:b", "urn:n", "urn:c")])
    assert {tuple(r) for r in plain(query(t, "SELECT ?x ?y WHERE { ?x <urn:n>+ ?y }")).collect()} == {("urn:a", "urn:b"), ("urn:b", "urn:c"), ("urn:a", "urn:c")}
    assert query(t, "CONSTRUCT { ?y <urn:i> ?x } WHERE { ?x <urn:n> ?y }").count() == 2
    assert query(t, "ASK { <urn:a> <urn:n> <urn:c> }").first().answer is False


def test_statistics_and_graph(spark):
    t = triples(spark, [("urn:A", RDFS + "subClassOf", "urn:B"), ("urn:B", RDFS + "subClassOf", "urn:C"), ("_:n", TYPE, "urn:A"), ("urn:x", "urn:p", "3", 2, XSD + "integer")])
    assert {tuple(r) for r in statistics.hierarchy_depth(t).collect()} == {("urn:C", 0), ("urn:B", 1), ("urn:A", 2)}
    one = statistics.counts(t).first()
    assert (one.triples, one.blanks_as_subject, one.literals) == (4, 1, 1)
    assert sorted(r.id for r in graph.dictionary(t, "p").collect()) == [0, 1, 2]


def test_chains_have_no_cap(spark):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(103)]
    edges = spark.createDataFrame([*chain, ("x", "y"), ("y", "x"), ("z", "x"), ("n0", "n50")], "child string, parent string").coalesce(1)
    got = {r.node: r.depth for r in depths(edges).collect()}
    assert got == {f"n{k}": 103 - k for k in range(104)} | {"x": None, "y": None, "z": None}
    paths = graph.shortest_paths(spark.createDataFrame(chain[:53], "src string, dst string").coalesce(1), ["n53"])
    assert {r.node: r.hops for r in paths.collect()} == {f"n{k}": 53 - k for k in range(54)}
