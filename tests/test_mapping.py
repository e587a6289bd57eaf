"""Tables as triples: Tarql, RML, R2RML, and queries over a lake."""

import json

from pyspark.sql import functions as F

from quadrille.model import TYPE, XSD, triples
from quadrille.plans import lake
from quadrille.plans.sparql import plain, query
from quadrille.sources import mapping, tabular

RML = """@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://semweb.mmlab.be/ns/rml#> . @prefix ql: <http://semweb.mmlab.be/ns/ql#> . @prefix e: <http://e/> .
<#P> rml:logicalSource [ rml:source "people.csv"; rml:referenceFormulation ql:CSV ] ;
  rr:subjectMap [ rr:template "http://e/p/{id}"; rr:class e:Person ] ;
  rr:predicateObjectMap [ rr:predicate e:name; rr:objectMap [ rml:reference "name" ] ] ;
  rr:predicateObjectMap [ rr:predicate e:age; rr:objectMap [ rml:reference "age"; rr:datatype <http://www.w3.org/2001/XMLSchema#integer> ] ] ;
  rr:predicateObjectMap [ rr:predicate e:city; rr:objectMap [ rr:parentTriplesMap <#C>; rr:joinCondition [ rr:child "city"; rr:parent "key" ] ] ] .
<#C> rml:logicalSource [ rml:source "cities.json"; rml:referenceFormulation ql:JSONPath; rml:iterator "$.[*]" ] ;
  rr:subjectMap [ rr:template "http://e/c/{key}"; rr:class e:City ] ;
  rr:predicateObjectMap [ rr:predicate e:label; rr:objectMap [ rml:reference "label"; rr:language "en" ] ] .
"""
E = "PREFIX e: <http://e/> "


def files(tmp_path):
    (tmp_path / "people.csv").write_text('id,name,age,city\n1,"Ann\nLee",30,b\n2,Bob,,b\n3,Cy,41,r s\n')
    (tmp_path / "cities.json").write_text(json.dumps([{"key": "b", "label": "Bonn"}, {"key": "r s", "label": "Rye"}]))
    return str(tmp_path)


def test_tarql_and_readers(spark, tmp_path):
    base = files(tmp_path)
    rows = tabular.read_csv(spark, base + "/people.csv")
    made = tabular.tarql(rows, E + "CONSTRUCT { ?x e:name ?name ; e:row ?ROWNUM ; e:age ?n } WHERE { BIND(IRI(CONCAT('http://e/', ?id)) AS ?x) BIND(xsd:integer(?age) AS ?n) }")
    got = {(r.s, r.p, r.o) for r in made.collect()}
    assert {("http://e/1", "http://e/name", "Ann\nLee"), ("http://e/3", "http://e/row", "3"), ("http://e/1", "http://e/age", "30")} <= got and not any(s == "http://e/2" and p.endswith("age") for s, p, _ in got)
    assert tabular.read_csv(spark, base + "/people.csv", names="excel").columns == ["A", "B", "C", "D"]
    assert tabular.read_json(spark, base + "/cities.json").count() == 2
    (tmp_path / "seq.json").write_text('{"a": 1}\n{"a": {"b": 2}}\n')
    assert [json.loads(r.json)["a"] for r in tabular.read_json(spark, base + "/seq.json").collect()] == [1, {"b": 2}]
    numbered = tabular.numbered(spark.range(100).repartition(7)).collect()
    assert sorted(r.ROWNUM for r in numbered) == list(range(1, 101))


def test_rml(spark, tmp_path):
    base = files(tmp_path)
    got = {(r.s, r.p, r.o, r.dt, r.lang) for r in mapping.triples(spark, RML, base).collect()}
    assert ("http://e/p/1", "http://e/age", "30", XSD + "integer", None) in got and ("http://e/c/r%20s", "http://e/label", "Rye", None, "en") in got and ("http://e/p/3", "http://e/city", "http://e/c/r%20s", None, None) in got and ("http://e/p/2", TYPE, "http://e/Person", None, None) in got
    assert len(got) == 3 * 3 + 2 + 4
    rows = tabular.read_csv(spark, base + "/people.csv")
    again = {(r.s, r.p, r.o, r.dt, r.lang) for r in tabular.tarql(rows, mapping.to_construct(RML)["#P"]).collect()}
    assert again == {x for x in got if x[0].startswith("http://e/p/")}


def test_lake(spark, tmp_path):
    base = files(tmp_path)
    text = E + "SELECT ?n ?l WHERE { ?p e:name ?n ; e:age ?a ; e:city ?c . ?c e:label ?l FILTER(?a > 35) } ORDER BY ?n LIMIT 5"
    assert [tuple(r) for r in plain(lake.answer(spark, text, RML, base)).collect()] == [("Cy", "Rye")]
    sources = mapping.MappedSources(spark, RML, base)
    p = lake.plan(text, sources, {"#C": 0.5})
    assert p.joins == [("p", "c", "http://e/city")] and p.sources == {"p": {"#P"}, "c": {"#C"}} and p.order == ["p", "c"] and p.limit == 5 and p.order_by == [("n", False)]
    assert p.needed["p"] == {"http://e/name", "http://e/age", "http://e/city"}
    df = query(sources, E + "SELECT ?n WHERE { <http://e/p/2> e:name ?n }")
    assert "EqualTo(id,2)" in df._jdf.queryExecution().toString() and plain(df).first().n == "Bob"
    everything = plain(query(sources, "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p"))
    assert {r.p: r.n for r in everything.collect()}["http://e/city"] == "3"
    steps = ["skp(2)", "prefix(x)", "postfix(y)", "replc(b, c)"]
    assert spark.range(1).select(lake.transform(F.lit("aabb"), steps).alias("v"), lake.transform(F.lit("12"), ["toInt"]).alias("n"), lake.transform(F.lit("abc"), ["skp(-1)"]).alias("w")).first() == ("xccy", 12, "ab")
    assert lake.read_config('{"sources": [{"type": "csv", "options": {}, "source": "s", "entity": "E"}], "weights": [{"datasource": "csv", "weight": 2}]}')[1] == {"csv": 2.0}


def test_wide_tables(spark):
    t = triples(spark, [("urn:a", TYPE, "urn:A"), ("urn:a", TYPE, "urn:B"), ("urn:a", "urn:k", "1", 2, XSD + "string"), ("urn:a", "urn:k", "2", 2, XSD + "string"), ("urn:b", TYPE, "urn:A"), ("urn:b", "urn:k", "3", 2, XSD + "string")])
    got = {k: [r.asDict() for r in v.collect()] for k, v in lake.wide_tables(t, TYPE).items()}
    assert got == {"urn:A": [{"s": "urn:b", "k": "3"}], "urn:B": [{"s": "urn:a", "k": "1,2", "type_A": 1}]}
