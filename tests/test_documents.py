"""Readers and writers of RDF documents: the same graph in every language."""

import pytest
from pyspark.sql import functions as F

from quadrille.model import RDF, TYPE, XSD
from quadrille.sources import documents, ntriples, writers

TTL = """@prefix ex: <http://e/> . @base <http://b/> .
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
ex:a a ex:C ; ex:n "x\\"y\\n" , "chat"@fr ; ex:i -5 , 2.5 , 1e3 , true ; ex:d "2020-01-01"^^xsd:date .
<r> ex:p [ ex:q ex:a ] ; ex:l ( 1 "two" ) . # note
_:n ex:p _:n .
"""


def shape(rows):
    """Rows with blank nodes unnamed."""
    plain = lambda x: "_:" if x and x.startswith("_:") else x
    return sorted(((plain(r[0]), r[1], plain(r[2]), *r[3:6], r[6] if len(r) > 6 else None) for r in rows), key=repr)


def test_turtle():
    got = shape(documents.parse_turtle(TTL))
    assert ("http://e/a", "http://e/n", 'x"y\n', 2, XSD + "string", None, None) in got and ("http://e/a", "http://e/n", "chat", 2, None, "fr", None) in got
    assert ("http://e/a", "http://e/i", "-5", 2, XSD + "integer", None, None) in got and ("http://e/a", "http://e/i", "1e3", 2, XSD + "double", None, None) in got
    assert ("http://b/r", "http://e/p", "_:", 0, None, None, None) in got and ("_:", "http://e/q", "http://e/a", 1, None, None, None) in got and ("_:", RDF + "rest", RDF + "nil", 1, None, None, None) in got
    assert len(got) == 8 + 7 + 1
    with pytest.raises(ValueError):
        list(documents.parse_turtle("<a> <b> ."))


def test_trig():
    got = shape(documents.parse_turtle("@prefix e: <http://e/> . { e:a e:p e:b } e:g { e:c e:p 1 . e:d e:p e:e } GRAPH e:h { e:c e:p 'x' }"))
    assert {r[6] for r in got} == {None, "http://e/g", "http://e/h"} and len(got) == 4


def test_rdfxml():
    text = f"""<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="http://e/" xml:base="http://b/"><e:C rdf:about="http://e/a" e:k="v"><e:n xml:lang="fr">chat</e:n><e:i rdf:datatype="{XSD}integer">5</e:i>
    <e:p rdf:resource="r"/><e:q><rdf:Description rdf:nodeID="z"><e:s/></rdf:Description></e:q><e:l rdf:parseType="Collection"><rdf:Description rdf:about="#x"/></e:l><e:r rdf:parseType="Resource"><e:t>u</e:t></e:r></e:C></rdf:RDF>"""
    got = shape(documents.parse_rdfxml(text))
    s = XSD + "string"
    assert got == shape([("http://e/a", TYPE, "http://e/C", 1, None, None), ("http://e/a", "http://e/k", "v", 2, s, None), ("http://e/a", "http://e/n", "chat", 2, None, "fr"), ("http://e/a", "http://e/i", "5", 2, XSD + "integer", None), ("http://e/a", "http://e/p", "http://b/r", 1, None, None),
                         ("http://e/a", "http://e/q", "_:", 0, None, None), ("_:", "http://e/s", "", 2, s, None), ("http://e/a", "http://e/l", "_:", 0, None, None), ("_:", RDF + "first", "http://b/#x", 1, None, None), ("_:", RDF + "rest", RDF + "nil", 1, None, None), ("http://e/a", "http://e/r", "_:", 0, None, None), ("_:", "http://e/t", "u", 2, s, None)])


def test_jsonld():
    text = '{"@context": {"e": "http://e/", "name": "e:n", "knows": {"@id": "e:k", "@type": "@id"}, "items": {"@id": "e:l", "@container": "@list"}}, "@id": "e:a", "@type": "e:C", "name": [{"@value": "chat", "@language": "FR"}, 5, true], "knows": "http://x/b", "items": [1], "e:in": {"name": "z"}}'
    got = shape(documents.parse_jsonld(text))
    s = XSD + "string"
    assert got == shape([("http://e/a", TYPE, "http://e/C", 1, None, None), ("http://e/a", "http://e/n", "chat", 2, None, "fr"), ("http://e/a", "http://e/n", "5", 2, XSD + "integer", None), ("http://e/a", "http://e/n", "true", 2, XSD + "boolean", None), ("http://e/a", "http://e/k", "http://x/b", 1, None, None),
                         ("http://e/a", "http://e/l", "_:", 0, None, None), ("_:", RDF + "first", "1", 2, XSD + "integer", None), ("_:", RDF + "rest", RDF + "nil", 1, None, None), ("http://e/a", "http://e/in", "_:", 0, None, None), ("_:", "http://e/n", "z", 2, s, None)])


@pytest.mark.parametrize("lang, ending", [("turtle", "ttl"), ("trig", "trig"), ("ntriples", "nt"), ("nquads", "nq"), ("rdfxml", "rdf"), ("trix", "trix"), ("rdfjson", "rj"), ("jsonld", "jsonld")])
def test_round_trip(spark, tmp_path, lang, ending):
    quads = documents.loads(spark, TTL + ("<http://g/1> { <http://e/a> <http://e/p> 'in' . }" if lang in ("trig", "nquads", "trix", "jsonld") else ""), "trig")
    where = str(tmp_path / "out")
    writers.write(quads.coalesce(1), where, lang, {"ex": "http://e/"}, distinct=True)
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    for k, p in enumerate(parts):
        texts = p.read_text().splitlines() if lang in ("rdfjson", "jsonld") else [p.read_text()]
        for j, text in enumerate(texts):
            (tmp_path / f"doc{k}-{j}.{ending}").write_text(text)
    got = documents.read(spark, str(tmp_path / f"*.{ending}"), lang)
    assert shape(got.collect()) == shape(quads.distinct().collect())
    if lang in ("turtle", "nquads"):
        documents.register_sources(spark)
        (tmp_path / "in").mkdir()
        for p in tmp_path.glob(f"*.{ending}"):
            p.rename(tmp_path / "in" / p.name)
        assert shape(spark.read.format("rdf").load(str(tmp_path / "in")).collect()) == shape(quads.distinct().collect())


def test_helpers(spark, tmp_path):
    assert documents.language_of("/x/y.ttl.gz") == "turtle" and documents.language_of("a.owl") == "rdfxml"
    (tmp_path / "bad.ttl").write_text("<a> <b> .")
    assert documents.read(spark, str(tmp_path / "bad.ttl"), mode="skip").count() == 0
    quads = documents.loads(spark, "<urn:g> { <http://e/a> <http://e/p> 1 , 2 . }", "trig")
    assert [r.statements.count("\n") for r in documents.graphs(quads).collect()] == [1]
    assert [tuple(r) for r in writers.used_prefixes(quads, {"ex": "http://e/", "no": "http://n/"}).collect()] == [("ex", "http://e/", 4)]
    ordered = writers.finish(quads, order=True, descending=True).select(F.col("o")).collect()
    assert [r.o for r in ordered] == ["2", "1"]
    assert ntriples.parse(quads.select(ntriples.surface(True).alias("value"))).count() == 2
