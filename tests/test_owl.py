"""Ontologies: syntaxes against each other, figures, and reasoning over their triples."""

import pytest

from quadrille.model import RDFS, TYPE, XSD
from quadrille.operators import owl_statistics as stats
from quadrille.operators import rulesets
from quadrille.sources import owl

FUNCTIONAL = """Prefix(:=<http://e/>) Prefix(xsd:=<http://www.w3.org/2001/XMLSchema#>)
Ontology(<http://e/>
Declaration(Class(:A)) Declaration(Class(:B)) Declaration(ObjectProperty(:p)) Declaration(DataProperty(:d)) Declaration(NamedIndividual(:i))
SubClassOf(:A ObjectIntersectionOf(:B ObjectSomeValuesFrom(:p :C)))
SubClassOf(Annotation(<http://e/c> "x") :B :C)
EquivalentClasses(:D ObjectUnionOf(:A :B))
SubClassOf(:E ObjectMinCardinality(2 :p :A))
TransitiveObjectProperty(:p) ObjectPropertyDomain(:p :A) DataPropertyRange(:d xsd:integer)
ClassAssertion(:A :i) ObjectPropertyAssertion(:p :i :j) DataPropertyAssertion(:d :i "5"^^xsd:integer)
AnnotationAssertion(<http://www.w3.org/2000/01/rdf-schema#label> :A "the \\"A\\""@en)
)"""
MANCHESTER = """Prefix: : <http://e/>
Prefix: xsd: <http://www.w3.org/2001/XMLSchema#>
Prefix: rdfs: <http://www.w3.org/2000/01/rdf-schema#>
Ontology: <http://e/>
Class: :A
    Annotations: rdfs:label "the \\"A\\""@en
    SubClassOf: :B and (:p some :C)
Class: :B
    SubClassOf: :C
Class: :D
    EquivalentTo: :A or :B
Class: :E
    SubClassOf: :p min 2 :A
ObjectProperty: :p
    Characteristics: Transitive
    Domain: :A
DataProperty: :d
    Range: xsd:integer
Individual: :i
    Types: :A
    Facts: :p :j, :d 5
"""


def as_set(axioms):
    return {(k, tuple(a)) for k, a in axioms}


def test_syntaxes_agree(spark):
    a = as_set(owl.parse_functional(FUNCTIONAL))
    b = as_set(owl.parse_manchester(MANCHESTER))
    assert ("SubClassOf", ("<http://e/A>", "ObjectIntersectionOf(<http://e/B> ObjectSomeValuesFrom(<http://e/p> <http://e/C>))")) in a and len(a) == 16
    assert a <= b and {x[0] for x in b - a} == {"Declaration"}
    with pytest.raises(ValueError):
        list(owl.parse_functional("Ontology(SubClassOf(<a> <b>)"))


def test_round_trips(spark, tmp_path):
    (tmp_path / "o.ofn").write_text(FUNCTIONAL)
    axioms = owl.read(spark, str(tmp_path / "o.ofn")).cache()
    want = as_set((r["kind"], r["args"]) for r in axioms.collect())
    for syntax in ("functional", "owlxml", "manchester"):
        text = "\n".join(r.value for r in owl.lines(axioms.coalesce(1), syntax).collect())
        got = as_set(owl.PARSERS[syntax](text))
        assert want <= got and {k for k, _ in got - want} <= {"Declaration"}, syntax
    dl = {r.value for r in owl.lines(axioms, "dl").collect()}
    assert {"A ⊑ (B ⊓ ∃ p.C)", "E ⊑ ≥ 2 p.A", "D ≡ (A ⊔ B)", "A(i)", "∃ p.⊤ ⊑ A"} <= dl
    assert "(implies http://e/B http://e/C)" in {r.value for r in owl.lines(axioms, "krss2").collect()} and any("is_a: C" in r.value for r in owl.lines(axioms, "obo").collect()) and "(define-primitive-concept http://e/B http://e/C)" in {r.value for r in owl.lines(axioms, "krss").collect()}
    owl.write(axioms, str(tmp_path / "ttl"), "turtle")
    assert spark.read.text(str(tmp_path / "ttl")).count() > 5
    assert owl.of_kind(axioms, "ClassAssertion").count() == 1


def test_reasoning_and_figures(spark):
    axioms = spark.createDataFrame(list(owl.parse_functional(FUNCTIONAL)), owl.AXIOMS).cache()
    t = owl.to_triples(axioms)
    got = {(r.s, r.p, r.o) for r in rulesets.reason(t, "owl-horst").collect()}
    assert {("http://e/i", TYPE, "http://e/A"), ("http://e/B", RDFS + "subClassOf", "http://e/C")} <= got
    assert {tuple(r) for r in rulesets.el(t).collect()} >= {("http://e/A", "http://e/C"), ("http://e/A", "http://e/B")}
    named = {(k, tuple(a)) for k, a in owl.parse_functional(FUNCTIONAL) if not any("(" in x and not x.startswith('"') for x in a) or k == "Declaration"}
    assert {(r["kind"], tuple(r["args"])) for r in owl.from_triples(t).collect()} >= {x for x in named if x[0] not in ("DataPropertyRange", "ObjectPropertyDomain", "ObjectPropertyRange")}
    assert dict(map(tuple, stats.axiom_counts(axioms).collect()))["Declaration"] == 5 and {r.node: r.depth for r in stats.hierarchy_depth(axioms).collect()} == {"http://e/C": 0, "http://e/B": 1}
    assert stats.literals(axioms).first().literals == 2 and [tuple(r) for r in stats.datatypes(axioms).collect()] == [(XSD + "integer", 1)] and [tuple(r) for r in stats.languages(axioms).collect()] == [("en", 1)]
    assert [tuple(r) for r in stats.value_per_property(axioms).collect()] == [("http://e/d", 5.0, 5.0)] and {r.iri for r in stats.declared(axioms, "Class").collect()} == {"http://e/A", "http://e/B"}
    assert stats.typed_subjects(axioms).count() == 1 and stats.labeled_subjects(axioms).count() == 1 and stats.links(axioms).count() == 0 and stats.used_classes(axioms).count() == 1 and stats.used_properties(axioms, "Object").count() == 1
    assert stats.class_expressions(axioms, "ObjectUnionOf").count() == 1 and stats.vocabularies(axioms, "p").count() == 2 and stats.degrees(axioms).count() == 2 and stats.properties_per_subject(axioms).count() == 2
    assert dict(map(tuple, stats.summary(axioms).collect()))["classes"] == 2 and stats.entities(axioms).first().entities > 8
