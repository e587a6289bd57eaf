"""Rule sets: each rule alone on a small graph, and engines against each other."""

import duckdb
import pytest

from quadrille.model import OWL, RDF, RDFS, TYPE, XSD, triples
from quadrille.operators import rulesets
from quadrille.plans import rules

INT = XSD + "nonNegativeInteger"


def abox(rule):
    """Facts that match a rule's body: its variables become names."""
    name = lambda x: f"urn:{x[1:]}" if x.startswith("?") else x
    facts = [tuple(map(name, a)) for a in rule.body]
    for a in rule.body:
        if a[1] == rules.OWN + "number":
            n = f'"{a[2][-1]}"^^{INT}'
            facts = [(s, p, n if o == name(a[0]) else o) for s, p, o in facts if p != a[1]] + [(n, a[1], a[2])]
        if a[1] == rules.OWN + "datatype":
            facts = [(f'"5"^^{XSD}integer' if s == name(a[0]) else s, p, f'"5"^^{XSD}integer' if o == name(a[0]) else o) for s, p, o in facts]
    for test in rule.tests:
        if test[0] == "=":
            facts = [tuple(name(test[1]) if x == name(test[2]) else x for x in f) for f in facts]
    return facts


def in_sql(facts, chosen):
    """The closure by the rules' SQL in DuckDB, round after round."""
    con = duckdb.connect()
    con.execute("CREATE TABLE t (s VARCHAR, p VARCHAR, o VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", facts)
    while True:
        new = con.sql(" UNION ".join(f"({rules.rule_sql(r)})" for r in chosen) + " EXCEPT SELECT * FROM t").fetchall()
        if not new:
            return set(con.sql("SELECT * FROM t").fetchall())
        con.executemany("INSERT INTO t VALUES (?, ?, ?)", new)


@pytest.mark.parametrize("name", ["rdfs-full", "owl-horst-full", "owl-rl"])
def test_every_rule_fires(name):
    """Each rule by its SQL, on facts made for it alone."""
    for rule in rulesets.SETS[name]:
        facts = abox(rule)
        got = in_sql(facts, [rule])
        rename = lambda x: f"urn:{x[1:]}" if x.startswith("?") else x
        same = dict(((rename(t[2]), rename(t[1])) for t in rule.tests if t[0] == "="))
        want = {tuple(same.get(rename(x), rename(x)) for x in h) for h in rule.head}
        assert want <= got, rule.name


@pytest.mark.parametrize("name", ["rdfs", "owl-horst", "owl-rl"])
def test_engine_equals_sql(spark, name):
    facts = [("urn:A", RDFS + "subClassOf", "urn:B"), ("urn:B", RDFS + "subClassOf", "urn:C"), ("urn:x", TYPE, "urn:A"), ("urn:p", RDFS + "domain", "urn:A"), ("urn:q", RDFS + "subPropertyOf", "urn:p"), ("urn:y", "urn:q", "urn:z"),
             ("urn:y", "urn:q", '"5"^^' + XSD + "integer"), ("urn:t", TYPE, OWL + "TransitiveProperty"), ("urn:a", "urn:t", "urn:b"), ("urn:b", "urn:t", "urn:c"), ("urn:f", TYPE, OWL + "FunctionalProperty"), ("urn:a", "urn:f", "urn:u"),
             ("urn:a", "urn:f", "urn:v"), ("urn:u", "urn:t", "urn:a"), ("urn:i", OWL + "inverseOf", "urn:t"), ("urn:R", OWL + "onProperty", "urn:t"), ("urn:R", OWL + "someValuesFrom", "urn:C"), ("urn:b", "urn:t", "urn:x"), ("urn:C", OWL + "disjointWith", "urn:R"),
             ("urn:c", TYPE, "urn:R"), ("urn:c", TYPE, "urn:C")]
    chosen = rulesets.SETS[name]
    df = spark.createDataFrame(facts, "s string, p string, o string").coalesce(1)
    want = in_sql(facts, chosen)
    assert {tuple(r) for r in rules.saturate(df, chosen).collect()} == want
    if name == "rdfs":
        assert {tuple(r) for r in rules.saturate_in_layers(df, chosen).collect()} == want
        entailed = {tuple(r) for r in rulesets.ask_backward(rules.decode(df)).collect()}
        assert entailed == want
        assert {tuple(r) for r in rulesets.ask_backward(rules.decode(df), p=TYPE, o="urn:C").collect()} == {f for f in want if f[1] == TYPE and f[2] == "urn:C"}


def test_layers_and_minimal():
    groups = rules.layers(rulesets.RDFS_RULES)
    place = {r.name: k for k, (g, _) in enumerate(groups) for r in g}
    after = rules.dependencies(rulesets.RDFS_RULES)
    assert all(place[a] <= place[b] for a in after for b in after[a])
    extra = rules.parse_rules("same: ?u rdfs:subClassOf ?v, ?w a ?u -> ?w a ?v\nvoid: ?x a ?c -> ?x a ?c")
    assert [r.name for r in rules.minimal(rulesets.RDFS_RULES + extra)] == [r.name for r in rulesets.RDFS_RULES]


def test_lists_numbers_and_violations(spark):
    t = triples(spark, [("urn:C", OWL + "oneOf", "_:l"), ("_:l", RDF + "first", "urn:x"), ("_:l", RDF + "rest", "_:m"), ("_:m", RDF + "first", "urn:y"), ("_:m", RDF + "rest", RDF + "nil"),
                        ("urn:R", OWL + "onProperty", "urn:p"), ("urn:R", OWL + "maxCardinality", "1", 2, INT), ("urn:b", TYPE, "urn:R"), ("urn:b", "urn:p", "urn:c"), ("urn:b", "urn:p", "urn:d"), ("urn:c", OWL + "differentFrom", "urn:d"), ("urn:C", OWL + "disjointWith", "urn:D"), ("urn:x", TYPE, "urn:D")])
    got = {(r.s, r.p, r.o) for r in rulesets.reason(t, "owl-rl").collect()}
    assert {("urn:x", TYPE, "urn:C"), ("urn:y", TYPE, "urn:C"), ("urn:c", OWL + "sameAs", "urn:d")} <= got and not any(p in (rules.OWN + "member", rules.OWN + "number") for _, p, _ in got)
    assert {tuple(r) for r in rulesets.violations(t).collect()} == {("urn:c", "eq-diff1"), ("urn:d", "eq-diff1"), ("urn:x", "cax-dw")}


def test_el(spark):
    some = lambda n, p, d: [(n, OWL + "onProperty", p), (n, OWL + "someValuesFrom", d)]
    sub = lambda a, b: (a, RDFS + "subClassOf", b)
    t = triples(spark, [sub("urn:A", "urn:B"), sub("urn:B", "_:r"), *some("_:r", "urn:p", "urn:D"), sub("urn:D", "urn:E"), *some("_:s", "urn:q", "urn:E"), sub("_:s", "urn:F"), ("urn:p", RDFS + "subPropertyOf", "urn:q"),
                        ("_:i", OWL + "intersectionOf", "_:l"), ("_:l", RDF + "first", "urn:B"), ("_:l", RDF + "rest", "_:m"), ("_:m", RDF + "first", "urn:F"), ("_:m", RDF + "rest", RDF + "nil"), sub("_:i", "urn:G"),
                        sub("urn:X", "_:x"), *some("_:x", "urn:p", "urn:N"), sub("urn:N", OWL + "Nothing"),
                        ("urn:u", OWL + "propertyChainAxiom", "_:c"), ("_:c", RDF + "first", "urn:p"), ("_:c", RDF + "rest", "_:d"), ("_:d", RDF + "first", "urn:v"), ("_:d", RDF + "rest", RDF + "nil"), sub("urn:D", "_:y"), *some("_:y", "urn:v", "urn:Z"), *some("_:z", "urn:u", "urn:Z"), sub("_:z", "urn:W")])
    got = {tuple(r) for r in rulesets.el(t).collect()}
    assert got == {("urn:A", "urn:B"), ("urn:D", "urn:E"), ("urn:A", "urn:F"), ("urn:B", "urn:F"), ("urn:A", "urn:G"), ("urn:B", "urn:G"), ("urn:X", OWL + "Nothing"), ("urn:N", OWL + "Nothing"), ("urn:A", "urn:W"), ("urn:B", "urn:W")}


def test_kinds(spark):
    t = triples(spark, [("urn:a", TYPE, "urn:C"), ("urn:b", TYPE, "urn:C"), ("urn:a", "urn:p", "urn:b"), ("urn:b", "urn:p", "urn:a"), ("urn:c", "urn:p", "5", 2, INT)])
    got = {(r.types, r.outgoing, r.incoming): r.n for r in rulesets.kinds_of_things(t).collect()}
    assert got[("urn:C", "urn:p", "urn:p")] == 2 and got[("", "urn:p", "")] == 1
