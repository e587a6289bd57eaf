"""Sets of triples, queries for each graph, placements, dictionaries and quality."""

import json

from pyspark.sql import functions as F

from quadrille.model import OWL, RDFS, TYPE, XSD, triples
from quadrille.operators import algebra, graph, partition, statistics
from quadrille.plans.sparql import plain
from quadrille.sources import documents, mapping

INT = XSD + "integer"
ROWS = [("urn:a", "urn:p", "urn:b"), ("urn:a", "urn:p", "urn:b"), ("urn:b", "urn:p", "urn:c"), ("urn:c", "urn:q", "5", 2, INT), ("urn:c", "urn:q", "x", 2, INT), ("urn:a", TYPE, "urn:C"), ("urn:C", TYPE, OWL + "Class"), ("urn:D", TYPE, OWL + "Class")]


def test_sets(spark):
    t = triples(spark, ROWS)
    assert algebra.contains(t, p="urn:q") and not algebra.contains(t, s="urn:z")
    assert algebra.contains_all(t, t.limit(3)) and not algebra.contains_all(t.where("p = 'urn:p'"), t) and algebra.contains_any(t, t.limit(1)) and not algebra.contains_any(t, triples(spark, [("urn:z", "urn:p", "urn:b")]))
    assert algebra.remove(t, [("urn:a", "urn:p", "urn:b")]).count() == 6 and algebra.add(t, [("urn:z", "urn:p", "urn:b")]).count() == 9
    assert graph.difference(algebra.union_all(t, t), t).count() == 0 and algebra.filter_place(t, "p", {"urn:q"}).count() == 2 and algebra.filter_place(t, "o", lambda c: c.endswith("b")).count() == 2
    t.createOrReplaceTempView("triples")
    assert spark.sql(algebra.find_sql(s="urn:a", p="urn:p")).count() == 2
    records = algebra.records(t, "p", 1)
    assert records.where("key = 'urn:q'").count() >= 1 and sorted(map(tuple, algebra.statements(records).collect()), key=repr) == sorted(map(tuple, t.collect()), key=repr)
    assert len(algebra.to_graph(t)) == 8


def test_each_graph(spark):
    quads = documents.loads(spark, "@prefix e: <http://e/> . e:g1 { e:a e:p 1 , 2 . e:g1 e:k 9 } e:g2 { e:a e:p 5 . e:a e:q e:b }", "trig")
    got = {(r.g, r.n.v) for r in algebra.each_graph(quads, "SELECT (COUNT(*) AS ?n) WHERE { ?s <http://e/p> ?o }").collect()}
    assert got == {("http://e/g1", "2"), ("http://e/g2", "1")}
    made = algebra.construct_each(quads, "CONSTRUCT { ?o <http://e/r> ?s } WHERE { ?s <http://e/q> ?o }").collect()
    assert [(r.s, r.o, r.g) for r in made] == [("http://e/b", "http://e/a", "http://e/g2")]
    assert algebra.graphs_where(quads, "ASK { ?s <http://e/q> ?o }").count() == 2 and algebra.graphs_where(quads, "ASK { ?s <http://e/q> ?o }", drop=True).count() == 3
    assert [r.g[-2:] for r in algebra.graphs_by(quads, "SELECT ?o WHERE { ?s <http://e/p> ?o }", descending=True).collect()] == ["g2", "g1"]
    assert [r.s for r in algebra.natural_resources(quads).collect()] == ["http://e/g1"]
    assert sum(int(r.n.v) for r in algebra.each_partition(quads, "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }").collect()) == 5


def test_placements(spark):
    t = triples(spark, [(f"urn:{a}", "urn:p", f"urn:{b}") for a, b in (("a", "b"), ("b", "c"), ("x", "c"), ("y", "z"), ("z", "y"))])
    for placed in (partition.by_subject(t, 3), partition.by_object(t, 3), partition.by_both(t, 3), partition.by_path(t, 3), partition.by_subject(t, 3, hops=2)):
        assert placed.drop("part").distinct().count() == 5 and placed.where("part < 0 or part > 2").isEmpty()
    m = partition.measures(partition.by_both(t, 3), 3).first()
    assert 1 <= m.duplication <= 2 and m.balance >= 1 and 0 < m.efficiency <= 1
    place = {r.n: r.part for r in spark.createDataFrame([("urn:a",), ("urn:x",)], "n string").select("n", partition.place_of(F.col("n"), 3).alias("part")).collect()}
    paths = {(r.s, r.part) for r in partition.by_path(t, 3).collect()}
    assert {("urn:a", place["urn:a"]), ("urn:b", place["urn:a"]), ("urn:x", place["urn:x"])} <= paths
    assert {tuple(r.path) for r in partition.paths(t.select(F.col("s").alias("src"), F.col("o").alias("dst")), 2).collect()} == {("urn:a", "urn:b"), ("urn:b", "urn:c"), ("urn:x", "urn:c"), ("urn:y", "urn:z"), ("urn:z", "urn:y"), ("urn:a", "urn:b", "urn:c")}


def test_dictionaries_and_tables(spark, tmp_path):
    t = triples(spark, ROWS).distinct()
    coded, books = partition.encode(t)
    partition.save_tables(coded, books, str(tmp_path / "hdt"))
    assert {tuple(r) for r in partition.decode(*partition.read_tables(spark, str(tmp_path / "hdt"))).collect()} == {(r[0], r[1], r[2]) for r in ROWS}
    facts, entities, relations = partition.tensor(t)
    assert facts.count() == 5 and sorted(r.id for r in entities.collect()) == list(range(1, entities.count() + 1)) and relations.count() == 2
    views = partition.register_vertical(t)
    assert spark.table(views["urn:p"]).count() == 2
    text = partition.vertical_mapping(["urn:p", "urn:q"], {"urn:q": INT})
    assert {(r.s, r.p, r.o, r.dt) for r in mapping.triples(spark, text).collect()} == {("urn:a", "urn:p", "urn:b", None), ("urn:b", "urn:p", "urn:c", None), ("urn:c", "urn:q", "5", INT), ("urn:c", "urn:q", "x", INT)}
    partition.persist_vertical(t, str(tmp_path / "vp"))
    assert spark.read.parquet(str(tmp_path / "vp")).where("predicate = 'urn:p'").count() == 2
    partition.persist_property_table(t, str(tmp_path / "pt"), ["urn:p"])
    assert spark.read.parquet(str(tmp_path / "pt")).count() == 2
    assert {json.loads(r.value)["kind"] for r in partition.graph_json(t).collect()} == {"node", "link"} and partition.vertices(t).count() == 8 and partition.hashed_graph(t).count() == 7


def test_quality(spark):
    t = triples(spark, [*ROWS, ("urn:C", RDFS + "label", "c", 2, XSD + "string")])
    assert {(r.dt, r.valid, r.wrong) for r in statistics.valid_literals(t).collect()} == {(INT, 1, 1), (XSD + "string", 1, 0)}
    assert tuple(statistics.numeric_range(t, "urn:q", 0, 10).first()) == (1, 1.0)
    assert tuple(statistics.property_completeness(t, "urn:C", "urn:p").first()) == (1, 1.0) and tuple(statistics.schema_completeness(t).first()) == (2, 0.5)
    assert tuple(statistics.dereferenceable(t, "s", "urn:", lambda iris: [x == "urn:a" for x in iris]).first()) == (5, 0.2)
    lines = [r.value for r in statistics.void_description(t, "urn:d").collect()]
    assert len(list(documents.parse_turtle("\n".join(lines)))) > len(lines) and any("classPartition" in x for x in lines)
    assert plain(spark.range(0).select()).columns == []
