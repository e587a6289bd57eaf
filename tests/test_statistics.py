"""Statistics whose work is one row a node or a few passes."""

from quadrille.model import TYPE, triples
from quadrille.operators import statistics


def test_properties_per_node(spark):
    for names in (["it's \\ \"odd\"", "\\", "q'"], [f"urn:p{k}" for k in range(150)], [f"urn:p{k}" for k in range(300)]):
        rows = [(f"urn:s{k % 7}", p, f"urn:o{k % 3}") for k, p in enumerate(names * 2)]
        t = triples(spark, rows)
        for place, at in (("s", 0), ("o", 2)):
            want = {x: len({r[1] for r in rows if r[at] == x}) for x in {r[at] for r in rows}}
            assert {r.node: r.n for r in statistics.properties_per(t, place).collect()} == want
    assert statistics.properties_per(t.where("false"), "s").collect() == []
    few = statistics.properties_per(triples(spark, [("urn:a", "urn:p", "urn:b"), ("urn:a", "urn:q", "urn:b")]), "s")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate(keys=[s#" in plan  # a row a node is sent, not one for each of its properties


def test_description_in_two_passes(spark):
    t = triples(spark, [("_:n", TYPE, "urn:A"), ("urn:x", "urn:v#p", "3", 2, "urn:int"), ("urn:x", "urn:v#q", "urn:y"), ("urn:y", "urn:v#q", "urn:x"), ("urn:y", "urn:v#q", "_:n", 0), ("urn:y", "urn:v#r", "x", 2, None, "en")])
    got = statistics.describe(t)
    want = {("triples", None): 6, ("distinctSubjects", None): 2, ("distinctObjects", None): 3, ("entities", None): 7, ("classPartition", "urn:A"): 1, ("datatype", "urn:int"): 1}
    want |= {("propertyPartition", TYPE): 1, ("propertyPartition", "urn:v#p"): 1, ("propertyPartition", "urn:v#q"): 3, ("propertyPartition", "urn:v#r"): 1, ("vocabulary", TYPE.split("#")[0] + "#"): 1, ("vocabulary", "urn:v#"): 5}
    assert {(r.criterion, r.key): r.n for r in got.collect()} == want
    assert {(r.criterion, r.key): r.n for r in statistics.describe(t.where("s = 'none'")).collect()} == {("triples", None): 0, ("distinctSubjects", None): 0, ("distinctObjects", None): 0, ("entities", None): 0}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("LogicalRDD") == 2
