"""Rule sets of the RDFS, OWL Horst, OWL RL and EL entailments, and reasoners over them.

Violations are facts (thing, q:violation, q:rule name).  Lists are seen through q:member.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import OWL, RDF, RDFS, TYPE
from ..plans.fixpoint import closure
from ..plans.rules import OWN, Rule, decode, encode, members, parse_rules, saturate

#: The rules of the RDFS entailment.
RDFS_RULES = parse_rules("""
rdfs2: ?p rdfs:domain ?c, ?x ?p ?y -> ?x a ?c
rdfs3: ?p rdfs:range ?c, ?x ?p ?y, resource ?y -> ?y a ?c
rdfs5: ?p rdfs:subPropertyOf ?q, ?q rdfs:subPropertyOf ?r -> ?p rdfs:subPropertyOf ?r
rdfs7: ?p rdfs:subPropertyOf ?q, ?x ?p ?y -> ?x ?q ?y
rdfs9: ?c rdfs:subClassOf ?d, ?x a ?c -> ?x a ?d
rdfs11: ?c rdfs:subClassOf ?d, ?d rdfs:subClassOf ?e -> ?c rdfs:subClassOf ?e
""")
#: Rules that add what holds of everything.
AXIOMATIC_RULES = parse_rules("""
rdfs4a: ?x ?p ?y -> ?x a rdfs:Resource
rdfs4b: ?x ?p ?y, resource ?y -> ?y a rdfs:Resource
rdfs6: ?p a rdf:Property -> ?p rdfs:subPropertyOf ?p
rdfs8: ?c a rdfs:Class -> ?c rdfs:subClassOf rdfs:Resource
rdfs10: ?c a rdfs:Class -> ?c rdfs:subClassOf ?c
rdfs12: ?p a rdfs:ContainerMembershipProperty -> ?p rdfs:subPropertyOf rdfs:member
rdfs13: ?d a rdfs:Datatype -> ?d rdfs:subClassOf rdfs:Literal
""")
#: The rules of the pD* (OWL Horst) entailment.
HORST_RULES = parse_rules("""
rdfp1: ?p a owl:FunctionalProperty, ?x ?p ?y, ?x ?p ?z, ?y != ?z, resource ?y, resource ?z -> ?y owl:sameAs ?z
rdfp2: ?p a owl:InverseFunctionalProperty, ?x ?p ?z, ?y ?p ?z, ?x != ?y -> ?x owl:sameAs ?y
rdfp3: ?p a owl:SymmetricProperty, ?x ?p ?y, resource ?y -> ?y ?p ?x
rdfp4: ?p a owl:TransitiveProperty, ?x ?p ?y, ?y ?p ?z -> ?x ?p ?z
rdfp6: ?x owl:sameAs ?y -> ?y owl:sameAs ?x
rdfp7: ?x owl:sameAs ?y, ?y owl:sameAs ?z, ?x != ?z -> ?x owl:sameAs ?z
rdfp8ax: ?p owl:inverseOf ?q, ?x ?p ?y, resource ?y -> ?y ?q ?x
rdfp8bx: ?p owl:inverseOf ?q, ?x ?q ?y, resource ?y -> ?y ?p ?x
rdfp12a: ?c owl:equivalentClass ?d -> ?c rdfs:subClassOf ?d
rdfp12b: ?c owl:equivalentClass ?d -> ?d rdfs:subClassOf ?c
rdfp12c: ?c rdfs:subClassOf ?d, ?d rdfs:subClassOf ?c, ?c != ?d -> ?c owl:equivalentClass ?d
rdfp13a: ?p owl:equivalentProperty ?q -> ?p rdfs:subPropertyOf ?q
rdfp13b: ?p owl:equivalentProperty ?q -> ?q rdfs:subPropertyOf ?p
rdfp13c: ?p rdfs:subPropertyOf ?q, ?q rdfs:subPropertyOf ?p, ?p != ?q -> ?p owl:equivalentProperty ?q
rdfp14a: ?r owl:hasValue ?v, ?r owl:onProperty ?p, ?x ?p ?v -> ?x a ?r
rdfp14bx: ?r owl:hasValue ?v, ?r owl:onProperty ?p, ?x a ?r -> ?x ?p ?v
rdfp15: ?r owl:someValuesFrom ?d, ?r owl:onProperty ?p, ?x ?p ?y, ?y a ?d -> ?x a ?r
rdfp16: ?r owl:allValuesFrom ?d, ?r owl:onProperty ?p, ?x ?p ?y, ?x a ?r, resource ?y -> ?y a ?d
""")
#: Everything that is named is the same as itself; apart, as it doubles most graphs.
REFLEXIVE_RULES = parse_rules("""
rdfp5a: ?x ?p ?y -> ?x owl:sameAs ?x
rdfp5b: ?x ?p ?y, resource ?y -> ?y owl:sameAs ?y
eq-all: ?x a owl:Thing -> ?x owl:sameAs ?x
""")
#: The rules of the OWL RL profile.
RL_RULES = parse_rules("""
prp-dom: ?p rdfs:domain ?c, ?x ?p ?y -> ?x a ?c
prp-rng: ?p rdfs:range ?c, ?x ?p ?y, resource ?y -> ?y a ?c
prp-fp: ?p a owl:FunctionalProperty, ?x ?p ?y, ?x ?p ?z, ?y != ?z, resource ?y, resource ?z -> ?y owl:sameAs ?z
prp-ifp: ?p a owl:InverseFunctionalProperty, ?x ?p ?z, ?y ?p ?z, ?x != ?y -> ?x owl:sameAs ?y
prp-symp: ?p a owl:SymmetricProperty, ?x ?p ?y -> ?y ?p ?x
prp-trp: ?p a owl:TransitiveProperty, ?x ?p ?y, ?y ?p ?z -> ?x ?p ?z
prp-spo1: ?p rdfs:subPropertyOf ?q, ?p != ?q, ?x ?p ?y -> ?x ?q ?y
prp-inv1: ?p owl:inverseOf ?q, ?x ?p ?y -> ?y ?q ?x
prp-inv2: ?p owl:inverseOf ?q, ?x ?q ?y -> ?y ?p ?x
scm-spo: ?p rdfs:subPropertyOf ?q, ?q rdfs:subPropertyOf ?r -> ?p rdfs:subPropertyOf ?r
scm-sco: ?c rdfs:subClassOf ?d, ?d rdfs:subClassOf ?e -> ?c rdfs:subClassOf ?e
scm-eqc: ?c owl:equivalentClass ?d -> ?c rdfs:subClassOf ?d, ?d rdfs:subClassOf ?c
scm-eqp: ?p owl:equivalentProperty ?q -> ?p rdfs:subPropertyOf ?q, ?q rdfs:subPropertyOf ?p
cls-svf1a: ?r owl:onProperty ?p, ?r owl:someValuesFrom ?d, ?x ?p ?y, ?y a ?d -> ?x a ?r
cls-svf1b: ?r owl:onProperty ?p, ?r owl:someValuesFrom ?d, ?x ?p ?y, ?y q:datatype ?d -> ?x a ?r
cls-svf2: ?r owl:onProperty ?p, ?r owl:someValuesFrom owl:Thing, ?x ?p ?y -> ?x a ?r
cls-avf: ?r owl:onProperty ?p, ?r owl:allValuesFrom ?d, ?x ?p ?y, ?x a ?r, resource ?y -> ?y a ?d
cls-hv1: ?r owl:onProperty ?p, ?r owl:hasValue ?v, ?x a ?r -> ?x ?p ?v
cls-hv2: ?r owl:onProperty ?p, ?r owl:hasValue ?v, ?x ?p ?v -> ?x a ?r
cls-maxc2: ?r owl:onProperty ?p, ?r owl:maxCardinality ?n, ?n q:number q:1, ?x a ?r, ?x ?p ?y, ?x ?p ?z, ?y != ?z, resource ?y, resource ?z -> ?y owl:sameAs ?z
cls-maxqc3: ?r owl:maxQualifiedCardinality ?n, ?n q:number q:1, ?r owl:onProperty ?p, ?r owl:onClass ?c, ?x a ?r, ?x ?p ?y, ?y a ?c, ?x ?p ?z, ?z a ?c, ?y != ?z -> ?y owl:sameAs ?z
cls-maxqc4: ?r owl:maxQualifiedCardinality ?n, ?n q:number q:1, ?r owl:onProperty ?p, ?r owl:onClass owl:Thing, ?x a ?r, ?x ?p ?y, ?x ?p ?z, ?y != ?z, resource ?y, resource ?z -> ?y owl:sameAs ?z
cls-oo: ?c owl:oneOf ?l, ?l q:member ?x -> ?x a ?c
cax-sco: ?c rdfs:subClassOf ?d, ?c != ?d, ?x a ?c -> ?x a ?d
cax-eqc1: ?c owl:equivalentClass ?d, ?c != ?d, ?x a ?c -> ?x a ?d
cax-eqc2: ?c owl:equivalentClass ?d, ?c != ?d, ?x a ?d -> ?x a ?c
eq-sym: ?x owl:sameAs ?y -> ?y owl:sameAs ?x
eq-trans: ?x owl:sameAs ?y, ?y owl:sameAs ?z, ?x != ?z -> ?x owl:sameAs ?z
eq-rep-s: ?x owl:sameAs ?y, ?x != ?y, ?x ?p ?v -> ?y ?p ?v
eq-rep-o: ?x owl:sameAs ?y, ?x != ?y, ?v ?p ?x -> ?v ?p ?y
distinct: ?w owl:distinctMembers ?l, ?l q:member ?x, ?l q:member ?y, ?x != ?y -> ?x owl:differentFrom ?y
prp-irp: ?p a owl:IrreflexiveProperty, ?x ?p ?x -> ?x q:violation q:prp-irp
prp-asyp: ?p a owl:AsymmetricProperty, ?x ?p ?y, ?y ?p ?x -> ?x q:violation q:prp-asyp
prp-pdw: ?p owl:propertyDisjointWith ?q, ?x ?p ?y, ?x ?q ?y -> ?x q:violation q:prp-pdw
prp-adp: ?d a owl:AllDisjointProperties, ?d owl:members ?l, ?l q:member ?p, ?l q:member ?q, ?p != ?q, ?x ?p ?y, ?x ?q ?y -> ?x q:violation q:prp-adp
cls-maxc1: ?r owl:onProperty ?p, ?r owl:maxCardinality ?n, ?n q:number q:0, ?x a ?r, ?x ?p ?y -> ?x q:violation q:cls-maxc1
cls-maxqc1: ?r owl:maxQualifiedCardinality ?n, ?n q:number q:0, ?r owl:onProperty ?p, ?r owl:onClass ?c, ?x a ?r, ?x ?p ?y, ?y a ?c -> ?x q:violation q:cls-maxqc1
cls-maxqc2: ?r owl:maxQualifiedCardinality ?n, ?n q:number q:0, ?r owl:onProperty ?p, ?r owl:onClass owl:Thing, ?x a ?r, ?x ?p ?y -> ?x q:violation q:cls-maxqc2
cls-com: ?c owl:complementOf ?d, ?x a ?c, ?x a ?d -> ?x q:violation q:cls-com
cax-dw: ?c owl:disjointWith ?d, ?x a ?c, ?x a ?d -> ?x q:violation q:cax-dw
eq-diff1: ?x owl:differentFrom ?y, ?x owl:sameAs ?y -> ?x q:violation q:eq-diff1
validationIndiv3: ?x a owl:Nothing -> ?x q:violation q:validationIndiv3
""")
#: The completion rules of EL.  Roles of existentials are predicates; normal forms are nodes with q: properties.
EL_RULES = parse_rules("""
CR1: ?c rdfs:subClassOf ?d, ?d rdfs:subClassOf ?e -> ?c rdfs:subClassOf ?e
CR2: ?n q:left ?a, ?n q:right ?b, ?n q:under ?d, ?c rdfs:subClassOf ?a, ?c rdfs:subClassOf ?b -> ?c rdfs:subClassOf ?d
CR3: ?n q:some ?r, ?n q:of ?d, ?c rdfs:subClassOf ?n -> ?c ?r ?d
CR4: ?n q:some ?r, ?n q:of ?b, ?c ?r ?d, ?d rdfs:subClassOf ?b -> ?c rdfs:subClassOf ?n
CR5: ?r a q:Role, ?c ?r ?d, ?d rdfs:subClassOf owl:Nothing -> ?c rdfs:subClassOf owl:Nothing
CR10: ?r q:subRole ?s, ?c ?r ?d -> ?c ?s ?d
CR11: ?n q:first ?r, ?n q:second ?s, ?n q:chain ?u, ?c ?r ?d, ?d ?s ?e -> ?c ?u ?e
""")
SETS: dict[str, list[Rule]] = {"rdfs": RDFS_RULES, "rdfs-full": RDFS_RULES + AXIOMATIC_RULES, "owl-horst": RDFS_RULES + HORST_RULES, "owl-horst-full": RDFS_RULES + HORST_RULES + REFLEXIVE_RULES, "owl-rl": RL_RULES}


def _fact(df: DataFrame, s, p, o) -> DataFrame:
    col = lambda x: F.lit(x) if isinstance(x, str) and ":" in x else F.col(x) if isinstance(x, str) else x
    return df.select(col(s).alias("s"), col(p).alias("p"), col(o).alias("o"))


def _helpers(facts: DataFrame) -> DataFrame:
    """Facts that rules look lists, numbers and datatypes up in; literals stand as subjects in them, and never come out."""
    number = facts.where(F.col("p").isin(OWL + "maxCardinality", OWL + "maxQualifiedCardinality")).select("o", F.regexp_extract("o", r'^"(\d+)"', 1).alias("n")).where("n in ('0', '1')")
    some = facts.where(F.col("p") == OWL + "someValuesFrom").select(F.col("o").alias("d")).distinct()
    typed = facts.where(F.col("o").startswith('"')).select("o", F.regexp_extract("o", r'(?s)"\^\^(.*)$', 1).alias("d")).join(some, "d", "left_semi")
    return members(facts).unionByName(_fact(number, "o", OWN + "number", F.concat(F.lit(OWN), "n"))).unionByName(_fact(typed, "o", OWN + "datatype", "d")).distinct()


def reason(t: DataFrame, rules: str | list[Rule] = "rdfs") -> DataFrame:
    """t with all that a rule set, named or given, adds to it."""
    chosen = SETS[rules] if isinstance(rules, str) else rules
    facts = encode(t)
    helped = any(OWN in term for r in chosen for a in r.body for term in a)
    done = saturate(facts.unionByName(_helpers(facts)) if helped else facts, chosen)
    if helped:
        done = done.where(~F.col("p").isin(OWN + "member", OWN + "number", OWN + "datatype"))
    return decode(done)


def violations(t: DataFrame) -> DataFrame:
    """thing, rule: what contradicts the ontology under OWL RL."""
    return reason(t, "owl-rl").where(F.col("p") == OWN + "violation").select(F.col("s").alias("thing"), F.regexp_extract("o", f"^{OWN}(.*)$", 1).alias("rule"))


def el_normal(t: DataFrame) -> DataFrame:
    """An ontology in triples as facts of the EL rules: subclasses, existentials, intersections, role hierarchy and chains of two."""
    f = encode(t)
    of = lambda p, a, b: f.where(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b))
    sub = of(RDFS + "subClassOf", "a", "b")
    same = of(OWL + "equivalentClass", "a", "b")
    sub = sub.unionByName(same).unionByName(same.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    on, some = of(OWL + "onProperty", "n", "r"), of(OWL + "someValuesFrom", "n", "d")
    first, rest = of(RDF + "first", "l", "x"), of(RDF + "rest", "l", "m")
    item = members(f).select(F.col("s").alias("l"), F.col("o").alias("x"))
    pair = first.join(rest, "l").join(first.select(F.col("l").alias("m"), F.col("x").alias("y")), "m")
    # An intersection lies under each part; of each longer list the rest is an intersection of its own.
    conj = of(OWL + "intersectionOf", "c", "l")
    tails = closure(rest.where(F.col("m") != RDF + "nil").select(F.col("l").alias("a"), F.col("m").alias("b")))
    nodes = conj.unionByName(conj.join(tails, conj.l == tails.a).select(F.col("b").alias("c"), F.col("b").alias("l"))).distinct()
    parts = nodes.join(item, "l")
    both = nodes.join(first, "l").join(rest, "l").select("c", "x", F.when(F.col("m") == RDF + "nil", F.col("x")).otherwise(F.col("m")).alias("m"))
    chain = of(OWL + "propertyChainAxiom", "u", "l").join(pair, "l")
    node = lambda *c: F.concat_ws("|", F.lit(OWN + "n"), *c)
    roles = on.join(some, "n")
    every = sub.select(F.explode(F.array("a", "b")).alias("c")).union(some.select("d")).union(parts.select("x")).distinct()
    made = [
        _fact(sub, "a", RDFS + "subClassOf", "b"),
        _fact(every, "c", RDFS + "subClassOf", "c"),
        _fact(parts, "c", RDFS + "subClassOf", "x"),
        _fact(roles, "n", OWN + "some", "r"),
        _fact(roles, "n", OWN + "of", "d"),
        _fact(roles, "r", TYPE, OWN + "Role"),
        _fact(of(RDFS + "subPropertyOf", "a", "b"), "a", OWN + "subRole", "b"),
    ]
    for p, c in (("left", F.col("x")), ("right", F.col("m")), ("under", F.col("c"))):
        made.append(_fact(both, node("c", "x", "m"), OWN + p, c))
    for p, c in (("first", F.col("x")), ("second", F.col("y")), ("chain", F.col("u"))):
        made.append(_fact(chain, node("u", "x", "y"), OWN + p, c))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out.distinct()


def el(t: DataFrame) -> DataFrame:
    """a, b: every named class and what it lies under, by the EL completion."""
    done = saturate(el_normal(t), EL_RULES).where(F.col("p") == RDFS + "subClassOf")
    return done.where(~F.col("s").startswith("_:") & ~F.col("o").startswith("_:") & (F.col("s") != F.col("o"))).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()


def ask_backward(t: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """s, p, o of the statements that RDFS entails and a pattern asks for: the pattern is rewritten over the closed schema, and nothing else is derived."""
    f = encode(t)
    up = lambda q: closure(f.where(F.col("p") == q).select(F.col("s").alias("a"), F.col("o").alias("b")))
    properties = up(RDFS + "subPropertyOf").where("a <> b")
    inherited = f.join(properties, f.p == properties.a).select("s", F.col("b").alias("p"), "o")
    known = f.unionByName(inherited)
    parts = []
    if p in (None, RDFS + "subClassOf"):
        parts.append(_fact(up(RDFS + "subClassOf"), "a", RDFS + "subClassOf", "b"))
    if p in (None, RDFS + "subPropertyOf"):
        parts.append(_fact(properties, "a", RDFS + "subPropertyOf", "b"))
    if p in (None, TYPE):
        classes = up(RDFS + "subClassOf").select(F.col("a").alias("c"), F.col("b").alias("d"))
        wanted = classes.where(F.col("d") == o).select("c").unionByName(f.sparkSession.createDataFrame([(o,)], "c string")) if o else None
        typed = known.where(F.col("p") == TYPE).select("s", F.col("o").alias("c"))
        for relation, end in ((RDFS + "domain", "s"), (RDFS + "range", "o")):
            of = f.where(F.col("p") == relation).select(F.col("s").alias("q"), F.col("o").alias("c"))
            facts = known.where(~F.col(end).startswith('"'))
            typed = typed.unionByName(facts.join(of, facts.p == of.q).select(F.col(end).alias("s"), "c"))
        if wanted is not None:
            rows = typed.join(wanted.distinct(), "c", "left_semi").select("s").distinct().withColumn("c", F.lit(o))
        else:
            rows = typed.unionByName(typed.join(classes, "c").select("s", F.col("d").alias("c")))
        parts.append(_fact(rows, "s", TYPE, "c"))
    if p not in (RDFS + "subClassOf", TYPE):
        parts.append(known.where(F.col("p") == p) if p else known)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    for name, value in (("s", s), ("p", p), ("o", o)):
        out = out if value is None else out.where(F.col(name) == value)
    return out.distinct()


def schema_of(t: DataFrame) -> DataFrame:
    """The statements that describe classes and properties."""
    schema = [RDFS + x for x in ("subClassOf", "subPropertyOf", "domain", "range")] + [OWL + x for x in ("equivalentClass", "equivalentProperty", "inverseOf", "onProperty", "someValuesFrom", "allValuesFrom", "hasValue")]
    return t.where(F.col("p").isin(*schema))


def kinds_of_things(t: DataFrame) -> DataFrame:
    """types, outgoing, incoming, n: how many things have the same types and the same properties to and from them."""
    types = t.where(F.col("p") == TYPE).select(F.col("s").alias("x"), F.lit("t").alias("k"), F.col("o").alias("v"))
    out = t.where(F.col("p") != TYPE).select(F.col("s").alias("x"), F.lit("o").alias("k"), F.col("p").alias("v"))
    back = t.where((F.col("p") != TYPE) & (F.col("t") < 2)).select(F.col("o").alias("x"), F.lit("i").alias("k"), F.col("p").alias("v"))
    # Kinds and properties are few, so a thing's sets are small whatever its number of statements.
    rows = types.unionByName(out).unionByName(back).distinct()
    pick = lambda k: F.array_join(F.sort_array(F.collect_set(F.when(F.col("k") == k, F.col("v")))), " ")
    return rows.groupBy("x").agg(pick("t").alias("types"), pick("o").alias("outgoing"), pick("i").alias("incoming")).groupBy("types", "outgoing", "incoming").agg(F.count("*").alias("n"))
