"""Rules as text, and their closure over triples by semi-naive joins.

A rule is a line "name: atoms -> atoms"; an atom is three terms (?x, prefix:name or a full name in < >), or a test: ?x != ?y, ?x = ?y, literal ?x, resource ?x.
Terms are compared as one string each, so that rules see triples of three columns; literals carry their datatype or language in it.

A round joins what is new with all that is known, once for each atom that new facts can match; a look at the constants of rules shows which ones those are, so
rules without facts cost nothing.  New facts are appended, and put together only now and then.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import OWL, RDF, RDFS, XSD
from .fixpoint import closure, cut

OWN = "urn:quadrille:"
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "q": OWN}
#: Parts of the known facts after which they are put together.
PARTS = 8
LITERAL = r'^"(.*)"(?:\^\^(.*)|@(.*))$'


@dataclass
class Rule:
    name: str
    body: list[tuple[str, str, str]]
    head: list[tuple[str, str, str]]
    tests: list[tuple] = field(default_factory=list)


def _term(text: str) -> str:
    if text.startswith("?"):
        return text
    if text.startswith("<"):
        return text[1:-1]
    if text.startswith('"'):
        return text
    if text == "a":
        return RDF + "type"
    prefix, _, name = text.partition(":")
    return PREFIXES[prefix] + name


def parse_rules(text: str) -> list[Rule]:
    rules = []
    for line in text.splitlines():
        if not (line := line.strip()) or line.startswith("#"):
            continue
        name, rest = line.split(": ", 1)
        sides = [[atom.split() for atom in side.split(",")] for side in rest.split("->")]
        body = [tuple(map(_term, a)) for a in sides[0] if len(a) == 3 and a[1] not in ("!=", "=")]
        tests = [(a[1], a[0], a[2]) if len(a) == 3 else (a[0], a[1]) for a in sides[0] if len(a) == 2 or len(a) == 3 and a[1] in ("!=", "=")]
        rules.append(Rule(name, body, [tuple(map(_term, a)) for a in sides[1]], tests))
    return rules


def encode(t: DataFrame) -> DataFrame:
    """s, p, o as one string each."""
    suffix = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).otherwise(F.concat(F.lit("^^"), F.coalesce("dt", F.lit(XSD + "string"))))
    return t.select("s", "p", F.when(F.col("t") == 2, F.concat(F.lit('"'), "o", F.lit('"'), suffix)).otherwise(F.col("o")).alias("o"))


def decode(facts: DataFrame) -> DataFrame:
    o = F.col("o")
    lit = o.startswith('"')
    part = lambda k: F.when(lit & (F.regexp_extract(o, "(?s)" + LITERAL, k) != ""), F.regexp_extract(o, "(?s)" + LITERAL, k))
    kind = F.when(lit, 2).when(o.startswith("_:"), 0).otherwise(1)
    return facts.select("s", "p", F.when(lit, F.regexp_extract(o, "(?s)" + LITERAL, 1)).otherwise(o).alias("o"), kind.alias("t"), part(2).alias("dt"), part(3).alias("lang"))


def members(facts: DataFrame) -> DataFrame:
    """Facts (list, q:member, item) of all lists."""
    rest = closure(facts.where((F.col("p") == RDF + "rest") & (F.col("o") != RDF + "nil")).select(F.col("s").alias("a"), F.col("o").alias("b")))
    first = facts.where(F.col("p") == RDF + "first").select(F.col("s").alias("b"), F.col("o").alias("item"))
    every = first.select(F.col("b").alias("s"), "item").unionByName(rest.join(first, "b").select(F.col("a").alias("s"), "item"))
    return every.select("s", F.lit(OWN + "member").alias("p"), F.col("item").alias("o")).distinct()


def _constants(atom) -> tuple:
    """What a fact must have to match an atom: place and constant."""
    return tuple((place, term) for place, term in zip("spo", atom) if not term.startswith("?"))


def _matches(atom) -> Column:
    return reduce(lambda a, b: a & b, (F.col(place) == term for place, term in _constants(atom)), F.lit(True))


def _present(facts: DataFrame, keys: list[tuple]) -> set[tuple]:
    """Which of the constants of atoms some fact has, in one pass."""
    if not keys:
        return set()
    tests = [F.max(reduce(lambda a, b: a & b, (F.col(place) == term for place, term in key), F.lit(True))).alias(f"k{k}") for k, key in enumerate(keys)]
    row = facts.agg(*tests).first()
    return {key for key, found in zip(keys, row) if found}


def _scan(facts: DataFrame, atom) -> DataFrame:
    """The bindings of one atom, a column a variable."""
    taken: dict[str, Column] = {}
    rows = facts.where(_matches(atom))
    for place, term in zip("spo", atom):
        if term.startswith("?"):
            if term[1:] in taken:
                rows = rows.where(F.col(place) == taken[term[1:]])
            else:
                taken[term[1:]] = F.col(place)
    return rows.select(*(c.alias(v) for v, c in taken.items())) if taken else rows.select(F.lit(True).alias("_"))


def _test(test) -> Column:
    col = lambda x: F.col(x[1:]) if x.startswith("?") else F.lit(x)
    kind, a, *b = test
    return {"!=": lambda: col(a) != col(b[0]), "=": lambda: col(a) == col(b[0]), "literal": lambda: col(a).startswith('"'), "resource": lambda: ~col(a).startswith('"')}[kind]()


def fire(rule: Rule, sources: list[DataFrame], first: int = 0) -> DataFrame:
    """The conclusions of a rule, each body atom read from its own source; joins begin with the first and follow shared variables."""
    out = _scan(sources[first], rule.body[first])
    todo = [k for k in range(len(rule.body)) if k != first]
    while todo:
        shares = lambda k: len({x[1:] for x in rule.body[k] if x[0] == "?"} & {*out.columns})  # noqa: B023, E731
        k = max(todo, key=lambda k: (shares(k), len(_constants(rule.body[k]))))
        todo.remove(k)
        side = _scan(sources[k], rule.body[k])
        shared = [v for v in side.columns if v in out.columns and v != "_"]
        out = out.join(side, shared) if shared else out.crossJoin(side.drop("_"))
    for test in rule.tests:
        out = out.where(_test(test))
    col = lambda x: F.col(x[1:]) if x.startswith("?") else F.lit(x)
    # Literals are no subjects or predicates.
    made = [out.where(~col(s).startswith('"') & ~col(p).startswith('"')).select(col(s).alias("s"), col(p).alias("p"), col(o).alias("o")) for s, p, o in rule.head]
    return reduce(DataFrame.unionByName, made)


def saturate(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """All facts (s, p, o) that the rules add up to."""
    keys = list(dict.fromkeys(_constants(a) for r in rules for a in r.body))
    parts = [cut(facts.select("s", "p", "o").distinct())]
    delta, have = parts[0], set()
    while True:
        new_keys = _present(delta, keys)
        have |= new_keys
        known = reduce(DataFrame.unionByName, parts)
        made = []
        for rule in rules:
            if all(_constants(a) in have for a in rule.body):
                made += [fire(rule, [delta if j == k else known for j in range(len(rule.body))], k) for k, a in enumerate(rule.body) if _constants(a) in new_keys]
        if not made:
            break
        new = reduce(DataFrame.unionByName, made).where("s is not null and p is not null and o is not null").distinct()
        delta = cut(new.join(known, ["s", "p", "o"], "left_anti"))
        if delta.isEmpty():
            break
        parts.append(delta)
        if len(parts) > PARTS:
            parts = [cut(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


def dependencies(rules: list[Rule]) -> dict[str, set[str]]:
    """For each rule, those whose body its conclusions may match."""
    meet = lambda a, b: all(x == y or x[0] == "?" or y[0] == "?" for x, y in zip(a, b))
    return {r.name: {q.name for q in rules if any(meet(h, b) for h in r.head for b in q.body)} for r in rules}


def layers(rules: list[Rule]) -> list[tuple[list[Rule], bool]]:
    """Rules in an order in which none feeds an earlier layer, and whether a layer feeds itself and needs a fixpoint."""
    after = dependencies(rules)
    reach = {name: set(to) for name, to in after.items()}
    for k in reach:
        for a in reach:
            if k in reach[a]:
                reach[a] |= reach[k]
    groups: list[list[Rule]] = []
    for r in rules:
        same = next((g for g in groups if r.name in reach[g[0].name] and g[0].name in reach[r.name]), None)
        same.append(r) if same else groups.append([r])
    ordered: list[list[Rule]] = []
    while groups:
        g = next(g for g in groups if not any(g[0].name in reach[h[0].name] for h in groups if h is not g))
        groups.remove(g)
        ordered.append(g)
    return [(g, any(r.name in reach[r.name] for r in g)) for g in ordered]


def saturate_in_layers(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """The same as saturate, layer by layer: those that don't feed themselves take one pass."""
    known = cut(facts.select("s", "p", "o").distinct())
    for group, again in layers(rules):
        if again:
            known = saturate(known, group)
        else:
            made = [fire(r, [known] * len(r.body)) for r in group]
            known = cut(reduce(DataFrame.unionByName, [known, *made]).distinct())
    return known


def minimal(rules: list[Rule]) -> list[Rule]:
    """The rules without those that add nothing: whose head is in their body, or that equal another but for names of variables."""
    seen, out = set(), []
    for r in rules:
        if all(h in r.body for h in r.head):
            continue
        names: dict[str, str] = {}
        rename = lambda x: names.setdefault(x, f"?{len(names)}") if x.startswith("?") else x  # noqa: B023, E731
        form = tuple(tuple(map(rename, a)) for a in (*sorted(r.body), *r.head)), tuple(tuple(map(rename, x[1:])) for x in r.tests), len(r.head)
        if form not in seen:
            seen.add(form)
            out.append(r)
    return out


def rule_sql(rule: Rule, table: str = "t") -> str:
    """One application of a rule as SQL over a table of s, p, o."""
    where, of = [], {}
    for k, atom in enumerate(rule.body):
        for place, term in zip("spo", atom):
            here = f"a{k}.{place}"
            if not term.startswith("?"):
                where.append(f"{here} = '" + term.replace("'", "''") + "'")
            elif term in of:
                where.append(f"{here} = {of[term]}")
            else:
                of[term] = here
    text = lambda x: of[x] if x.startswith("?") else "'" + x.replace("'", "''") + "'"
    for kind, a, *b in rule.tests:
        where.append({"!=": lambda: f"{text(a)} <> {text(b[0])}", "=": lambda: f"{text(a)} = {text(b[0])}", "literal": lambda: f"{text(a)} LIKE '\"%'", "resource": lambda: f"{text(a)} NOT LIKE '\"%'"}[kind]())  # noqa: B023
    source = ", ".join(f"{table} a{k}" for k in range(len(rule.body)))
    return " UNION ".join(f"SELECT {text(s)} AS s, {text(p)} AS p, {text(o)} AS o FROM {source} WHERE {' AND '.join(where) or 'TRUE'} AND {text(s)} NOT LIKE '\"%' AND {text(p)} NOT LIKE '\"%'" for s, p, o in rule.head)


def named(rules: Iterable[Rule], *names: str) -> list[Rule]:
    return [r for r in rules if r.name in names]
