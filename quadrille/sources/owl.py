"""OWL ontologies as rows of axioms: functional, Manchester and OWL/XML syntax in; functional, Manchester, OWL/XML, DL, KRSS, KRSS2, OBO and all RDF languages out.

An axiom is its kind and its arguments, each in functional syntax with full names, so that built-in string functions find their way in it.
"""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import OWL, RDF, RDFS, SCHEMA, TYPE, XSD
from . import writers

AXIOMS = "kind string, args array<string>"
TOKEN = re.compile(r'\s+|#[^\n]*|(?P<iri><[^>]*>)|(?P<str>"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^(?:<[^>]*>|[\w-]*:[\w.-]+))?)|(?P<open>\()|(?P<close>\))|(?P<eq>=)|(?P<name>_:[\w.-]+|[\w-]*:[\w.%-]*|[\w-]+)')
STANDARD = {"owl": OWL, "rdf": RDF, "rdfs": RDFS, "xsd": XSD}
Tree = tuple


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:at + 20]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


def trees(text: str, prefixes: dict[str, str] | None = None) -> Iterator[Tree]:
    """Expressions of functional syntax: strings (names in < >, literals, numbers) and tuples (kind, arguments)."""
    names, toks, stack = dict(STANDARD, **(prefixes or {})), _tokens(text), [[]]

    def name(kind: str, x: str) -> str:
        if kind == "str":
            body, _, dt = x.rpartition("^^")
            return f"{body}^^{name('name', dt)}" if body.endswith('"') and not dt.startswith("<") else x
        if kind == "name" and ":" in x and not x.startswith("_:"):
            prefix, _, local = x.partition(":")
            if prefix not in names:
                raise ValueError(f"unknown prefix {prefix!r}")
            return f"<{names[prefix]}{local}>"
        return x

    k = 0
    while k < len(toks):
        kind, x = toks[k]
        if kind == "name" and k + 1 < len(toks) and toks[k + 1][0] == "open":
            if x == "Prefix":  # Prefix( name : = <iri> )
                end = next(j for j in range(k, len(toks)) if toks[j][0] == "close")
                names["".join(t for g, t in toks[k + 2 : end] if g == "name").rstrip(":")] = toks[end - 1][1][1:-1]
                k = end + 1
                continue
            stack.append([x])
            k += 2
            continue
        if kind == "close":
            done = tuple(stack.pop())
            if not stack:
                raise ValueError("a bracket too many")
            stack[-1].append(done)
            if len(stack) == 1 and done[0] != "Ontology":
                yield stack[0].pop()
            elif len(stack) == 1:
                stack[0].pop()
        elif len(stack) > 1:
            stack[-1].append(name(kind, x))
        if len(stack) == 2 and stack[1][0] == "Ontology" and isinstance(stack[1][-1], tuple):
            yield stack[1].pop()
        k += 1
    if len(stack) > 1:
        raise ValueError("a bracket too few")


def show(x) -> str:
    return x if isinstance(x, str) else f"{x[0]}({' '.join(map(show, x[1:]))})"


def parse_functional(text: str) -> Iterator[tuple[str, list[str]]]:
    """Annotations of an axiom are left out of its arguments."""
    for x in trees(text):
        if x[0] not in ("Annotation", "Import"):
            yield x[0], [show(a) for a in x[1:] if not (isinstance(a, tuple) and a[0] == "Annotation")]


def parse_owlxml(text: str) -> Iterator[tuple[str, list[str]]]:
    root, names = ET.fromstring(text), dict(STANDARD)
    base = root.get("{http://www.w3.org/XML/1998/namespace}base", root.get("ontologyIRI", ""))
    local = lambda e: e.tag.rsplit("}", 1)[-1]

    def tree(e) -> str:
        kind = local(e)
        iri = e.get("IRI")
        if iri is not None or e.get("abbreviatedIRI"):
            prefix, _, rest = (e.get("abbreviatedIRI") or "").partition(":")
            full = names[prefix] + rest if iri is None else iri if ":" in iri else base + iri
            return f"<{full}>"
        if kind in ("IRI", "AbbreviatedIRI"):
            return f"<{e.text if ':' in (e.text or '') else base + (e.text or '')}>"
        if kind == "AnonymousIndividual":
            return "_:" + e.get("nodeID", "").removeprefix("_:")
        if kind == "Literal":
            lang = e.get("{http://www.w3.org/XML/1998/namespace}lang")
            dt = e.get("datatypeIRI")
            body = '"' + (e.text or "").replace("\\", "\\\\").replace('"', '\\"') + '"'
            return body + (f"@{lang}" if lang else f"^^<{dt}>" if dt else "")
        n = [e.get("cardinality")] if e.get("cardinality") else []
        return f"{kind}({' '.join([*n, *map(tree, e)])})"

    for e in root:
        if local(e) == "Prefix":
            names[e.get("name", "")] = e.get("IRI")
        elif local(e) not in ("Import", "Annotation"):
            kids = [x for x in e if local(x) != "Annotation"]
            if local(e) == "Declaration":
                yield "Declaration", [f"{local(kids[0])}({tree(kids[0])})"]
            else:
                yield local(e), list(map(tree, kids))


FRAMES = {"Class": "Class", "ObjectProperty": "ObjectProperty", "DataProperty": "DataProperty", "AnnotationProperty": "AnnotationProperty", "Individual": "NamedIndividual", "Datatype": "Datatype"}
SECTIONS = {
    ("Class", "SubClassOf"): "SubClassOf", ("Class", "EquivalentTo"): "EquivalentClasses", ("Class", "DisjointWith"): "DisjointClasses", ("ObjectProperty", "SubPropertyOf"): "SubObjectPropertyOf", ("DataProperty", "SubPropertyOf"): "SubDataPropertyOf",
    ("ObjectProperty", "EquivalentTo"): "EquivalentObjectProperties", ("DataProperty", "EquivalentTo"): "EquivalentDataProperties", ("ObjectProperty", "DisjointWith"): "DisjointObjectProperties", ("ObjectProperty", "InverseOf"): "InverseObjectProperties",
    ("ObjectProperty", "Domain"): "ObjectPropertyDomain", ("ObjectProperty", "Range"): "ObjectPropertyRange", ("DataProperty", "Domain"): "DataPropertyDomain", ("DataProperty", "Range"): "DataPropertyRange", ("Individual", "SameAs"): "SameIndividual", ("Individual", "DifferentFrom"): "DifferentIndividuals",
}
MANCHESTER = re.compile(r'\s+|(?P<iri><[^>]*>)|(?P<str>"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^(?:<[^>]*>|[\w-]*:[\w.-]+))?)|(?P<op>[(){},])|(?P<num>[+-]?\d+(?:\.\d+)?)|(?P<name>[\w-]*:[\w.%-]+|[\w-]+)')


class Manchester:
    """Class expressions: and, or, not, some, only, value, min, max, exactly, Self, { individuals }."""

    def __init__(self, text: str, names: dict[str, str], data: set[str]):
        self.toks, self.at, self.names, self.data = [m[0] for m in MANCHESTER.finditer(text) if m.lastgroup], 0, names, data

    def peek(self) -> str:
        return self.toks[self.at] if self.at < len(self.toks) else ""

    def take(self, *words: str) -> bool:
        if self.peek() in words:
            self.at += 1
            return True
        return False

    def name(self) -> str:
        x = self.toks[self.at]
        self.at += 1
        if x[0] in '<"' or x.lstrip("+-").replace(".", "").isdigit():
            return x if x[0] in '<"' else f'"{x}"^^<{XSD}{"decimal" if "." in x else "integer"}>'
        prefix, colon, local = x.partition(":")
        return f"<{self.names[prefix if colon else '']}{local if colon else x}>"

    def expression(self) -> str:
        sides = [self.conjunction()]
        while self.take("or"):
            sides.append(self.conjunction())
        return sides[0] if len(sides) == 1 else f"ObjectUnionOf({' '.join(sides)})"

    def conjunction(self) -> str:
        sides = [self.primary()]
        while self.take("and", "that"):
            sides.append(self.primary())
        return sides[0] if len(sides) == 1 else f"ObjectIntersectionOf({' '.join(sides)})"

    def primary(self) -> str:
        if self.take("not"):
            return f"ObjectComplementOf({self.primary()})"
        if self.take("("):
            e = self.expression()
            self.take(")")
            return e
        if self.take("{"):
            items = []
            while not self.take("}"):
                items.append(self.name())
                self.take(",")
            return f"ObjectOneOf({' '.join(items)})"
        inverse = self.take("inverse")
        x = self.name()
        side = "Data" if x in self.data else "Object"
        x = f"ObjectInverseOf({x})" if inverse else x
        if self.take("some"):
            return f"{side}SomeValuesFrom({x} {self.primary()})"
        if self.take("only"):
            return f"{side}AllValuesFrom({x} {self.primary()})"
        if self.take("value"):
            v = self.name()
            return f"{'Data' if v[0] == '\"' else side}HasValue({x} {v})"
        if self.take("Self"):
            return f"ObjectHasSelf({x})"
        for word, kind in (("min", "MinCardinality"), ("max", "MaxCardinality"), ("exactly", "ExactCardinality")):
            if self.take(word):
                n = self.toks[self.at]
                self.at += 1
                more = self.peek() and self.peek() not in ("and", "or", ")", ",")
                return f"{side}{kind}({n} {x}{' ' + self.primary() if more else ''})"
        return x


def parse_manchester(text: str) -> Iterator[tuple[str, list[str]]]:
    names = dict(STANDARD)
    for m in re.finditer(r"(?m)^\s*Prefix:\s*([\w-]*):\s*<([^>]*)>", text):
        names[m[1]] = m[2]
    frames = re.split(rf"(?m)^\s*({'|'.join(FRAMES)}|Prefix|Ontology|Import):", text)
    data = {Manchester(b.strip().split()[0], names, set()).name() for a, b in zip(frames[1::2], frames[2::2]) if a == "DataProperty"}
    for kind, body in zip(frames[1::2], frames[2::2]):
        if kind not in FRAMES:
            continue
        head, *parts = re.split(r"(?m)(?:^|\s)([A-Z]\w+):(?=\s)", body)
        subject = Manchester(head.strip(), names, data).name()
        yield "Declaration", [f"{FRAMES[kind]}({subject})"]
        for section, content in zip(parts[::2], parts[1::2]):
            p = Manchester(content, names, data)
            while p.peek():
                if section == "Annotations":
                    yield "AnnotationAssertion", [p.name(), subject, p.name()]
                elif section == "Characteristics":
                    x = p.toks[p.at]
                    p.at += 1
                    yield f"{x}{kind}", [subject]
                elif section == "Types":
                    yield "ClassAssertion", [p.expression(), subject]
                elif section == "Facts":
                    no, prop, v = p.take("not"), p.name(), p.name()
                    yield f"{'Negative' if no else ''}{'Data' if v[0] == '\"' else 'Object'}PropertyAssertion", [prop, subject, v]
                elif (kind, section) in SECTIONS:
                    yield SECTIONS[kind, section], [subject, p.expression()]
                else:
                    raise ValueError(f"no section {section} of {kind}")
                p.take(",")


PARSERS = {"functional": parse_functional, "owlxml": parse_owlxml, "manchester": parse_manchester}


def read(spark: SparkSession, path: str, syntax: str = "functional") -> DataFrame:
    """kind, args of the axioms of a file or folder; a file is a record, as prefixes hold for all of it."""
    parse = PARSERS[syntax]

    def work(batches):
        for b in batches:
            for content in b.column("content").to_pylist():
                rows = list(parse(content.decode("utf-8-sig")))
                for k in range(0, len(rows), 20_000):
                    kinds, args = zip(*rows[k : k + 20_000])
                    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(args, pa.list_(pa.string()))], names=["kind", "args"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, AXIOMS).distinct()


def expressions(spark: SparkSession, path: str, syntax: str = "functional") -> DataFrame:
    """value: the axioms as they are in functional syntax."""
    return read(spark, path, syntax).select(text().alias("value"))


def text():
    return F.concat("kind", F.lit("("), F.array_join("args", " "), F.lit(")"))


def of_kind(axioms: DataFrame, *kinds: str) -> DataFrame:
    return axioms.where(F.col("kind").isin(*kinds))


#: Axioms with two arguments that are one triple (subject, predicate, object).
DIRECT = {
    "SubClassOf": RDFS + "subClassOf", "EquivalentClasses": OWL + "equivalentClass", "DisjointClasses": OWL + "disjointWith", "SubObjectPropertyOf": RDFS + "subPropertyOf", "SubDataPropertyOf": RDFS + "subPropertyOf", "SubAnnotationPropertyOf": RDFS + "subPropertyOf",
    "EquivalentObjectProperties": OWL + "equivalentProperty", "EquivalentDataProperties": OWL + "equivalentProperty", "DisjointObjectProperties": OWL + "propertyDisjointWith", "DisjointDataProperties": OWL + "propertyDisjointWith", "InverseObjectProperties": OWL + "inverseOf",
    "ObjectPropertyDomain": RDFS + "domain", "DataPropertyDomain": RDFS + "domain", "AnnotationPropertyDomain": RDFS + "domain", "ObjectPropertyRange": RDFS + "range", "DataPropertyRange": RDFS + "range", "AnnotationPropertyRange": RDFS + "range", "SameIndividual": OWL + "sameAs", "DifferentIndividuals": OWL + "differentFrom",
}
KINDS = {"Class": OWL + "Class", "ObjectProperty": OWL + "ObjectProperty", "DataProperty": OWL + "DatatypeProperty", "AnnotationProperty": OWL + "AnnotationProperty", "NamedIndividual": OWL + "NamedIndividual", "Datatype": RDFS + "Datatype"}
LISTS = {"ObjectIntersectionOf": OWL + "intersectionOf", "ObjectUnionOf": OWL + "unionOf", "ObjectOneOf": OWL + "oneOf", "DataIntersectionOf": OWL + "intersectionOf", "DataUnionOf": OWL + "unionOf", "DataOneOf": OWL + "oneOf"}
RESTRICTIONS = {"SomeValuesFrom": OWL + "someValuesFrom", "AllValuesFrom": OWL + "allValuesFrom", "HasValue": OWL + "hasValue"}


class Triples:
    """The triples of axioms; a class expression is a blank node named by its text, so that equal ones are one."""

    def __init__(self):
        self.out: list[tuple] = []

    def add(self, s: str, p: str, o) -> None:
        self.out.append((s, p, *(o if isinstance(o, tuple) else (o, 0 if o.startswith("_:") else 1, None, None))))

    def term(self, x):
        if isinstance(x, str):
            if x[0] == "<":
                return x[1:-1]
            if x[0] == '"':
                end = x.rindex('"')
                body, tail = re.sub(r"\\(.)", r"\1", x[1:end]), x[end + 1 :]
                return body, 2, tail[3:-1] if tail.startswith("^^") else None if tail else XSD + "string", tail[1:].lower() if tail.startswith("@") else None
            return x
        kind, *args = x
        node = "_:x" + hashlib.md5(show(x).encode()).hexdigest()[:16]
        if kind in LISTS:
            self.add(node, TYPE, OWL + "Class")
            self.add(node, LISTS[kind], self.items(node, args))
        elif kind in ("ObjectComplementOf", "ObjectInverseOf"):
            self.add(node, OWL + ("complementOf" if kind == "ObjectComplementOf" else "inverseOf"), self.term(args[0]))
        else:
            self.add(node, TYPE, OWL + "Restriction")
            inner = kind.removeprefix("Object").removeprefix("Data")
            if inner in RESTRICTIONS:
                self.add(node, OWL + "onProperty", self.term(args[0]))
                self.add(node, RESTRICTIONS[inner], self.term(args[1]))
            elif inner == "HasSelf":
                self.add(node, OWL + "onProperty", self.term(args[0]))
                self.add(node, OWL + "hasSelf", ("true", 2, XSD + "boolean", None))
            elif inner.endswith("Cardinality"):
                self.add(node, OWL + "onProperty", self.term(args[1]))
                word = {"MinCardinality": "min", "MaxCardinality": "max", "ExactCardinality": ""}[inner]
                name = (word + ("QualifiedCardinality" if len(args) > 2 else "Cardinality")) if word else "qualifiedCardinality" if len(args) > 2 else "cardinality"
                self.add(node, OWL + name, (args[0], 2, XSD + "nonNegativeInteger", None))
                if len(args) > 2:
                    self.add(node, OWL + ("onClass" if kind.startswith("Object") else "onDataRange"), self.term(args[2]))
            else:
                raise ValueError(f"no triples for {kind}")
        return node

    def items(self, stem: str, args) -> str:
        cells = [f"{stem}l{k}" for k in range(len(args))] + [RDF + "nil"]
        for cell, x, rest in zip(cells, args, cells[1:]):
            self.add(cell, RDF + "first", self.term(x))
            self.add(cell, RDF + "rest", rest)
        return cells[0]

    def axiom(self, kind: str, args: list) -> None:
        if kind == "Declaration":
            self.add(self.term(args[0][1]), TYPE, KINDS[args[0][0]])
        elif kind in ("ObjectPropertyAssertion", "DataPropertyAssertion", "AnnotationAssertion"):
            self.add(self.term(args[1]), self.term(args[0]), self.term(args[2]))
        elif kind == "ClassAssertion":
            self.add(self.term(args[1]), TYPE, self.term(args[0]))
        elif kind == "SubObjectPropertyOf" and args[0][0] == "ObjectPropertyChain":
            p = self.term(args[1])
            self.add(p, OWL + "propertyChainAxiom", self.items("_:c" + hashlib.md5(show(args[0]).encode()).hexdigest()[:16], args[0][1:]))
        elif kind in DIRECT:
            pairs = zip(args, args[1:]) if not kind.startswith(("Disjoint", "Different")) else ((a, b) for k, a in enumerate(args) for b in args[k + 1 :])
            for a, b in pairs:
                self.add(self.term(a), DIRECT[kind], self.term(b))
        elif kind.endswith(("ObjectProperty", "DataProperty")):
            self.add(self.term(args[0]), TYPE, OWL + kind.replace("ObjectProperty", "Property").replace("DataProperty", "Property"))
        else:
            raise ValueError(f"no triples for {kind}")


def to_triples(axioms: DataFrame) -> DataFrame:
    """The axioms as triples, for rules and RDF languages."""

    def work(batches):
        for b in batches:
            made = Triples()
            for kind, args in zip(b.column("kind").to_pylist(), b.column("args").to_pylist()):
                made.axiom(kind, [next(iter(trees(a))) if "(" in a and a[0] not in '<"' else a for a in args])
            if made.out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 3 else pa.string()) for k, c in enumerate(zip(*made.out))], names=["s", "p", "o", "t", "dt", "lang"])

    return axioms.mapInArrow(work, SCHEMA).distinct()


def from_triples(t: DataFrame) -> DataFrame:
    """The axioms that statements between named things make."""
    named = t.where(~F.col("s").startswith("_:") & (F.col("t") != 0))
    iri = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    kind_of = F.when(F.col("p") == TYPE, "type")
    for name, p in {v: k for k, v in reversed(DIRECT.items())}.items():
        kind_of = kind_of.when(F.col("p") == name, p)
    declared = F.when(F.col("o") == "", None)
    for name, o in KINDS.items():
        declared = declared.when(F.col("o") == o, name)
    marks = [n for n in ("Functional", "InverseFunctional", "Transitive", "Symmetric", "Asymmetric", "Reflexive", "Irreflexive")]
    mark = F.when(F.col("o") == "", None)
    for n in marks:
        mark = mark.when(F.col("o") == f"{OWL}{n}Property", f"{n}ObjectProperty")
    rows = named.select("*", kind_of.alias("k"), declared.alias("d"), mark.alias("m"))
    literal = F.concat(F.lit('"'), F.replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'), F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).otherwise(F.concat(F.lit("^^<"), "dt", F.lit(">"))))
    kind = F.when(F.col("k") == "type", F.when(F.col("d").isNotNull(), F.lit("Declaration")).when(F.col("m").isNotNull(), F.col("m")).otherwise("ClassAssertion")).when(F.col("k").isNotNull(), F.col("k")).when(F.col("p").startswith(RDFS), "AnnotationAssertion").when(F.col("t") == 2, "DataPropertyAssertion").otherwise("ObjectPropertyAssertion")
    value = F.when(F.col("t") == 2, literal).otherwise(iri("o"))
    args = F.when(F.col("d").isNotNull() & (F.col("k") == "type"), F.array(F.concat("d", F.lit("("), iri("s"), F.lit(")")))).when(F.col("m").isNotNull() & (F.col("k") == "type"), F.array(iri("s"))).when(F.col("k") == "type", F.array(iri("o"), iri("s"))).when(F.col("k").isNotNull(), F.array(iri("s"), value)).otherwise(F.array(iri("p"), iri("s"), value))
    return rows.select(kind.alias("kind"), args.alias("args")).distinct()


def _local(x: str) -> str:
    return re.split(r"[#/:]", x[1:-1].rstrip("/#"))[-1] if x[0] == "<" else x


SIGNS = {"ObjectIntersectionOf": " ⊓ ", "ObjectUnionOf": " ⊔ ", "SomeValuesFrom": "∃ ", "AllValuesFrom": "∀ ", "SubClassOf": " ⊑ ", "EquivalentClasses": " ≡ ", "SubObjectPropertyOf": " ⊑ ", "SubDataPropertyOf": " ⊑ "}


def _dl(x) -> str:
    if isinstance(x, str):
        return "⊤" if x == f"<{OWL}Thing>" else "⊥" if x == f"<{OWL}Nothing>" else _local(x)
    kind, *a = x
    inner = kind.removeprefix("Object").removeprefix("Data")
    if kind in ("ObjectIntersectionOf", "ObjectUnionOf"):
        return "(" + SIGNS[kind].join(map(_dl, a)) + ")"
    if inner in ("SomeValuesFrom", "AllValuesFrom"):
        return f"{SIGNS[inner]}{_dl(a[0])}.{_dl(a[1])}"
    if inner == "HasValue":
        return f"∃ {_dl(a[0])}.{{{_dl(a[1])}}}"
    if inner.endswith("Cardinality"):
        return f"{ {'Min': '≥', 'Max': '≤', 'Exa': '='}[inner[:3]]} {a[0]} {_dl(a[1])}.{_dl(a[2]) if len(a) > 2 else '⊤'}"
    return f"¬{_dl(a[0])}" if kind == "ObjectComplementOf" else "{" + ", ".join(map(_dl, a)) + "}" if kind == "ObjectOneOf" else f"{_dl(a[0])}⁻" if kind == "ObjectInverseOf" else f"{kind}({', '.join(map(_dl, a))})"


def _dl_axiom(kind, a) -> str:
    if kind in ("SubClassOf", "EquivalentClasses", "SubObjectPropertyOf", "SubDataPropertyOf"):
        return SIGNS[kind].join(map(_dl, a))
    if kind == "DisjointClasses":
        return f"{_dl(a[0])} ⊓ {_dl(a[1])} ⊑ ⊥"
    if kind == "ClassAssertion":
        return f"{_dl(a[0])}({_dl(a[1])})"
    if kind.endswith("PropertyAssertion"):
        return f"{_dl(a[0])}({_dl(a[1])}, {_dl(a[2])})"
    if kind.endswith("Domain"):
        return f"∃ {_dl(a[0])}.⊤ ⊑ {_dl(a[1])}"
    if kind.endswith("PropertyRange"):
        return f"⊤ ⊑ ∀ {_dl(a[0])}.{_dl(a[1])}"
    return f"{kind}({', '.join(map(_dl, a))})"


def _man(x) -> str:
    if isinstance(x, str):
        return x
    kind, *a = x
    inner = kind.removeprefix("Object").removeprefix("Data")
    words = {"SomeValuesFrom": "some", "AllValuesFrom": "only", "HasValue": "value", "MinCardinality": "min", "MaxCardinality": "max", "ExactCardinality": "exactly"}
    if kind in ("ObjectIntersectionOf", "ObjectUnionOf"):
        return "(" + (" and " if kind == "ObjectIntersectionOf" else " or ").join(map(_man, a)) + ")"
    if inner.endswith("Cardinality"):
        return f"({_man(a[1])} {words[inner]} {a[0]}{' ' + _man(a[2]) if len(a) > 2 else ''})"
    if inner in words:
        return f"({_man(a[0])} {words[inner]} {_man(a[1])})"
    return f"(not {_man(a[0])})" if kind == "ObjectComplementOf" else "{" + ", ".join(map(_man, a)) + "}" if kind == "ObjectOneOf" else f"inverse {_man(a[0])}" if kind == "ObjectInverseOf" else f"({_man(a[0])} Self)"


def _man_axiom(kind, a) -> str | None:
    """A frame for each axiom; frames of one thing add up."""
    if kind == "Declaration":
        return f"{next(k for k, v in FRAMES.items() if v == a[0][0])}: {a[0][1]}"
    section = next(((k, s) for (k, s), v in SECTIONS.items() if v == kind), None)
    if section and isinstance(a[0], str):
        return f"{section[0]}: {a[0]}\n    {section[1]}: {_man(a[1])}"
    if kind == "ClassAssertion":
        return f"Individual: {a[1]}\n    Types: {_man(a[0])}"
    if kind in ("ObjectPropertyAssertion", "DataPropertyAssertion"):
        return f"Individual: {a[1]}\n    Facts: {a[0]} {a[2]}"
    if kind == "AnnotationAssertion":
        return f"Class: {a[1]}\n    Annotations: {a[0]} {a[2]}"
    for frame in ("ObjectProperty", "DataProperty"):
        if kind.endswith(frame):
            return f"{frame}: {a[0]}\n    Characteristics: {kind.removesuffix(frame)}"
    return None


def _xml(x, kind="Class") -> str:
    if isinstance(x, str):
        if x[0] == "<":
            return f"<{kind} IRI={quoteattr(x[1:-1])}/>"
        if x[0] == '"':
            end = x.rindex('"')
            tail = x[end + 1 :]
            at = f' xml:lang="{tail[1:]}"' if tail.startswith("@") else f" datatypeIRI={quoteattr(tail[3:-1])}" if tail else ""
            return f"<Literal{at}>{escape(re.sub(r'\\(.)', r'\1', x[1:end]))}</Literal>"
        return f'<AnonymousIndividual nodeID="{x}"/>'
    k, *a = x
    side = "ObjectProperty" if k.startswith("Object") else "DataProperty"
    if k.endswith("Cardinality"):
        return f'<{k} cardinality="{a[0]}">{_xml(a[1], side)}{_xml(a[2]) if len(a) > 2 else ""}</{k}>'
    if k.endswith(("ValuesFrom", "HasValue", "HasSelf")):
        filler = "NamedIndividual" if k == "ObjectHasValue" else "Datatype" if k.startswith("Data") else "Class"
        return f"<{k}>{_xml(a[0], side)}{''.join(_xml(y, filler) for y in a[1:])}</{k}>"
    inner = "NamedIndividual" if k == "ObjectOneOf" else "ObjectProperty" if k in ("ObjectInverseOf", "ObjectPropertyChain") else "Class"
    return f"<{k}>{''.join(_xml(y, inner) for y in a)}</{k}>"


def _xml_axiom(kind, a) -> str:
    if kind == "Declaration":
        return f"<Declaration>{_xml(a[0][1], a[0][0])}</Declaration>"
    if kind == "AnnotationAssertion":
        return f"<AnnotationAssertion><AnnotationProperty IRI={quoteattr(a[0][1:-1])}/><IRI>{escape(a[1][1:-1])}</IRI>{_xml(a[2], 'IRI') if a[2][0] == '\"' else f'<IRI>{escape(a[2][1:-1])}</IRI>'}</AnnotationAssertion>"
    side = "ObjectProperty" if "ObjectProp" in kind else "DataProperty" if "DataProp" in kind else "Class"
    kinds = [side] * len(a)
    if kind == "ClassAssertion":
        kinds = ["Class", "NamedIndividual"]
    elif kind.endswith("PropertyAssertion"):
        kinds = [side, "NamedIndividual", "NamedIndividual"]
    elif kind in ("SameIndividual", "DifferentIndividuals"):
        kinds = ["NamedIndividual"] * len(a)
    elif kind.endswith(("Domain", "PropertyRange")):
        kinds = [side, "Datatype" if kind == "DataPropertyRange" else "Class"]
    return f"<{kind}>{''.join(_xml(x, k) for x, k in zip(a, kinds))}</{kind}>"


def _lisp(x) -> str:
    if isinstance(x, str):
        return {f"<{OWL}Thing>": "TOP", f"<{OWL}Nothing>": "BOTTOM"}.get(x, x[1:-1] if x[0] == "<" else x)
    kind, *a = x
    inner = kind.removeprefix("Object").removeprefix("Data")
    word = {"IntersectionOf": "and", "UnionOf": "or", "ComplementOf": "not", "SomeValuesFrom": "some", "AllValuesFrom": "all", "MinCardinality": "at-least", "MaxCardinality": "at-most", "ExactCardinality": "exactly", "InverseOf": "inv", "OneOf": "one-of", "HasValue": "has-value"}.get(inner, inner)
    return f"({word} {' '.join(map(_lisp, a))})"


def _krss(kind, a, two: bool) -> str | None:
    name = "define-primitive-concept" if not two else "implies"
    if kind == "SubClassOf":
        return f"({name} {_lisp(a[0])} {_lisp(a[1])})"
    if kind == "EquivalentClasses":
        return f"({'equivalent' if two else 'define-concept'} {_lisp(a[0])} {_lisp(a[1])})"
    if kind == "DisjointClasses":
        return f"(disjoint {' '.join(map(_lisp, a))})" if two else f"(implies {_lisp(a[0])} (not {_lisp(a[1])}))"
    if kind == "ClassAssertion":
        return f"(instance {_lisp(a[1])} {_lisp(a[0])})"
    if kind == "ObjectPropertyAssertion":
        return f"(related {_lisp(a[1])} {_lisp(a[0])} {_lisp(a[2])})" if not two else f"(related {_lisp(a[1])} {_lisp(a[2])} {_lisp(a[0])})"
    if kind == "SubObjectPropertyOf" and isinstance(a[0], str):
        return f"(implies-role {_lisp(a[0])} {_lisp(a[1])})" if two else f"(define-primitive-role {_lisp(a[0])} :parent {_lisp(a[1])})"
    if kind == "TransitiveObjectProperty":
        return f"(transitive {_lisp(a[0])})"
    if kind.endswith("ObjectPropertyDomain") or kind.endswith("ObjectPropertyRange"):
        return f"({'domain' if kind.endswith('Domain') else 'range'} {_lisp(a[0])} {_lisp(a[1])})"
    return f"(define-primitive-{'concept' if a[0][0] == 'Class' else 'role'} {_lisp(a[0][1])})" if kind == "Declaration" and a[0][0] in ("Class", "ObjectProperty") else None


def _obo(kind, a) -> str | None:
    """A stanza for each axiom; stanzas of one term add up."""
    if kind == "Declaration" and a[0][0] in ("Class", "ObjectProperty", "NamedIndividual"):
        return f"[{ {'Class': 'Term', 'ObjectProperty': 'Typedef', 'NamedIndividual': 'Instance'}[a[0][0]]}]\nid: {_local(a[0][1])}\n"
    if kind == "SubClassOf" and isinstance(a[0], str):
        if isinstance(a[1], str):
            return f"[Term]\nid: {_local(a[0])}\nis_a: {_local(a[1])}\n"
        if a[1][0] == "ObjectSomeValuesFrom" and all(isinstance(x, str) for x in a[1]):
            return f"[Term]\nid: {_local(a[0])}\nrelationship: {_local(a[1][1])} {_local(a[1][2])}\n"
    if kind == "DisjointClasses" and all(isinstance(x, str) for x in a):
        return f"[Term]\nid: {_local(a[0])}\ndisjoint_from: {_local(a[1])}\n"
    if kind == "SubObjectPropertyOf" and isinstance(a[0], str):
        return f"[Typedef]\nid: {_local(a[0])}\nis_a: {_local(a[1])}\n"
    if kind == "AnnotationAssertion" and a[0] == f"<{RDFS}label>":
        return f"[Term]\nid: {_local(a[1])}\nname: {a[2][1:a[2].rindex('\"')]}\n"
    return f"[Typedef]\nid: {_local(a[0])}\nis_transitive: true\n" if kind == "TransitiveObjectProperty" else None


FORMS = {"dl": _dl_axiom, "manchester": _man_axiom, "krss": lambda k, a: _krss(k, a, False), "krss2": lambda k, a: _krss(k, a, True), "obo": _obo}


def lines(axioms: DataFrame, syntax: str = "functional") -> DataFrame:
    """value: the axioms in a syntax.  What KRSS and OBO have no words for is left out."""
    if syntax == "functional":
        return axioms.select(text().alias("value"))
    if syntax in (*writers.WRITERS, "ntriples", "nquads"):
        t = to_triples(axioms)
        return writers.lines(t.withColumn("g", F.lit(None).cast("string")) if syntax == "nquads" else t, syntax)
    make = _xml_axiom if syntax == "owlxml" else FORMS[syntax]

    def work(batches):
        if syntax == "owlxml":
            yield pa.RecordBatch.from_arrays([pa.array([f'<Ontology xmlns="{OWL}">'])], names=["value"])
        for b in batches:
            made = (make(kind, [next(iter(trees(a))) if "(" in a and a[0] not in '<"' else a for a in args]) for kind, args in zip(b.column("kind").to_pylist(), b.column("args").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x in made if x], pa.string())], names=["value"])
        if syntax == "owlxml":
            yield pa.RecordBatch.from_arrays([pa.array(["</Ontology>"])], names=["value"])

    return axioms.mapInArrow(work, "value string")


def write(axioms: DataFrame, path: str, syntax: str = "functional", mode: str = "errorifexists") -> None:
    lines(axioms, syntax).write.mode(mode).text(path)
