"""RML and R2RML mappings: rows of sources as triples, or as tables that queries read directly.

A mapping document is read on the driver (it grows with the number of tables, not of rows).  Each triples map has a source, a subject term and terms for
predicates and objects; terms are constants, columns or templates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TYPE, XSD
from ..plans.sparql import term
from . import tabular
from .documents import parse_turtle

RR, RML = "http://www.w3.org/ns/r2rml#", "http://semweb.mmlab.be/ns/rml#"
SLOT = re.compile(r"\{((?:[^{}\\]|\\.)+)\}")


@dataclass
class TermMap:
    """kind: constant, column or template; t: 0 blank, 1 IRI, 2 literal."""

    kind: str
    text: str
    t: int
    dt: str | None = None
    lang: str | None = None

    def columns(self) -> list[str]:
        return [self.text] if self.kind == "column" else SLOT.findall(self.text) if self.kind == "template" else []

    def value(self, rename: dict[str, str] | None = None) -> Column:
        """The text of the term; null where a column is."""
        name = lambda c: F.col(f"`{(rename or {}).get(c, c)}`").cast("string")
        if self.kind == "constant":
            return F.lit(self.text)
        if self.kind == "column":
            return name(self.text)
        parts, at = [], 0
        for m in SLOT.finditer(self.text):
            parts += [F.lit(self.text[at : m.start()]), F.replace(F.url_encode(name(m[1])), F.lit("+"), F.lit("%20")) if self.t == 1 else name(m[1])]
            at = m.end()
        return F.concat(*parts, F.lit(self.text[at:]))

    def terms(self, rename: dict[str, str] | None = None) -> Column:
        v = self.value(rename)
        return F.when(v.isNotNull(), term(self.t, F.concat(F.lit("_:"), v) if self.t == 0 else v, None if self.t != 2 or self.lang else self.dt or XSD + "string", self.lang))

    def test(self, text: str) -> Column:
        """Whether the value is a text: on the column itself if there is just one, so that it reaches the scan."""
        slots = self.columns()
        if self.kind == "column" or (self.kind == "template" and len(slots) == 1):
            head, tail = ("", "") if self.kind == "column" else SLOT.split(self.text)[::2]
            inner = text[len(head) : len(text) - len(tail) or None]
            if text.startswith(head) and text.endswith(tail) and quote(inner, safe="-_.~") == inner:
                return F.col(f"`{slots[0]}`") == inner
        return self.value() == text


@dataclass
class TriplesMap:
    name: str
    kind: str
    path: str
    options: dict[str, str]
    subject: TermMap
    classes: list[str] = field(default_factory=list)
    #: predicate, object, and columns of this map that stand for those of the object's own map
    objects: list[tuple[TermMap, TermMap, dict[str, str]]] = field(default_factory=list)
    graph: TermMap | None = None


def parse_mapping(text: str) -> dict[str, TriplesMap]:
    """The triples maps of an RML or R2RML document in Turtle, by name."""
    at: dict[str, dict[str, list]] = {}
    for s, p, o, t, dt, lang, _ in parse_turtle(text):
        at.setdefault(s, {}).setdefault(p, []).append((o, t))
    one = lambda s, *names: next((at.get(s, {})[n][0][0] for n in names if n in at.get(s, {})), None)

    def term_map(node: str, default: int) -> TermMap:
        column, template, constant = one(node, RML + "reference", RR + "column"), one(node, RR + "template"), at.get(node, {}).get(RR + "constant")
        kind = one(node, RR + "termType")
        dt, lang = one(node, RR + "datatype"), one(node, RR + "language")
        t = {RR + "IRI": 1, RR + "Literal": 2, RR + "BlankNode": 0}.get(kind, 2 if dt or lang else 1 if template else default)
        if constant:
            return TermMap("constant", constant[0][0], constant[0][1], dt, lang)
        return TermMap("template", template, t, dt, lang) if template else TermMap("column", column.removeprefix("$.").removeprefix("@"), t, dt, lang)

    def shortcut(node: str, full: str, short: str, default: int) -> list[TermMap]:
        return [term_map(x, default) for x, _ in at.get(node, {}).get(full, [])] + [TermMap("constant", x, t) for x, t in at.get(node, {}).get(short, [])]

    out: dict[str, TriplesMap] = {}
    for name, x in at.items():
        if not (RR + "subjectMap" in x or RR + "subject" in x):
            continue
        logical = one(name, RML + "logicalSource", RR + "logicalTable")
        path = one(logical, RML + "source", RR + "tableName", RML + "query", RR + "sqlQuery") or ""
        form = (one(logical, RML + "referenceFormulation") or "").rsplit("#", 1)[-1]
        kind = {"CSV": "csv", "JSONPath": "json", "XPath": "xml"}.get(form) or (path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else "view")
        iterator = one(logical, RML + "iterator")
        subject_node = one(name, RR + "subjectMap")
        subject = shortcut(name, RR + "subjectMap", RR + "subject", 1)[0]
        graphs = (shortcut(subject_node, RR + "graphMap", RR + "graph", 1) if subject_node else []) or [None]
        query = one(logical, RML + "query", RR + "sqlQuery")
        out[name] = TriplesMap(name, "sql" if query else kind, path, {"iterator": iterator} if iterator else {}, subject, [c for c, _ in at.get(subject_node, {}).get(RR + "class", [])], [], graphs[0])
    for name, made in out.items():
        for node, _ in at[name].get(RR + "predicateObjectMap", []):
            for p in shortcut(node, RR + "predicateMap", RR + "predicate", 1):
                for o_node, _ in at[node].get(RR + "objectMap", []):
                    parent = one(o_node, RR + "parentTriplesMap")
                    if parent:
                        joins = {one(j, RR + "parent"): one(j, RR + "child") for j, _ in at[o_node].get(RR + "joinCondition", [])}
                        made.objects.append((p, out[parent].subject, joins))
                    else:
                        made.objects.append((p, term_map(o_node, 2), {}))
                made.objects += [(p, TermMap("constant", x, t), {}) for x, t in at[node].get(RR + "object", [])]
    return out


def load(spark: SparkSession, m: TriplesMap, base: str = "", views: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of a triples map's source; base: the folder of relative paths; views: tables by name."""
    if views and m.path in views:
        return views[m.path]
    if m.kind == "sql":
        return spark.sql(m.path)
    if m.kind == "view":
        return spark.table(m.path)
    path = m.path if "://" in m.path or m.path.startswith("/") or not base else f"{base.rstrip('/')}/{m.path}"
    if m.kind == "json":
        # The iterator $.[*] is what a JSON reader does with arrays; a longer one names the array.
        keys = [k for k in re.split(r"[.\[\]*$]+", m.options.get("iterator", "")) if k]
        df = spark.read.option("multiLine", True).json(path)
        return df.select(F.explode(F.col(".".join(keys))).alias("x")).select("x.*") if keys else df
    if m.kind == "xml":
        return tabular.read_xml(spark, path, m.options["iterator"].rstrip("/").rsplit("/", 1)[-1])
    return tabular.source(spark, m.kind, path)


def triples(spark: SparkSession, text: str, base: str = "", views: dict[str, DataFrame] | None = None) -> DataFrame:
    """All triples of a mapping: each source is read once, and its rows exploded."""
    maps, parts = parse_mapping(text), []
    for m in maps.values():
        s, made = m.subject.terms(), [(F.lit(TYPE), term(1, c)) for c in m.classes]
        made += [(p.value(), o.terms(joins)) for p, o, joins in m.objects if set(o.columns()) <= set(joins) or not joins]
        rows = load(spark, m, base, views)
        g = m.graph.value() if m.graph else F.lit(None).cast("string")
        array = F.array(*(F.struct(p.alias("p"), o.alias("o")) for p, o in made))
        df = rows.select(s["v"].alias("s"), g.alias("g"), F.explode(array).alias("x"))
        parts.append(df.select("s", "x.p", F.col("x.o.v").alias("o"), F.col("x.o.t").alias("t"), F.col("x.o.dt").alias("dt"), F.col("x.o.lang").alias("lang"), "g").where("s is not null and o is not null"))
        for p, o, joins in m.objects:
            if joins and not set(o.columns()) <= set(joins):  # the other source has to be asked
                other = next(x for x in maps.values() if x.subject is o)
                right = load(spark, other, base, views).select(*(F.col(f"`{c}`").alias(f"_k{k}") for k, c in enumerate(joins)), o.terms().alias("_o"))
                left = rows.select(s["v"].alias("s"), g.alias("g"), p.value().alias("p"), *(F.col(f"`{c}`").alias(f"_l{k}") for k, c in enumerate(joins.values())))
                df = left.join(right, reduce(lambda a, b: a & b, (F.col(f"_l{k}") == F.col(f"_k{k}") for k in range(len(joins)))))
                parts.append(df.select("s", "p", F.col("_o.v").alias("o"), F.col("_o.t").alias("t"), F.col("_o.dt").alias("dt"), F.col("_o.lang").alias("lang"), "g").where("s is not null and o is not null"))
    return reduce(DataFrame.unionByName, parts)


class MappedSources:
    """Sources under a mapping, for queries: a star of patterns about one subject is one scan of each source that has all its predicates."""

    def __init__(self, spark: SparkSession, text: str, base: str = "", views: dict[str, DataFrame] | None = None):
        self.spark, self.maps, self.base, self.views, self.text = spark, parse_mapping(text), base, views, text

    def _of(self, table: str, predicate: str):
        if predicate == TYPE:
            m = self.maps[table]
            return (TermMap("constant", m.classes[0], 1), {}) if m.classes else None
        return next(((o, joins) for p, o, joins in self.maps[table].objects if p.kind == "constant" and p.text == predicate and (not joins or set(o.columns()) <= set(joins))), None)

    def frame(self, predicate: str | None = None) -> DataFrame:
        every = triples(self.spark, self.text, self.base, self.views).drop("g")
        return every if predicate is None else every.where(F.col("p") == predicate)

    def tables_of(self, predicate: str, o=None) -> set[str]:
        if predicate == TYPE:
            return {n for n, m in self.maps.items() if o and o[0] == "term" and m.classes == [o[2]]}
        # A source that has a predicate twice, or joined from elsewhere, is read triple by triple.
        count = lambda m: sum(p.kind == "constant" and p.text == predicate for p, _, _ in m.objects)
        having = {n for n, m in self.maps.items() if count(m)}
        return having if all(count(self.maps[n]) == 1 and self._of(n, predicate) for n in having) else set()

    def rows(self, table: str) -> DataFrame:
        return load(self.spark, self.maps[table], self.base, self.views)

    def subject(self, table: str) -> Column:
        return self.maps[table].subject.value()

    def subject_is(self, table: str, iri: str) -> Column:
        return self.maps[table].subject.test(iri)

    def value(self, table: str, predicate: str):
        o, joins = self._of(table, predicate)
        return o.t, o.value(joins), (None if o.t != 2 or o.lang else o.dt or XSD + "string")

    def value_is(self, table: str, predicate: str, text: str) -> Column:
        o, joins = self._of(table, predicate)
        return o.value(joins) == text if joins or o.kind == "constant" else o.test(text)


def to_construct(text: str) -> dict[str, str]:
    """Each triples map as a CONSTRUCT query over its rows, for tarql()."""
    out = {}
    for name, m in parse_mapping(text).items():
        binds, template = [], []

        def var(t: TermMap, joins=None) -> str:
            v = f"?v{len(binds)}"
            col = lambda c: "?" + (joins or {}).get(c, c).replace(" ", "_")
            if t.kind == "constant":
                e = f"<{t.text}>" if t.t == 1 else '"' + t.text.replace('"', '\\"') + '"'
                e = f"IRI(STR({e}))" if t.t == 1 else e
            else:
                parts, at = [], 0
                for slot in SLOT.finditer(t.text) if t.kind == "template" else ():
                    parts += [f'"{t.text[at:slot.start()]}"', f"ENCODE_FOR_URI(STR({col(slot[1])}))" if t.t == 1 else f"STR({col(slot[1])})"]
                    at = slot.end()
                e = f"CONCAT({', '.join([*parts, chr(34) + t.text[at:] + chr(34)])})" if parts else f"STR({col(t.text)})"
                e = f"IRI({e})" if t.t == 1 else f"BNODE({e})" if t.t == 0 else f'STRLANG({e}, "{t.lang}")' if t.lang else f"STRDT({e}, <{t.dt}>)" if t.dt else e
            binds.append(f"BIND({e} AS {v})")
            return v

        s = var(m.subject)
        template += [f"{s} a <{c}> ." for c in m.classes]
        template += [f"{s} {var(p)} {var(o, joins)} ." for p, o, joins in m.objects if not joins or set(o.columns()) <= set(joins)]
        out[name] = f"CONSTRUCT {{ {' '.join(template)} }} WHERE {{ {' '.join(binds)} }}"
    return out


