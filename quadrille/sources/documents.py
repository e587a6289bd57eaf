"""RDF in whole documents: Turtle, TriG, RDF/XML, TriX, RDF/JSON and JSON-LD, parsed on the executors, one file a record.

Line formats are in ntriples.py.  read() picks the language by name or by a path's ending; the data source "rdf" does the same for spark.read.format("rdf").
Blank nodes get a mark of their document, so that those of two files never meet.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import RDF, SCHEMA, TYPE, XSD
from ..plans.sparql_parser import Parser, SparqlError
from . import ntriples

COLUMNS = ["s", "p", "o", "t", "dt", "lang", "g"]
QUAD_SCHEMA = SCHEMA + ", g string"
ENDINGS = {"nt": "ntriples", "ntriples": "ntriples", "nq": "nquads", "nquads": "nquads", "ttl": "turtle", "turtle": "turtle", "n3": "turtle", "trig": "trig", "rdf": "rdfxml", "owl": "rdfxml", "xml": "rdfxml", "trix": "trix", "rj": "rdfjson", "json": "jsonld", "jsonld": "jsonld"}
Quad = tuple


class TurtleParser(Parser):
    """Turtle and TriG: the statements of SPARQL's patterns, with names for blank nodes in place of variables."""

    def __init__(self, text: str, mark: str, base: str = ""):
        super().__init__(text)
        self.mark, self.base, self.prefixes = mark, base, {}

    def quads(self) -> Iterator[Quad]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            word = text.lstrip("@").upper()
            if (kind == "lang" or kind == "word") and word in ("PREFIX", "BASE"):
                self.next()
                if word == "PREFIX":
                    name = self.next()[1]
                    self.prefixes[name.rstrip(":")] = self.iri(*self.next())
                else:
                    self.base = self.iri(*self.next())
                self.take(".")
                continue
            if self.take("GRAPH"):
                yield from self.block(self.term())
            elif self.is_("{"):
                yield from self.block(None)
            elif kind in ("iri", "pname", "bnode") and self.peek(1)[1] == "{":
                yield from self.block(self.term())
            else:
                out: list = []
                s = self.node(out)
                if not self.is_("."):
                    self.properties(s, out)
                self.want(".")
                yield from (self.quad(x, None) for x in out)

    def block(self, graph):
        self.want("{")
        out = self.triples_until("}")
        self.want("}")
        self.take(".")
        yield from (self.quad(x, graph) for x in out)

    def iri(self, kind, text):
        made = super().iri(kind, text)
        return urljoin(self.base, made) if kind == "iri" and self.base and ":" not in made.split("/")[0] else made

    def path(self):
        return self.term()

    def name(self, node) -> str:
        return f"_:{self.mark}{node[1].strip('_')}" if node[0] == "var" else node[2]

    def quad(self, triple, graph) -> Quad:
        s, p, o = triple
        literal = o[0] == "term" and o[1] == 2
        return self.name(s), self.name(p), o[2] if literal else self.name(o), 2 if literal else 0 if o[0] == "var" else 1, o[3] if literal else None, o[4] if literal else None, self.name(graph) if graph else None


def parse_turtle(text: str, mark: str = "", base: str = "") -> Iterator[Quad]:
    return TurtleParser(text, mark, base).quads()


class XmlParser:
    """RDF/XML."""

    LANG, BASE = "{http://www.w3.org/XML/1998/namespace}lang", "{http://www.w3.org/XML/1998/namespace}base"

    def __init__(self, text: str, mark: str = "", base: str = ""):
        self.root, self.mark, self.base, self.fresh, self.out = ET.fromstring(text), mark, base, 0, []

    @staticmethod
    def full(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def blank(self) -> str:
        self.fresh += 1
        return f"_:{self.mark}x{self.fresh}"

    def add(self, s, p, o, t=1, dt=None, lang=None):
        self.out.append((s, p, o, t, dt, lang, None))

    def link(self, s, p, o):
        self.add(s, p, o, 0 if o.startswith("_:") else 1)

    def text(self, s, p, value, lang, dt=None):
        self.add(s, p, value, 2, None if lang and not dt else dt or XSD + "string", lang if lang and not dt else None)

    def quads(self) -> list[Quad]:
        if self.full(self.root.tag) == RDF + "RDF":
            base = self.root.get(self.BASE, self.base)
            for x in self.root:
                self.node(x, base, (self.root.get(self.LANG) or "").lower())
        else:
            self.node(self.root, self.base, "")
        return self.out

    def node(self, e, base: str, lang: str) -> str:
        base, lang = e.get(self.BASE, base), e.get(self.LANG, lang).lower()
        at = {self.full(k): v for k, v in e.attrib.items()}
        if RDF + "about" in at:
            s = urljoin(base, at[RDF + "about"])
        elif RDF + "ID" in at:
            s = urljoin(base, "#" + at[RDF + "ID"])
        else:
            s = f"_:{self.mark}n{at[RDF + 'nodeID']}" if RDF + "nodeID" in at else self.blank()
        if self.full(e.tag) != RDF + "Description":
            self.link(s, TYPE, self.full(e.tag))
        self.attributes(s, at, base, lang)
        items = 0
        for x in e:
            p = self.full(x.tag)
            if p == RDF + "li":
                items += 1
                p = f"{RDF}_{items}"
            self.property(s, p, x, base, lang)
        return s

    def attributes(self, s, at, base, lang):
        for k, v in at.items():
            if k == TYPE:
                self.link(s, TYPE, urljoin(base, v))
            elif not k.startswith("http://www.w3.org/XML") and k[len(RDF) :] not in ("about", "ID", "nodeID", "resource", "datatype", "parseType") if k.startswith(RDF) else not k.startswith("http://www.w3.org/XML"):
                self.text(s, k, v, lang)

    def property(self, s, p, e, base, lang):
        base, lang = e.get(self.BASE, base), e.get(self.LANG, lang).lower()
        at = {self.full(k): v for k, v in e.attrib.items()}
        kind = at.get(RDF + "parseType")
        if kind == "Resource":
            o = self.blank()
            self.link(s, p, o)
            for x in e:
                self.property(o, self.full(x.tag), x, base, lang)
        elif kind == "Collection":
            nodes = [self.node(x, base, lang) for x in e]
            cells = [self.blank() for _ in nodes] + [RDF + "nil"]
            self.link(s, p, cells[0])
            for cell, node, rest in zip(cells, nodes, cells[1:]):
                self.link(cell, RDF + "first", node)
                self.link(cell, RDF + "rest", rest)
        elif kind:
            self.text(s, p, (e.text or "") + "".join(ET.tostring(x, "unicode") for x in e), "", RDF + "XMLLiteral")
        elif RDF + "resource" in at:
            self.link(s, p, o := urljoin(base, at[RDF + "resource"]))
            self.attributes(o, at, base, lang)
        elif RDF + "nodeID" in at:
            self.link(s, p, f"_:{self.mark}n{at[RDF + 'nodeID']}")
        elif len(e):
            self.link(s, p, self.node(e[0], base, lang))
        elif (extra := {k: v for k, v in at.items() if not k.startswith(RDF) and not k.startswith("http://www.w3.org/XML")}) and not (e.text or "").strip():
            self.link(s, p, o := self.blank())
            self.attributes(o, extra, base, lang)
        else:
            self.text(s, p, e.text or "", lang, at.get(RDF + "datatype"))


def parse_rdfxml(text: str, mark: str = "", base: str = "") -> list[Quad]:
    return XmlParser(text, mark, base).quads()


def parse_trix(text: str, mark: str = "", base: str = "") -> Iterator[Quad]:
    local = lambda e: e.tag.rsplit("}", 1)[-1]

    def term(e):
        value = (e.text or "").strip() if local(e) in ("uri", "id") else e.text or ""
        if local(e) == "uri":
            return value, 1, None, None
        if local(e) == "id":
            return f"_:{mark}{value}", 0, None, None
        lang = e.get(XmlParser.LANG)
        return value, 2, None if lang else e.get("datatype") or XSD + "string", lang.lower() if lang else None

    for graph in ET.fromstring(text):
        name = next((term(e)[0] for e in graph if local(e) in ("uri", "id")), None)
        for triple in (e for e in graph if local(e) == "triple"):
            s, p, o = map(term, triple)
            yield s[0], p[0], *o, name


def parse_rdfjson(text: str, mark: str = "", base: str = "") -> Iterator[Quad]:
    own = lambda x: f"_:{mark}{x[2:]}" if x.startswith("_:") else x
    for s, properties in json.loads(text).items():
        for p, objects in properties.items():
            for o in objects:
                if o["type"] == "literal":
                    lang = o.get("lang")
                    yield own(s), p, o["value"], 2, None if lang else o.get("datatype") or XSD + "string", lang.lower() if lang else None, None
                else:
                    yield own(s), p, own(o["value"]), 0 if o["type"] == "bnode" else 1, None, None, None


class JsonLd:
    """JSON-LD with inline contexts: terms, prefixes, @vocab, types, languages, lists, sets, reverse links and graphs."""

    def __init__(self, mark: str, base: str):
        self.mark, self.base, self.fresh, self.out = mark, base, 0, []

    def blank(self):
        self.fresh += 1
        return f"_:{self.mark}j{self.fresh}"

    def context(self, old: dict, new) -> dict:
        for c in new if isinstance(new, list) else [new]:
            if c is None:
                old = {}
            elif isinstance(c, dict):
                old = old | {k: {"@id": v} if isinstance(v, str) and k[0] != "@" else v for k, v in c.items()}
            else:
                raise ValueError(f"contexts by address are not fetched: {c}")
        return old

    def iri(self, c: dict, x: str, term: bool = True) -> str:
        if x.startswith("_:"):
            return f"_:{self.mark}{x[2:]}"
        if term and isinstance(c.get(x), dict) and c[x].get("@id", x) != x:
            return self.iri(c, c[x]["@id"])
        prefix, colon, rest = x.partition(":")
        if colon and isinstance(c.get(prefix), dict) and not rest.startswith("//"):
            return self.iri(c, c[prefix]["@id"]) + rest
        return x if colon or x[0] == "@" else c.get("@vocab", "") + x if term and "@vocab" in c else urljoin(c.get("@base", self.base), x)

    def add(self, s, p, o, g):
        self.out.append((s, p, *o, g))

    def value(self, c, x, how: dict, g):
        """The term of a value; its own statements are added."""
        if isinstance(x, dict) and "@value" in x or not isinstance(x, (dict, list)):
            v = x["@value"] if isinstance(x, dict) else x
            dt = x.get("@type") if isinstance(x, dict) else how.get("@type")
            lang = x.get("@language") if isinstance(x, dict) else how.get("@language", c.get("@language"))
            if dt in ("@id", "@vocab"):
                o = self.iri(c, v, dt == "@vocab")
                return o, 0 if o.startswith("_:") else 1, None, None
            if isinstance(v, bool):
                return str(v).lower(), 2, self.iri(c, dt) if dt else XSD + "boolean", None
            if isinstance(v, (int, float)):
                return (repr(v) if isinstance(v, int) else f"{v:E}"), 2, self.iri(c, dt) if dt else XSD + ("integer" if isinstance(v, int) else "double"), None
            return v, 2, self.iri(c, dt) if dt else None if lang else XSD + "string", lang.lower() if lang and not dt else None
        if isinstance(x, dict) and "@list" in x:
            return self.cells(c, x["@list"], how, g)
        o = self.node(c, x, g)
        return o, 0 if o.startswith("_:") else 1, None, None

    def cells(self, c, items, how, g):
        cells = [self.blank() for _ in items] + [RDF + "nil"]
        for cell, item, rest in zip(cells, items, cells[1:]):
            self.add(cell, RDF + "first", self.value(c, item, how, g), g)
            self.add(cell, RDF + "rest", (rest, 0 if rest.startswith("_:") else 1, None, None), g)
        return cells[0], 0 if items else 1, None, None

    def node(self, c, x, g=None) -> str:
        c = self.context(c, x["@context"]) if "@context" in x else c
        key = lambda k: c[k].get("@id", k) if isinstance(c.get(k), dict) and str(c[k].get("@id", "")).startswith("@") else k
        x = {key(k): v for k, v in x.items()}
        s = self.iri(c, x["@id"], False) if "@id" in x else self.blank()
        for t in [x["@type"]] if isinstance(x.get("@type"), str) else x.get("@type", []):
            self.add(s, TYPE, (self.iri(c, t), 1, None, None), g)
        if "@graph" in x:
            inner = s if "@id" in x else g
            for y in x["@graph"] if isinstance(x["@graph"], list) else [x["@graph"]]:
                self.node(c, y, inner)
        for k, v in x.get("@reverse", {}).items():
            for y in v if isinstance(v, list) else [v]:
                self.add(self.node(c, y, g) if isinstance(y, dict) else self.iri(c, y, False), self.iri(c, k), (s, 0 if s.startswith("_:") else 1, None, None), g)
        for k, v in x.items():
            if k[0] == "@":
                continue
            how = c[k] if isinstance(c.get(k), dict) else {}
            p = self.iri(c, k)
            if ":" not in p:
                continue
            if how.get("@container") == "@list":
                self.add(s, p, self.cells(c, v if isinstance(v, list) else [v], how, g), g)
                continue
            if how.get("@container") == "@language" and isinstance(v, dict):
                v = [{"@value": y, "@language": lang} for lang, y in v.items()]
            if isinstance(v, dict) and "@set" in v:
                v = v["@set"]
            for y in v if isinstance(v, list) else [v]:
                if y is not None:
                    self.add(s, p, self.value(c, y, how, g), g)
        return s


def parse_jsonld(text: str, mark: str = "", base: str = "") -> list[Quad]:
    ld, data = JsonLd(mark, base), json.loads(text)
    for x in data if isinstance(data, list) else [data]:
        ld.node({}, x)
    return ld.out


#: What parses the documents of a language: (text, mark of blank nodes, base) to quads.
PARSERS: dict[str, Callable] = {"turtle": parse_turtle, "trig": parse_turtle, "rdfxml": parse_rdfxml, "trix": parse_trix, "rdfjson": parse_rdfjson, "jsonld": parse_jsonld}


def register(lang: str, parser: Callable) -> None:
    """Adds a language, or replaces its parser."""
    PARSERS[lang] = parser


def language_of(path: str) -> str:
    name = re.sub(r"\.(gz|bz2|zst)$", "", path.rstrip("/")).rsplit("/", 1)[-1]
    try:
        return ENDINGS[name.rsplit(".", 1)[-1].lower()]
    except KeyError:
        raise ValueError(f"no language for {path}") from None


def _quads(lang: str, path: str, text: str, mode: str, base: str) -> list[Quad]:
    try:
        return list(PARSERS[lang](text, hashlib.md5(path.encode()).hexdigest()[:8] + "-", base))
    except (SparqlError, ET.ParseError, ValueError, KeyError) as e:
        if mode == "skip":
            return []
        raise ValueError(f"{path}: {e}") from e


def read(spark: SparkSession, path: str, lang: str | None = None, mode: str = "stop", base: str = "") -> DataFrame:
    """s, p, o, t, dt, lang, g of a file or folder.  mode: stop raises on what does not parse, skip passes over it (a line, or a document)."""
    lang = lang or language_of(path)
    if lang in ("ntriples", "nquads"):
        return ntriples.read(spark, path, mode)
    parsers = {lang: PARSERS[lang]}

    def work(batches):
        PARSERS.update(parsers)
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                quads = _quads(lang, name, content.decode("utf-8-sig"), mode, base)
                for k in range(0, len(quads), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "t" else pa.string()) for n, c in zip(COLUMNS, zip(*quads[k : k + 20_000]))], names=COLUMNS)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, QUAD_SCHEMA)


def loads(spark: SparkSession, text: str, lang: str = "turtle", base: str = "") -> DataFrame:
    """The quads of a document in hand."""
    return spark.createDataFrame(list(PARSERS[lang](text, "", base)), QUAD_SCHEMA)


class _Paths(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _RdfReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.lang, self.mode, self.base = options["path"], options.get("lang"), options.get("mode", "stop"), options.get("base", "")

    def files(self) -> list[str]:
        parsed = urlparse(self.path)
        if parsed.scheme in ("", "file"):
            at = parsed.path if parsed.scheme else self.path
            found = [at] if os.path.isfile(at) else [os.path.join(d, n) for d, _, names in os.walk(at) for n in names]
        else:
            from pyarrow import fs

            where, at = fs.FileSystem.from_uri(self.path)
            info = where.get_file_info(at)
            found = [self.path] if info.is_file else [self.path.split(at, 1)[0] + i.path for i in where.get_file_info(fs.FileSelector(at, recursive=True)) if i.is_file]
        return sorted(f for f in found if os.path.basename(f)[0] not in "._")

    def partitions(self):
        return [_Paths(f) for f in self.files()] or [_Paths("")]

    def read(self, partition):
        if not partition.path:
            return
        if "://" in partition.path:
            from pyarrow import fs

            where, at = fs.FileSystem.from_uri(partition.path)
            with where.open_input_stream(at) as f:
                text = f.read().decode("utf-8-sig")
        else:
            with open(partition.path, encoding="utf-8-sig", newline="") as f:
                text = f.read()
        lang = self.lang or language_of(partition.path)
        if lang in ("ntriples", "nquads"):
            lang = "trig"  # each statement in line form is one in TriG, but for graphs
            text = re.sub(r"(?m)^(.*\S)\s+(<[^<>\s]*>|_:\S+)\s*\.\s*$", lambda m: f"{m[2]} {{ {m[1]} }}" if _is_statement(m[1]) else m[0], text)
        yield from _quads(lang, partition.path, text, self.mode, self.base)


def _is_statement(text: str) -> bool:
    return re.match(ntriples.LINE, text + " .") is not None


class Rdf(DataSource):
    """spark.read.format("rdf").option("lang", ...).load(path)"""

    @classmethod
    def name(cls):
        return "rdf"

    def schema(self):
        return QUAD_SCHEMA

    def reader(self, schema):
        return _RdfReader(self.options)


class NTriples(Rdf):
    """spark.read.format("ntriples").load(path)"""

    @classmethod
    def name(cls):
        return "ntriples"

    def reader(self, schema):
        return _RdfReader({"lang": "ntriples"} | dict(self.options))


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(Rdf)
    spark.dataSource.register(NTriples)


def graphs(quads: DataFrame, ordered: bool = False, distinct: bool = True) -> DataFrame:
    """g, statements: each named graph as one record (an N-Triples text), for languages whose unit is a graph."""
    from pyspark.sql import functions as F

    rows = quads.where("g is not null")
    rows = rows.dropDuplicates() if distinct else rows
    made = rows.select("g", ntriples.surface().alias("line")).groupBy("g").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("statements"))
    return made.orderBy("g") if ordered else made
