"""RDF and result sets as text in several languages; each partition is a document of its own, or a part that can be put after others."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import RDF, TYPE, XSD, namespace
from . import ntriples


def _short(iri: str, prefixes: dict[str, str]) -> str:
    for name, ns in prefixes.items():
        rest = iri[len(ns) :]
        if iri.startswith(ns) and rest and rest.replace("_", "a").replace("-", "a").isalnum() and rest.isascii():
            return f"{name}:{rest}"
    return iri if iri.startswith("_:") else f"<{iri}>"


def _literal(o: str, dt: str | None, lang: str | None, prefixes: dict[str, str]) -> str:
    text = json.dumps(o, ensure_ascii=False).replace("\x7f", "\\u007F")
    return text + (f"@{lang}" if lang else "" if dt in (None, XSD + "string") else "^^" + _short(dt, prefixes))


def _object(r: dict, prefixes) -> str:
    return _literal(r["o"], r["dt"], r["lang"], prefixes) if r["t"] == 2 else _short(r["o"], prefixes)


def _turtle(rows: list[dict], prefixes) -> Iterator[str]:
    """Statements about one subject, and one property, in a row are put together."""
    yield from (f"@prefix {k}: <{v}> ." for k, v in prefixes.items())
    graph = subject = predicate = None
    line = ""
    for r in rows:
        g, s, p = r.get("g"), r["s"], r["p"]
        o, verb = _object(r, prefixes), "a" if p == TYPE else _short(p, prefixes)
        if line and (g, s, p) == (graph, subject, predicate):
            line += f" , {o}"
            continue
        if line and (g, s) == (graph, subject):
            line += f" ;\n    {verb} {o}"
        else:
            if line:
                yield line + " ."
            if g != graph:
                if graph is not None:
                    yield "}"
                if g is not None:
                    yield f"{_short(g, prefixes)} {{"
            line = f"{_short(s, prefixes)} {verb} {o}"
        graph, subject, predicate = g, s, p
    if line:
        yield line + " ."
    if graph is not None:
        yield "}"


def _rdfjson(rows, prefixes):
    for r in rows:
        o = {"value": r["o"], "type": ("bnode", "uri", "literal")[r["t"]]} | ({"lang": r["lang"]} if r["lang"] else {"datatype": r["dt"]} if r["t"] == 2 and r["dt"] != XSD + "string" else {})
        yield json.dumps({r["s"]: {r["p"]: [o]}}, ensure_ascii=False)


def _jsonld(rows, prefixes):
    """Expanded form, a node a line."""
    for r in rows:
        o = {"@value": r["o"]} | ({"@language": r["lang"]} if r["lang"] else {"@type": r["dt"]} if r["dt"] and r["dt"] != XSD + "string" else {}) if r["t"] == 2 else {"@id": r["o"]}
        node = {"@id": r["s"], **({"@type": [r["o"]]} if r["p"] == TYPE and r["t"] == 1 else {r["p"]: [o]})}
        yield json.dumps({"@id": r["g"], "@graph": [node]} if r.get("g") else node, ensure_ascii=False)


def _rdfxml(rows, prefixes):
    yield f'<rdf:RDF xmlns:rdf="{RDF}">'
    for r in rows:
        cut = max(r["p"].rfind("#"), r["p"].rfind("/"), r["p"].rfind(":")) + 1
        about = f'rdf:nodeID="{r["s"][2:]}"' if r["s"].startswith("_:") else f"rdf:about={quoteattr(r['s'])}"
        at = "" if r["t"] == 2 else f' rdf:nodeID="{r["o"][2:]}"' if r["t"] == 0 else f" rdf:resource={quoteattr(r['o'])}"
        at += f' xml:lang="{r["lang"]}"' if r["lang"] else f" rdf:datatype={quoteattr(r['dt'])}" if r["t"] == 2 and r["dt"] and r["dt"] != XSD + "string" else ""
        value = escape(r["o"]) if r["t"] == 2 else ""
        yield f"<rdf:Description {about}><q:{r['p'][cut:]} xmlns:q={quoteattr(r['p'][:cut])}{at}>{value}</q:{r['p'][cut:]}></rdf:Description>"
    yield "</rdf:RDF>"


def _trix(rows, prefixes):
    def term(x, t):
        return f"<id>{escape(x[2:])}</id>" if t == 0 or x.startswith("_:") and t != 2 else f"<uri>{escape(x)}</uri>"

    yield '<trix xmlns="http://www.w3.org/2004/03/trix/trix-1/">'
    for r in rows:
        lit = f'<plainLiteral xml:lang="{r["lang"]}">{escape(r["o"])}</plainLiteral>' if r["lang"] else f"<typedLiteral datatype={quoteattr(r['dt'] or XSD + 'string')}>{escape(r['o'])}</typedLiteral>"
        yield f"<graph>{term(r['g'], 1) if r.get('g') else ''}<triple>{term(r['s'], 1)}{term(r['p'], 1)}{lit if r['t'] == 2 else term(r['o'], r['t'])}</triple></graph>"
    yield "</trix>"


#: Each turns the rows of a partition into lines.  Of RDF/JSON and JSON-LD every line is a document.
WRITERS = {"turtle": _turtle, "trig": _turtle, "rdfjson": _rdfjson, "jsonld": _jsonld, "rdfxml": _rdfxml, "trix": _trix}
GROUPED = ("turtle", "trig")


def lines(df: DataFrame, lang: str = "turtle", prefixes: dict[str, str] | None = None) -> DataFrame:
    """A column value of lines.  Turtle and TriG put a subject's statements together where they are neighbours."""
    if lang in ("ntriples", "nquads"):
        return df.select(ntriples.surface(lang == "nquads").alias("value"))
    names, work = prefixes or {}, WRITERS[lang]
    if lang in GROUPED:
        df = df.sortWithinPartitions(*(c for c in ("g", "s", "p") if c in df.columns and (c != "g" or lang == "trig")))
    if lang not in ("trig", "trix", "jsonld") and "g" in df.columns:
        df = df.drop("g")

    def run(batches):
        def rows():
            for b in batches:
                yield from b.to_pylist()

        held = []
        for line in work(rows(), names):
            held.append(line)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(held)], names=["value"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    return df.mapInArrow(run, "value string")


def finish(df: DataFrame, distinct: bool = False, order: bool = False, descending: bool = False, partitions: int | None = None) -> DataFrame:
    """What a writer does first if asked: distinct, then sort by graph, subject, property and object."""
    df = df.distinct() if distinct else df
    if order:
        keys = [F.col(c).desc() if descending else F.col(c) for c in ("g", "s", "p", "o") if c in df.columns]
        df = (df.repartitionByRange(partitions, *keys) if partitions else df).orderBy(*keys)
    elif partitions:
        df = df.coalesce(partitions)
    return df


def write(df: DataFrame, path: str, lang: str = "turtle", prefixes: dict[str, str] | None = None, mode: str = "errorifexists", single: bool = False, **how) -> None:
    df = finish(df, **how)
    lines(df.coalesce(1) if single else df, lang, prefixes).write.mode(mode).text(path)


def used_prefixes(df: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """prefix, namespace, n: those of the given prefixes that terms of df have, with the number of mentions."""
    terms = df.select(F.explode(F.array("s", "p", F.when(F.col("t") == 1, F.col("o")), F.col("dt"))).alias("iri")).where("iri is not null")
    known = F.create_map(*(x for k, v in prefixes.items() for x in (F.lit(v), F.lit(k))))
    return terms.groupBy(namespace(F.col("iri")).alias("namespace")).agg(F.count("*").alias("n")).withColumn("prefix", known[F.col("namespace")]).where("prefix is not null").select("prefix", "namespace", "n")


def results(df: DataFrame, form: str = "json") -> DataFrame:
    """Solutions of a SELECT as lines: the bindings of SPARQL's JSON (an object a line), CSV or TSV."""
    if form == "json":
        def binding(v):
            x = F.col(v)
            return F.when(x.isNotNull(), F.struct(F.element_at(F.array(F.lit("bnode"), F.lit("uri"), F.lit("literal")), x["t"] + 1).alias("type"), x["v"].alias("value"), F.when(x["dt"] != XSD + "string", x["dt"]).alias("datatype"), x["lang"].alias("xml:lang"))).alias(v)

        return df.select(F.to_json(F.struct(*(binding(v) for v in df.columns))).alias("value"))
    if form == "csv":
        return df.select(F.to_csv(F.struct(*(F.col(v)["v"].alias(v) for v in df.columns))).alias("value"))

    def term(v):
        x = F.col(v)
        suffix = F.when(x["lang"].isNotNull(), F.concat(F.lit("@"), x["lang"])).when(x["dt"] != XSD + "string", F.concat(F.lit("^^<"), x["dt"], F.lit(">"))).otherwise("")
        return F.coalesce(F.when(x["t"] == 2, F.concat(F.lit('"'), ntriples.escape(x["v"]), F.lit('"'), suffix)).otherwise(ntriples.node(x["v"])), F.lit(""))

    return df.select(F.concat_ws("\t", *(term(v) for v in df.columns)).alias("value"))
