"""python -m quadrille COMMAND: queries, mappings, counts and prefixes of RDF files, and a SPARQL endpoint."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import algebra
from .plans.sparql import plain, query
from .sources import documents, mapping, tabular, writers

PREFIX_LINES = r"(?i)(?<!\S)@?prefix\s+([\w-]*):\s*<([^>]*)>"


def load(spark: SparkSession, paths: list[str], lang: str | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, (documents.read(spark, p, lang) for p in paths))


def text_of(argument: str) -> str:
    """A query as it is, or that of a file after @."""
    if argument.startswith("@"):
        with open(argument[1:], encoding="utf-8") as f:
            return f.read()
    return argument


def put(df: DataFrame, args) -> None:
    """Triples, quads or solutions, to a folder or to the console."""
    if "s" in df.columns and "o" in df.columns and dict(df.dtypes)["s"] == "string":
        lang = args.format or ("nquads" if "g" in df.columns else "ntriples")
        df = writers.finish(df, args.distinct, args.sort, args.descending)
        out = writers.lines(df, lang)
    elif all(kind.startswith("struct") for _, kind in df.dtypes):
        out = writers.results(df, args.format or "json")
    else:
        out = df.select(F.to_json(F.struct("*")).alias("value"))
    if args.out:
        out.write.mode("overwrite" if args.overwrite else "errorifexists").text(args.out)
    else:
        for row in out.toLocalIterator():
            print(row.value)


def run_query(spark, args):
    put(query(load(spark, args.files, args.lang), text_of(args.query)), args)


def run_tarql(spark, args):
    rows = spark.read.json(args.rows) if args.rows.endswith((".json", ".jsonl")) else tabular.read_csv(spark, args.rows, sep=args.separator)
    put(tabular.tarql(rows, text_of(args.query)), args)


def run_map(spark, args):
    df = load(spark, args.files, args.lang)
    put(algebra.into_graph(df, None if args.graph == "default" else args.graph), args)


def run_count(spark, args):
    print(load(spark, args.files, args.lang).count())


def run_graphs(spark, args):
    quads, text = load(spark, args.files, args.lang), text_of(args.query)
    form = text.upper()
    if args.order:
        put(algebra.graphs_by(quads, text, args.descending), args)
    elif "CONSTRUCT" in form:
        put(algebra.construct_each(quads, text), args)
    elif "ASK" in form:
        put(algebra.graphs_where(quads, text, args.drop), args)
    else:
        for row in plain(algebra.each_graph(quads, text).withColumn("g", F.struct(F.col("g").alias("v")))).toLocalIterator():
            print("\t".join(x or "" for x in row))


def declared_prefixes(spark, paths: list[str]) -> dict[str, str]:
    found = reduce(DataFrame.union, (spark.read.text(p, wholetext=True).select(F.explode(F.arrays_zip(F.regexp_extract_all("value", F.lit(PREFIX_LINES), F.lit(1)).alias("k"), F.regexp_extract_all("value", F.lit(PREFIX_LINES), F.lit(2)).alias("v"))).alias("x")).select("x.k", "x.v") for p in paths))
    return {r.k: r.v for r in found.distinct().collect()}  # prefixes, not statements


def run_prefixes(spark, args):
    declared = declared_prefixes(spark, args.files)
    used = {r.prefix: r for r in writers.used_prefixes(load(spark, args.files, args.lang), declared).collect()}
    for name, ns in sorted(declared.items()):
        if args.what == "all" or (name in used) == (args.what == "used"):
            print(f"PREFIX {name}: <{ns}>" + (f" # {used[name].n}" if name in used else ""))


def run_rml(spark, args):
    with open(args.mapping, encoding="utf-8") as f:
        for name, text in mapping.to_construct(f.read()).items():
            print(f"# {name}\n{text}")


def run_analyze(spark, args):
    """Records of each file, and those that don't parse."""
    for path in args.files:
        try:
            if path.endswith(".csv"):
                df = tabular.read_csv(spark, path)
                print(json.dumps({"file": path, "records": df.count(), "columns": df.columns}))
            elif path.endswith((".json", ".jsonl")) and args.lang is None:
                print(json.dumps({"file": path, "records": tabular.read_json(spark, path).count()}))
            else:
                df = documents.read(spark, path, args.lang, "stop" if (args.lang or documents.language_of(path)) not in ("ntriples", "nquads") else "keep")
                bad = df.where("corrupt is not null").count() if "corrupt" in df.columns else 0
                print(json.dumps({"file": path, "records": df.count() - bad, "bad": bad}))
        except Exception as e:  # noqa: BLE001  the report goes on with the next file
            print(json.dumps({"file": path, "error": str(e).splitlines()[0][:200]}))


def handler(df: DataFrame):
    class Handler(BaseHTTPRequestHandler):
        def answer(self, text: str):
            try:
                out = query(df, text)
                if out.columns == ["answer"]:
                    kind, body = "application/sparql-results+json", json.dumps({"head": {}, "boolean": out.first().answer})
                elif all(k.startswith("struct") for _, k in out.dtypes):
                    rows = [json.loads(r.value) for r in writers.results(out).toLocalIterator()]
                    kind, body = "application/sparql-results+json", json.dumps({"head": {"vars": out.columns}, "results": {"bindings": rows}})
                else:
                    kind, body = "application/n-triples", "\n".join(r.value for r in writers.lines(out, "ntriples").toLocalIterator())
                code = 200
            except Exception as e:  # noqa: BLE001  the client is told
                code, kind, body = 400, "text/plain", str(e).splitlines()[0]
            data = body.encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):  # noqa: N802
            self.answer(parse_qs(urlparse(self.path).query).get("query", [""])[0])

        def do_POST(self):  # noqa: N802
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            self.answer(body if "sparql-query" in self.headers.get("Content-Type", "") else parse_qs(body).get("query", [""])[0])

        def log_message(self, *args):
            pass

    return Handler


def run_endpoint(spark, args):
    """SPARQL's protocol over the files, held in memory and on disk."""
    from pyspark import StorageLevel

    df = load(spark, args.files, args.lang).persist(StorageLevel.MEMORY_AND_DISK)
    ThreadingHTTPServer((args.host, args.port), handler(df)).serve_forever()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quadrille")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, files=True, output=True):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        if files:
            c.add_argument("--lang", help="language of the files; by their ending if not given")
        if output:
            c.add_argument("--out")
            c.add_argument("--format")
            for flag in ("overwrite", "distinct", "sort", "descending"):
                c.add_argument(f"--{flag}", action="store_true")
        return c

    c = command("query", run_query)
    c.add_argument("query", help="text, or @file")
    c.add_argument("files", nargs="+")
    c = command("tarql", run_tarql, files=False)
    c.add_argument("query")
    c.add_argument("rows")
    c.add_argument("--separator", default=",")
    c = command("map", run_map)
    c.add_argument("--graph", default="default")
    c.add_argument("files", nargs="+")
    command("count", run_count, output=False).add_argument("files", nargs="+")
    c = command("graphs", run_graphs)
    c.add_argument("query")
    c.add_argument("files", nargs="+")
    c.add_argument("--order", action="store_true")
    c.add_argument("--drop", action="store_true")
    c = command("prefixes", run_prefixes, output=False)
    c.add_argument("what", choices=["used", "unused", "all"])
    c.add_argument("files", nargs="+")
    command("rml-to-tarql", run_rml, files=False, output=False).add_argument("mapping")
    command("analyze", run_analyze, output=False).add_argument("files", nargs="+")
    c = command("endpoint", run_endpoint, output=False)
    c.add_argument("files", nargs="+")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=7531)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName("quadrille").getOrCreate(), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
