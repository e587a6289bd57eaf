"""N-Triples and N-Quads: line formats, read and written with built-in functions, so splits, pruning and pushdown are Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IRI = r"<([^\x00-\x20<>\"{}|^`\\]*)>"
BLANK = r"(_:[^\s<>\"]+)"
LITERAL = r'"((?:[^"\\\r\n]|\\.)*)"(?:\^\^<([^>]*)>|@([a-zA-Z]+(?:-[a-zA-Z0-9]+)*))?'
LINE = rf"^\s*(?:{IRI}|{BLANK})\s*{IRI}\s*(?:{IRI}|{BLANK}|{LITERAL})\s*(?:(?:{IRI}|{BLANK})\s*)?\.\s*(?:#.*)?$"
XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"


def unescape(text: Column) -> Column:
    """Turns escapes into characters.  A doubled backslash is parked on a character that text files can't hold."""
    out = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for code, char in (("\\t", "\t"), ("\\b", "\b"), ("\\n", "\n"), ("\\r", "\r"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'")):
        out = F.replace(out, F.lit(code), F.lit(char))
    parts = F.split(out, r"(?=\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})")

    def piece(x: Column) -> Column:
        short, long = x.rlike(r"^\\u[0-9A-Fa-f]{4}"), x.rlike(r"^\\U[0-9A-Fa-f]{8}")
        code = F.when(short, F.substring(x, 3, 4)).when(long, F.substring(x, 3, 8))
        # A code point becomes text by way of UTF-16, in two units above the first plane.
        above = F.conv(code, 16, 10).cast("long") - 0x10000
        pair = F.concat(F.lower(F.hex(F.shiftright(above, 10) + 0xD800)), F.lower(F.hex(above % 1024 + 0xDC00)))
        units = F.when(above < 0, F.lpad(F.hex(above + 0x10000), 4, "0")).otherwise(pair)
        char = F.decode(F.unhex(units), "UTF-16BE")
        return F.when(short, F.concat(char, F.substring(x, 7, 1 << 30))).when(long, F.concat(char, F.substring(x, 11, 1 << 30))).otherwise(x)

    plain = F.when(out.contains("\\"), F.array_join(F.transform(parts, piece), "")).otherwise(out)
    return F.replace(plain, F.lit("\x00"), F.lit("\\"))


def parse(lines: DataFrame, mode: str = "skip", value: str = "value") -> DataFrame:
    """s, p, o, t, dt, lang, g of lines.  mode: skip drops bad lines, stop raises on them, keep returns them in a column corrupt."""
    text = F.col(value)
    rows = lines.where(~text.rlike(r"^\s*(#.*)?$"))
    ok = text.rlike(LINE)
    if mode == "skip":
        rows = rows.where(ok)
    elif mode == "stop":
        rows = rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad statement: "), text)).cast("boolean")))

    def group(k: int) -> Column:
        return F.regexp_extract(text, LINE, k)

    def term(iri: int, blank: int) -> Column:
        return F.when(group(blank) != "", group(blank)).otherwise(unescape(group(iri)))

    literal = text.rlike(rf"^\s*(?:{IRI}|{BLANK})\s*{IRI}\s*\"")
    kind = F.when(literal, 2).when(group(5) != "", 0).otherwise(1)
    lang = F.when(literal & (group(8) != ""), F.lower(group(8)))
    dt = F.when(literal & lang.isNull(), F.when(group(7) != "", group(7)).otherwise(XSD_STRING))
    graph = F.when(group(10) != "", group(10)).when(group(9) != "", unescape(group(9)))
    out = rows.select(term(1, 2).alias("s"), unescape(group(3)).alias("p"), F.when(literal, unescape(group(6))).otherwise(term(4, 5)).alias("o"), kind.alias("t"), dt.alias("dt"), lang.alias("lang"), graph.alias("g"), *([F.when(~ok, text).alias("corrupt")] if mode == "keep" else []))
    return out


def read(spark: SparkSession, path: str, mode: str = "skip") -> DataFrame:
    return parse(spark.read.text(path), mode)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, code in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def node(term: Column) -> Column:
    return F.when(term.startswith("_:"), term).otherwise(F.concat(F.lit("<"), term, F.lit(">")))


def surface(graph: bool = False) -> Column:
    """The statement of a row of s, p, o, t, dt, lang (and g)."""
    suffix = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).when(F.col("dt").isNotNull() & (F.col("dt") != XSD_STRING), F.concat(F.lit("^^<"), "dt", F.lit(">"))).otherwise(F.lit(""))
    o = F.when(F.col("t") == 2, F.concat(F.lit('"'), escape(F.col("o")), F.lit('"'), suffix)).otherwise(node(F.col("o")))
    return F.concat_ws(" ", node(F.col("s")), node(F.col("p")), o, *([F.when(F.col("g").isNotNull(), node(F.col("g")))] if graph else []), F.lit("."))


def write(df: DataFrame, path: str, mode: str = "errorifexists", graph: bool = False) -> None:
    df.select(surface(graph).alias("value")).write.mode(mode).text(path)
