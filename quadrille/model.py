"""Triples as DataFrames: s, p, o strings with the object's kind t (0 blank, 1 IRI, 2 literal), datatype dt and language lang.

Ordinary tables become triples by the direct mapping below, and the same mapping is available as SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE = RDF + "type"
COLUMNS = ["s", "p", "o", "t", "dt", "lang"]
SCHEMA = "s string, p string, o string, t int, dt string, lang string"
NUMERIC = [XSD + n for n in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong")]

#: table: (key columns, {column: (kind, referenced table or datatype)})
MAPPING = {
    "region": (["r_regionkey"], {"r_name": "string"}),
    "nation": (["n_nationkey"], {"n_name": "string", "n_regionkey": "region"}),
    "customer": (["c_custkey"], {"c_name": "string", "c_nationkey": "nation", "c_acctbal": "decimal", "c_mktsegment": "string"}),
    "supplier": (["s_suppkey"], {"s_name": "string", "s_nationkey": "nation", "s_acctbal": "decimal"}),
    "part": (["p_partkey"], {"p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "decimal"}),
    "orders": (["o_orderkey"], {"o_custkey": "customer", "o_orderstatus": "string", "o_totalprice": "decimal", "o_orderpriority": "string"}),
    "lineitem": (["l_orderkey", "l_linenumber"], {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier", "l_quantity": "decimal", "l_returnflag": "string"}),
}


def _text(column: str, kind: str) -> str:
    return f"CAST(CAST({column} AS DECIMAL(18,2)) AS STRING)" if kind == "decimal" else f"CAST({column} AS STRING)"


def table_triples(spark: SparkSession, sf_dir: str, tables: list[str]) -> DataFrame:
    """Each table is read once: its columns become an array of predicate and object that is exploded, not a union of scans."""
    parts = []
    for table in tables:
        keys, columns = MAPPING[table]
        key = "concat_ws('-', " + ", ".join(f"CAST({k} AS STRING)" for k in keys) + ")"
        row = [f"named_struct('p', '{TYPE}', 'o', 'urn:class:{table}', 't', 1, 'dt', CAST(NULL AS STRING))"]
        for c, kind in columns.items():
            o, t, dt = (f"concat('urn:{kind}:', CAST({c} AS STRING))", 1, "CAST(NULL AS STRING)") if kind in MAPPING else (_text(c, kind), 2, f"'{XSD}{kind}'")
            row.append(f"named_struct('p', 'urn:{table}#{c}', 'o', {o}, 't', {t}, 'dt', {dt})")
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"concat('urn:{table}:', {key}) AS s", f"explode(array({', '.join(row)})) AS x")
        parts.append(df.select("s", "x.p", "x.o", "x.t", "x.dt", F.lit(None).cast("string").alias("lang")).where("o IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts)


class MappedTables:
    """Tables under the direct mapping, for queries that read just the tables and columns that their patterns name."""

    def __init__(self, spark: SparkSession, sf_dir: str, tables: list[str]):
        self.spark, self.sf_dir, self.tables = spark, sf_dir, tables

    def frame(self, predicate: str | None = None) -> DataFrame:
        """The triples of a predicate, or all."""
        if predicate is None or predicate == TYPE:
            if predicate is None:
                return table_triples(self.spark, self.sf_dir, self.tables)
            return reduce(DataFrame.unionByName, (self._select(t, TYPE) for t in self.tables))
        table = self.table_of(predicate)
        return self._select(table, predicate) if table else table_triples(self.spark, self.sf_dir, self.tables[:1]).where(F.lit(False))

    def _select(self, table: str, predicate: str) -> DataFrame:
        t, v, dt = self.value(table, predicate)
        none = F.lit(None).cast("string")
        return self.rows(table).where(v.isNotNull()).select(self.subject(table).alias("s"), F.lit(predicate).alias("p"), v.alias("o"), F.lit(t).alias("t"), (F.lit(dt) if dt else none).cast("string").alias("dt"), none.alias("lang"))

    def table_of(self, predicate: str, o=None) -> str | None:
        """The table whose column a predicate is, or whose class a type pattern asks for."""
        if predicate == TYPE:
            name = o[2].removeprefix("urn:class:") if o and o[0] == "term" and o[1] == 1 else None
        else:
            name, _, column = predicate.removeprefix("urn:").partition("#")
            name = name if column in MAPPING.get(name, ((), {}))[1] else None
        return name if name in self.tables else None

    def tables_of(self, predicate: str, o=None) -> set[str]:
        if predicate == TYPE and not (o and o[0] == "term"):
            return set()
        table = self.table_of(predicate, o)
        return {table} if table else set()

    def rows(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def subject(self, table: str) -> Column:
        return F.concat(F.lit(f"urn:{table}:"), F.concat_ws("-", *(F.col(k).cast("string") for k in MAPPING[table][0])))

    def subject_is(self, table: str, iri: str) -> Column:
        """A test on the key columns themselves, so that it reaches the scan."""
        parts = iri.removeprefix(f"urn:{table}:").split("-")
        keys = MAPPING[table][0]
        if not iri.startswith(f"urn:{table}:") or len(parts) != len(keys) or not all(p.isdigit() and str(int(p)) == p for p in parts):
            return self.subject(table) == iri
        return reduce(lambda a, b: a & b, (F.col(k) == int(p) for k, p in zip(keys, parts)))

    def value(self, table: str, predicate: str) -> tuple[int, Column, str | None]:
        """Kind, text and datatype of a predicate's objects."""
        if predicate == TYPE:
            return 1, F.lit(f"urn:class:{table}"), None
        column = predicate.partition("#")[2]
        kind = MAPPING[table][1][column]
        if kind in MAPPING:
            return 1, F.concat(F.lit(f"urn:{kind}:"), F.col(column).cast("string")), None
        return 2, F.expr(_text(column, kind)), XSD + kind

    def value_is(self, table: str, predicate: str, text: str) -> Column:
        kind = MAPPING[table][1].get(predicate.partition("#")[2])
        column = F.col(predicate.partition("#")[2])
        if kind == "string":
            return column == text
        number = text.removeprefix(f"urn:{kind}:") if kind in MAPPING else text
        if (kind in MAPPING or kind == "integer") and number.isdigit() and str(int(number)) == number:
            return column == int(number)
        return self.value(table, predicate)[1] == text


def triples_sql(tables: list[str]) -> str:
    """The same mapping for DuckDB, as the text of a common table expression body."""
    parts = []
    for table in tables:
        keys, columns = MAPPING[table]
        s = f"'urn:{table}:' || concat_ws('-', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")"
        parts.append(f"SELECT {s} AS s, '{TYPE}' AS p, 'urn:class:{table}' AS o, 1 AS t, NULL AS dt FROM {table}")
        for c, kind in columns.items():
            o, t, dt = (f"'urn:{kind}:' || CAST({c} AS VARCHAR)", 1, "NULL") if kind in MAPPING else (_text(c, kind).replace("STRING", "VARCHAR"), 2, f"'{XSD}{kind}'")
            parts.append(f"SELECT {s}, 'urn:{table}#{c}', {o}, {t}, {dt} FROM {table} WHERE {c} IS NOT NULL")
    return " UNION ALL ".join(parts)


def triples(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Triples from Python tuples (s, p, o[, t[, dt[, lang]]]); an object is an IRI unless t says otherwise."""
    full = [(*r, *(1, None, None)[len(r) - 3 :]) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def namespace(term: Column) -> Column:
    """The part of an IRI up to its last # or /."""
    return F.regexp_extract(term, r"^(.*[#/])[^#/]*$", 1)


def is_iri(term: Column) -> Column:
    return ~term.startswith("_:")
