"""Rows of CSV, JSON, XML, Parquet and databases as solutions, and the mapping of such rows to triples by a CONSTRUCT query for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..model import SCHEMA, XSD
from ..plans.sparql import query, term

#: Partitions of a table read from a database by its numeric key.
JDBC_PARTITIONS = 10


def read_csv(spark: SparkSession, path: str, header: bool = True, names: str = "header", **dialect) -> DataFrame:
    """All columns as text; cells may hold line breaks.  names: header (the first line's), row (a, b, c ... as in spreadsheets) or excel (A, B, C ...)."""
    options = {"header": header, "multiLine": True, "escape": '"', "inferSchema": False} | dialect
    df = spark.read.options(**options).csv(path)
    if names == "header" and header:
        return df

    def letters(k: int) -> str:
        text = ""
        while True:
            k, r = divmod(k, 26)
            text = chr(ord("a") + r) + text
            if not k:
                return text
            k -= 1

    made = [letters(k) for k in range(len(df.columns))]
    return df.toDF(*(m.upper() if names == "excel" else m for m in made))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a JSON text, in a column json: the items of an array, or documents one after another or a line each, whichever a file's first sign shows."""
    text = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "array<string>")
    arrays = text.where(F.col("value").rlike(r"^\s*\[")).select(F.explode(items).alias("json"))
    # Documents follow each other: cut where one ends at the outermost level and the next begins on a line of its own.
    rest = text.where(~F.col("value").rlike(r"^\s*\[")).select(F.explode(F.split(F.trim("value"), r"(?<=[}\]])\s*\n\s*(?=[{\[])")).alias("json"))
    return arrays.unionByName(rest).where(F.trim("json") != "")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | StructType | None = None) -> DataFrame:
    reader = spark.read.option("rowTag", row_tag)
    return (reader.schema(schema) if schema is not None else reader).xml(path)


def read_database(spark: SparkSession, url: str, table: str, key: str | None = None, properties: dict | None = None) -> DataFrame:
    """A table of a database over JDBC, in parts of a numeric key if it has one."""
    props = properties or {}
    if key is None:
        return spark.read.jdbc(url, table, properties=props)
    low, high = spark.read.jdbc(url, f"(SELECT min({key}) AS low, max({key}) AS high FROM {table}) x", properties=props).first()
    if low is None:
        return spark.read.jdbc(url, table, properties=props)
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high + 1, numPartitions=JDBC_PARTITIONS, properties=props)


def source(spark: SparkSession, kind: str, path: str, options: dict | None = None) -> DataFrame:
    """A source of a data lake by its type.  Types whose connector has to be on the class path (cassandra, mongodb) are read by that format."""
    o = options or {}
    if kind == "csv":
        return spark.read.options(**({"header": "true", "multiLine": "true"} | o)).csv(path)
    if kind in ("parquet", "json", "orc", "text"):
        return spark.read.options(**o).format(kind).load(path)
    if kind == "xml":
        return read_xml(spark, path, o.get("rowTag", "row"))
    if kind == "jdbc":
        return spark.read.format("jdbc").options(**({"dbtable": path} | o)).load()
    formats = {"cassandra": "org.apache.spark.sql.cassandra", "mongodb": "mongodb", "rdf": "rdf", "ntriples": "ntriples"}
    return spark.read.format(formats.get(kind, kind)).options(**o).load(*([path] if path else []))


def _kind(data_type: str) -> str | None:
    return {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "timestamp": "dateTime"}.get(data_type, "decimal" if data_type.startswith("decimal") else None)


def solutions(df: DataFrame, typed: bool = False) -> DataFrame:
    """A term a column: plain literals, or literals of the column's own type.  Nested columns become JSON; null is unbound."""
    def made(field) -> Column:
        c, kind = F.col(f"`{field.name}`"), _kind(field.dataType.simpleString()) if typed else None
        text = F.to_json(c) if isinstance(field.dataType, (StructType, ArrayType)) else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if field.dataType.simpleString() == "timestamp" else c.cast("string")
        return F.when(c.isNotNull(), term(2, text, XSD + (kind or "string"))).alias(field.name.replace(" ", "_"))

    return df.select(*(made(f) for f in df.schema.fields))


def numbered(df: DataFrame, name: str = "ROWNUM") -> DataFrame:
    """df with the rows' numbers from 1 on, in order of partitions: counts of partitions give each its first, and no row moves."""
    parts = df.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    counts = parts.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row a partition
    before, at = [], 0
    for r in counts:
        before += [F.lit(r["_part"]), F.lit(at)]
        at += r["n"]
    if not before:
        return df.withColumn(name, F.lit(1))
    first = F.create_map(*before)[F.col("_part")]
    return parts.withColumn(name, first + F.col("_at") % F.lit(1 << 33) + 1).drop("_part", "_at")


def tarql(rows: DataFrame, construct: str, typed: bool = False) -> DataFrame:
    """The triples (or quads) of a CONSTRUCT query for each row, whose columns are the query's first bindings; ?ROWNUM is the row's number if the query names it."""
    df = numbered(rows) if "ROWNUM" in construct else rows
    start = solutions(df, typed)
    if "ROWNUM" in construct:
        start = start.withColumn("ROWNUM", term(2, F.col("ROWNUM")["v"], XSD + "integer"))
    nothing = rows.sparkSession.createDataFrame([], SCHEMA)
    return query(nothing, construct, start)


