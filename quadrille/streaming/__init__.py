"""Streams of triples: files and topics of N-Triples lines, running figures, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import ntriples


def read_files(spark: SparkSession, path: str, mode: str = "skip", files_a_batch: int | None = None) -> DataFrame:
    """Triples and quads of the files that come into a folder."""
    reader = spark.readStream.format("text")
    return ntriples.parse((reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).load(path), mode)


def read_topic(spark: SparkSession, servers: str, topic: str, mode: str = "skip") -> DataFrame:
    """Triples and quads of a Kafka topic, a statement a message; at is the message's time.  The Kafka connector has to be on the class path."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return ntriples.parse(rows.select(F.col("value").cast("string").alias("value")), mode)


def usage(triples: DataFrame) -> DataFrame:
    """property, n: running counts."""
    return triples.groupBy(F.col("p").alias("property")).agg(F.count("*").alias("n"))


def windowed(triples: DataFrame, at: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """start, property, n: counts for each window of a time column; windows close once later rows are so far ahead."""
    rows = triples.withWatermark(at, late).groupBy(F.window(at, size), F.col("p").alias("property")).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "property", "n")


def write(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A stream of triples as N-Triples files."""
    lines = df.select(ntriples.surface("g" in df.columns).alias("value"))
    writer = lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
