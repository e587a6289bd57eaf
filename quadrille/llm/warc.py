"""Operator 2: WARC archives, written by Spark's own text writer and read by a Python data source.

Writing needs no Python: a record is one string, and the text writer's line separator is the record separator, so any file system and commit
protocol that Spark has serves.  Equal payloads are found on a narrow table of ids, digests and urls; payloads themselves go from the scan straight into the
archive.  Whether a row is a revisit, and so has no payload to write, is asked of a bitmap of hashed ids of fixed size; the few rows that only share a bit with
a revisit are picked out by a join.  Reading plans whole files into partitions (one large archive is one task), takes predicates on the record type and header
columns into the reader, parses a record's headers first, and seeks over payloads that no one asked for.

Equal payloads (of min_bytes at least): the smallest page id is the response, the others revisits of it.  Null html: an empty payload.  Null url: no
target header; line breaks in it are dropped.  Rows that repeat a page id and its payload are each a response.  Null ids come last.  An empty table: an archive
without records.  Very long payloads: one string each, as Spark holds them.  Extra columns, whatever their names, are ignored.
"""

import gzip
import hashlib
import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from .common import fresh_path, stored, table

CRLF = "\r\n"
END = "\r\n\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{END}"
MIN_BYTES = 100
PARTITION_BYTES = 64 << 20


#: Bits of the map of revisits that all tasks get: 8 MB, whatever the input.  The more revisits, the more other rows share a bit with one and go through a join.
MAP_BITS = 1 << 26


def narrow(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, digest, n_bytes and payload of each page."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    return rows.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "n_bytes": F.octet_length("payload").cast("long")})


def find_revisits(rows: DataFrame, min_bytes: int) -> DataFrame:
    """The rows (page_id, url, digest, n_bytes) that repeat a payload, with refers_to."""
    # Grouped by one key more than the join has: the join then gets its own exchanges, and a hot digest's rows can be split at run time.
    first = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").select(F.col("digest").alias("of"), "refers_to")
    return rows.join(first, rows.digest == F.col("of")).where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull()).drop("of")


def _bit(seed: int, bits: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("page_id").cast("string"), F.lit(""))), F.lit(bits))


def marked(rows: DataFrame, ids: DataFrame, seed: int, bits: int) -> DataFrame:
    """rows with a column marked: whether the bitmap of ids has the bit of the row's page_id."""
    bit = _bit(seed, bits)
    maps = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("map", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("_byte >> _place & 1") == 1, F.lit(False))
    joined = rows.join(F.broadcast(maps), F.bitmap_bucket_number(bit) == F.col("bucket"), "left").withColumns({"_byte": byte, "_place": (place % 8).cast("int")})
    return joined.withColumn("marked", hit).drop("bucket", "map", "_byte", "_place")


def record(rows: DataFrame):
    """The text of one record, without the separator after it."""

    def head(name: str, value):
        return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))

    response = F.col("refers_to").isNull()
    block = F.when(response, F.concat(F.lit(HTTP), "payload")).otherwise(F.lit(HTTP))
    clean = F.regexp_replace("url", r"[\x00-\x1f\x7f]", "")
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        head("WARC-Type", F.when(response, F.lit("response")).otherwise(F.lit("revisit"))),
        head("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        head("WARC-Target-URI", clean),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z" + CRLF),
        head("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        head("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        head("X-Payload-Length", F.col("n_bytes").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF),
        head("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, bits: int = MAP_BITS, **columns) -> None:
    """Three folders of archives: revisits (headers alone), responses, and those responses whose id shares a bit with a revisit's."""

    def put(rows: DataFrame, name: str) -> None:
        rows.select(record(rows).alias("value")).write.option("lineSep", END).text(f"{path}/{name}")

    whole = narrow(pages, **columns)
    rows = stored(whole.drop("payload"), "warc-rows")
    again = stored(find_revisits(rows, min_bytes), "warc-revisits")
    put(again.withColumn("payload", F.lit("")), "revisits")
    if again.isEmpty():
        put(whole.withColumn("refers_to", F.lit(None).cast("string")), "responses")
        return
    told = marked(whole, again, 1, bits).withColumn("refers_to", F.lit(None).cast("string"))
    put(told.where(~F.col("marked")), "responses")
    key = ["page_id", "digest"]
    same = lambda x: F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of"))
    ids = again.select(F.col("page_id").alias("id"), F.col("digest").alias("of"))
    spared = stored(marked(rows, again, 1, bits).where("marked").select(*key).join(ids, same(ids), "left_anti").distinct(), "warc-spared")
    if not spared.isEmpty():
        ids = spared.select(F.col("page_id").alias("id"), F.col("digest").alias("of"))
        put(marked(told.where("marked").drop("marked"), spared, 2, bits).where("marked").join(ids, same(ids), "left_semi"), "shared-bits")


COLUMNS = {
    "file": pa.string(), "start": pa.int64(), "record_type": pa.string(), "record_id": pa.string(), "target_uri": pa.string(), "refers_to": pa.string(),
    "payload_digest": pa.string(), "payload_length": pa.int64(), "content_length": pa.int64(), "payload_sha256": pa.string(), "payload": pa.binary(),
}
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _filesystem(path: str):
    """None and a local path, or an Arrow file system and its path."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return None, unquote(parsed.path) if parsed.scheme else path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _listed(path: str) -> list[tuple[str, int]]:
    where, at = _filesystem(path)
    if where is None:
        found = [at] if os.path.isfile(at) else [f"{d}/{n}" for d, _, names in os.walk(at) for n in names]
        sized = [(p, os.path.getsize(p)) for p in found]
    else:
        from pyarrow import fs

        info = where.get_file_info(at)
        infos = [info] if info.is_file else where.get_file_info(fs.FileSelector(at, recursive=True))
        scheme = path.split(at, 1)[0]
        sized = [(scheme + i.path, i.size) for i in infos if i.is_file]
    return sorted((p, n) for p, n in sized if n and os.path.basename(p)[0] not in "._")


def _open(path: str):
    where, at = _filesystem(path)
    raw = open(at, "rb") if where is None else where.open_input_file(at)
    magic = raw.read(2)
    raw.seek(0)
    return gzip.GzipFile(fileobj=raw) if magic == b"\x1f\x8b" else raw


class WarcReader(DataSourceReader):
    """Options: path; payload = none, digest (the default: payload_sha256 is computed, the payload not returned) or full."""

    def __init__(self, options):
        self.path, self.payload, self.tests = options["path"], options.get("payload", "digest"), []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((HEADERS[name], {f.value}))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((HEADERS[name], set(f.value)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((HEADERS[name], None))
            else:
                yield f

    def partitions(self):
        groups, size = [[]], 0
        for path, n in _listed(self.path):
            if groups[-1] and size + n > PARTITION_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [Files(g) for g in groups]

    def wanted(self, head: dict[str, str]) -> bool:
        return all((name in head) if values is None else head.get(name) in values for name, values in self.tests)

    def records(self, path: str) -> Iterator[tuple]:
        with _open(path) as f:
            while True:
                start = f.tell()
                line = f.readline()
                if not line:
                    return
                if line in (b"\r\n", b"\n"):  # what ends the record before
                    continue
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"{path}: no record at {start}")
                head = {}
                while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                    name, _, value = line.decode("utf-8", "replace").partition(":")
                    head[name.strip().lower()] = value.strip()
                length = int(head.get("content-length", 0))
                if not self.wanted(head):
                    f.seek(length, 1)
                    continue
                payload = sha = None
                n = int(head["x-payload-length"]) if "x-payload-length" in head else None
                if self.payload == "none" or head.get("warc-type") == "revisit":
                    f.seek(length, 1)
                else:
                    payload = f.read(length)
                    if "http" in head.get("content-type", ""):
                        payload = payload.partition(b"\r\n\r\n")[2]
                    sha, n = hashlib.sha256(payload).hexdigest(), len(payload)
                yield path, start, head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-refers-to"), head.get("warc-payload-digest"), n, length, sha, payload if self.payload == "full" else None

    def read(self, partition):
        rows, size = [], 0
        for path in partition.paths if partition else ():
            for row in self.records(path):
                rows.append(row)
                size += 500 + (len(row[-1]) if row[-1] else 0)
                if size > 4 << 20:
                    yield self.batch(rows)
                    rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), COLUMNS.values())], names=list(COLUMNS))


class Warc(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return "file string, start long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, content_length long, payload_sha256 string, payload binary"

    def reader(self, schema):
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: str = "digest") -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("payload", payload).load(path)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    got = read_warc(spark, path).where(F.col("record_type").isin("response", "revisit"))

    def number(name):
        return F.regexp_extract(name, r"<urn:page:(-?\d+)>", 1).try_cast("long") if hasattr(F.col(name), "try_cast") else F.expr(f"try_cast(regexp_extract({name}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")

    return got.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.coalesce("payload_sha256", F.substring_index("payload_digest", ":", -1)).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), "target_uri")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, url FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to, url AS target_uri FROM f
"""
