"""Shared plumbing: tables, the shared checkpoint folder, and Arrow UDFs over whole texts."""

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

#: What counts as a word wherever a contract speaks of words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A UDF works on slices of a batch of about so many bytes of text, so its arrays stay small whatever the batch holds.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only where none is set, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: later reads neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def slices(arr: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of a string or list array, each of about limit bytes (a single longer value stays whole)."""
    sizes = pc.binary_length(arr) if pa.types.is_string(arr.type) or pa.types.is_binary(arr.type) else pc.multiply(pc.list_value_length(arr), 8)
    ends = np.cumsum(np.asarray(pc.fill_null(sizes, 0), dtype=np.int64))
    at = 0
    while at < len(arr):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield arr.slice(at, to - at)
        at = to


#: What empties the stores that modules keep between tasks of a worker process, and the module whose UDF ran last in this one.
_stores: list[Callable[[], None]] = []
_last = ""


def keeps(clear: Callable[[], None]) -> None:
    """clear is called in a worker process before a UDF of another module runs there: workers are reused, and what one stage keeps is no use to the next."""
    _stores.append(clear)


def _begin(module: str) -> None:
    global _last
    if _last and _last != module:
        for clear in _stores:
            clear()
        gc.unfreeze()
        gc.collect()
    _last = module


def _give_back() -> None:
    """Free memory goes back to the system; an idle worker would hold it beside the one that works next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def struct_udf(make: Callable[[], Callable], fields: list[tuple[str, pa.DataType]], limit: int = SLICE_BYTES):
    """An Arrow UDF from a column to a struct.  make() runs once a task and returns a function from an Arrow array to the struct's columns.

    It is marked as nondeterministic only so that the optimizer never evaluates it twice.
    """
    kind = pa.struct([pa.field(n, t) for n, t in fields])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _begin(make.__module__)
        work = make()
        for arr in batches:
            parts = []
            for piece in slices(arr, limit):
                cols = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, (_, t) in zip(work(piece), fields, strict=True)]
                parts.append(pa.StructArray.from_arrays(cols, fields=list(kind)))
            yield pa.concat_arrays(parts) if parts else pa.array([], type=kind)
        del work
        _give_back()

    return F.arrow_udf(run, returnType=from_arrow_type(kind)).asNondeterministic()


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: what follows neither recomputes it nor inherits its partitioning, so joins can split hot keys."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows up to which a table of sources, languages or the like is sent to all tasks.
SMALL_ROWS = 50_000


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its rows are few when counted; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def stored_stage(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again."""
    return stored(df, "stage-" + "".join(c if c.isalnum() else "-" for c in label))
