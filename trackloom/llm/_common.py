"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the cluster names in spark.checkpoint.dir; a temporary folder where none is named and all runs on this machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(spark, "_trackloom_scratch", None)
        if not base:
            base = spark._trackloom_scratch = "file://" + tempfile.mkdtemp(prefix="trackloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and no lost executor can take it away."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._trackloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that no later job reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._trackloom_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_mod(c: Column, m: int) -> Column:
    """crc32 of the value as text, modulo m; null stays null."""
    return F.crc32(c.cast("string").cast("binary")) % m


def texts_of(batch, column: str = "text") -> list[bytes | None]:
    """The column's UTF-8 bytes, without decoding."""
    import pyarrow as pa

    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def chunks(sizes: list[int], most: int):
    """Ranges of consecutive rows whose sizes add up to about most."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def of_kind(kind: str):
    """A test of an array's elements."""
    return lambda x: x["kind"] == kind


_SLOT: tuple = (None, None)
_USED = 0.0
_WATCH = None
#: Seconds after which a worker that does nothing gives its cache back: idle workers stay alive between stages.
IDLE = 10.0


def worker_cache(key, make):
    """A Python worker's cache of words. Workers live on from one operator to the next, so each keeps that of one operator only, and only while it is used."""
    global _SLOT, _USED, _WATCH
    _USED = time.monotonic()
    if _SLOT[0] != key:
        _SLOT = (None, None)
        _SLOT = (key, make())
        if _WATCH is None or not _WATCH.is_alive():
            _WATCH = threading.Thread(target=watch, daemon=True)
            _WATCH.start()
    return _SLOT[1]


def watch() -> None:
    """Empties the cache when nobody has asked for it for a while, and ends."""
    global _SLOT
    while time.monotonic() - _USED < IDLE:
        time.sleep(1)
    _SLOT = (None, None)
    give_back()


#: Bytes that go to a Python worker at once, where the session says nothing. Texts are long, and a worker's memory is mostly that of one batch.
BATCH_BYTES = "4m"


def map_arrow(df: DataFrame, work, schema, cache=None) -> DataFrame:
    """mapInArrow in batches of bounded size, in a worker that keeps no cache but that of this key; without one it gives back what a task has freed."""
    bound_batches(df.sparkSession)

    def run(batches):
        from trackloom.llm import _common

        if _common._SLOT[0] != cache:
            _common._SLOT = (None, None)
            _common.give_back()
        yield from work(batches)
        if cache is None:
            _common.give_back()

    return df.mapInArrow(run, schema)


def bound_batches(spark: SparkSession) -> None:
    """Sets the bytes of a batch where the session sets neither bytes nor rows; its own settings stay."""
    names = [f"spark.sql.execution.arrow.{x}PerBatch" for x in ("maxBytes", "maxRecords")]
    if all(spark.conf.get(n, None) is None for n in names):
        spark.conf.set(names[0], BATCH_BYTES)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
