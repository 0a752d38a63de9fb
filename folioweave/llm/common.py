"""Shared plumbing: reading tables, shared checkpoints, worker import paths."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that setting is unset and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="folioweave-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there, and any executor may be lost after it."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/folioweave/{spark.sparkContext.applicationId}"
    path = f"{base}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if base not in _bases:
        _bases[base] = spark
        atexit.register(_drop, base)
    written = spark.read.schema(df.schema).parquet(path)
    written._cut_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._cut_path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_bases: dict[str, SparkSession] = {}


def _drop(base: str) -> None:
    """Remove what cut() wrote for this application, if its JVM still answers."""
    spark = _bases.pop(base, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    _delete(spark, base)


#: Seconds without a task after which a worker gives up what it keeps between tasks.
IDLE = 3.0
_kept: dict[str, object] = {}
_timer: list[threading.Timer] = []


def kept(name: str, make: Callable[[], object]) -> object:
    """On a worker: what ``make`` gives, made once and kept between tasks that follow each other."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def _begin() -> None:
    while _timer:
        _timer.pop().cancel()


def _empty() -> None:
    _kept.clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such function
        ctypes.CDLL(None).malloc_trim(0)


def _end() -> None:
    """Idle workers stay alive between tasks; after a while they give their memory back to the system."""
    timer = threading.Timer(IDLE, _empty)
    timer.daemon = True
    _timer.append(timer)
    timer.start()


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow whose worker gives its memory back once it is idle."""

    def wrapped(batches: Iterator) -> Iterator:
        _begin()
        try:
            yield from run(batches)
        finally:
            _end()

    return wrapped


def worker_path(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)


def held(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with further columns, each worked out once a row.

    A generator of one row stands between: without it the optimizer may put a column's expression
    into the lambda function that reads it, where it runs anew for every element.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


#: The words of a text: runs without space, tab, LF, VT, FF or CR.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """array<string> of the words of a whole text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")
