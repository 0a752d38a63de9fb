"""Tables written once and read by many queries, in the shared folder of the session."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


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


_bases: dict[str, SparkSession] = {}


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table read back: lineage ends there.  It goes when the application ends."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/folioweave-tables/{spark.sparkContext.applicationId}"
    path = f"{base}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    if base not in _bases:
        _bases[base] = spark
        atexit.register(_drop, base)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def _drop(base: str) -> None:
    """Remove what was written for this application, if its JVM still answers."""
    spark = _bases.pop(base, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_stored: dict[tuple, dict[str, DataFrame]] = {}


def stored(spark: SparkSession, name: str, source: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables of ``make``, which are written at the first call for this source and application."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _stored:
        _stored[key] = make()
    return _stored[key]
