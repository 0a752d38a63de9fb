"""A bounded sample of labelled documents, for the operators that are trained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut


def training_sample(docs: DataFrame, labels: DataFrame, target: str, mod: int, held: int, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents whose id's crc32 modulo ``mod`` isn't ``held``, as a written table.

    The labels taken are those first by a hash of the id, one per id, the greater of several; equal texts
    are taken once, under their least id, with the label that most of them have, and 1 if as many have either.
    Null ids and null labels are not taken.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (crc_mod(F.col("doc_id"), mod) != held))
    chosen = usable.groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` ids: that bounds what is broadcast
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("text").agg(F.min("doc_id").alias("doc_id"), (F.avg("y") >= 0.5).cast("int").alias("y"))
    return cut(one.select("doc_id", "text", "y"), f"labelled-{target}")
