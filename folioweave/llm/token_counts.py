"""Operator 4, token counts: a broadcast table of frequent pre-token lengths, worker caches for the rest.

No pre-token is shuffled.  The first tier is filled from a bounded sample of rows; it only
saves work, and every count is exact whatever it holds.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PieceCounter
from .common import kept, released, table, worker_path

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Rows of the sample that fills the first tier, bytes of each that are looked at there, and entries broadcast at most.
TIER_ROWS, TIER_CHARS, TIER_ENTRIES = 512, 20_000, 32_768


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def frequent_lengths(docs: DataFrame, path: str) -> dict[str, int]:
    """The most frequent pre-tokens of a few rows with their token counts: at most TIER_ENTRIES short strings."""
    counter = PieceCounter(path, {})
    seen: Counter[str] = Counter()
    for row in docs.select(F.substring("text", 1, TIER_CHARS).alias("text")).limit(TIER_ROWS).collect():
        if row.text and counter.plain(row.text):
            seen.update(p for p in counter.find(row.text) if len(p) < 64)
    return {p: len(counter.merged(p)) for p, _ in seen.most_common(TIER_ENTRIES)}


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """One row per input row: doc_id, UTF-8 bytes, tokens, and whether tokens exceed ``limit``.

    A null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows are
    counted each; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    worker_path(spark)
    path = path or tokenizer_path("byte_bpe_50k.json")
    sent, mark = spark.sparkContext.broadcast(frequent_lengths(docs, path)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(f"pieces {path} {mark}", lambda: PieceCounter(path, sent.value))
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = [counter.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
