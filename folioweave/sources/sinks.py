"""Results as text: entries separated by pipes, packs as Markdown and JSON; and gold queries read from CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def entry_line(chunk_id: Column, topic: Column, confidence: Column, method: Column, keywords: Column, text: Column) -> Column:
    """``id | topic | 0.00 | method | a,b | text`` on one line; without a topic, ``unclassified``."""
    flat = F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")))
    score = F.format_string("%.2f", F.round(confidence, 2))
    return F.concat_ws(" | ", chunk_id, F.coalesce(topic, F.lit("unclassified")), score, method, F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), ","), flat)


def entries(topics: DataFrame, keywords: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_path, idx, method, first_of_file, line) of chunks (id, file_path, idx, text) with their first topic (id, topic, score, rank) and keywords (id, token, rank).

    A topic named after keywords is a fallback; a line that begins another file is marked, for its heading.
    """
    first = topics.where("rank = 1").select("id", "topic", "score")
    words = keywords.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("words"))
    rows = chunks.select("id", "file_path", "idx", "text").join(first, "id", "left").join(words, "id", "left")
    return lines(rows, F.lag("file_path").over(Window.partitionBy("file_path").orderBy("idx")).isNull())


def lines(rows: DataFrame, first_of_file: Column) -> DataFrame:
    """entries() of chunks that have their first topic, its score and their words with them."""
    method = F.when(F.col("topic").startswith("topic:") | F.col("topic").isNull(), "fallback").otherwise("supervised")
    line = entry_line(F.col("id"), F.col("topic"), F.coalesce("score", F.lit(0.0)), F.col("method"), F.col("words"), F.col("text"))
    return rows.withColumn("method", method).select("file_path", "idx", "method", first_of_file.alias("first_of_file"), line.alias("line"))


def method_counts(rows: DataFrame) -> DataFrame:
    """(method, n, share in percent) of entries."""
    total = rows.agg(F.count("*").alias("all"))
    return rows.groupBy("method").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("method", "n", F.round(100 * F.col("n") / F.col("all"), 1).alias("share"))  # total is one row


def write_entries(rows: DataFrame, folder: str) -> None:
    """Lines as text files by file and place, each file's first below its heading."""
    headed = F.when(F.col("first_of_file"), F.concat(F.lit("\n# === Source: "), "file_path", F.lit(" ===\n"), "line")).otherwise(F.col("line"))
    rows.repartitionByRange("file_path").sortWithinPartitions("file_path", "idx").select(headed.alias("value")).write.mode("overwrite").text(folder)


def pack_markdown(packed: DataFrame, question: str) -> DataFrame:
    """(rank, value): a block of Markdown for each packed node (id, kind, rank, excerpt), the heading before the first; ``pack`` returns a few dozen rows."""
    block = F.concat(F.lit("### "), "kind", F.lit(" — `"), "id", F.lit("`\n"), F.coalesce(F.concat(F.lit("\n```\n"), F.trim("excerpt"), F.lit("\n```\n")), F.lit("")))
    head = F.concat(F.lit("# Pack\n\n**Query:** `"), F.lit(question), F.lit("`\n\n## Nodes\n\n"))
    return packed.select("rank", F.when(F.col("rank") == 1, F.concat(head, block)).otherwise(block).alias("value"))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def gold_queries(spark: SparkSession, path: str) -> DataFrame:
    """(book, qid, query, expected) of a CSV with query_id, query_text, expected_node_ids and book_relpath; ids are split at commas, semicolons, pipes and line ends, and incomplete rows go."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    ids = F.filter(F.transform(F.split(clean("expected_node_ids"), "[,;|\\n]"), lambda x: F.trim(x)), lambda x: x != "")
    rows = raw.select(clean("book_relpath").alias("book"), clean("query_id").alias("qid"), clean("query_text").alias("query"), ids.alias("expected"))
    return rows.where((F.col("book") != "") & (F.col("query") != "") & (F.size("expected") > 0))
