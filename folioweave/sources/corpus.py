"""Corpora as DataFrames of (file_path, text): the driver's tables, Markdown renderings, and folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED_FOLDERS = (".git", ".venv", "venv", "node_modules", "__pycache__", "build", "dist", ".tox", ".mypy_cache")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path is source/id.txt with the id in six digits."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".txt"))
    return docs.select(path.alias("file_path"), F.coalesce("text", F.lit("")).alias("text"), "doc_id", "lang")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown file per conversation, with a heading per turn; empty turns are left out."""
    turns = table(spark, sf_dir, "conversations").where("trim(coalesce(text, '')) <> ''")
    turn = F.struct("turn", F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), F.col("text")).alias("md"))
    talk = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    body = F.array_join(F.transform("t", lambda t: t["md"]), "\n\n")
    return talk.select(F.concat(F.lit("sessions/"), "conv_id", F.lit(".md")).alias("file_path"), F.concat(F.lit("# Session "), "conv_id", F.lit("\n\n"), body).alias("text"), "conv_id")


def folder(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("md", "txt", "rst"), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Text files below a folder; skipped are hidden files and folders, build folders and ``exclude``, at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.substring_index(F.col("path"), root.removeprefix("file://").rstrip("/") + "/", -1)
    parts = F.split(rel, "/")
    hidden = F.exists(parts, lambda p: p.startswith(".")) | F.arrays_overlap(parts, F.array(*map(F.lit, (*SKIPPED_FOLDERS, *(x.rstrip("/") for x in exclude)))))
    wanted = F.lower(F.substring_index(rel, ".", -1)).isin([x.lower() for x in extensions])
    text = F.replace(F.expr("make_valid_utf8(cast(content as string))"), F.lit("�"), F.lit(""))
    return files.where(wanted & ~hidden).select(rel.alias("file_path"), text.alias("text"))


def topic_catalog(path: str) -> dict[str, list[str]]:
    """A topic catalog from JSON: topics to keyword lists, or to {keywords: [...]}, perhaps under ``topics``."""
    import json
    import os

    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if not path.lower().endswith(".json"):
        raise ValueError(f"catalogs are JSON files, not {path}")
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    raw = raw.get("topics", raw)
    found = {str(k): [str(w).lower() for w in (v.get("keywords", []) if isinstance(v, dict) else v)] for k, v in raw.items()}
    if not any(found.values()):
        raise ValueError("the catalog has no keywords")
    return found
