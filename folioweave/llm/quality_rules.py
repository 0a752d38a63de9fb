"""Operator 2, quality rules: cross-document line frequency, in DataFrame functions alone.

Normalised lines are hashed and counted over the distinct documents of each host (the
``source`` column); exact copies of a text are one document there.  Lines above the host's
limit are removed, and documents that lose nearly everything are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPLIT, cut, held, table

#: A line is boilerplate in a host where it stands in more distinct documents than LINE_DOCS, or in more than FEW_DOCS that are more than LINE_SHARE of the host's.
LINE_DOCS, FEW_DOCS, LINE_SHARE = 100, 5, 0.01
#: A document that loses lines is depleted if fewer words than this, or a smaller share of its words, are left.
LEFT_WORDS, LEFT_SHARE = 20, 0.2
#: Frequent lines travel with the host's name while there are at most so many, and so many for any one host.
SENT_LINES, SENT_HOST_LINES = 100_000, 2_000

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def sorted_pairs(windows: Column) -> Column:
    """(hash, position) of all windows by hash; nothing where no hash stands twice."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(windows) != F.size(F.array_distinct(windows)), pairs)


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_SPLIT))


def repeat_words(windows: Column, pairs: Column) -> Column:
    """Words covered by windows whose hash stands twice or more; ``pairs`` is the column of sorted_pairs(windows)."""
    same = lambda e, other: F.coalesce(e["h"] == other["h"], F.lit(False))
    # k counts from 0 and element_at from 1, so element k is the one before and k + 2 the one after
    twins = F.transform(
        pairs,
        lambda e, k: F.when(((k > 0) & same(e, F.try_element_at(pairs, F.greatest(k, F.lit(1))))) | same(e, F.try_element_at(pairs, k + 2)), e["i"]),
    )
    at = F.array_sort(F.filter(twins, lambda i: i.isNotNull()))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"))
    covered = F.aggregate(at, start, step, lambda a: a["n"])
    return F.coalesce(covered, F.lit(0).cast("long"))


def _zip_hash(a: Column, shift: int) -> Column:
    """Hashes of each element with the one ``shift`` places on."""
    return F.zip_with(F.slice(a, F.lit(1), F.size(a) - shift), F.slice(a, F.lit(1 + shift), F.size(a) - shift), lambda x, y: F.xxhash64(x, y))


def base_rules(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, host, text and the base measures of every row; with ``carry`` also the row itself, without its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = [F.struct(*[F.col(c) for c in docs.columns if c != "text"], F.col("text").isNull().alias("no_text")).alias("row")] if carry else []
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), text.alias("text"), *row)
    keep = ["row"] if carry else []
    df = df.withColumn("w", _words(F.col("text")))
    df = df.withColumn("h", F.when(F.size("w") >= WINDOW, F.transform("w", lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>")))
    for shift in (1, 2, 4):
        df = df.withColumn("h", F.when(F.size("h") > shift, _zip_hash(F.col("h"), shift)).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    count = lambda c: c.cast("long")
    df = df.withColumn("pairs", sorted_pairs(F.col("h")))
    df = df.select(
        "doc_id", "host", "text", *keep,
        count(F.size("w")).alias("n_words"),
        count(F.length(F.translate("text", SPACES, ""))).alias("word_chars"),
        count(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        lines.alias("lines"),
        repeat_words(F.col("h"), F.col("pairs")).alias("n_repeat_words"),
    )
    df = df.withColumn("n_dup_lines", count(F.size("lines") - F.size(F.array_distinct("lines")))).drop("lines")
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def normal_lines(text: Column) -> Column:
    """The lines of a text in lower case, with single spaces and none at the ends; blank ones are empty strings."""
    flat = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\x0b\\f\\r]+", " "))
    return F.transform(F.split(flat, "\n"), lambda x: F.btrim(x))


def _line_hashes(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(normal_lines(text), lambda x: x != ""), lambda x: F.xxhash64(x)))


def frequent_lines(docs: DataFrame, line_docs: int = LINE_DOCS, few_docs: int = FEW_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(host, line): hashes of lines in more than ``line_docs`` distinct texts of the host, or in more than ``few_docs`` that are more than ``line_share`` of its texts."""
    host, text = F.col("source").cast("string").alias("host"), F.col("text").cast("string")
    own = docs.where(text.isNotNull()).select(host, F.xxhash64(text).alias("a"), F.xxhash64(F.reverse(text)).alias("b"), _line_hashes(text).alias("lines"))
    texts = own.groupBy("host", "a", "b").agg(F.first("lines").alias("lines"))
    # a null line stands for the text itself, so that one shuffle counts lines and texts
    each = texts.select("host", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), F.col("lines"))).alias("line"))
    counts = cut(each.groupBy("host", "line").count().where((F.col("count") > few_docs) | F.col("line").isNull()), "line-counts")
    hosts = counts.where("line IS NULL").select("host", F.col("count").alias("texts"))
    found = counts.where("line IS NOT NULL").alias("c").join(hosts.alias("t"), F.expr("c.host <=> t.host"))
    return found.where((F.col("c.count") > line_docs) | (F.col("c.count") > line_share * F.col("t.texts"))).select("c.host", "c.line")


def with_removed(df: DataFrame, frequent: DataFrame) -> DataFrame:
    """``df`` (doc_id, host, text, ...) with the array ``removed`` of the hashes of its boilerplate lines."""
    by_host = frequent.groupBy("host").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("line")).alias("boiler"))
    sizes = frequent.groupBy("host").count().agg(F.sum("count").alias("all"), F.max("count").alias("most")).first()
    none = F.array().cast("array<bigint>")
    if (sizes["all"] or 0) <= SENT_LINES and (sizes["most"] or 0) <= SENT_HOST_LINES:
        sent = F.broadcast(by_host.select(F.col("host").alias("boiler_host"), "boiler"))
        df = df.join(sent, F.col("host").eqNullSafe(F.col("boiler_host")), "left")
        hit = F.when(F.col("boiler").isNull(), none).otherwise(F.array_intersect(_line_hashes(F.col("text")), F.col("boiler")))
        return df.withColumn("removed", hit).drop("boiler", "boiler_host")
    key = [F.col("doc_id"), F.col("host"), F.xxhash64("text").alias("key")]
    each = df.select(*key, F.explode(_line_hashes(F.col("text"))).alias("line")).alias("e")
    hits = each.join(frequent.alias("f"), F.expr("e.host <=> f.host AND e.line = f.line")).groupBy("e.doc_id", "e.host", "e.key").agg(F.collect_set("e.line").alias("removed")).alias("r")
    joined = df.alias("d").join(hits, F.expr("d.doc_id <=> r.doc_id AND d.host <=> r.host AND xxhash64(d.text) = r.key"), "left")
    return joined.select("d.*", F.coalesce("r.removed", none).alias("removed"))


def _left_text(text: Column, removed: Column) -> Column:
    """The text without the lines whose normal form is among ``removed``."""
    kept = F.filter(F.arrays_zip(F.split(text, "\n").alias("line"), normal_lines(text).alias("normal")), lambda x: ~F.array_contains(removed, F.xxhash64(x["normal"])))
    return F.when(F.size(removed) == 0, text).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))


def quality_rules(docs: DataFrame, line_docs: int = LINE_DOCS, few_docs: int = FEW_DOCS, line_share: float = LINE_SHARE, carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left_words, left_text, kept.

    A null text has no words and fails the base rules; a null source is a host of its own; repeated
    rows are one document when lines are counted, and a row each in the result; an empty table gives
    an empty result; further columns of the input are not read, but for ``carry``, which keeps the
    row in a struct.
    """
    df = with_removed(base_rules(docs, carry), frequent_lines(docs, line_docs, few_docs, line_share))
    df = df.withColumn("left_text", _left_text(F.col("text"), F.col("removed")))
    df = df.withColumn("n_left_words", F.when(F.size("removed") == 0, F.col("n_words")).otherwise(F.size(_words(F.col("left_text"))).cast("long")))
    depleted = (F.size("removed") > 0) & ((F.col("n_left_words") < LEFT_WORDS) | (F.col("n_left_words") < LEFT_SHARE * F.col("n_words")))
    df = held(df, kept=~F.col("base_failed") & ~depleted)  # a filter on it stays above the measures
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left_words", "left_text", "kept", *(["row"] if carry else [])
    )


def clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with boilerplate lines taken out of ``text`` and ``n_chars``, if there, set anew."""
    kept = quality_rules(docs, carry=True).where("kept")
    own = {"text": F.col("left_text"), "n_chars": F.length("left_text").cast("long")}
    return kept.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("left_text")


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, text, source FROM d
), pos AS (
  SELECT r, i, array_to_string(w[i:i+7], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM pos) WHERE n > 1
), gaps AS (
  SELECT r, least(8, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -8)) AS g FROM twice
), rep AS (
  SELECT r, sum(g)::BIGINT AS n_repeat_words FROM gaps GROUP BY r
), ln AS (
  SELECT r, source, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d
), norm AS (
  SELECT r, source, text, pos, raw, trim(lower(regexp_replace(raw, '[ \t\x0b\f\r]+', ' ', 'g'))) AS line FROM ln
), dup AS (
  SELECT r, count(*) - count(DISTINCT raw) AS n_dup_lines FROM norm WHERE line <> '' GROUP BY r
), freq AS (
  SELECT n.source, n.line FROM norm n JOIN (SELECT source, count(DISTINCT text) AS texts FROM d GROUP BY source) t ON n.source IS NOT DISTINCT FROM t.source
  WHERE n.line <> '' GROUP BY n.source, n.line, t.texts HAVING count(DISTINCT n.text) > 100 OR (count(DISTINCT n.text) > 5 AND count(DISTINCT n.text) > 0.01 * t.texts)
), lw AS (
  SELECT n.r, bool_or(f.line IS NOT NULL) AS hit,
    sum(CASE WHEN f.line IS NULL THEN len(list_filter(string_split_regex(n.raw, '[\x20\x09-\x0D]+'), lambda x: x <> '')) ELSE 0 END)::BIGINT AS n_left_words
  FROM norm n LEFT JOIN freq f ON n.source IS NOT DISTINCT FROM f.source AND n.line = f.line GROUP BY n.r
), m AS (
  SELECT w.r, w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rep.n_repeat_words, 0)::BIGINT AS n_repeat_words, lw.n_left_words, lw.hit
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) JOIN lw USING (r)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left_words,
  NOT base_failed AND NOT (hit AND (n_left_words < 20 OR n_left_words < 0.2 * n_words)) AS kept
FROM b
"""
