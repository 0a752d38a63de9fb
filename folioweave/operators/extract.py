"""Extraction: keywords, topics, entities, and the edges that they make."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T


#: Keywords of a chunk that listed() keeps.
LISTED = 4


def listed(chunks: DataFrame, most: int = LISTED) -> DataFrame:
    """``chunks`` (id, text, ...) with ``kw``, array<struct<token, n>>: the ``most`` frequent words of each but stop words; ties by the word.

    A chunk's words are counted where it is, in Arrow batches, so no row moves; what has such a column keeps it.
    """
    if "kw" in chunks.columns and most <= LISTED:
        return chunks
    token, stop = T.TOKEN.replace("A-Z", "").encode(), frozenset(w.encode() for w in T.STOP_WORDS)
    each = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile(token)
        for batch in batches:
            ends, tokens, ns = [0], [], []
            for text in batch.column("text"):
                # tokens are ASCII: of bytes, lower() takes no other letters, and no other letter has bytes in common with them
                n = Counter(words.findall((text.as_py() or "").encode().lower()))
                for w in stop & n.keys():
                    del n[w]
                for w, k in heapq.nsmallest(most, n.items(), key=lambda x: (-x[1], x[0])):
                    tokens.append(w.decode())
                    ns.append(k)
                ends.append(len(tokens))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(ns, pa.int64())], ["token", "n"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists.cast(each)], [*batch.schema.names, "kw"])

    rows = chunks.drop("kw").withColumn("text", F.make_valid_utf8("text"))
    return rows.mapInArrow(count, StructType([*rows.schema.fields, *StructType.fromDDL("kw array<struct<token string, n bigint>>").fields]))


def keywords(chunks: DataFrame, most: int = 4) -> DataFrame:
    """(id, token, n, rank): the most frequent words of each chunk but stop words; ties by the word."""
    each = listed(chunks if "kw" in chunks.columns else chunks.select("id", "text"), most)
    each = each.select("id", F.posexplode(F.slice("kw", 1, most)).alias("at", "k"))
    return each.select("id", "k.token", "k.n", (F.col("at") + 1).alias("rank"))


def topic_lists(chunks: DataFrame, catalog: dict[str, list[str]], threshold: float = 0.2, most: int = 3) -> DataFrame:
    """``chunks`` with ``kw`` and ``topics``, array<struct<topic, score>>, as topics() has them."""
    rows = listed(chunks)
    once = lambda rows, **cols: rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))  # noqa: E731  # a generator of one row, before which all is worked out once
    rows = once(rows, _low=F.lower("text"), _own=F.array_distinct(T.tokens(F.col("text"))))
    each = []
    for words in catalog.values():
        single, several = [w for w in set(words) if " " not in w], [w for w in set(words) if " " in w]
        hits = F.size(F.array_intersect("_own", F.array(*map(F.lit, sorted(single))))) if single else F.lit(0)
        for w in sorted(several):
            hits = hits + F.when(F.contains("_low", F.lit(w)), 1).otherwise(0)
        each.append(hits)
    rows = once(rows, _n=F.size("_own"), **{f"_{k}": x for k, x in enumerate(each)})
    scored = []
    for place, (name, words) in enumerate(catalog.items()):
        part = 0.75 * F.col(f"_{place}") / len(set(words)) + 0.25 * F.col(f"_{place}") / F.greatest(F.lit(1), F.least(F.lit(12), F.col("_n")))
        scored.append(F.struct(F.least(F.lit(1.0), part).alias("score"), F.lit(place).alias("place"), F.lit(name).alias("topic")))
    found = F.transform(F.filter(F.array(*scored), lambda t: t["score"] >= threshold), lambda t: F.struct((-F.round(t["score"], 4)).alias("less"), t["place"].alias("place"), t["topic"].alias("topic")))
    rows = once(rows, _found=F.array_sort(found)).select(*chunks.columns, *[c for c in ("kw",) if c not in chunks.columns], "_found")
    matched = F.transform(F.slice("_found", 1, most), lambda t: F.struct(t["topic"].alias("topic"), (-t["less"]).alias("score")))
    pair = F.concat(F.lit("topic:"), F.array_join(F.transform(F.slice("kw", 1, 2), lambda k: k["token"]), "_"))
    fallback = F.when(F.size("kw") > 0, F.array(F.struct(pair.alias("topic"), F.lit(0.2).alias("score")))).otherwise(F.array().cast("array<struct<topic:string,score:double>>"))
    return rows.withColumn("topics", F.when(F.size("_found") > 0, matched).otherwise(fallback)).drop("_found")


def topics(chunks: DataFrame, catalog: dict[str, list[str]], threshold: float = 0.2, most: int = 3) -> DataFrame:
    """(id, topic, score, rank) by catalog matching; a chunk that matches none gets a topic of its two top keywords, at 0.2.

    A one-word keyword matches a token, a longer one a part of the text.  The catalog is a constant of the
    plan: it is a few hundred words.
    """
    own = chunks.select("id", "text", *[c for c in ("kw",) if c in chunks.columns])
    each = topic_lists(own, catalog, threshold, most).select("id", F.posexplode("topics").alias("at", "t"))
    return each.select("id", "t.topic", "t.score", (F.col("at") + 1).alias("rank"))


ENTITY_STOP = "with into from the but for and to or on of it is in if by at as an a".split()
_COLOURS = "khaki tan violet indigo magenta cyan olive maroon navy lavender coral teal silver gold ivory cream beige white black grey gray brown pink purple blue green yellow orange red".split()
_SHADES = "cool warm soft bold vivid shiny glossy matte bright pale deep dark light darker lighter".split()
_FIELDS = "principal associate assistant staff head chief lead junior senior financial project product data software sales marketing".split()
_ROLES = "strategist architect executive advisor scientist officer designer developer coordinator consultant director analyst manager engineer specialist".split()
#: What is found first and in this order: names, acronyms and mixed-case words together, by place; then each of the others.
NAMES = "\\b(?:[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){0,3}|[A-Z]{2,}[A-Z0-9]*|[A-Z][a-z]+[A-Z][A-Za-z0-9]*|[A-Z]{2,}[a-z][A-Za-z0-9]*)\\b"
VALUES = (
    "\\b\\d+(?:\\.\\d+)?\\s*%",
    "[¥€£$]\\d[\\d,]*(?:\\.\\d+)?",
    f"(?i)\\b(?:{'|'.join(_SHADES)})\\s+(?:shade\\s+of\\s+)?(?:{'|'.join(_COLOURS)})\\b",
    f"(?i)\\b(?:{'|'.join(_COLOURS)})\\b",
    f"(?i)\\b(?:{'|'.join(_FIELDS)})\\s+(?:{'|'.join(_ROLES)})\\b",
)


def entities(text: Column, most: int = 8) -> Column:
    """array<string>: capitalised names, acronyms and mixed-case words by their place, then percentages, amounts, colours and roles; the first spelling of each."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (NAMES, *VALUES)])
    named = F.filter(F.transform(found, lambda e: F.trim(e)), lambda e: ~F.lower(e).isin(ENTITY_STOP) & (F.length(e) >= 2))
    pairs = F.transform(named, lambda e: F.struct(F.lower(e).alias("low"), e.alias("e")))
    start = F.struct(F.array().cast("array<string>").alias("lows"), F.array().cast("array<string>").alias("es"))
    step = lambda a, p: F.when(F.array_contains(a["lows"], p["low"]) | (F.size(a["es"]) >= most), a).otherwise(F.struct(F.array_append(a["lows"], p["low"]).alias("lows"), F.array_append(a["es"], p["e"]).alias("es")))
    return F.aggregate(pairs, start, step, lambda a: a["es"])


def cooccurrence(members: DataFrame) -> DataFrame:
    """CO_OCCURS_WITH edges, both ways, between the (id, target) pairs that share an id; a chunk has few targets."""
    return cooccurring(members.groupBy("id").agg(F.collect_set("target").alias("t")).select("t"))


def cooccurring(sets: DataFrame) -> DataFrame:
    """CO_OCCURS_WITH edges, both ways, between the elements of each array ``t``, none of which is in it twice."""
    sets = sets.select(F.inline(F.array(F.struct(F.sort_array("t").alias("t")))))
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.greatest(F.lit(0), F.size("t") - i - 1)), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    # src is below dst here, so that the other way has no edge of these
    one = sets.select(F.explode(pairs).alias("p")).select("p.src", "p.dst").distinct()
    both = one.union(one.select("dst", "src"))
    return both.select("src", F.lit("CO_OCCURS_WITH").alias("rel"), "dst")
