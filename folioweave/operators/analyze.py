"""Analyses of a graph: coverage, orphans, busy chunks, language measures, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import written
from .segment import sentences

#: Words that carry no content, by their last letters.
NO_CONTENT = (
    "a had used did could should would and be since three he she the while same some one are here there where were before more these those use have we if of being during using each "
    "which such though although through with both i until all still will them him from an can than been between then when often even in again on do no too so also to into two under her "
    "other another further after never over their or for our your as has was does is his this its us always at that what get might it different got not last most first just must but "
    "about you few new how may by already they only my any many very every "
).split()
NO_ENTITY = ("They", "She", "He", "It", "An", "A", "The", "No", "This")
SEMANTIC = ("HAS_TOPIC", "MENTIONS_ENTITY", "HAS_KEYWORD", "CO_OCCURS_WITH", "SIMILAR_TO")


def document_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, chunks, semantic_links, next_links) of every document."""
    chunks = nodes.where("kind = 'chunk'").select("id", "file_path")
    links = edges.where(F.col("rel").isin(*SEMANTIC, "NEXT")).join(chunks.withColumnRenamed("id", "src"), "src")
    per = links.groupBy("file_path").agg(F.sum(F.when(F.col("rel") == "NEXT", 0).otherwise(1)).alias("s"), F.sum(F.when(F.col("rel") == "NEXT", 1).otherwise(0)).alias("x"))
    n = chunks.groupBy("file_path").agg(F.count("*").alias("chunks"))
    docs = nodes.where("kind = 'document'").select("file_path").join(n, "file_path", "left").join(per, "file_path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return docs.select("file_path", zero("chunks").alias("chunks"), zero("s").alias("semantic_links"), zero("x").alias("next_links"))


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rel, covered, share): chunks' share with an outgoing edge of each semantic relation; 0 for those that don't occur."""
    n = nodes.where("kind = 'chunk'").agg(F.count("*").alias("n"))
    per = edges.where(F.col("rel").isin(*SEMANTIC)).groupBy("rel").agg(F.countDistinct("src").alias("covered"))
    all_ = edges.sparkSession.createDataFrame([(r,) for r in SEMANTIC], "rel string").join(per, "rel", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return all_.join(F.broadcast(n)).select("rel", "covered", F.when(F.col("n") > 0, F.round(F.col("covered") / F.col("n"), 6)).otherwise(0.0).alias("share"))  # n is one row


#: The relation by which each kind of concept is reached.
OWN_RELATION = {"topic": "HAS_TOPIC", "entity": "MENTIONS_ENTITY", "keyword": "HAS_KEYWORD"}


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, n): concept nodes to which no edge of their own relation points."""
    concepts = nodes.where(F.col("kind").isin(*OWN_RELATION)).select("id", "kind", F.try_element_at(F.create_map(*[F.lit(x) for kv in OWN_RELATION.items() for x in kv]), F.col("kind")).alias("rel"))
    return concepts.join(edges.select(F.col("dst").alias("id"), "rel"), ["id", "rel"], "left_anti").groupBy("kind").agg(F.count("*").alias("n"))


def busy_chunks(nodes: DataFrame, edges: DataFrame, most: int = 15) -> DataFrame:
    """(id, refs, semantic, total): chunks with the most outgoing edges."""
    out = edges.join(nodes.where("kind = 'chunk'").select(F.col("id").alias("src")), "src", "left_semi")
    n = lambda test: F.sum(F.when(test, 1).otherwise(0))
    each = out.groupBy(F.col("src").alias("id")).agg(n(F.col("rel") == "REFERENCES").alias("refs"), n(F.col("rel").isin(*SEMANTIC)).alias("semantic"), F.count("*").alias("total"))
    return each.orderBy(F.desc("total"), "id").limit(most)


def _name(dst: str = "dst"):
    return F.regexp_replace(dst, "^[a-z]+:", "")


def keyword_frequency(edges: DataFrame, most: int = 40) -> DataFrame:
    """(dst, n) of keywords of more than one character that are no number and no word of NO_CONTENT."""
    each = edges.where("rel = 'HAS_KEYWORD'").groupBy("dst").agg(F.count("*").alias("n"))
    each = each.where((F.length(_name()) > 1) & ~_name().rlike("^[0-9]+$") & ~F.lower(_name()).isin(NO_CONTENT))
    return each.orderBy(F.desc("n"), "dst").limit(most)


def spread(nodes: DataFrame, edges: DataFrame, rel: str) -> DataFrame:
    """(dst, files, n): in how many files and chunks each concept stands."""
    chunks = nodes.where("kind = 'chunk'").select(F.col("id").alias("src"), "file_path")
    return edges.where(F.col("rel") == rel).join(chunks, "src").groupBy("dst").agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("n"))


WORD = "\\b[a-zA-Z']+\\b"


def language(chunks: DataFrame) -> DataFrame:
    """One row of chunks over 10 characters: words, vocabulary, type-token ratio, mean words of sentences and chunks, lexical density, reading grade; nulls are 0."""
    own = chunks.where(F.length("text") > 10)
    lengths = F.filter(F.transform(F.split("text", "[.!?]+"), lambda x: F.regexp_count(x, F.lit(WORD))), lambda n: n > 0)
    sizes = own.agg(F.count("*").alias("chunks"), F.sum(F.size(lengths)).alias("sentences"), F.sum(F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n)).alias("in_sentences"))
    words = own.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    content = F.when((F.length("w") > 2) & ~F.col("w").isin(NO_CONTENT), 1).otherwise(0)
    total = words.agg(F.sum("n").alias("words"), F.count("*").alias("vocabulary"), F.sum(F.col("n") * T.syllables(F.col("w"))).alias("syllables"), F.sum(F.col("n") * content).alias("content"))
    row = total.join(F.broadcast(sizes))  # one row each
    zero = lambda c: F.coalesce(c, F.lit(0))
    return row.select(
        zero("words").alias("words"), "vocabulary", zero(F.round(F.col("vocabulary") / F.col("words"), 4)).alias("type_token"), zero(F.round(F.col("in_sentences") / F.nullif("sentences", F.lit(0)), 1)).alias("sentence_words"),
        zero(F.round(F.col("words") / F.nullif("chunks", F.lit(0)), 1)).alias("chunk_words"), zero(F.round(F.col("content") / F.col("words"), 4)).alias("density"),
        F.when(F.col("words") > 0, F.round(T.reading_grade(F.col("words"), F.col("sentences"), F.col("syllables")), 1)).otherwise(0.0).alias("grade"),
    )


def content_words(chunks: DataFrame, most: int = 40) -> DataFrame:
    """(word, n): the most frequent words of content of chunks over 10 characters."""
    words = chunks.where(F.length("text") > 10).select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    each = words.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n")).where((F.length("word") > 2) & ~F.col("word").isin(NO_CONTENT))
    return each.orderBy(F.desc("n"), "word").limit(most)


def signatures(nodes: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """(file_path, chunks, words, keywords, entities) of every file with chunks: its most frequent concepts, ties by name; words are spaces and one."""
    chunks = nodes.where("kind = 'chunk' AND file_path IS NOT NULL")
    spaces = F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(""))) + 1
    sizes = chunks.groupBy("file_path").agg(F.count("*").alias("chunks"), F.sum(spaces).alias("words"))
    used = edges.where(F.col("rel").isin("HAS_KEYWORD", "MENTIONS_ENTITY")).join(chunks.select(F.col("id").alias("src"), "file_path"), "src")
    each = used.groupBy("file_path", "rel", _name().alias("name")).agg(F.count("*").alias("n"))
    keyword = (F.col("rel") == "HAS_KEYWORD") & (F.length("name") > 1) & ~F.col("name").rlike("[0-9]") & ~F.lower("name").isin(NO_CONTENT)
    entity = (F.col("rel") == "MENTIONS_ENTITY") & ~F.col("name").isin([x.lower() for x in NO_ENTITY[3:]])
    top = each.where(keyword | entity).withColumn("r", F.row_number().over(Window.partitionBy("file_path", "rel").orderBy(F.desc("n"), "name"))).where(F.col("r") <= most)
    names = lambda rel: F.transform(F.array_sort(F.collect_list(F.when(F.col("rel") == rel, F.struct("r", "name")))), lambda x: x["name"])
    per = top.groupBy("file_path").agg(names("HAS_KEYWORD").alias("keywords"), names("MENTIONS_ENTITY").alias("entities"))
    none = F.array().cast("array<string>")
    return sizes.join(per, "file_path", "left").select("file_path", "chunks", "words", F.coalesce("keywords", none).alias("keywords"), F.coalesce("entities", none).alias("entities"))


def heading_words(titles: DataFrame, most: int = 30) -> DataFrame:
    """(word, n): words over 3 characters of section titles (title) over 3 characters, but NO_CONTENT."""
    bare = F.regexp_replace(F.lower("title"), "(?U)[^\\w\\s]", " ")
    words = titles.where(F.length("title") > 3).select(F.explode(F.split(bare, "\\s+")).alias("word")).where((F.length("word") > 3) & ~F.col("word").isin(NO_CONTENT))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def cohesion(themes: DataFrame, least: int = 3) -> DataFrame:
    """One row, score: the share of themes (dst, files) in ``least`` files or more; of readable names only, 0 without any."""
    named = themes.where(~_name().rlike("^topic[:-]"))
    return named.agg(F.coalesce(F.round(F.sum(F.when(F.col("files") >= least, 1).otherwise(0)) / F.count("*"), 3), F.lit(0.0)).alias("score"))


def snapshot_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: total_nodes, total_edges, meaningful_nodes (all but documents), coverage_score (mean of three coverages), complexity_median (upper median of the semantic links of the ten busiest chunks)."""
    kinds = nodes.agg(F.count("*").alias("total_nodes"), F.greatest(F.lit(0), F.sum(F.when(F.col("kind") == "document", 0).otherwise(1))).alias("meaningful_nodes"))
    rels = edges.agg(F.count("*").alias("total_edges"))
    share = coverage(nodes, edges).where(F.col("rel").isin("HAS_TOPIC", "MENTIONS_ENTITY", "HAS_KEYWORD")).agg(F.round(F.sum("share") / 3, 6).alias("coverage_score"))
    busy = busy_chunks(nodes, edges, 10).agg(F.array_sort(F.collect_list("semantic")).alias("s"))  # ten rows
    median = busy.select(F.coalesce(F.get("s", F.floor(F.size("s") / 2).cast("int")), F.lit(0)).cast("double").alias("complexity_median"))
    # a row each
    return kinds.join(F.broadcast(rels)).join(F.broadcast(share)).join(F.broadcast(median)).select("total_nodes", "total_edges", F.coalesce("meaningful_nodes", F.lit(0)).alias("meaningful_nodes"), "coverage_score", "complexity_median")


def features(corpus: DataFrame) -> DataFrame:
    """(file_path, file_hash, n_tokens, n_sentences, n_unique, text_length) of every file."""
    t = T.tokens(F.col("text"))
    return corpus.select(
        "file_path", F.left(F.sha2("text", 256), F.lit(16)).alias("file_hash"), F.size(t).alias("n_tokens"), F.greatest(F.lit(1), F.size(sentences(F.col("text")))).alias("n_sentences"),
        F.size(F.array_distinct(t)).alias("n_unique"), F.length("text").alias("text_length"),
    )


def evenly_spaced(corpus: DataFrame, most: int) -> DataFrame:
    """``most`` files, first and last among them, evenly spaced by path; all if there are no more.

    Places are counted in two steps, so that no task numbers all rows: by range, then within it.  The ranges are
    a written table, which both steps read.
    """
    ranged = corpus.select("file_path").repartitionByRange("file_path").sortWithinPartitions("file_path").withColumn("part", F.spark_partition_id())
    ordered = written(ranged, "ordered")
    sizes = ordered.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("file_path"))
    rows = ordered.withColumn("place", place).join(F.broadcast(sizes.select("part", "before")), "part").select("file_path", (F.col("before") + F.col("place") - 1).alias("place"))  # a row per partition
    n = ordered.count()
    if n <= most:
        return rows.select("file_path", "place")
    wanted = sorted({round(k * (n - 1) / (most - 1)) for k in range(most)}) if most > 1 else [0]
    return rows.where(F.col("place").isin(wanted))


def cluster_terms(assigned: DataFrame, most: int = 5) -> DataFrame:
    """(cluster, term, score) of chunks (id, cluster, text): share in the cluster and lift over the corpus."""
    words = assigned.select("cluster", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z']{2,30}"), F.lit(0))).alias("term")).where(~F.col("term").isin(T.STOP_WORDS))
    each = words.groupBy("cluster", "term").agg(F.count("*").alias("n"))
    in_cluster = each.groupBy("cluster").agg(F.sum("n").alias("cn"))
    overall = each.groupBy("term").agg(F.sum("n").alias("tn"))
    total = each.agg(F.sum("n").alias("all"))
    rows = each.join(in_cluster, "cluster").join(overall, "term").join(F.broadcast(total)).where("n >= 2")  # total is one row
    within = F.col("n") / F.col("cn")
    lift = within / (F.col("tn") / F.col("all"))
    rows = rows.withColumn("score", F.round(0.7 * within + 0.3 * F.least(lift / 10, F.lit(1.0)), 6))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), F.desc("term")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("cluster", "term", "score", "rank")
