"""Segmentation: sentences, sentence groups, headings and verses."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SENTENCE_END = "(?<=[.!?])\\s+(?=[A-Z\"'(\\[])"
VERSE = "^(\\d+):(\\d+)\\s"


#: What is taken off the ends of sentences.
BLANKS = " \t\n\r\x0b\x0c"
#: Elements that prefix sums take together.
STRIDE = 256
#: Characters of groups that a worker gathers before it hands them over.
FLUSH = 4 << 20


def sentences(text: Column) -> Column:
    """Cut at white space after . ! or ? and before a capital, quote or bracket; of one sentence, at blank lines; else the whole text."""
    whole = lambda parts: F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(BLANKS))), lambda s: s != "")
    first, blank = whole(F.split(text, SENTENCE_END)), whole(F.split(text, "\\n\\s*\\n"))
    return F.when(F.size(first) > 1, first).otherwise(blank)


def prefix_sums(lengths: Column) -> Column:
    """Sums of what stands before each element of an array of ints, by way of sums over strides."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    strides = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.size(lengths)) - 1, F.lit(STRIDE)), lambda k: add(F.slice(lengths, k + 1, STRIDE)))
    before = F.aggregate(strides, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    return F.transform(lengths, lambda _, i: F.get(before, F.floor(i / STRIDE).cast("int")) + add(F.slice(lengths, F.floor(i / STRIDE).cast("int") * STRIDE + 1, i % STRIDE)))


def sentence_groups(corpus: DataFrame, size: int = 4, least: int = 50) -> DataFrame:
    """(file_path, idx, text, char_start, char_end): groups of ``size`` sentences, numbered from 0 in each file.

    A group's text is the part of the source that it spans; dropped are those that are shorter than ``least``
    with single spaces between their sentences.  Each text is gone through once in Arrow batches, so the time goes with
    its length; what is gathered leaves the worker from FLUSH characters on.
    """
    blanks, flush = BLANKS, FLUSH
    columns = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # white space as in Java, which is what BLANKS has; the next sentence begins at the end of a match
        end, gap, word = (re.compile(x, re.ASCII) for x in ("[.!?]\\s+(?=[A-Z\"'(\\[])", "\\n\\s*\\n", "\\S"))
        out, held = [[] for _ in columns], 0

        def batch() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, columns, strict=True)], ["file_path", "idx", "text", "char_start", "char_end"])
            for c in out:
                c.clear()
            return found

        for rows in batches:
            for path, text in zip(rows.column("file_path"), rows.column("text"), strict=True):
                path, text = path.as_py(), text.as_py() or ""
                last = len(text.rstrip(blanks))
                if not last:
                    continue
                first = len(text) - len(text.lstrip(blanks))
                starts, ends = [first], []
                for m in end.finditer(text):
                    ends.append(m.start() + 1)
                    starts.append(m.end())
                if not ends:
                    for m in gap.finditer(text, first, last):
                        ends.append(starts[-1] + len(text[starts[-1] : m.start()].rstrip(blanks)))
                        starts.append(word.search(text, m.end()).start())
                ends.append(last)
                idx = 0
                for k in range(0, len(starts), size):
                    s, e = starts[k : k + size], ends[k : k + size]
                    if sum(e) - sum(s) + len(s) - 1 >= least:
                        for c, x in zip(out, (path, idx, text[s[0] : e[-1]], s[0], e[-1]), strict=True):
                            c.append(x)
                        idx += 1
                        held += e[-1] - s[0]
                if held >= flush:
                    yield batch()
                    held = 0
        if out[0]:
            yield batch()

    texts = corpus.select("file_path", F.make_valid_utf8("text").alias("text"))
    return texts.mapInArrow(cut, "file_path string, idx int, text string, char_start int, char_end int")


def fixed_size_groups(corpus: DataFrame, size: int = 512, overlap: int = 64, least: int = 50) -> DataFrame:
    """(file_path, idx, text): sentences gathered up to ``size`` characters; the last ones, up to ``overlap``, begin the next group.

    A sentence longer than ``size`` is a group of its own.  The fold runs within a row, so no row moves.
    """
    cut = corpus.select("file_path", sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    strings = "array<string>"
    none = F.array().cast(strings)
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), none.alias("open"), F.lit(0).alias("n"))

    def tail(group: Column) -> Column:
        """The longest run of last sentences whose lengths sum to ``overlap`` at most."""
        kept = F.aggregate(
            F.reverse(group), F.struct(none.alias("t"), F.lit(0).alias("n"), F.lit(True).alias("more")),
            lambda a, x: F.when(a["more"] & (a["n"] + F.length(x) <= overlap), F.struct(F.concat(F.array(x), a["t"]).alias("t"), (a["n"] + F.length(x)).alias("n"), F.lit(True).alias("more"))).otherwise(
                F.struct(a["t"].alias("t"), a["n"].alias("n"), F.lit(False).alias("more"))
            ),
        )
        return F.struct(kept["t"].alias("t"), kept["n"].alias("n"))

    def step(a: Column, x: Column) -> Column:
        # the open group counts as it stands joined, spaces included
        full = (F.size(a["open"]) > 0) & (a["n"] + F.size(a["open"]) - 1 + F.length(x) > size)
        carried = tail(a["open"])
        return F.when(full, F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), F.concat(carried["t"], F.array(x)).alias("open"), (carried["n"] + F.length(x)).alias("n"))).otherwise(
            F.struct(a["done"].alias("done"), F.concat(a["open"], F.array(x)).alias("open"), (a["n"] + F.length(x)).alias("n"))
        )

    groups = F.aggregate("s", start, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    texts = F.filter(F.transform(groups, lambda g: F.array_join(g, " ")), lambda t: F.length(t) >= least)
    return cut.select("file_path", F.posexplode(texts).alias("idx", "text"))


def neighbour_similarity(vectors: Column) -> Column:
    """Dot products of each vector with the one after it; of unit vectors, their cosines."""
    n = F.greatest(F.lit(0), F.size(vectors) - 1)
    return F.zip_with(F.slice(vectors, F.lit(1), n), F.slice(vectors, F.lit(2), n), lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def semantic_groups(corpus: DataFrame, embed: Callable[[Column], Column], threshold: float = 0.75, size: int = 512, least: int = 50) -> DataFrame:
    """(file_path, idx, text): sentences together until the next one's vector is less alike than ``threshold``, or ``size`` characters would be passed.

    ``embed`` gives a vector of length 1 for a column of text.
    """
    cut = corpus.select("file_path", sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    cut = cut.select("file_path", "s", F.transform("s", embed).alias("v")).select("file_path", "s", neighbour_similarity(F.col("v")).alias("near"))
    strings = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), strings.alias("open"), F.lit(0).alias("n"))
    pairs = F.transform("s", lambda x, i: F.struct(x.alias("x"), F.coalesce(F.get("near", i - 1), F.lit(1.0)).alias("near")))

    def step(a: Column, p: Column) -> Column:
        x = p["x"]
        apart = (F.size(a["open"]) > 0) & ((p["near"] < threshold) | (a["n"] + F.size(a["open"]) - 1 + F.length(x) > size))
        return F.when(apart, F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), F.array(x).alias("open"), F.length(x).alias("n"))).otherwise(
            F.struct(a["done"].alias("done"), F.concat(a["open"], F.array(x)).alias("open"), (a["n"] + F.length(x)).alias("n"))
        )

    groups = F.aggregate(pairs, start, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    texts = F.filter(F.transform(groups, lambda g: F.array_join(g, " ")), lambda t: F.length(t) >= least)
    return cut.select("file_path", F.posexplode(texts).alias("idx", "text"))


def heading_sections(corpus: DataFrame) -> DataFrame:
    """(file_path, part, level, title, body, start): text before the first heading has no title; blank untitled parts are dropped; ``start`` is the body's place in the file."""
    lines = corpus.select("file_path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    head = F.regexp_extract("line", "^(#{1,6})\\s+(.+)$", 1)
    w = Window.partitionBy("file_path").orderBy("at")
    lines = lines.withColumn("level", F.length(head)).withColumn("part", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(w))
    lines = lines.withColumn("before", (F.sum(F.length("line") + 1).over(w) - F.length("line") - 1).cast("int"))
    title = F.max(F.when(F.col("level") > 0, F.trim(F.regexp_extract("line", "^(#{1,6})\\s+(.+)$", 2))))
    rows = F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("at", "line"))))
    parts = lines.groupBy("file_path", "part").agg(F.max("level").alias("level"), title.alias("title"), rows.alias("rows"), F.min(F.when(F.col("level") == 0, F.col("before"))).alias("before"))
    whole = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    blanks = F.lit(" \n\t\r")
    start = F.coalesce("before", F.lit(0)) + F.length(whole) - F.length(F.ltrim(whole, blanks))
    parts = parts.select("file_path", "part", F.when(F.col("level") > 0, F.col("level")).alias("level"), "title", F.btrim(whole, blanks).alias("body"), start.alias("start"))
    return parts.where("title IS NOT NULL OR body <> ''")


def sections(corpus: DataFrame) -> DataFrame:
    """heading_sections with the section id: repeated headings of a file get ~2, ~3 and so on; neighbours of one slug are one section."""
    parts = heading_sections(corpus).where("title IS NOT NULL").withColumn("slug", T.heading_slug(F.col("title")))
    w = Window.partitionBy("file_path").orderBy("part")
    parts = parts.withColumn("new", F.when(F.lag("slug").over(w).eqNullSafe(F.col("slug")), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    occurrence = F.dense_rank().over(Window.partitionBy("file_path", "slug").orderBy("island"))
    parts = parts.withColumn("occurrence", occurrence)
    name = F.concat(F.lit("sec:"), "file_path", F.lit(":"), "slug", F.when(F.col("occurrence") > 1, F.concat(F.lit("~"), F.col("occurrence").cast("string"))).otherwise(""))
    return parts.select("file_path", "part", "level", "title", "body", "island", "occurrence", name.alias("section_id"))


def is_verse_document(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.size(F.filter(lines, lambda x: x.rlike(VERSE))) > 0.10 * F.size(lines)


def verse_groups(corpus: DataFrame, size: int = 5, least: int = 30) -> DataFrame:
    """(file_path, book, chapter, verse_start, verse_end, text): ``size`` verses of one chapter of a book together; a book is what stands below a heading of the second level."""
    lines = corpus.select("file_path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    anchor = F.col("line").rlike(VERSE)
    w = Window.partitionBy("file_path").orderBy("at")
    lines = lines.withColumn("book", F.last(F.when(F.col("line").rlike("^##\\s"), F.trim(F.regexp_replace("line", "^##\\s+", ""))), True).over(w))
    lines = lines.withColumn("verse_no", F.sum(F.when(anchor, 1).otherwise(0)).over(w)).where((F.col("verse_no") > 0) & ~F.col("line").rlike("^#{1,6}\\s"))
    verse = lines.groupBy("file_path", "verse_no").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("rows"), F.min_by("book", "at").alias("book"))
    flat = F.trim(F.regexp_replace(F.array_join(F.transform("rows", lambda r: r["line"]), " "), "\\s+", " "))
    verse = verse.select("file_path", "verse_no", "book", flat.alias("line"))
    verse = verse.select(
        "file_path", "verse_no", "book", F.regexp_extract("line", VERSE, 1).cast("int").alias("chapter"), F.regexp_extract("line", VERSE, 2).cast("int").alias("verse"), F.trim(F.regexp_replace("line", VERSE, "")).alias("text")
    ).where("text <> ''")
    k = F.floor((F.row_number().over(Window.partitionBy("file_path", "book", "chapter").orderBy("verse_no")) - 1) / size)
    groups = verse.withColumn("k", k).groupBy("file_path", "book", "chapter", "k").agg(F.min("verse").alias("verse_start"), F.max("verse").alias("verse_end"), F.array_sort(F.collect_list(F.struct("verse_no", "text"))).alias("rows"))
    return groups.select("file_path", "book", "chapter", "verse_start", "verse_end", F.array_join(F.transform("rows", lambda r: r["text"]), " ").alias("text")).where(F.length("text") >= least)


def section_groups(corpus: DataFrame, size: int = 4, least: int = 50) -> DataFrame:
    """sentence_groups() within the sections of Markdown files: (file_path, idx, text, char_start, char_end, title, level, slug, island).

    Groups never cross a heading; indices run through a file.  An island is a run of groups below one heading, or
    of neighbours with the same; ``slug`` is null where there is no heading.
    """
    parts = heading_sections(corpus).where("body <> ''")
    key = F.concat("file_path", F.lit("\u0001"), F.lpad(F.col("part").cast("string"), 9, "0"))
    groups = sentence_groups(parts.select(key.alias("file_path"), F.col("body").alias("text")), size, least).withColumnRenamed("file_path", "key").withColumnRenamed("idx", "g")
    rows = groups.join(parts.select(key.alias("key"), "file_path", "part", "title", "level", "start"), "key")
    w = Window.partitionBy("file_path").orderBy("part", "g")
    rows = rows.withColumn("idx", F.row_number().over(w) - 1).withColumn("slug", T.heading_slug(F.col("title")))
    new = F.when((F.col("idx") > 0) & F.lag("slug").over(w).eqNullSafe(F.col("slug")), 0).otherwise(1)
    rows = rows.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return rows.select("file_path", "idx", "text", (F.col("start") + F.col("char_start")).alias("char_start"), (F.col("start") + F.col("char_end")).alias("char_end"), "title", "level", "slug", "island")


#: How files are cut by default: by the ends of their names, first match; then everything as plain text.
ROUTES = (((".md", ".markdown", ".mdx"), "sections"), ((".txt", ".rst", ""), "plain"))


def chunks(corpus: DataFrame, strategy: str | None = None, size: int = 4, least: int = 50, most: int = 0) -> DataFrame:
    """(file_path, idx, text, strategy) of every file by ``strategy`` (sections, plain, fixed or verse), or by what its name and text call for.

    Markdown goes by sections, verse documents by verses, all else as plain text; a verse document without verse
    groups falls back to sections.  ``most`` keeps that many chunks of a file at most.
    """
    if strategy not in (None, "sections", "plain", "fixed", "verse"):
        raise ValueError(f"no such strategy: {strategy}")
    route = F.lit("plain")
    for ends, name in reversed(ROUTES):
        route = F.when(F.exists(F.array(*map(F.lit, ends)), lambda e: F.lower("file_path").endswith(e)), name).otherwise(route)
    route = F.when(is_verse_document(F.col("text")), "verse").otherwise(route) if strategy is None else F.lit(strategy)
    files = corpus.select("file_path", "text", route.alias("strategy"))
    part = lambda name: files.where(F.col("strategy") == name).select("file_path", "text")
    w = Window.partitionBy("file_path").orderBy("book", "chapter", "verse_start")
    verse = verse_groups(part("verse"), least=min(30, least)).select("file_path", (F.row_number().over(w) - 1).alias("idx"), "text")
    unversed = part("verse").join(verse.select("file_path").distinct(), "file_path", "left_anti")
    found = None
    for name, rows in (
        ("sections", section_groups(part("sections").unionByName(unversed), size, least)), ("plain", sentence_groups(part("plain"), size, least)), ("fixed", fixed_size_groups(part("fixed"), least=least)), ("verse", verse),
    ):
        rows = rows.select("file_path", "idx", "text", F.lit(name).alias("strategy"))
        found = rows if found is None else found.unionByName(rows)
    return found.where(F.col("idx") < most) if most else found
