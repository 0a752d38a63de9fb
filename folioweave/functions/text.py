"""Scalar text functions as Spark columns: identifiers, tokens, quotes, scores and classifiers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z][A-Za-z0-9_\\-]{1,30}"
#: Words that are no keywords, longest first.
STOP_WORDS = sorted("with will were from that was the has its and are for as be by he in is it of on or to an at a".split(), key=lambda w: (-len(w), w))
HOP_LABELS = {"SIMILAR_TO": "similar to", "REFERENCES": "links to", "CO_OCCURS_WITH": "co-occurs with", "MENTIONS_ENTITY": "mentions", "HAS_KEYWORD": "keyword", "HAS_TOPIC": "on topic", "NEXT": "then", "CONTAINS": "contains"}


def _accents() -> tuple[str, str]:
    """Latin letters with a mark, and the letters without it."""
    found = [(chr(c), b) for c in range(0xC0, 0x250) if len(b := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and b != chr(c)]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def folded(text: Column) -> Column:
    """Lower case without the marks of Latin letters, composed or combining."""
    marked, bare = _accents()
    whole = F.regexp_replace(F.translate(F.lower(text), marked, bare), "[\\u0300-\\u036f]", "")
    # as many bytes as characters: ASCII, which has no marks
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(whole)


def slug(name: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 to one hyphen, none at the ends; ``unknown`` if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(bare == "", "unknown").otherwise(bare)


def heading_slug(title: Column) -> Column:
    """Slug of a heading: letters, digits and hyphens of any script, 80 characters at most."""
    kept = F.regexp_replace(F.lower(F.trim(title)), "(?U)[^\\w\\s-]", "")
    return F.left(F.regexp_replace(kept, "(?U)[\\s_]+", "-"), F.lit(80))


def topic_id(name: Column) -> Column:
    return F.concat(F.lit("topic:"), slug(name))


def keyword_id(name: Column) -> Column:
    return F.concat(F.lit("keyword:"), slug(name))


def entity_id(name: Column) -> Column:
    """Slugs over 60 characters keep 40 of them and 12 hex digits of the name's SHA-1."""
    s = slug(name)
    return F.concat(F.lit("entity:"), F.when(F.length(s) > 60, F.concat(F.left(s, F.lit(40)), F.lit("-"), F.left(F.sha1(name), F.lit(12)))).otherwise(s))


def document_id(path: Column) -> Column:
    return F.concat(F.lit("doc:"), path)


def chunk_id(path: Column, idx: Column) -> Column:
    return F.concat(F.lit("chunk:"), path, F.lit(":"), F.lpad(idx.cast("string"), 4, "0"))


def content_id(path: Column, start: Column, text: Column) -> Column:
    """Identifier by content: 8 hex digits of SHA-256 over path, start and the first 256 characters."""
    return F.concat(F.lit("pchunk:"), path, F.lit(":"), F.left(F.sha2(F.concat_ws(":", path, start.cast("string"), F.left(text, F.lit(256))), 256), F.lit(8)))


def tokens(text: Column) -> Column:
    """Words of 2 to 31 ASCII letters, digits, hyphens and underscores that begin with a letter, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def content_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: ~t.isin(STOP_WORDS))


def search_terms(text: Column) -> Column:
    """Runs of letters and digits of any script, folded."""
    return F.regexp_extract_all(folded(text), F.lit("[\\p{L}\\p{N}\\p{Co}]+"), F.lit(0))


def index_text(kind: Column, name: Column, title: Column, path: Column, text: Column) -> Column:
    """What is embedded of a node: its kind, title or name, file, and the first 1024 characters of its text."""
    return F.concat_ws(
        "\n", F.concat(F.lit("KIND: "), kind), F.coalesce(F.concat(F.lit("TITLE: "), title), F.concat(F.lit("NAME: "), name)), F.concat(F.lit("FILE: "), path), F.concat(F.lit("TEXT:\n"), F.left(F.trim(text), F.lit(1024)))
    )


def excerpt(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def quote(text: Column, most: int = 160) -> Column:
    """White space made single; cut after the first sentence that ends within ``most`` characters, else at them; null of a blank text."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    at = [F.instr(flat, F.lit(mark)) for mark in (". ", "! ", "? ")]
    # a mark at the very beginning ends no sentence
    cut = F.coalesce(*[F.when((a > 1) & (a <= most), a) for a in at])
    short = F.concat(F.rtrim(F.left(flat, F.lit(most))), F.lit("…"))
    return F.when(flat == "", None).when(cut.isNotNull(), F.left(flat, cut)).when(F.length(flat) > most, short).otherwise(flat)


def cite(path: Column, start: Column) -> Column:
    """file:offset, or the file alone; empty without a file."""
    return F.when(F.coalesce(path, F.lit("")) == "", "").otherwise(F.concat(path, F.coalesce(F.concat(F.lit(":"), start.cast("string")), F.lit(""))))


def relevance(dist: Column) -> Column:
    """1 - distance, to 4 places, and not under 0."""
    return F.greatest(F.lit(0.0), F.round(1 - dist, 4))


def short_boost(kind: Column, text: Column) -> Column:
    """Short chunks rank a little higher: 1.5 (1 - n / 200) from 50 to 199 characters."""
    n = F.length(text)
    return F.when((kind == "chunk") & (n >= 50) & (n < 200), F.round(1.5 * (1 - n / 200.0), 4)).otherwise(0.0)


def hop_label(rel: Column, similarity: Column | None = None, href: Column | None = None) -> Column:
    names = F.create_map(*[F.lit(x) for kv in HOP_LABELS.items() for x in kv])
    label = F.coalesce(F.try_element_at(names, rel), F.lower(F.replace(rel, F.lit("_"), F.lit(" "))))
    if similarity is not None:
        label = F.when(similarity.isNotNull(), F.concat(label, F.lit(" ("), similarity.cast("string"), F.lit(")"))).otherwise(label)
    if href is not None:
        label = F.when((similarity.isNull() if similarity is not None else F.lit(True)) & href.isNotNull(), F.concat(label, F.lit(" ("), href, F.lit(")"))).otherwise(label)
    return label


#: Headings of main content, and of front matter, as patterns of their lower-case forms.
MAIN_HEADINGS = "tale ode song section letter scene act canto volume part book chapter night day".split()
_KINDS = {"editor": "note|remarks|preface|introduction", "translator": "note|remarks|preface|introduction", "publisher": "preface|note", "transcriber": "note"}
FRONT_HEADINGS = [
    *[f"{who}['’]?s?\\s*({kinds})" for who, kinds in _KINDS.items()],
    "select\\s+bibliography", "introductory\\s+essay", "copyright", "by\\s+way\\s+of\\s+introduction", "table\\s+of\\s+contents", "about\\s+the\\s+author", "about\\s+this\\s+(translation|text|edition|book)",
    "biographical\\s+sketch", "note\\s+on\\s+the\\s+(edition|translation|text)", "a\\s+note\\s+on", "notes?\\s*to\\s+the", "proleg\\w*", "prefator\\w*", "fore\\s*word", "preface", "introduc\\w*",
]


def content_type(path: Column, title: Column, level: Column, start: Column, total: Column) -> Column:
    """front_matter, reference or null of a section, by file, heading and place."""
    main = F.lower(title).rlike(f"^({'|'.join(MAIN_HEADINGS)})\\b")
    front = F.lower(title).rlike(f"\\b({'|'.join(FRONT_HEADINGS)})\\b")
    return (
        F.when(path.endswith("reference.md"), "reference")
        .when(title.isNull() | (level == 1) | main, None)
        .when((total > 0) & (start / total > 0.40), None)
        .when(front, "front_matter")
    )


def links(text: Column) -> Column:
    """Targets of inline links, then of link definitions."""
    return F.concat(F.regexp_extract_all(text, F.lit("\\[([^\\]]*)\\]\\(([^)]+)\\)"), F.lit(2)), F.regexp_extract_all(text, F.lit("(?m)^\\[[^\\]]+\\]:\\s*(\\S+)"), F.lit(1)))


def title_of(text: Column, path: Column) -> Column:
    """The first level-one heading of the first 20 lines, else the file's stem in words."""
    heads = F.filter(F.slice(F.split(text, "\n"), 1, 20), lambda x: x.startswith("# "))
    stem = titled(F.regexp_replace(F.regexp_extract(path, "([^/]+?)(\\.[^./]*)?$", 1), "[_-]", " "))
    return F.coalesce(F.trim(F.substring(F.try_element_at(heads, F.lit(1)), 3, 1 << 30)), stem)


def titled(text: Column) -> Column:
    """Each run of letters with a capital and then small letters, also after digits and apostrophes."""
    runs = F.regexp_extract_all(text, F.lit("\\p{L}+|\\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 1 << 30)))), "")


def syllables(word: Column) -> Column:
    """Groups of vowels, one less for a last e but not le; at least one; none of an empty word."""
    bare = F.btrim(F.lower(word), F.lit(".,!?;:'\""))
    groups = F.regexp_count(bare, F.lit("[aeiouy]+"))
    silent = bare.endswith("e") & ~bare.endswith("le")
    return F.when(bare == "", 0).otherwise(F.greatest(F.lit(1), groups - F.when(silent, 1).otherwise(0)))


def reading_grade(words: Column, sentences: Column, syllables_: Column) -> Column:
    """Flesch-Kincaid grade of counts."""
    return 0.39 * words / F.greatest(F.lit(1), sentences) + 11.8 * F.coalesce(syllables_ / words, F.lit(0.0)) - 15.59


#: Question words with what may follow them, and what is then left of a personal question.
_ASKS = {"what": "are|does|do|did|were|was|is", "where": "do|did|was|is", "when": "do|did|was|is", "who": "did|was|is"}
OPENING = "(?i)^(?:" + "|".join(f"{w}(?:'s| (?:{v}))?" for w, v in _ASKS.items()) + "|how(?:\\s+(?:old|far|often|long|much|many))?|why|which)\\s+"
_DOING = "complete finish start join create lose win earn pack spend find pick use attend do make go buy take have get".split()
PERSONAL = f"(?i)^(?:(?:did|do|have)\\s+(?:my|i)\\b|was\\s+(?:the|my|i)\\b|(?:is|are)\\s+(?:the|my)\\b|i\\s+(?:{'|'.join(_DOING)})\\b|(?:the|my|i)\\s+)\\s*"


def plain_question(text: Column) -> Column:
    """A question without its mark, its question word and a personal beginning; the question itself if nothing is left."""
    bare = F.btrim(F.rtrim(F.btrim(text, F.lit(" \n\t\r")), F.lit("?")), F.lit(" \n\t\r"))
    left = F.trim(F.regexp_replace(F.regexp_replace(bare, OPENING, ""), PERSONAL, ""))
    return F.when(left == "", text).otherwise(left)


def answer_tokens(text: Column) -> Column:
    """Words of an answer in lower case, without ASCII punctuation and the words a, an, the and and (written small)."""
    bare = F.regexp_replace(F.replace(text, F.lit(","), F.lit("")), "\\b(?:and|the|an|a)\\b", " ")
    return F.filter(F.split(F.lower(F.regexp_replace(bare, "\\p{Punct}", "")), "\\s+"), lambda w: w != "")


def answer_f1(given: Column, right: Column) -> Column:
    """F1 of two answers' words as multisets, from two arrays of words; of an empty one, whether both are."""
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    both = F.aggregate(F.array_distinct(given), F.lit(0), lambda a, w: a + F.least(count(given, w), count(right, w)))
    empty = (F.size(given) == 0) | (F.size(right) == 0)
    return F.when(empty, (F.size(given) == F.size(right)).cast("double")).otherwise(2.0 * both / (F.size(given) + F.size(right)))


def session_of(path: Column) -> Column:
    """The stem of a file's name."""
    return F.regexp_extract(path, "([^/]+?)(\\.[^./]*)?$", 1)


def normal_phrase(text: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower), " ")


def metadata(json: Column) -> Column:
    """A map from a JSON object; anything else is an empty map."""
    return F.coalesce(F.from_json(json, "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))


def routed(path: Column, routes: list[tuple[str, str]], default: str) -> Column:
    """The name of the first route whose prefix the path begins with."""
    found = F.lit(default)
    for prefix, name in reversed(routes):
        found = F.when(path.startswith(prefix), name).otherwise(found)
    return found
