"""Scores of evaluation runs as columns: overlaps with a question, closeness in time, and where evidence stands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .analyze import NO_CONTENT

#: Capitalised words that are no names.
NO_NAMES = ("When", "What", "Where", "Which", "Who", "How", "Why", "The", "This", "That", "Speaker", "Person", "Day", "Year", "Date", "Time")


def question_words(text: Column, stop: tuple[str, ...] = NO_CONTENT) -> Column:
    """Words of three letters or more, in lower case, repeats included, without ``stop``."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("\\b[a-z]{3,}\\b"), F.lit(0)), lambda w: ~w.isin(*stop))


def quoted(text: Column) -> Column:
    """What stands in single, then in double quotes, 3 to 60 characters."""
    each = lambda q: F.regexp_extract_all(text, F.lit(f"{q}([^{q}]{{3,60}}){q}"), F.lit(1))
    return F.filter(F.transform(F.concat(each("'"), each('"')), lambda p: F.trim(p)), lambda p: F.length(p) >= 3)


def names(text: Column, stop: tuple[str, ...] = NO_NAMES) -> Column:
    """Capitalised words of 3 to 16 letters, each once, without ``stop``."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit("\\b[A-Z][a-z]{2,15}\\b"), F.lit(0)), lambda w: ~w.isin(*stop)))


def share_in(words: Column, text: Column) -> Column:
    """Share of ``words`` that stand anywhere in the text, whatever their case; 0 without words."""
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(text), F.lower(w))))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(0.0)


def closeness(day: Column, target: Column, tolerance: int, most: float = 0.4) -> Column:
    """``most`` within ``tolerance`` days of the target, falling to 0 at three times that."""
    apart = F.abs(F.datediff(day, target))
    return F.when(apart <= tolerance, most).when(apart <= 3 * tolerance, most * (1.0 - (apart - tolerance) / (2.0 * tolerance))).otherwise(0.0)


def fused_distance(distance: Column, overlap: Column, near: Column, weight: float = 0.3) -> Column:
    """A distance made less by overlap with the question and by closeness in time."""
    return distance * (1.0 - weight * overlap) * (1.0 - near)


def session_of_evidence(evidence: Column) -> Column:
    """``D12:3`` stands in ``session_12``; anything else in none."""
    number = F.regexp_extract(evidence, "^D(\\d+):", 1)
    return F.when(number != "", F.concat(F.lit("session_"), number))


def session_of_id(corpus_id: Column) -> Column:
    """The id without its last ``_turn_...``."""
    return F.regexp_replace(corpus_id, "^(.*)_turn_.*$", "$1")
