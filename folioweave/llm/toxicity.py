"""Operator 9, toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes homoglyphs, accents and digit substitutions and leaves words between single spaces.
The lexicon has whole words and word beginnings; its weights are log odds learnt from a bounded
sample of labelled rows.  Hits inside exception phrases don't count.  The sum of the weights, and
the sum over the length, go through a logistic curve fitted on the same sample.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, worker_path
from .labelled import training_sample

#: Labelled rows that lexicon and curve are fitted on, and entries of the lexicon, at most.
TRAIN_ROWS, ENTRIES = 12_000, 4_000
#: An entry stands in so many labelled toxic documents, after so many different words, with log odds of so much at least.
SUPPORT, CONTEXTS, LEAST_WEIGHT = 5, 4, 2.0
BEGINNINGS = (4, 5, 6)
MOD, HELD = 5, 0
#: Harmless phrases that hold words which alone may be abusive, in folded form.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clown around", "scum of the pond", "pond scum", "sore loser", "worthless cheque", "pathetic fallacy")

_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "ⅼ": "l", "κ": "k",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "ß": "ss", "æ": "ae", "œ": "oe",
}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}


class _Fold(dict):
    """For str.translate: what each character becomes, found out when it is first met."""

    def __missing__(self, c: int) -> str:
        out = ""
        for x in unicodedata.normalize("NFKD", chr(c)).lower():
            if unicodedata.combining(x) or unicodedata.category(x) == "Cf":
                continue
            x = _LOOKALIKES.get(x, _DIGITS.get(x, x))
            out += x if x.isalnum() else " "
        self[c] = out
        return out


_FOLD = _Fold()
#: Marks outside words, where they stand for no letter.
_AROUND = regex.compile(r"(?<=[^\s@$!|])[@$!|%#*&.,;:?]+(?=\s|$)|(?<=^|\s)[!|]+(?=\s|$)")


def fold(text: str) -> str:
    return " " + " ".join(_AROUND.sub(" ", text).translate(_FOLD).split()) + " "


def patterns(word: str) -> list[str]:
    return [f" {word} ", *(f" {word[:k]}" for k in BEGINNINGS if len(word) > k)]


class Matcher:
    """Weights of an automaton's hits: one for each place, the greatest; none inside an exception phrase."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.machine = ahocorasick.Automaton()
        for phrase in exceptions:
            key = " " + phrase + " "
            self.machine.add_word(key, (key, 0.0))
        for key, weight in lexicon.items():
            self.machine.add_word(key, (key, weight))
        self.machine.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (key, weight) in self.machine.iter(folded):
            start = end - len(key) + 1
            if weight:
                found[start] = max(weight, found.get(start, 0.0))
            else:
                spared.append((start, end))
        for a, b in spared:
            for at in [at for at in found if a <= at < b]:
                del found[at]
        return found

    def measures(self, text: str) -> list[float]:
        folded = fold(text)
        hits = self.hits(folded)
        total, words = sum(hits.values()), max(1, folded.count(" ") - 1)
        return [1.0, float(np.log1p(total)), float(np.log1p(100 * total / words)), max(hits.values(), default=0.0)]


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition: in how many toxic and clean documents each pattern stands, and a 64-bit set of the words before it in toxic ones."""
    seen: dict[str, list[int]] = {}
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words, before, own = fold(text).split(), "", {}
            for w in words:
                if len(w) < 40:
                    bit = 1 << (zlib.crc32(before.encode()) & 63)
                    for p in patterns(w):
                        own[p] = own.get(p, 0) | bit
                before = w
            for p, bits in own.items():
                s = seen.setdefault(p, [0, 0, 0])
                s[1 - y] += 1
                if y:
                    s[2] |= bits
    rows = [(p, a, b, c - (1 << 64) if c >= 1 << 63 else c) for p, (a, b, c) in seen.items() if a]
    rows += [(p, 0, b, 0) for p, (a, b, _) in seen.items() if not a]
    for k in range(0, len(rows), 50_000):
        part = list(zip(*rows[k : k + 50_000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(part[0]), *(pa.array(x, pa.int64()) for x in part[1:])], names=["pattern", "toxic", "clean", "bits"])


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a little ridge."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[float]]:
    sample = training_sample(docs, labels, "toxic", MOD, HELD, TRAIN_ROWS)
    counts = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        rate = (toxic + 1) / (toxic + clean + 2)
        return {}, [float(np.log(rate / (1 - rate))), 0.0, 0.0, 0.0]
    mined = sample.select("y", "text").mapInArrow(_mine, "pattern string, toxic long, clean long, bits long")
    each = mined.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("bits").alias("bits"))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    each = each.withColumn("weight", weight).where((F.col("toxic") >= SUPPORT) & (F.bit_count("bits") >= CONTEXTS) & (F.col("weight") >= LEAST_WEIGHT))
    lexicon = {r.pattern: r.weight for r in each.orderBy(F.desc("weight"), F.desc("toxic"), "pattern").limit(ENTRIES).collect()}
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([matcher.measures(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])

    rows = sorted(sample.select("y", "text").mapInArrow(measured, "y int, x array<double>").collect())  # TRAIN_ROWS rows at most, in an order that files don't give
    x = np.array([r.x for r in rows])
    return lexicon, _curve(x, np.array([r.y for r in rows], dtype=float)).tolist()


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher for label 1), predicted (1 from 0.5 on).

    A null text is scored as an empty one; a null doc_id stays null and is not held out; repeated rows
    are scored each; without usable labels every score is 0.5; an empty table gives an empty result;
    columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    worker_path(spark)
    sent = spark.sparkContext.broadcast(train(docs, labels))  # ENTRIES short strings at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = sent.value
        matcher, w = Matcher(lexicon), np.array(w)
        for batch in batches:
            x = np.array([matcher.measures(t or "") for t in batch.column(2).to_pylist()]).reshape(-1, 4)
            score = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    source = docs.select(doc_id.alias("doc_id"), F.coalesce(crc_mod(doc_id, MOD) == HELD, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
