"""Operator 8, quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees over binned features learns one lookup table per feature, then
one small grid for each of the strongest pairs.  A score is the sum of the looked-up bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, worker_path
from .labelled import training_sample

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 16_000
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS = 32, 120, 0.15, 6, 8, 60
THRESHOLD = 0.7
MOD, HELD = 4, 2

FEATURES = (
    "log_words", "word_length", "symbols", "exclaims", "bars", "digits", "upper_words", "distinct_words", "distinct_threes",
    "stutters", "dup_lines", "line_words", "commas", "stops", "longest_word", "spaces",
)
_SYMBOLS = "#*$%&<>=~^_{}[]\\/@+"


def features(text: str) -> list[float]:
    """Measures of a whole text, none of them on its language, source or id."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x]
    spaces = text.count(" ")
    return [
        float(np.log1p(len(words))),
        (chars - spaces) / n,
        sum(map(text.count, _SYMBOLS)) / n,
        text.count("!") / n,
        text.count("|") / n,
        sum(map(text.count, "0123456789")) / chars,
        sum(map(str.isupper, words)) / n,
        len(set(words)) / n,
        len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2),
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(words) / max(1, len(lines)))),
        text.count(",") / n,
        text.count(".") / n,
        float(np.log1p(max(map(len, words), default=0))),
        spaces / chars,
    ]


def _cells(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1).astype(np.int32)


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    cuts = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    return cuts[cuts > values.min()] if len(values) else cuts


def _tree(g: np.ndarray, h: np.ndarray, leaf: float) -> np.ndarray:
    """Values of a tree of three leaves at most over ordered bins, by the gain of Newton steps."""
    value = np.zeros(len(g))
    parts = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None)
        for a, b in parts:
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            tg, th = g[a:b].sum(), h[a:b].sum()
            ok = (ch >= leaf) & (th - ch >= leaf)
            gain = np.where(ok, cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - tg**2 / (th + 1), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (a, b, a + k + 1))
        if best[1] is None:
            break
        a, b, c = best[1]
        parts.remove((a, b))
        parts += [(a, c), (c, b)]
    for a, b in parts:
        value[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return value


def _pair_tree(g: np.ndarray, h: np.ndarray, leaf: float) -> tuple[float, np.ndarray]:
    """Gain and values of one cut of each axis of a grid: four leaves."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    rg, rh, dg, dh = cg[:-1, -1:], ch[:-1, -1:], cg[-1:, :-1], ch[-1:, :-1]
    parts = [(a, b), (rg - a, rh - b), (dg - a, dh - b), (tg - rg - dg + a, th - rh - dh + b)]
    gain = sum(x**2 / (y + 1) for x, y in parts) - tg**2 / (th + 1)
    gain = np.where(np.minimum.reduce([np.broadcast_to(y, a.shape) for _, y in parts]) >= leaf, gain, 0) if a.size else np.zeros((1, 1))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    value = np.zeros(g.shape)
    if gain[i, j] > 1e-9:
        for rows in (slice(0, i + 1), slice(i + 1, None)):
            for cols in (slice(0, j + 1), slice(j + 1, None)):
                value[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1)
    return float(gain[i, j]), value


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Lookup tables of the model; of one class, or no rows, the base rate alone."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = {"base": float(np.log(rate / (1 - rate))), "edges": [], "tables": [], "pairs": []}
    if len(y) < 20 or y.min() == y.max():
        return model
    edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    cells = _cells(x, edges)
    tables = [np.zeros(len(e) + 1) for e in edges]
    score = np.full(len(y), model["base"])
    slope = lambda: (y - (p := 1 / (1 + np.exp(-score))), p * (1 - p))
    for _ in range(ROUNDS):
        for j, t in enumerate(tables):  # each feature in turn
            if len(t) > 1:
                g, h = slope()
                step = RATE * _tree(np.bincount(cells[:, j], g, len(t)), np.bincount(cells[:, j], h, len(t)), 2.0)
                t += step
                score += step[cells[:, j]]
    rough = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    grid = _cells(x, rough)
    sizes = [len(e) + 1 for e in rough]

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(grid[:, i] * sizes[j] + grid[:, j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    g, h = slope()
    gains = sorted(((_pair_tree(sums(i, j, g), sums(i, j, h), 1.0)[0], i, j) for i in range(len(sizes)) for j in range(i) if min(sizes[i], sizes[j]) > 1), reverse=True)
    pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in pairs:
            g, h = slope()
            step = RATE * _pair_tree(sums(i, j, g), sums(i, j, h), 1.0)[1]
            t += step
            score += step[grid[:, i], grid[:, j]]
    return model | {"edges": edges, "tables": tables, "rough": rough, "pairs": pairs}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    score = np.full(len(x), model["base"])
    if model["tables"] and len(x):
        cells = _cells(x, model["edges"])
        for j, t in enumerate(model["tables"]):
            score += t[cells[:, j]]
        grid = _cells(x, model["rough"])
        for i, j, t in model["pairs"]:
            score += t[grid[:, i], grid[:, j]]
    return 1 / (1 + np.exp(-score))


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in texts], dtype=float).reshape(len(texts), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame) -> dict:
    sample = training_sample(docs, labels, "quality", MOD, HELD, TRAIN_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_matrix(batch.column(2).to_pylist()).tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = sorted(sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<double>").collect())  # TRAIN_ROWS rows at most
    x = np.array([r.x for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r.y for r in rows], dtype=float))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher for label 1), predicted (1 from 0.7 on).

    A null text is scored as an empty one; a null doc_id stays null and is not held out; repeated rows
    are scored each; without usable labels every score is 0.5; an empty table gives an empty result;
    columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    worker_path(spark)
    sent = spark.sparkContext.broadcast(train(docs, labels))  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = predict(sent.value, _matrix(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    source = docs.select(doc_id.alias("doc_id"), F.coalesce(crc_mod(doc_id, MOD) == HELD, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
