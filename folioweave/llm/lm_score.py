"""Operator 1, LM scoring: masked pseudo-likelihood with a bidirectional window network.

A small network predicts each token from the two tokens on either side: an embedding for each place, one
hidden layer, and a softmax in two steps, over 32 classes and over the 32 tokens of a class.  The most frequent
words of the whole corpus are tokens of their own; other words share tokens by their ending, and a word's
share of its token comes from the corpus counts, so that every word has a probability of its own.  Every window
of every document trains the network once: documents are dealt by a hash of their tokens to as many replicas
as the corpus's words ask for, replicas are trained in numpy and averaged up a tree, first on an eighth of the
documents and from there on the others.  A document's score is the sum of the log-probabilities of its
words, each given its neighbours.  Neither replicas nor scores depend on how rows lie in files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPLIT, cut, released, table, worker_path

CLASSES, PER_CLASS = 32, 32
TOKENS = CLASSES * PER_CLASS
#: Tokens that are words of their own; the others are shared by words of like endings.  PAD stands beyond a text's ends.
FREQUENT, PAD = TOKENS // 2, TOKENS
#: Words with a count of their own in the table that workers get; the others of a token share what is left of it.
LISTED = 200_000
HIDDEN, SIDE = 24, 2
#: Words of a replica; examples of a step; step size; replicas that meet in a node of the tree; the first round takes one document in so many.
REPLICA_WORDS, STEP, RATE, FAN_IN, FIRST = 4_000_000, 8192, 0.1, 8, 8
#: Tokens that are scored at once; words that a worker's cache holds.
CHUNK, WORD_CACHE = 32_768, 300_000
SEED = 7


def _scattered(k: int) -> int:
    """Deals tokens over the classes, so that each class has frequent and rare ones."""
    return (k % CLASSES) * PER_CLASS + k // CLASSES


def ending(word: str) -> int:
    """Which of the shared tokens a word falls to, by its last three characters."""
    return zlib.crc32(word[-3:].encode()) % (TOKENS - FREQUENT)


class Vocabulary:
    """Words by number: the listed ones first, then one number for the other words of each shared token."""

    def __init__(self, words: list[str], counts: np.ndarray, shared: dict[int, tuple[int, int]]):
        """``shared`` has, by ending, the sum of counts and the number of words that fall there, listed or not."""
        self.words, self.counts, self.shared = words, counts, shared
        n = len(words)
        self.listed = n
        self.token = np.empty(n + TOKENS - FREQUENT, np.int16)
        self.log_share = np.zeros(n + TOKENS - FREQUENT)
        sums, kinds = np.zeros(TOKENS - FREQUENT), np.zeros(TOKENS - FREQUENT)
        for e, (total, distinct) in shared.items():
            sums[e], kinds[e] = total, distinct
        for k in range(min(n, FREQUENT)):
            self.token[k] = _scattered(k)
        at = np.array([ending(w) for w in words[FREQUENT:]], np.int64)
        self.token[FREQUENT:n] = [_scattered(FREQUENT + e) for e in at] if n > FREQUENT else []
        rest = np.arange(TOKENS - FREQUENT)
        self.token[n:] = [_scattered(FREQUENT + e) for e in rest]
        # one more count than there are stands for words that the corpus doesn't have
        if n > FREQUENT:
            self.log_share[FREQUENT:n] = np.log(counts[FREQUENT:] / (sums[at] + 1))
            left, own = sums - np.bincount(at, counts[FREQUENT:], TOKENS - FREQUENT), kinds - np.bincount(at, minlength=TOKENS - FREQUENT)
        else:
            left, own = sums, kinds
        self.log_share[n:] = np.log((left + 1) / (sums + 1) / (own + 1))


class Numbers(dict):
    """Numbers of words, found when first met."""

    def __init__(self, vocabulary: Vocabulary):
        self.base = {w: k for k, w in enumerate(vocabulary.words)}
        self.first = vocabulary.listed
        self.update(self.base)

    def __missing__(self, word: str) -> int:
        if len(self) >= len(self.base) + WORD_CACHE:
            self.clear()
            self.update(self.base)
        value = self[word] = self.first + ending(word)
        return value


def numbers_of(text: str | None, numbers: Numbers) -> np.ndarray:
    words = (text or "").lower().split()
    return np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))


def windows(tokens: list[np.ndarray]) -> Iterator[np.ndarray]:
    """(n, 5) at a time: two tokens before, two after, and the token itself, of several texts one after the other."""
    gap = np.full(SIDE, PAD, np.int16)
    wide = np.concatenate([gap, *[x for t in tokens for x in (t.astype(np.int16), gap)]])
    places = np.flatnonzero(wide != PAD)
    for a in range(0, len(places), CHUNK):
        at = places[a : a + CHUNK]
        yield np.stack([wide[at - 2], wide[at - 1], wide[at + 1], wide[at + 2], wide[at]], axis=1)


SHAPES = {"places": (2 * SIDE, TOKENS + 1, HIDDEN), "bias": (HIDDEN,), "to_class": (HIDDEN, CLASSES), "class_bias": (CLASSES,), "to_word": (CLASSES, HIDDEN, PER_CLASS), "word_bias": (CLASSES, PER_CLASS)}


def start() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return {k: (rng.standard_normal(s) * (0.0 if "bias" in k else 0.1)).astype(np.float32) for k, s in SHAPES.items()}


def to_bytes(net: dict[str, np.ndarray]) -> bytes:
    return b"".join(net[k].astype("<f4").tobytes() for k in SHAPES)


def from_bytes(raw: bytes) -> dict[str, np.ndarray]:
    flat, net, at = np.frombuffer(raw, "<f4"), {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        net[k] = flat[at : at + n].reshape(s).copy()
        at += n
    return net


_ONES = np.ones(max(CLASSES, PER_CLASS), np.float32)
#: Logits count as this at most, either way, while training, far beyond what it makes them.
HIGHEST = 60.0


def _softmax(x: np.ndarray) -> np.ndarray:
    """Probabilities, in place."""
    np.clip(x, -HIGHEST, HIGHEST, out=x)
    np.exp(x, out=x)
    x /= (x @ _ONES[: x.shape[1]])[:, None]
    return x


def _log_of(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of one column of each row of logits."""
    x -= x.max(axis=1, keepdims=True)
    own = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    return own - np.log(x @ _ONES[: x.shape[1]])


def _hidden(net: dict[str, np.ndarray], part: np.ndarray) -> np.ndarray:
    h = net["places"][0][part[:, 0]]
    for k in range(1, 2 * SIDE):
        h += net["places"][k][part[:, k]]
    h += net["bias"]
    return np.tanh(h, out=h)


def _classed(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of their target's class, those classes, and where each class begins and ends."""
    part = part[np.argsort(part[:, 4] // PER_CLASS, kind="stable")]
    kinds = part[:, 4] // PER_CLASS
    return part, kinds, np.searchsorted(kinds, np.arange(CLASSES + 1))


class Trainer:
    """Adagrad over windows, in steps."""

    def __init__(self, net: dict[str, np.ndarray]):
        self.net = net
        self.past = {k: np.full(v.shape, 1e-4, np.float32) for k, v in net.items()}

    def move(self, k: str, g: np.ndarray, at=...) -> None:
        past, own = self.past[k], self.net[k]
        past[at] += g * g
        own[at] -= RATE * g / np.sqrt(past[at])

    def __call__(self, w: np.ndarray) -> None:
        for a in range(0, len(w), STEP):
            self.step(w[a : a + STEP])

    def step(self, part: np.ndarray) -> None:
        net = self.net
        part, kinds, ends = _classed(part)
        members, rows = part[:, 4] % PER_CLASS, np.arange(len(part))
        h = _hidden(net, part)
        g_class = _softmax(h @ net["to_class"] + net["class_bias"])
        g_class[rows, kinds] -= 1
        g_class /= len(part)
        g_h = g_class @ net["to_class"].T
        for c in np.flatnonzero(ends[1:] > ends[:-1]):
            at = slice(ends[c], ends[c + 1])
            g = _softmax(h[at] @ net["to_word"][c] + net["word_bias"][c])
            g[np.arange(len(g)), members[at]] -= 1
            g /= len(part)
            g_h[at] += g @ net["to_word"][c].T
            self.move("to_word", h[at].T @ g, c)
            self.move("word_bias", g.sum(0), c)
        self.move("to_class", h.T @ g_class)
        self.move("class_bias", g_class.sum(0))
        g_h *= 1 - h * h
        self.move("bias", g_h.sum(0))
        for k in range(2 * SIDE):
            order = np.argsort(part[:, k], kind="stable")
            own = part[order, k]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            self.move("places", np.add.reduceat(g_h[order], first, axis=0), (k, own[first]))


def score_windows(net: dict[str, np.ndarray], w: np.ndarray) -> np.ndarray:
    """Log-probabilities of the tokens in the last column."""
    order = np.argsort(w[:, 4] // PER_CLASS, kind="stable")
    part, kinds, ends = _classed(w)
    members = part[:, 4] % PER_CLASS
    h = _hidden(net, part)
    got = _log_of(h @ net["to_class"] + net["class_bias"], kinds)
    for c in np.flatnonzero(ends[1:] > ends[:-1]):
        at = slice(ends[c], ends[c + 1])
        got[at] += _log_of(h[at] @ net["to_word"][c] + net["word_bias"][c], members[at])
    out = np.empty(len(w), np.float64)
    out[order] = got
    return out


def vocabulary(docs: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary of the whole corpus, in lower case, and its number of words.  LISTED words at most, a row for each level of counts and for each shared token reach the driver."""
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), WORD_SPLIT)).alias("w")).where("w <> ''")
    counts = cut(words.groupBy("w").count(), "word-counts")
    # the listed words are those from a count on: of the levels of counts, as many from above as LISTED words allow
    counts = counts.withColumn("level", F.floor(F.log2("count") * 32).cast("int"))
    room, least = LISTED, 1 << 30
    for r in sorted(counts.groupBy("level").agg(F.count("*").alias("n")).collect(), reverse=True):
        room -= r.n
        if room < 0:
            break
        least = r.level
    found = counts.where(F.col("level") >= least).select("w", "count").toArrow()
    top = sorted(zip((-n for n in found.column("count").to_pylist()), found.column("w").to_pylist(), strict=True))
    frequent = [w for _, w in top[:FREQUENT]]
    by_end = (F.crc32(F.right("w", F.lit(3)).cast("binary")) % F.lit(TOKENS - FREQUENT)).cast("int")
    rare = counts.where(~F.col("w").isin(frequent)) if frequent else counts
    shared = {r.e: (r.n, r.k) for r in rare.groupBy(by_end.alias("e")).agg(F.sum("count").alias("n"), F.count("*").alias("k")).collect()}
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return Vocabulary([w for _, w in top], np.array([-n for n, _ in top], float), shared), total


def train(docs: DataFrame, words: Vocabulary, total: int) -> bytes:
    """The trained network.  At most FAN_IN replicas, of some 500 kB each, reach the driver."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(words)
    replicas = max(1, -(-total // REPLICA_WORDS))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, of = Numbers(sent.value), sent.value.token
        for batch in batches:
            raw = [of[numbers_of(t, numbers)].astype("<i2").tobytes() for t in batch.column(1).to_pylist()]
            keys = np.array([xxhash.xxh3_64_intdigest(r) >> 1 for r in raw], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(raw, pa.binary())], names=["doc_id", "h", "tokens"])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(tokens), "doc_id long, h long, tokens binary").where(F.length("tokens") > 0)
    # the id takes part, so that a group of copies is dealt to all replicas
    place = lambda k: F.xxhash64(F.lit(k), "h", "doc_id")
    dealt = dealt.select((F.pmod(place(0), F.lit(FIRST)) == 0).alias("first"), F.pmod(place(1), F.lit(replicas)).cast("int").alias("replica"), place(2).alias("order"), "tokens")
    dealt = cut(dealt, "tokens")
    net = to_bytes(start())
    kind = "k int, n long, net binary"
    for turn in (True, False):
        given = context.broadcast(net)

        def replica(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            """Rows come in the order of replicas."""
            now, own, seen, held, size = None, None, 0, [], 0

            def trained() -> None:
                nonlocal held, size
                for w in windows(held):
                    own(w[np.random.default_rng(SEED).permutation(len(w))])
                held, size = [], 0

            def result() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([seen], pa.int64()), pa.array([to_bytes(own.net)], pa.binary())], names=["k", "n", "net"])

            for batch in batches:
                for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if k != now:
                        if own is not None:
                            trained()
                            yield result()
                        now, own, seen = k, Trainer(from_bytes(given.value)), 0
                    t = np.frombuffer(raw.as_buffer(), "<i2")
                    held.append(t)
                    size, seen = size + len(t), seen + len(t)
                    if size >= CHUNK:
                        trained()
            if own is not None:
                trained()
                yield result()

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come in the order of nodes, and of replicas in them."""
            now, total, seen = None, None, 0
            for batch in batches:
                for node, n, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if node != now and now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([seen], pa.int64()), pa.array([(total / seen).astype("<f4").tobytes()], pa.binary())], names=["k", "n", "net"])
                        total, seen = None, 0
                    now, x = node, np.frombuffer(raw, "<f4").astype(np.float64) * n
                    total, seen = x if total is None else total + x, seen + n
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([seen], pa.int64()), pa.array([(total / seen).astype("<f4").tobytes()], pa.binary())], names=["k", "n", "net"])

        own = dealt.where(F.col("first") if turn else ~F.col("first"))
        ordered = own.repartitionByRange(replicas, "replica").sortWithinPartitions("replica", "order").select("replica", "tokens")
        nets = cut(ordered.mapInArrow(released(replica), kind), "replicas")
        while nets.count() > FAN_IN:
            tree = nets.select(F.floor(F.col("k") / FAN_IN).cast("int").alias("node"), "k", "n", "net")
            nets = cut(tree.repartition("node").sortWithinPartitions("node", "k").mapInArrow(average, kind), "replicas")
        rows = sorted(nets.collect())
        if rows:
            seen = sum(r.n for r in rows)
            net = (sum(np.frombuffer(r.net, "<f4").astype(np.float64) * r.n for r in rows) / seen).astype("<f4").tobytes()
    return net


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_tokens, log_likelihood (the sum), mean_logprob, perplexity.

    Tokens are words between white space, in lower case.  A text without words, or null, has
    log_likelihood 0 and null mean and perplexity; a null doc_id stays null; repeated rows are scored
    each; an empty table gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    worker_path(spark)
    words, total = vocabulary(docs)
    sent = spark.sparkContext.broadcast((words, train(docs, words, total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, raw = sent.value
        numbers, net = Numbers(known), from_bytes(raw)

        def scored(held: list[np.ndarray]) -> np.ndarray:
            """Sums over texts."""
            flat = np.concatenate(held)
            each = known.log_share[flat]
            if len(flat):
                each = each + np.concatenate([score_windows(net, w) for w in windows([known.token[t] for t in held])])
            sizes = np.array([len(t) for t in held])
            ends = np.cumsum(sizes)
            return np.array([each[e - n : e].sum() for e, n in zip(ends, sizes, strict=True)])

        for batch in batches:
            sums, counts, held, size = [], [], [], 0
            for text in batch.column(1).to_pylist():
                t = numbers_of(text, numbers)
                held.append(t)
                counts.append(len(t))
                size += len(t)
                if size >= CHUNK:
                    sums.append(scored(held))
                    held, size = [], 0
            if held:
                sums.append(scored(held))
            n, s = np.array(counts), np.concatenate(sums) if sums else np.zeros(0)
            mean = np.divide(s, n, out=np.zeros(len(n)), where=n > 0)
            none = n == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(s), pa.array(mean, mask=none), pa.array(np.exp(-mean), mask=none)],
                names=["doc_id", "n_tokens", "log_likelihood", "mean_logprob", "perplexity"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(released(run), "doc_id long, n_tokens long, log_likelihood double, mean_logprob double, perplexity double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
