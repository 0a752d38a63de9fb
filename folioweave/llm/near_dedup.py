"""Operator 3, SimHash near-duplicates: an LSH forest over randomly permuted bits.

Texts with the same set of five-word shingles are one node.  Each trie of the forest orders the nodes by
64 of the 128 SimHash bits, drawn in an order of its own.  The search climbs: a first level compares nodes
that share a long prefix in a few tries, which makes components of what is close, and further levels take
shorter prefixes and more tries, down to the depth that the density allows (so that a prefix holds CROWD
nodes on average), with as many tries as the target recall needs at that depth.  On every level but the
first, each pair of nodes in different components that shares a prefix is compared; a crowded prefix is
compared in blocks, a task each, in which the nodes of its largest component stand once and meet the
others only.

Pairs within RADIUS bits are candidates.  Only what connects components leaves a task, so that
candidates make families and not pairs; then each family's shingle sets come together, once for each block
of the family, and a task verifies by exact similarity until no pair of different components is left.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, released, table, worker_path
from .components import components

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.998
#: Bits of a fingerprint, and those in which candidates differ at most: at similarity 0.8 some 3 pairs in 10,000 differ in more.
BITS, RADIUS = 128, 33
#: Nodes that a prefix of the base depth holds on average; nodes of a prefix, and bytes of shingle sets (and some for each), that are a block.
CROWD, TASK_NODES, TASK_BYTES, NODE_BYTES = 1024, 8192, 8 << 20, 2048
#: Levels above the base: bits more, and tries.
CLIMB = ((6, 6),)
#: Nodes (one of so many) from which crowded prefixes are told; nodes that all blocks of a large family share on the first level.
CROWD_SAMPLE, HUBS = 16, 16
#: Rows of one side of a join that are broadcast at most.
SENT_ROWS = 1_000_000
WORD_CACHE = 200_000
SEED = 20240229


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2 + k]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: dict[str, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words, in lower case; of shorter texts, the one run of all their words."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = _Hashes() if hashes is None else hashes
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    acc = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        acc = _mixed(acc * _MIX[0] + h[k : k + n], 0)
    return np.unique(acc)


def node_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes())


def simhash(shingles: np.ndarray) -> np.ndarray:
    """128 bits, as booleans."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(shingles), 1 << 15):
        part = shingles[k : k + (1 << 15)]
        wide = np.stack([_mixed(part + _MIX[0], 0), _mixed(part + _MIX[3], 1)], axis=1)
        ones += np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(len(part), 16), axis=1).sum(axis=0, dtype=np.int64)
    return 2 * ones > len(shingles)


def _bits(f0: np.ndarray, f1: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(np.stack([f0, f1], axis=1)).view(np.uint8).reshape(-1, 16), axis=1)


def trie_bits(trie: int) -> np.ndarray:
    return np.random.default_rng([SEED, trie]).permutation(BITS)[:64]


def _keys(bits: np.ndarray, trie: int) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(bits[:, trie_bits(trie)], axis=1)).view(">i8").astype(np.int64).reshape(-1)


def plan(nodes: int, similarity: float = SIMILARITY, recall: float = RECALL, crowd: int = CROWD) -> tuple[int, int]:
    """(base depth, tries): the depth by the density, the tries by the recall that it leaves at ``similarity``; depth 0 is one prefix for all."""
    depth = min(40, max(0, math.ceil(math.log2(max(1, nodes) / crowd))))
    same = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** depth
    return depth, 1 if depth == 0 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def levels(nodes: int, similarity: float = SIMILARITY, recall: float = RECALL, crowd: int = CROWD) -> list[tuple[int, int]]:
    """(depth, tries) of each level of the climb, the last of which has the target recall."""
    depth, tries = plan(nodes, similarity, recall, crowd)
    return [(0, 1)] if depth == 0 else [*((depth + more, few) for more, few in CLIMB), (depth, tries)]


def hook(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining those of rows ``i`` and ``j`` pairwise; a label is the number of a row that bears it."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
        labels = parent[labels]


def _apart(f0: np.ndarray, f1: np.ndarray, i, j) -> np.ndarray:
    return np.bitwise_count((f0[i] ^ f0[j]).view(np.uint64)).astype(np.int16) + np.bitwise_count((f1[i] ^ f1[j]).view(np.uint64))


def bucket_links(c: np.ndarray, f0: np.ndarray, f1: np.ndarray, n: np.ndarray, group: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs of components, as few as connect them, between which rows of one group are within RADIUS bits and of sizes that allow ``similarity``.

    Rows come in the order of their group numbers and, in a group, of their sizes ``n``.
    """
    _, first, of = np.unique(c, return_index=True, return_inverse=True)
    labels = first[of]  # rows of one component are joined from the start
    start = labels.copy()
    ends = np.cumsum(np.bincount(group))
    begins = np.concatenate([[0], ends[:-1]])
    small = (ends - begins)[group] <= 64
    rest = np.flatnonzero(small)
    for step in range(1, 64):
        rest = rest[rest + step < len(c)]
        rest = rest[(group[rest] == group[rest + step]) & (n[rest] >= similarity * n[rest + step])]
        if not len(rest):
            break
        ok = rest[(labels[rest] != labels[rest + step]) & (_apart(f0, f1, rest, rest + step) <= RADIUS)]
        labels = hook(labels, ok, ok + step)
    for g in np.flatnonzero(ends - begins > 64):
        lo, hi = begins[g], ends[g]
        if (labels[lo:hi] == labels[lo]).all():
            continue
        own, x0, x1, own_n = labels[lo:hi], f0[lo:hi], f1[lo:hi], n[lo:hi]
        own = np.unique(own, return_index=True, return_inverse=True)
        own = own[1][own[2]]
        was = own.copy()
        for a in range(0, hi - lo - 1, 128):
            b = min(a + 128, hi - lo)
            top = np.searchsorted(own_n, own_n[b - 1] / similarity + 1e-9, "right")
            if top <= a + 1 or (own[a:top] == own[a]).all():
                continue
            near = np.bitwise_count((x0[a:b, None] ^ x0[None, a:top]).view(np.uint64)).astype(np.uint8) + np.bitwise_count((x1[a:b, None] ^ x1[None, a:top]).view(np.uint64)) <= RADIUS
            i, j = np.nonzero(near)
            i, j = i + a, j + a
            ok = (own[i] != own[j]) & (np.minimum(own_n[i], own_n[j]) >= similarity * np.maximum(own_n[i], own_n[j]))
            own = hook(own, i[ok], j[ok])
        moved = np.flatnonzero(was != own)
        labels = hook(labels, lo + was[moved], lo + own[moved])
    heads = np.unique(start)
    heads = heads[labels[heads] != heads]
    return np.stack([c[labels[heads]], c[heads]], axis=1)


def _grouped(columns: int, most: int, done) -> Callable:
    """A function for mapInArrow over rows sorted by group, whose first two columns tell groups apart: ``done(arrays)`` gets whole groups, many at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        kept = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            kept += batch.num_rows
            if kept < most:
                continue
            x, y = (np.concatenate([h.column(k).to_numpy() for h in held]) for k in (0, 1))
            change = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            if len(change):
                whole = pa.Table.from_batches(held)
                yield done([whole.column(k).to_numpy() for k in range(columns)], change[-1] + 1)
                held = whole.slice(change[-1] + 1).combine_chunks().to_batches()
                kept = sum(h.num_rows for h in held)
        if kept:
            whole = pa.Table.from_batches(held)
            yield done([whole.column(k).to_numpy() for k in range(columns)], kept)

    return run


def _blocks(major: Column, mine: Column, b1: Column, b2: Column) -> Column:
    """Numbers of the block pairs in which a row stands: of ``b1`` blocks of the largest component and ``b2`` of the others; two of the first kind never meet."""
    across = F.when(major, F.transform(F.sequence(F.lit(0), b2 - 1), lambda j: mine * b2 + j)).otherwise(
        F.concat(
            F.when(b1 > 0, F.transform(F.sequence(F.lit(0), F.greatest(b1, F.lit(1)) - 1), lambda i: i * b2 + mine)).otherwise(F.array().cast("array<int>")),
            F.transform(F.sequence(F.lit(0), b2 - 1), lambda j: b1 * b2 + F.least(j, mine) * b2 + F.greatest(j, mine)),
        )
    )
    return across


def _few(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it has at most SENT_ROWS rows."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def _candidates(nodes: DataFrame, tries: int, depth: int, whole: bool, similarity: float) -> DataFrame:
    """Pairs (a, b) of components of ``nodes`` (id, f0, f1, n, c) that connect those with candidates at a prefix of ``depth`` bits in one of the tries.

    With ``whole``, all pairs of a prefix are compared; without it, a crowded prefix is dealt at random to
    groups of TASK_NODES.
    """
    own = ["id", "f0", "f1", "n", "c"]
    kind = "trie int, prefix long, id long, f0 long, f1 long, n long, c long"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k) for k in range(len(own))]
            bits = _bits(cols[1].to_numpy(), cols[2].to_numpy())
            for t in range(tries):
                prefix = _keys(bits, t) >> np.int64(64 - depth) if depth else np.zeros(len(bits), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), t, np.int32)), pa.array(prefix), *cols], names=["trie", "prefix", *own])

    rows = nodes.select(*own).mapInArrow(spread, kind)
    some = nodes.where(F.pmod(F.xxhash64("id"), F.lit(CROWD_SAMPLE)) == 0).select(*own).mapInArrow(spread, kind)
    of_c = some.groupBy("trie", "prefix", "c").count()
    crowds = of_c.groupBy(F.col("trie").alias("t"), F.col("prefix").alias("p")).agg(F.sum("count").alias("n_all"), F.max(F.struct("count", "c")).alias("top"))
    crowds = cut(crowds.where(F.col("n_all") * CROWD_SAMPLE > TASK_NODES), "crowds")
    code = F.lit(0)
    if not crowds.isEmpty():
        size = lambda x: F.greatest(F.lit(1), F.ceil(x * CROWD_SAMPLE / TASK_NODES)).cast("int")
        if whole:
            large = F.col("top.count") * CROWD_SAMPLE > TASK_NODES // 2
            parts = crowds.select("t", "p", F.when(large, F.col("top.c")).alias("major"), F.when(large, size(F.col("top.count"))).otherwise(0).alias("b1"), size(F.col("n_all") - F.when(large, F.col("top.count")).otherwise(0)).alias("b2"))
            rows = rows.join(_few(parts), (F.col("trie") == F.col("t")) & (F.col("prefix") == F.col("p")), "left")
            major = F.coalesce(F.col("c") == F.col("major"), F.lit(False))
            mine = F.pmod(F.xxhash64("id"), F.when(major, F.col("b1")).otherwise(F.col("b2"))).cast("int")
            each = F.when(F.col("b2").isNull(), F.array(F.lit(0))).otherwise(_blocks(major, mine, F.col("b1"), F.col("b2")))
            rows = rows.withColumn("code", F.explode(each))
        else:
            rows = rows.join(_few(crowds.select("t", "p", size(F.col("n_all")).alias("b"))), (F.col("trie") == F.col("t")) & (F.col("prefix") == F.col("p")), "left")
            rows = rows.withColumn("code", F.coalesce(F.pmod(F.xxhash64("id"), F.col("b")).cast("int"), F.lit(0)))
        code = F.col("code")

    def compare(cols: list[np.ndarray], end: int) -> pa.RecordBatch:
        x, y, n, c, f0, f1 = (k[:end] for k in cols)
        new = np.ones(end, bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        pairs = bucket_links(c, f0, f1, n, np.cumsum(new) - 1, similarity)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])

    dealt = rows.select((F.col("trie").cast("long") * F.lit(1 << 40) + F.col("prefix")).alias("x"), code.cast("long").alias("y"), "n", "c", "f0", "f1").repartition("x", "y").sortWithinPartitions("x", "y", "n")
    found = cut(dealt.mapInArrow(_grouped(6, 32_768, compare), "a long, b long").distinct(), "met")
    discard(crowds)
    return found


def linked(c: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Pairs of components, as few as connect them, between which some sets have ``similarity`` (intersection over union); all pairs of different components are covered."""
    if len(sets) == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        good = c[0] != c[1] and n >= similarity * (len(sets[0]) + len(sets[1]) - n) - 1e-9
        return np.array([[c[0], c[1]]] if good else np.zeros((0, 2)), np.int64)
    _, first, of = np.unique(c, return_index=True, return_inverse=True)
    labels = first[of]
    start = labels.copy()
    size = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    ends = np.cumsum(size)
    begins = ends - size
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    todo = np.ones(len(c), bool)
    turn = 0
    while True:
        counts = np.bincount(labels, minlength=len(c))
        major = counts.argmax()
        left = np.flatnonzero(todo & (labels != major))
        if not len(left):  # a pair of different components has one row outside the largest, and all of those are done
            break
        # at first some of any component, which soon joins most; then those outside the largest
        some = np.flatnonzero(todo) if turn < 8 else left
        i = some[size[some].argsort(kind="stable")[len(some) // 2]] if turn % 2 else some[len(some) * (turn + 1) // 9 % len(some)]
        turn += 1
        todo[i] = False
        j = np.flatnonzero((labels != labels[i]) & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]) - 1e-9))
        if not len(j) or not size[i]:
            continue
        mark[flat[begins[i] : ends[i]]] = True
        if 2 * size[j].sum() > len(flat):
            both = np.concatenate([[0], np.cumsum(mark[flat])])
            both = both[ends[j]] - both[begins[j]]
        else:
            at = np.concatenate([flat[begins[k] : ends[k]] for k in j])
            both = np.add.reduceat(mark[at], np.concatenate([[0], np.cumsum(size[j])[:-1]]), dtype=np.int64)
        mark[flat[begins[i] : ends[i]]] = False
        good = j[both >= similarity * (size[i] + size[j] - both) - 1e-9]
        labels = hook(labels, np.full(len(good), i), good)
    heads = np.unique(start)
    heads = heads[labels[heads] != heads]
    return np.stack([c[labels[heads]], c[heads]], axis=1).astype(np.int64)


def _sets(source: DataFrame, rows: DataFrame, members: DataFrame) -> DataFrame:
    """(id, shingles) of the nodes in ``members``: their sets, made anew from one text of each."""
    own = rows.select("id", "th").join(_few(members.select("id")), "id", "left_semi")
    heads = cut(own.groupBy("id").agg(F.min("th").alias("th")), "heads")
    texts = source.join(_few(heads.select(F.col("id").alias("want"), "th")), "th").select("want", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        for batch in batches:
            ids, sets = [], []
            for want, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if want in seen:
                    continue
                s = shingle_set(text, hashes)
                if node_id(s) == want % (1 << 64):  # else a text of the same hash
                    seen.add(want)
                    ids.append(want)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "shingles"])

    made = texts.mapInArrow(released(make), "id long, shingles binary")
    return made.groupBy("id").agg(F.first("shingles").alias("shingles"))  # of equal sets any will do


def _verified(edges: DataFrame, nodes: DataFrame, rows: DataFrame, source: DataFrame, whole: bool, similarity: float) -> DataFrame:
    """Pairs (a, b) of components of ``nodes`` that connect those with ``similarity``, of the families that ``edges`` make of components."""
    families = components(edges)
    members = cut(nodes.join(_few(families.select(F.col("id").alias("c"), F.col("c").alias("fam"))), "c").select("id", "c", "fam", "n"), "members")
    by_c = members.groupBy("fam", "c").agg(F.sum(8 * F.col("n") + NODE_BYTES).alias("size"))
    large = cut(by_c.groupBy("fam").agg(F.sum("size").alias("n_all"), F.max(F.struct("size", "c")).alias("top")).where(F.col("n_all") > TASK_BYTES), "large-families")
    sets = _sets(source, rows, members)
    code: Column = F.lit(0)
    placed = members
    if not large.isEmpty():
        size = lambda x: F.greatest(F.lit(1), F.ceil(x / TASK_BYTES)).cast("int")
        big = F.col("top.size") > TASK_BYTES // 2
        parts = large.select(F.col("fam").alias("f"), F.when(big, F.col("top.c")).alias("major"), F.when(big, size(F.col("top.size"))).otherwise(0).alias("b1"), size(F.col("n_all") - F.when(big, F.col("top.size")).otherwise(0)).alias("b2"), size(F.col("n_all")).alias("b"))
        placed = members.join(_few(parts), F.col("fam") == F.col("f"), "left")
        if whole:
            major = F.coalesce(F.col("c") == F.col("major"), F.lit(False))
            mine = F.pmod(F.xxhash64("id"), F.when(major, F.col("b1")).otherwise(F.col("b2"))).cast("int")
            each = F.when(F.col("b2").isNull(), F.array(F.lit(0))).otherwise(_blocks(major, mine, F.col("b1"), F.col("b2")))
        else:  # one block a node, and the hubs in all: what they leave apart, the next level compares
            hubs = members.join(_few(large.select("fam")), "fam", "left_semi").groupBy(F.col("fam").alias("hub_fam"))
            hubs = hubs.agg(F.array(*[F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id"))["id"] for k in range(HUBS)]).alias("hubs"))
            placed = placed.join(_few(hubs), F.col("fam") == F.col("hub_fam"), "left")
            each = F.when(F.col("b").isNull(), F.array(F.lit(0))).when(F.array_contains("hubs", F.col("id")), F.sequence(F.lit(0), F.col("b") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("b")).cast("int")))
        placed = placed.withColumn("code", F.explode(each))
        code = F.col("code")
    placed = placed.select("id", "fam", code.cast("long").alias("code"), "c")

    def verify(cols: list[np.ndarray], end: int) -> pa.RecordBatch:
        x, y, c, raw = (k[:end] for k in cols)
        cuts = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]), [True]]))
        found = [np.zeros((0, 2), np.int64)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1 and (c[a:b] != c[a]).any():
                found.append(linked(c[a:b], [np.frombuffer(r, np.uint64) for r in raw[a:b]], similarity))
        pairs = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])

    dealt = placed.join(sets, "id").select("fam", "code", "c", "shingles").repartition("fam", "code").sortWithinPartitions("fam", "code")
    return cut(dealt.mapInArrow(_grouped(4, 2048, verify), "a long, b long").distinct(), "links")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        ids, fs, sizes = [], [], []
        for text in batch.column(2).to_pylist():
            s = shingle_set(text, hashes)
            ids.append(node_id(s))
            fs.append(simhash(s))
            sizes.append(len(s))
        f = np.packbits(np.array(fs, bool).reshape(-1, BITS), axis=1).view(np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(np.ascontiguousarray(f[:, 0])), pa.array(np.ascontiguousarray(f[:, 1])), pa.array(sizes, pa.int64())],
            names=["doc_id", "th", "id", "f0", "f1", "n"],
        )


def classes(docs: DataFrame, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """One row per input row: doc_id, th (a hash of the text), class_id (the least doc_id of its class), n_class (rows of the class), kept.

    ``kept`` marks one row of each class, the one of the least (doc_id, th); where that row is repeated,
    all its repeats are marked.  Null, empty and blank texts have no shingles and are copies of each
    other.  Null ids are members like others; a class without any id has a class_id that is no doc_id.
    An empty table gives an empty result; further columns are not read.
    """
    worker_path(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    rows = cut(source.mapInArrow(released(_fingerprints), "doc_id long, th long, id long, f0 long, f1 long, n long"), "fingerprints")
    nodes = cut(rows.groupBy("id").agg(*[F.first(c).alias(c) for c in ("f0", "f1", "n")]).withColumn("c", F.col("id")), "nodes")
    climb = levels(nodes.count(), similarity, RECALL, crowd)
    for level, (depth, tries) in enumerate(climb):
        whole = level + 1 == len(climb)
        edges = _candidates(nodes, tries, depth, whole, similarity)
        if not edges.isEmpty():
            links = _verified(edges, nodes, rows, source.select("th", "text"), whole, similarity)
            merged = components(links).withColumnRenamed("c", "to").withColumnRenamed("id", "c")
            moved = cut(nodes.join(_few(merged), "c", "left").select("id", "f0", "f1", "n", F.coalesce("to", "c").alias("c")), "nodes")
            discard(nodes, links)
            nodes = moved
        discard(edges)
    found = nodes.where("c <> id").select("id", "c").union(nodes.where("c <> id").select(F.col("c").alias("id"), "c").distinct())
    of_row = rows.select("doc_id", "th", "id").join(_few(cut(found, "found")), "id", "left").select("doc_id", "th", F.coalesce("c", "id").alias("c"))
    of_row = cut(of_row, "row-classes")
    heads = of_row.groupBy("c").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))).alias("head"), F.min("th").alias("least_th"), F.count("*").alias("n_class")).where("n_class > 1")
    heads = cut(heads, "heads")
    whole = of_row.join(heads, "c", "left")
    least = F.coalesce("least_th", "th")
    return whole.select(
        "doc_id", "th",
        F.when(F.col("n_class").isNull(), F.coalesce("doc_id", "c")).otherwise(F.coalesce("head.doc_id", "c")).alias("class_id"),
        F.coalesce("n_class", F.lit(1)).alias("n_class"),
        F.when(F.col("n_class").isNull(), True).when(F.col("head").isNull(), F.col("th") == least).otherwise(F.coalesce((F.col("doc_id") == F.col("head.doc_id")) & (F.col("th") == F.col("head.th")), F.lit(False))).alias("kept"),
    )


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each class of near-duplicates; of repeats that differ in other columns, the first by these."""
    found = cut(classes(docs, similarity), "classes")
    drop = cut(found.where("NOT kept").select(F.col("doc_id").alias("drop_id"), F.col("th").alias("drop_th")).distinct(), "dropped")
    th = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    is_in = lambda i, h: docs["doc_id"].cast("long").eqNullSafe(F.col(i)) & (th == F.col(h))
    few = lambda d: F.broadcast(d) if d.count() <= SENT_ROWS else d
    left = docs.join(few(drop), is_in("drop_id", "drop_th"), "left_anti")
    again = cut(found.where("kept").groupBy(F.col("doc_id").alias("again_id"), F.col("th").alias("again_th")).count().where("count > 1"), "repeated")
    if again.isEmpty():
        return left
    sent = few(again)
    single = left.join(sent, is_in("again_id", "again_th"), "left_anti")
    whole = F.struct(*[F.col(c) for c in docs.columns])
    first = left.join(sent, is_in("again_id", "again_th"), "left_semi").groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return single.unionByName(first.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).drop("th")
