"""Operator 10, best-fit packing: hierarchical residual packing.

Each partition tokenises its rows and packs the pieces by best fit decreasing.  Bins that are
nearly full leave at once; underfull bins go up a tree, eight partitions to a node, where they
are the items of another best-fit round.  A node takes as many bins as hold NODE_PIECES pieces: once the
tree has narrowed to that, further rounds deal the underfull bins anew, until one saves next to nothing.
No underfull bin is given up before, but those that no other underfull bin fits into.  A bin is a row with
its pieces, 2048 at most, so the rounds need no join and the last step is an explode.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WordIds
from .common import cut, kept, released, table, worker_path
from .token_counts import tokenizer_path

#: Rows of a batch that are Python objects at a time.
SLICE = 256
#: Bins with this share of the capacity are nearly full and go no further up.
NEARLY_FULL = 0.995
#: Partitions that meet in a node of the tree; pieces that a partition packs at once, and those of a node; saving of a round, of the bins it took, under which the rounds end.
FAN_IN, BLOCK, NODE_PIECES, SAVING = 8, 200_000, 100_000, 0.001

PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BIN = pa.schema([("bin_id", pa.int64()), ("used", pa.int64()), ("pieces", pa.list_(PIECE))])
BIN_SQL = "bin_id long, used long, pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit over sizes that come in falling order: lists of their positions, one for each bin."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin has room r
    for k, n in enumerate(sizes):
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(k)
        else:
            room, at = capacity, len(bins)
            bins.append([k])
        if left := room - n:
            by_room[left].append(at)
            rooms |= 1 << left
    return bins


def pieces_of(doc_id: int | None, ids: bytes, capacity: int) -> list[tuple]:
    """(doc_id, piece, start, length, crc32) of a document's ids, given as little-endian 32-bit bytes."""
    n, view = len(ids) // 4, memoryview(ids)
    return [(doc_id, k, s, min(capacity, n - s), zlib.crc32(view[4 * s : 4 * min(n, s + capacity)])) for k, s in enumerate(range(0, n, capacity))]


def _order(held: tuple[int, list[tuple]]) -> tuple:
    """Falling size, then the first piece: the same set of items is always packed alike."""
    used, pieces = held
    first = pieces[0]
    return (-used, first[0] is None, first[0] or 0, first[1], first[4])


def _packed(items: list[tuple[int, list[tuple]]], capacity: int) -> list[tuple[int, list[tuple]]]:
    """Bins as (used, pieces); the offsets of all pieces are written anew."""
    items.sort(key=_order)
    bins = []
    for at in best_fit([u for u, _ in items], capacity):
        used, pieces = 0, []
        for k in at:
            for p in items[k][1]:
                pieces.append((*p[:5], used))
                used += p[3]
        bins.append((used, pieces))
    return bins


def _rows(bins: list[tuple[int, list[tuple]]], level: int, part: int, seq: int) -> tuple[pa.RecordBatch, int]:
    """Bins as rows, numbered by level, partition and place."""
    ids = [(level << 54) + (part << 34) + seq + k for k in range(len(bins))]
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "offset")
    batch = pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([u for u, _ in bins], pa.int64()), pa.array([[dict(zip(names, p, strict=True)) for p in ps] for _, ps in bins], pa.list_(PIECE))],
        schema=BIN,
    )
    return batch, seq + len(bins)


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then ``end_id``; null and empty texts are that id alone.  Documents
    longer than ``capacity`` are cut into pieces of that length, the last one shorter.  Repeated
    rows are packed each, null ids stay null, an empty table gives an empty result, and other
    columns are not read.
    """
    spark = docs.sparkSession
    worker_path(spark)
    path = path or tokenizer_path("word_bpe_49k.json")
    limit = int(capacity * NEARLY_FULL)
    end = int(end_id).to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq, items = kept(f"words {path}", lambda: WordIds(path)), TaskContext.get().partitionId(), 0, []
        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                items += [(p[3], [p]) for p in pieces_of(doc_id, coder.encode(text or "") + end, capacity)]
                if len(items) >= BLOCK:
                    rows, seq = _rows(_packed(items, capacity), 0, part, seq)
                    items = []
                    yield rows
        if items:
            yield _rows(_packed(items, capacity), 0, part, seq)[0]

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bins = cut(source.mapInArrow(released(first), BIN_SQL), "packed-0")
    done = bins.where(F.col("used") >= limit)
    level, nodes = 0, (bins.agg(F.max(F.shiftright("bin_id", 34))).first()[0] or 0) + 1
    while True:
        short = bins.where(F.col("used") < limit)
        least = short.agg(F.min("used")).first()[0]
        if least is None:
            break
        # a bin without room for the emptiest takes none, and fits into none
        open_ = short.where(capacity - F.col("used") >= least)
        done = done.unionByName(short.where(capacity - F.col("used") < least))
        count, pieces = open_.agg(F.count("*"), F.coalesce(F.sum(F.size("pieces")), F.lit(0))).first()
        if not count:
            break
        level, was, nodes = level + 1, nodes, max(-(-pieces // NODE_PIECES), -(-nodes // FAN_IN))
        dealt = open_.withColumn("node", F.pmod(F.xxhash64("bin_id", F.lit(level)), F.lit(nodes)).cast("int"))

        def merge(batches: Iterator[pa.RecordBatch], level=level) -> Iterator[pa.RecordBatch]:
            by_node: dict[int, list] = {}
            for batch in batches:
                got = batch.to_pydict()
                for used, pieces, node in zip(got["used"], got["pieces"], got["node"], strict=True):
                    by_node.setdefault(node, []).append((used, [tuple(p.values()) for p in pieces]))
            for node in sorted(by_node):
                yield _rows(_packed(by_node.pop(node), capacity), level, node, 0)[0]

        bins = cut(dealt.repartition(nodes, "node").mapInArrow(released(merge), BIN_SQL), f"packed-{level}")
        done = done.unionByName(bins.where(F.col("used") >= limit))
        if nodes == 1 or (nodes >= was and count - bins.count() <= SAVING * count):
            done = done.unionByName(bins.where(F.col("used") < limit))
            break

    each = done.select("bin_id", F.explode("pieces").alias("p"))
    return each.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", F.col("bin_id").alias("sequence_id"), "p.offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
