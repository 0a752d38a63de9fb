"""Vector operators: exact nearest neighbours, similarity edges, intrinsic dimension and truncation quality."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Vectors of a block: two blocks, some of their products and the best of one are what a task holds.
BLOCK = 8192
#: Tasks that share the blocks to compare with; each hands over the k best of a vector.
STREAMS = 4


def dot(a: Column, b: Column) -> Column:
    """Dot product in double; with unit vectors, the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unit(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return bound(vector, lambda v: bound(length(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))


def hashed_embedding(tokens: Column, dims: int = 64) -> Column:
    """A stand-in for a model: each token adds 1 or -1 at the place that its hash names; then length 1."""
    places = F.transform(tokens, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dims)).cast("int").alias("at"), F.when(F.pmod(F.hash(t), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("by")))
    sums = lambda p: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.aggregate(F.filter(p, lambda x: x["at"] == k), F.lit(0.0), lambda a, x: a + x["by"]))
    return unit(bound(places, sums))


def nearest(vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
    """(id, distance, rank) of the k nearest by cosine; ``where`` filters before the ranking."""
    if isinstance(k, bool) or not 1 <= k <= 100:
        raise ValueError("k goes from 1 to 100")
    rows = vectors if where is None else vectors.where(where)
    # a sum of products with constants, which is compiled with the scan
    same = F.lit(0.0)
    for place, x in enumerate(query):
        same = same + F.get("vector", F.lit(place)).cast("double") * F.lit(float(x))
    top = rows.select("id", F.round(1 - same, 6).alias("distance")).orderBy("distance", "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))


def neighbours_in_blocks(vectors: DataFrame, k: int = 0, threshold: float | None = None, dim: int = 0) -> DataFrame:
    """(a, b, similarity, r): of each vector a, those at ``threshold`` or above, the ``k`` most similar if k, in the order r; ties go by b.

    With ``dim``, of the vectors cut to it and made of length 1.  Exact, so quadratic by nature in time, but not in what is
    moved: vectors are written once in blocks of BLOCK, in the order of ids, and read again by every task that has a block
    to compare; a task keeps the k best so far of its block and hands over no more.  Products are taken in single
    precision, and those that may be among the k once more in double.
    """
    kind = dict(vectors.select("id").dtypes)["id"]
    cells = dict(vectors.select("vector").dtypes)["vector"]
    rows = vectors.select("id", "vector").where("vector IS NOT NULL")
    total, longest = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    most = max(1, min(BLOCK, 64 * BLOCK // max(1, longest or 1)))
    ordered = rows.repartitionByRange(1 + total // (4 * most), "id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(part: pa.Table) -> pa.RecordBatch:
            ids, rows, at = (c.combine_chunks() for c in part.columns)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, rows.flatten())]
            return pa.RecordBatch.from_arrays([at[:1], *lists], ["at", "ids", "cells"])

        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows >= most:
                yield row(held.slice(0, most))
                held = held.slice(most)
        if held is not None and held.num_rows:
            yield row(held)

    blocks = written(ordered.mapInArrow(pack, f"at bigint, ids array<{kind}>, cells {cells}"), "vectors")
    n = blocks.count()
    here = blocks.repartitionByRange(max(1, n), "at")
    there = blocks.repartitionByRange(max(1, min(n, STREAMS)), "at").sortWithinPartitions("at").select(*[F.col(c).alias(f"other_{c}") for c in blocks.columns])
    pairs = here.hint("shuffle_replicate_nl").crossJoin(there)
    compare = _comparer(k, threshold, dim)
    found = pairs.mapInArrow(compare, f"a {kind}, b {kind}, similarity double")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b")))
    return found.where(F.col("r") <= k) if k else found


def _comparer(k: int, threshold: float | None, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of blocks to (a, b, similarity): all at ``threshold``, or the k best of every row of a block over its run of pairs."""
    dense, few, at_once = 0.02, 1 << 17, 1 << 21

    def block(ids: pa.ListScalar, cells: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = ids.values.to_numpy(zero_copy_only=False)
        full = cells.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        if dim:
            full = full[:, :dim]
            full = full / np.sqrt(np.einsum("ij,ij->i", full, full))[:, None]
        return ids, full, full.astype(np.float32)

    def longest(full: np.ndarray) -> float:
        return float(np.sqrt(np.nanmax(np.einsum("ij,ij->i", full, full), initial=1.0)))

    def same(ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of equal ids in two ordered lists."""
        lo, hi = np.searchsorted(others, ids, "left"), np.searchsorted(others, ids, "right")
        i = np.repeat(np.arange(len(ids)), hi - lo)
        return i, np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)

    def exact(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        parts = [np.einsum("ij,ij->i", left[i[x : x + few]], right[j[x : x + few]]) for x in range(0, len(i), few)]
        return np.round(np.concatenate(parts), 6) if parts else np.zeros(0)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, kinds = None, None

        def table(a, b, s):
            return pa.RecordBatch.from_arrays([pa.array(a, kinds), pa.array(b, kinds), pa.array(s, pa.float64())], ["a", "b", "similarity"])

        def best():
            i, j = np.nonzero(mine["s"] > -np.inf)
            return table(mine["ids"][i], mine["b"][i, j], mine["s"][i, j])

        for batch in batches:
            kinds = batch.schema.field("ids").type.value_type
            for row in range(batch.num_rows):
                at, ids, cells, _, other_ids, other_cells = (c[row] for c in batch.columns)
                if mine is None or mine["at"] != at.as_py():
                    if mine is not None and k:
                        yield best()
                    ids, full, half = block(ids, cells)
                    mine = {"at": at.as_py(), "ids": ids, "full": full, "half": half, "long": longest(full), "s": np.full((len(ids), k), -np.inf), "b": np.empty((len(ids), k), ids.dtype)}
                others, full, half = block(other_ids, other_cells)
                # how far a product in single precision may be off, and a rounded one from its value
                slack = (full.shape[1] + 4) * 2.0**-24 * mine["long"] * longest(full) + 1e-6
                unknown = np.isnan(half).any() or np.isnan(mine["half"]).any()
                self_i, self_j = same(mine["ids"], others)
                step = max(1, at_once // max(1, len(others)))
                for x in range(0, len(mine["ids"]), step):
                    rows = slice(x, x + step)
                    sims = mine["half"][rows] @ half.T
                    own = (self_i >= x) & (self_i < x + step)
                    out = self_i[own] - x, self_j[own]
                    sims[out] = -np.inf
                    if unknown:
                        sims[np.isnan(sims)] = -np.inf
                    least = np.full(len(sims), -np.inf if threshold is None else threshold)
                    kth = mine["s"][rows][:, -1] if k else least
                    floor = np.maximum(least, kth)
                    fresh = np.nonzero(np.isneginf(kth))[0]
                    if k and len(fresh) and sims.shape[1] > k:
                        floor[fresh] = np.maximum(floor[fresh], np.partition(sims[fresh], -k, axis=1)[:, -k] - slack)
                    may = sims >= np.maximum(floor - slack, -1e30).astype(np.float32)[:, None]
                    flat = np.flatnonzero(may)
                    if len(flat) > dense * may.size:  # very many alike: one product for all
                        values = np.where(may, np.round(mine["full"][rows] @ full.T, 6), -np.inf)
                        if k and values.shape[1] > k:
                            top = np.partition(values, -k, axis=1)[:, -k, None]
                            over, level = values > top, (values == top) & may
                            may = over | (level & (np.cumsum(level, axis=1) <= k - np.count_nonzero(over, axis=1)[:, None]))
                        i, j = np.nonzero(may)
                        values = values[i, j]
                    else:
                        i, j = np.divmod(flat, may.shape[1])
                        values = exact(mine["full"][rows], full, i, j)
                    # blocks come in the order of ids, so that of equals what is held stays
                    ok = values >= least[i]
                    if k:
                        ok &= values > kth[i]
                    i, j, values = i[ok], j[ok], values[ok]
                    if not k:
                        yield table(mine["ids"][rows][i], others[j], values)
                        continue
                    order = np.lexsort((j, -values, i))
                    i, j, values = i[order], j[order], values[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i, "left")
                    i, j, values, place = (v[place < k] for v in (i, j, values, place))
                    came = np.full((len(sims), k), -np.inf)
                    named = np.empty((len(sims), k), others.dtype)
                    came[i, place], named[i, place] = values, others[j]
                    touched = np.unique(i)
                    s = np.concatenate([mine["s"][rows][touched], came[touched]], axis=1)
                    b = np.concatenate([mine["b"][rows][touched], named[touched]], axis=1)
                    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    mine["s"][x + touched] = np.take_along_axis(s, order, axis=1)
                    mine["b"][x + touched] = np.take_along_axis(b, order, axis=1)
        if mine is not None and k:
            yield best()

    return compare


def similar_edges(vectors: DataFrame, k: int = 5, threshold: float = 0.85, max_degree: int = 0) -> DataFrame:
    """SIMILAR_TO edges (src < dst, similarity to 4 places) to the k most similar of each; 0 means no limit."""
    near = neighbours_in_blocks(vectors, k, threshold)
    edges = near.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.round("similarity", 4).alias("similarity")).distinct()
    return capped(edges, max_degree) if max_degree else edges


def capped(edges: DataFrame, most: int) -> DataFrame:
    """Edges taken from the most similar on while both ends have fewer than ``most``; ties go by src and dst.

    Candidates are the ``most`` best edges of each node.  A round takes every edge that is so good at both of
    its ends that none before it can use up their room, and drops those with an end that is full; it always takes
    the best that is left, and most edges fall in the first few rounds.
    """
    ends = lambda df: df.select("src", "dst", "similarity", F.explode(F.array("src", "dst")).alias("end"))
    rank = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("similarity"), "src", "dst"))
    left = written(ends(edges).withColumn("r", rank).where(F.col("r") <= most).select("src", "dst", "similarity").distinct(), "capping")
    taken = None
    while not left.isEmpty():
        ranked = ends(left).withColumn("r", rank)
        if taken is not None:
            used = ends(taken).groupBy("end").agg(F.count("*").alias("used"))
            ranked = ranked.join(used, "end", "left").withColumn("r", F.col("r") + F.coalesce("used", F.lit(0))).drop("used")
        chosen = written(ranked.groupBy("src", "dst", "similarity").agg(F.max("r").alias("r")).where(F.col("r") <= most).drop("r"), "capped")
        taken = chosen if taken is None else taken.unionByName(chosen)
        full = ends(taken).groupBy("end").count().where(F.col("count") >= most).select("end")
        rest = left.join(chosen, ["src", "dst"], "left_anti")
        for end in ("src", "dst"):
            rest = rest.join(full.withColumnRenamed("end", end), end, "left_anti")
        left = written(rest.select("src", "dst", "similarity"), "capping")
    return edges.limit(0) if taken is None else taken


def two_nn(vectors: DataFrame) -> DataFrame:
    """Intrinsic dimension from the ratio of the two nearest distances; 0 of fewer than ten vectors."""
    near = neighbours_in_blocks(vectors, 2).select("a", (1 - F.col("similarity")).alias("d"), "r")
    each = near.groupBy("a").agg(F.max(F.when(F.col("r") == 1, F.col("d"))).alias("d1"), F.max(F.when(F.col("r") == 2, F.col("d"))).alias("d2")).where("d1 > 1e-10 AND d2 > d1")
    total = each.agg(F.count("*").alias("n"), F.sum(F.log(F.col("d2") / F.col("d1"))).alias("s"))
    return total.select("n", F.when(F.col("n") < 5, 0.0).otherwise(F.round(F.col("n") / F.col("s"), 4)).alias("dimension"))


def truncated_mrr(vectors: DataFrame, dims: tuple[int, ...] = (16, 32), k: int = 10) -> DataFrame:
    """(dim, mrr): of vectors cut to ``dim``, the reciprocal rank of the full vectors' nearest, within k."""
    full = neighbours_in_blocks(vectors, 1).select("a", "b")
    found = None
    for dim in dims:
        ranks = neighbours_in_blocks(vectors, k, dim=dim)
        one = full.join(ranks.select("a", "b", "r"), ["a", "b"], "left").agg(F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr")).select(F.lit(dim).alias("dim"), "mrr")
        found = one if found is None else found.unionByName(one)
    return found
