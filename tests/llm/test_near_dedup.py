import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave.llm import near_dedup as nd
from folioweave.llm.components import components


def shingles(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, least=0.8):
    """Partition of row numbers into connected components of exact similarity."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by, inverted = {}, defaultdict(set)
    for k, s in enumerate(sets):
        if s in by:
            parent[root(k)] = root(by[s])
        else:
            by[s] = k
            for x in s:
                inverted[x].add(k)
    for s, k in by.items():
        near = defaultdict(int)
        for x in s:
            for j in inverted[x]:
                if j < k:
                    near[j] += 1
        for j, n in near.items():
            if n >= least * (len(s) + len(sets[j]) - n) - 1e-12:
                parent[root(k)] = root(j)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(rows[k][0])
    return sorted(sorted(g, key=str) for g in groups.values())


def found(df):
    groups = defaultdict(list)
    for r in df.collect():
        groups[r.class_id].append(r.doc_id)
    return sorted(sorted(g, key=str) for g in groups.values())


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def edited(rng, t, k):
    w = t.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = text(rng, 1)
    return " ".join(w)


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    compare(brute(rows), found(nd.classes(docs)))


def compare(want, got):
    """No class joins two components, and hardly a link is missed."""
    of = {i: k for k, g in enumerate(got) for i in g}
    assert all(len({j for j, w in enumerate(want) if set(w) & set(g)}) == 1 for g in got if len(g) > 1)
    missed = sum(len({of[i] for i in w}) - 1 for w in want)
    assert missed <= 0.01 * sum(len(w) - 1 for w in want)


@pytest.mark.parametrize("crowd", [False, True])
def test_large_groups(spark, docs_of, monkeypatch, crowd):
    if crowd:
        monkeypatch.setattr(nd, "TASK_NODES", 64)
    rng = random.Random(5)
    base = text(rng, 150)
    rows = [(k, edited(rng, base, rng.randint(1, 3))) for k in range(900)] + [(900 + k, base) for k in range(200)]
    rows += [(1100 + k, text(rng, 120)) for k in range(300)]
    rows += [(1400 + k, edited(rng, rows[1100 + k][1], 2)) for k in range(100)]
    want, got = brute(rows), found(nd.classes(docs_of(rows)))
    compare(want, got)
    left = nd.one_of_each(docs_of(rows))
    assert left.count() == len(got) and left.columns == docs_of([]).columns


def test_edges(docs_of):
    long = "one two three four five six seven eight nine ten " * 3000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, long), (8, long + "x"), (7, long), (None, "q r s t u v"), (None, "q r s t u v"), (9, "x " * 9)]
    got = nd.classes(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.class_id for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == 4 and by[6] == 6 and by[7] == by[8] == 7
    left = nd.one_of_each(docs_of(rows))
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 4, 6, 7, 9, None]
    twice = docs_of([(1, "a b c d e f"), (1, "a b c d e f"), (2, "x")]).withColumn("score", F.concat("score", F.monotonically_increasing_id() % 2))
    assert nd.one_of_each(twice).count() == 2 and nd.one_of_each(twice).columns == twice.columns
    assert nd.classes(docs_of([])).collect() == [] and nd.one_of_each(docs_of([])).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100)] + [(k, 500) for k in range(300, 400)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(80)] + [(7, 7)]
    got = defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r.c].add(r.id)
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = defaultdict(set)
    for x in list(parent):
        want[root(x)].add(x)
    assert {min(v): v for v in want.values()} == dict(got)


def test_plan():
    d1, t1 = nd.plan(10_000)
    d2, t2 = nd.plan(1_000_000)
    assert d2 > d1 and t2 > t1


def joined(pairs, n):
    """Least member of each one's component."""
    label = np.arange(n)
    for a, b in list(pairs) * 1:
        x, y = label[a], label[b]
        label[label == max(x, y)] = min(x, y)
    return label.tolist()


def test_bucket_links():
    """What leaves a bucket connects exactly the components that pairs within the radius and the size bound connect."""
    rng = np.random.default_rng(3)
    for size, groups in ((40, 5), (700, 2), (1, 30)):
        heads = rng.random((size // 4 + 1, nd.BITS)) < 0.5
        rows = heads[rng.integers(0, len(heads), size * groups)] ^ (rng.random((size * groups, nd.BITS)) < 0.13)
        f = np.packbits(rows, axis=1).view(np.int64)
        f0, f1 = f[:, 0].copy(), f[:, 1].copy()
        group = np.repeat(np.arange(groups), size)
        n = rng.integers(80, 120, size * groups)
        n = n[np.lexsort((n, group))]
        c = rng.integers(0, size * groups, size * groups)
        got = nd.bucket_links(c, f0, f1, n, group, 0.8)
        assert len(got) < len(set(c.tolist()))
        near = [(c[i], c[j]) for i in range(len(c)) for j in range(i + 1, len(c)) if group[i] == group[j] and n[i] >= 0.8 * n[j] and (rows[i] != rows[j]).sum() <= nd.RADIUS]
        assert joined(got, size * groups) == joined(near, size * groups)


def test_linked():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    for _ in range(20):
        sets = []
        for _ in range(rng.integers(2, 60)):
            keep = base[rng.random(60) < rng.uniform(0.7, 1)]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 12), dtype=np.uint64)])))
        sets.append(np.zeros(0, np.uint64))
        c = rng.integers(0, len(sets), len(sets))
        exact = lambda x, y: (b := len(np.intersect1d(x, y))) >= 0.8 * (len(x) + len(y) - b) - 1e-9
        want = [(c[i], c[j]) for i in range(len(sets)) for j in range(i) if len(sets[i]) and len(sets[j]) and exact(sets[i], sets[j])]
        assert joined(nd.linked(c, sets, 0.8), len(sets)) == joined(want, len(sets))


def test_blocks_meet(spark):
    """Every two rows of which one is outside the largest component share a block pair."""
    rows = [(k, k < 30) for k in range(50)]
    df = spark.createDataFrame(rows, "id int, major boolean")
    mine = F.pmod("id", F.when(F.col("major"), F.lit(3)).otherwise(F.lit(2)))
    for b1 in (3, 0):
        some = df if b1 else df.withColumn("major", F.lit(False))
        got = {r.id: set(r.each) for r in some.select("id", nd._blocks(F.col("major"), F.pmod("id", F.lit(2)) if not b1 else mine, F.lit(b1), F.lit(2)).alias("each")).collect()}
        for x, m in rows:
            for y, k in rows:
                assert got[x] & got[y] or (b1 and m and k and x % 3 != y % 3)


@pytest.mark.parametrize("low", [0.80, 0.85, 0.92])
def test_recall_by_band(docs_of, low):
    """Pairs of a band of similarity and little above it, through several tries."""
    rng = random.Random(int(low * 100))
    rows, want = [], 0
    while want < 150:
        base = text(rng, 140)
        other = edited(rng, base, max(1, round(140 * (1 - low) / 10)))
        a, b = shingles(base), shingles(other)
        if low <= len(a & b) / len(a | b) < low + 0.06:
            rows += [(2 * want, base), (2 * want + 1, other)]
            want += 1
    got = found(nd.classes(docs_of(rows), crowd=8))
    assert nd.plan(300, crowd=8)[0] > 4
    assert sum(len(g) == 2 for g in got) >= 0.98 * want


@pytest.mark.parametrize("members", [3, 40, 1200])
def test_recall_by_family(docs_of, monkeypatch, members):
    """Families whose members are mostly less alike than the threshold, in blocks far smaller than a family."""
    monkeypatch.setattr(nd, "TASK_NODES", 256)
    monkeypatch.setattr(nd, "TASK_BYTES", 400_000)
    rng = random.Random(members)
    rows = []
    for f in range(max(1, 300 // members)):
        base = text(rng, 120)
        rows += [(f * members + k, edited(rng, base, rng.randint(0, 6))) for k in range(members)]
    rows += [(10_000 + k, text(rng, 120)) for k in range(200)]
    want, got = brute(rows), found(nd.classes(docs_of(rows), crowd=32))
    compare(want, got)


def test_levels():
    climb = nd.levels(1_000_000)
    assert [d for d, _ in climb] == sorted((d for d, _ in climb), reverse=True) and climb[-1] == nd.plan(1_000_000)
    assert nd.levels(100) == [(0, 1)]
