import math
import re

from folioweave.llm import decontaminate as dc


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute(docs, items, least=0.8):
    """Best similarity of any item-sized window, over all windows."""
    its = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            its[(i, t)] = (len(w), {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    df = {}
    for _, s in its.values():
        for x in s:
            df[x] = df.get(x, 0) + 1
    weight = lambda x: math.log1p(len(its) / df.get(x, 1))
    out = {}
    for d, t in set(docs):
        w = words(t)
        for (i, _), (n, s) in its.items():
            size = min(n, 5)
            sh = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
            if not s & set(sh):
                continue
            best = 0
            for a in range(max(1, len(w) - n + 1)):
                v = set(sh[a : a + max(1, n - 4)])
                both = sum(map(weight, v & s))
                best = max(best, both / (sum(map(weight, v | s))))
            if best >= least:
                out[(d, t, i)] = max(best, out.get((d, t, i), 0))
    return out


def compare(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "n") for r in docs], "doc_id long, text string, n int, item_id string")
    b = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, key int")
    got = sorted((str(r.doc_id), r.item_id, round(r.similarity, 4)) for r in dc.leaks(d, b).collect())
    want = brute(docs, items)
    assert got == sorted((str(k[0]), k[2], round(v, 4)) for k, v in want.items())
    bad = {(k[0], k[1]) for k in want}
    left = sorted(map(str, dc.clean(d, b).select("doc_id", "text").collect()))
    assert left == sorted(str(r) for r in spark.createDataFrame([r for r in docs if r not in bad], "doc_id long, text string").collect())


def test_edges(spark):
    a = " ".join(f"alpha{k}" for k in range(40))
    b = " ".join(f"beta{k}" for k in range(17)) + "."
    items = [(1, a), (2, b), (3, None), (4, ""), (5, "too short here"), (None, a), (6, "one two three four five"), (7, b)]
    pad = " ".join(f"x{k}" for k in range(300))
    w = a.split()
    docs = [
        (20, "this is too short here now"), (21, "too short there"), (22, f"{pad} too SHORT, here {pad} {a}"), (23, "short"), (24, f"{a} " * 900), (1, f"{pad} {a.upper()} {pad}"), (2, a), (3, pad), (4, None), (5, ""), (6, f"{pad}\n{b}\n{a}"), (7, " ".join(w[3:])), (8, " ".join(w[:20])), (9, " ".join(w[:20] + ["new"] + w[20:])),
        (10, " ".join(w[:10] + ["q"] + w[11:25] + ["q"] + w[26:])), (1, f"{pad} {a.upper()} {pad}"), (1, "another text"), (None, b), (11, "zero one two three four five six"),
    ]
    compare(spark, docs, items)


def test_between_two_alignments(spark):
    """The best window of a framed item with words put into its middle lines up with neither end of it."""
    head, tail = "in this question you are asked", "give one answer and explain it"
    items = [(k, f"{head} " + " ".join(f"w{k}x{j}" for j in range(60)) + f" {tail}") for k in range(200)] + [(900, "two words"), (901, "single")]
    w = items[7][1].split()
    pad = " ".join(f"p{k}" for k in range(60))
    docs = [(k, f"{pad} {' '.join(w[:cut] + ['put', 'in', 'between', 'these'][:n] + w[cut:])} {pad}") for k, (cut, n) in enumerate([(36, 4), (36, 2), (10, 4), (64, 4), (26, 0)])]
    docs += [(100, f"{pad} {head} {pad} {tail}"), (101, "these two words here"), (102, "two other words"), (103, "a single")]
    assert any(d == 0 for d, _, _ in brute(docs, items))
    compare(spark, docs, items)


def test_nothing(spark):
    compare(spark, [(1, "a b c d e f")], [(1, None)])
    d = spark.createDataFrame([], "doc_id long, text string")
    assert dc.leaks(d, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).collect() == []


def test_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    compare(spark, docs, items)
