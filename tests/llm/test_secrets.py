import re

import numpy as np
import pytest
import regex

from pyspark.sql import functions as F

from folioweave.llm import secret_scan as ss

KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
TEXTS = [
    None, "", "no numbers at all here but_a_very_long_identifier_indeed", f'x token = "{KEY}" y', f"{KEY}", f"é🎉 password: {KEY}\nand secret='{KEY[::-1]}' end", f"commit {KEY} fixed the build",
    "see src/main/java/com/example/service/Handler2.java now", "-" * 50 + "1" + "=" * 40, f"api_key={KEY}.{KEY}", "9" * 400, f'token = "{KEY}"### ' * 300, "a1" * 3000,
]


def candidates(t):
    named = regex.compile(f"(?:{ss.ASSIGNED}|(?i:bearer)\\s)$")
    return [m for m in regex.finditer(ss.CANDIDATE, t or "") if re.search(ss.MIXED, m[0]) or named.search(t[max(0, m.start() - ss.BEFORE) : m.start()])]


def test_scan(spark, docs_of):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[3])]
    got = ss.scan(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for k, t in enumerate(TEXTS):
        spans = candidates(t)
        assert by[k].n_candidates == len(spans)
        out, at = "", 0
        for s in by[k].secrets:
            assert (s.start, s.start + s.length) in {m.span() for m in spans} and s.score >= ss.THRESHOLD
            out += t[at : s.start] + ss.REDACTED
            at = s.start + s.length
        assert by[k].clean_text == (None if t is None else out + t[at:])
    assert [by[k].n_secrets for k in (3, 5, 6, 7, 8, 11)] == [1, 2, 0, 0, 0, 300]
    assert sum(r.n_secrets for r in got if r.doc_id == 3) == 2


def test_redact_keeps_rows(docs_of):
    docs = docs_of([(k, t) for k, t in enumerate(TEXTS)])
    out = ss.redact(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    assert not out.where(F.col("text").contains(f'token = "{KEY}"')).count()
    assert ss.scan(docs.limit(0)).collect() == []


def test_forest_on_other_findings(spark):
    rows = ss.labelled_findings(800, seed=99)
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, c string, b string, a string, y int")
    x = F.array(*ss.feature_columns(F.col("c"), F.col("b"), F.col("a")))
    forest = ss.forest_of(spark)
    df = df.withColumn("x", x).withColumn("p", ss.forest_column(forest, F.col("x")))
    got = np.array([(r.p >= ss.THRESHOLD) == r.y for r in df.collect()])
    assert got.mean() > 0.95


def test_planted_tokens(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id for r in ss.scan(docs).where("n_secrets > 0").collect()}
    want = {r.doc_id for r in docs.collect() if re.search(r'token = "[0-9a-f]{40}"', r.text or "")}
    assert found == want and want


def test_value_after_name(spark, docs_of):
    texts = [
        f"x api_key={KEY} y", f"TOKEN={KEY}", f"api_key={KEY}.{KEY}", "password=hunter2hunter2", f"a=b_2={KEY}", 'db_password = "Xk9$vQ!m2w#"', "export AWS_SECRET=qWmZpRtYxKvBnLcDfGhJ",
        'pwd: "tR4!pz8q"', "password=changeme", "api_key = your_key_here", 'token: "${API_TOKEN}"', "the key: something else", "the bearer certificate is here", f'token = "{ss.REDACTED}"',
    ]
    by = {r.doc_id: r for r in ss.scan(docs_of(list(enumerate(texts)))).collect()}
    assert [by[k].clean_text for k in (0, 1)] == [f"x api_key={ss.REDACTED} y", f"TOKEN={ss.REDACTED}"]
    assert [by[k].clean_text for k in (2, 3)] == [f"api_key={ss.REDACTED}", f"password={ss.REDACTED}"]
    assert [by[k].n_candidates for k in range(5)] == [1] * 5
    assert [by[k].n_secrets for k in (5, 6, 7)] == [1] * 3
    assert [by[k].n_secrets for k in range(8, 14)] == [0] * 6 and by[13].n_candidates == 0


def test_forest_is_its_trees(spark):
    """The column gives what a walk down each tree gives, ties at a threshold included."""
    rng = np.random.default_rng(2)
    x = np.round(rng.random((400, 6)), 1)
    forest = ss.grow_forest(x, (x[:, 0] + x[:, 3] > 1).astype(float), trees=9)

    def walk(tree, row):
        while not isinstance(tree, float):
            j, cut, left, right = tree
            tree = left if row[j] <= cut else right
        return tree

    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "k int, x array<double>")
    got = {r.k: r.p for r in df.select("k", ss.forest_column(forest, F.col("x")).alias("p")).collect()}
    for k, row in enumerate(x):
        assert got[k] == pytest.approx(np.mean([walk(t, row) for t in forest]), abs=1e-5)


def test_scores_by_hand(spark, docs_of):
    """Scores and verdicts of the operator are those of features and trees worked out one candidate at a time."""
    got = {r.doc_id: r for r in ss.scan(docs_of([(k, t) for k, t in enumerate(TEXTS[:9])])).collect()}
    forest = ss.forest_of(spark)
    for k, t in enumerate(TEXTS[:9]):
        want = []
        for m in candidates(t):
            df = spark.createDataFrame([(m[0], t[max(0, m.start() - ss.BEFORE) : m.start()], t[m.end() : m.end() + ss.AFTER])], "c string, b string, a string")
            p = df.select(ss.forest_column(forest, F.array(*ss.feature_columns(F.col("c"), F.col("b"), F.col("a"))))).first()[0]
            if round(p, 6) >= ss.THRESHOLD:
                want.append((m.start(), m.end() - m.start(), round(p, 6)))
        assert [tuple(s) for s in got[k].secrets] == want
