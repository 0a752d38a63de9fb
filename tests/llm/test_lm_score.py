import random
from collections import Counter

import numpy as np
import pytest

from folioweave.llm import lm_score as lm


def brute(net, tokens):
    """Every token by full softmaxes, one at a time."""
    total = 0.0
    for i, t in enumerate(tokens):
        near = [tokens[j] if 0 <= j < len(tokens) else lm.PAD for j in (i - 2, i - 1, i + 1, i + 2)]
        h = np.tanh(sum(net["places"][k][x] for k, x in enumerate(near)) + net["bias"])
        a = h @ net["to_class"] + net["class_bias"]
        b = h @ net["to_word"][t // lm.PER_CLASS] + net["word_bias"][t // lm.PER_CLASS]
        total += a[t // lm.PER_CLASS] - np.log(np.exp(a).sum()) + b[t % lm.PER_CLASS] - np.log(np.exp(b).sum())
    return total


def test_scores_are_sums_of_conditionals(monkeypatch):
    net = lm.start()
    net["class_bias"] += np.linspace(-1, 1, lm.CLASSES, dtype=np.float32)
    texts = [np.array(t, np.int16) for t in ([5, 1023, 7, 7, 300], [], [9], [3] * 40)]
    monkeypatch.setattr(lm, "CHUNK", 7)
    got = sum(lm.score_windows(net, w).sum() for w in lm.windows(texts))
    assert got == pytest.approx(sum(brute(net, t) for t in texts), rel=1e-4)
    assert lm.from_bytes(lm.to_bytes(net))["to_word"].shape == lm.SHAPES["to_word"]
    net["to_class"] *= 1e4  # logits far beyond what exp can take
    assert np.isfinite(lm.score_windows(net, next(lm.windows([np.arange(6)])))).all()


def test_step_goes_down_the_gradient():
    """Training lowers the loss on what it saw, by much."""
    rng = np.random.default_rng(0)
    w = next(lm.windows([np.tile(rng.integers(0, lm.TOKENS, 9), 3000)]))
    net = lm.start()
    before = lm.score_windows(net, w).mean()
    trainer = lm.Trainer(net)
    for _ in range(3):
        trainer(w)
    assert lm.score_windows(net, w).mean() > before + 2


def test_words_of_a_token_share_it():
    """Probabilities of a token's words, and of one that isn't known, add up to 1."""
    words = [f"f{k}" for k in range(lm.FREQUENT)] + ["xing", "ying"]
    counts = np.array([9.0] * lm.FREQUENT + [5, 3])
    e = lm.ending("xing")
    v = lm.Vocabulary(words, counts, {e: (12, 5)})
    n = lm.Numbers(v)
    assert v.token[n["xing"]] == v.token[n["zing"]] and v.log_share[n["f3"]] == 0 and n["zing"] == n["qing"]
    rest = 5 - 2 + 1  # unlisted words and the unknown one
    assert np.exp(v.log_share[n["xing"]]) + np.exp(v.log_share[n["ying"]]) + rest * np.exp(v.log_share[n["zing"]]) == pytest.approx(1)


def test_layout_does_not_matter(spark, monkeypatch):
    monkeypatch.setattr(lm, "REPLICA_WORDS", 4000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 3000")
    one, many = ({r.doc_id: r.mean_logprob or 0.0 for r in lm.lm_scores(docs.repartition(n)).collect()} for n in (1, 8))
    assert one.keys() == many.keys() and max(abs(one[k] - many[k]) for k in one) < 1e-5


def test_learns_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [r for r in docs.collect() if len(r.text.split()) > 100][:150]
    rng = random.Random(0)
    mixed = [(10**6 + r.doc_id, " ".join(rng.choice(rows).text.split()[k % 90] if k % 2 else "zq%d" % rng.randrange(9999) for k in range(100))) for r in rows]
    both = docs.union(spark.createDataFrame(mixed, docs.schema))
    got = {r.doc_id: r.mean_logprob for r in lm.lm_scores(both).collect()}
    assert np.mean([got[r.doc_id] for r in rows]) > np.mean([got[i] for i, _ in mixed])


def test_beats_word_counts(spark):
    """Words given their neighbours are likelier than by their frequency alone, which the corpus itself gives."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    counts = Counter(w for r in docs.collect() for w in (r.text or "").lower().split())
    n = sum(counts.values())
    found = lm.lm_scores(docs).agg({"log_likelihood": "sum", "n_tokens": "sum"}).first()
    assert found["sum(n_tokens)"] == n and found["sum(log_likelihood)"] > sum(k * np.log(k / n) for k in counts.values())


def test_edges(docs_of):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "w " * 50_000)]
    got = lm.lm_scores(docs_of(rows)).collect()
    assert len(got) == 6
    for r in got:
        assert (r.n_tokens == 0) == (r.mean_logprob is None) and r.log_likelihood <= 0
    assert lm.lm_scores(docs_of([])).collect() == []
