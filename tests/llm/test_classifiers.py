import zlib

import numpy as np
import pytest

from folioweave.llm import quality_gam as gam
from folioweave.llm import toxicity as tox

EDGE = [(None, "x"), (7, None), (8, ""), (9, "word " * 40_000), (9, "word " * 40_000), (10, "%%% !!!")]


def label_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("run", "target", "mod", "held", "cut"), [(gam.quality_scores, "quality", 4, 2, 0.7), (tox.toxicity, "toxic", 5, 0, 0.5)])
def test_held_out(spark, run, target, mod, held, cut):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in run(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r[target] for r in labels.collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % mod == held)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= cut)
    held_out = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held_out]) >= 0.95


@pytest.mark.parametrize("run", [gam.quality_scores, tox.toxicity])
def test_edges(spark, docs_of, run):
    docs = docs_of(EDGE)
    for labels in ([], [(7, None, None), (None, 1, 1)], [(8, 1, 1), (8, 0, 0), (9, 1, 1)]):
        got = run(docs, label_table(spark, labels)).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert run(docs_of([]), label_table(spark, [(1, 1, 1)])).collect() == []


def test_folding():
    assert tox.fold("1D10T ԁо") == " idiot do "
    assert tox.fold("Crétin, l0ser! $cum??") == " cretin loser scum "
    assert tox.fold("") == "  "


def test_exceptions_and_places():
    m = tox.Matcher({" trash ": 2.0, " tras": 1.5, " loser ": 3.0})
    assert m.hits(tox.fold("a trash can here")) == {}
    assert m.hits(tox.fold("the trash loser trashy")) == {4: 2.0, 10: 3.0, 16: 1.5}


def test_lookup_tables_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert np.mean((gam.predict(model, x) > 0.5) == y) > 0.9
    assert len(model["pairs"]) == 3


def test_labels_that_disagree(spark, docs_of):
    """Equal texts are one example, with the label of most; ids with several labels have the greater."""
    from folioweave.llm.labelled import training_sample

    docs = docs_of([(k, "same") for k in range(1, 7)] + [(20, "other"), (21, "tie"), (22, "tie"), (23, None)])
    labels = label_table(spark, [(k, int(k > 4), 0) for k in range(1, 7)] + [(20, 0, 0), (20, 1, 0), (21, 0, 0), (22, 1, 0), (23, 1, 0)])
    got = {r.text: (r.doc_id, r.y) for r in training_sample(docs, labels, "quality", 10_000, 9_999, 100).collect()}
    assert got == {"same": (1, 0), "other": (20, 1), "tie": (21, 1), "": (23, 1)}
