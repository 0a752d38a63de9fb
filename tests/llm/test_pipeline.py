import re

import corpus_pipeline as cp
from folioweave.llm import decontaminate, near_dedup, quality_rules, secret_scan
from folioweave.llm.common import cut


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(cp.STAGES):
        out = cut(stage(spark, docs, sf), f"test-{k}")
        if k + 1 < len(cp.STAGES):
            assert out.columns == columns
            ids, before = {r.doc_id for r in out.select("doc_id").collect()}, {r.doc_id for r in docs.select("doc_id").collect()}
            assert ids <= before and out.count() == len(ids)
        if k == 0:
            verdict = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).select("doc_id", "kept").collect()}
            assert ids == {i for i, kept in verdict.items() if kept}
        if k == 1:
            classes = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
            assert len(ids) == len(set(classes.values())) and {classes[i] for i in ids} == set(classes.values())
        if k == 2:
            found = {r.doc_id for r in decontaminate.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert ids == before - found
        if k == 3:
            assert ids == before
            assert not [r for r in out.select("text").collect() if re.search(r'token = "[0-9a-f]{40}"', r.text)]
            assert secret_scan.scan(out).where("n_secrets > 0").count() == 0
        if k == 4:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
        docs = out


def test_clean_takes_lines_out(spark):
    line = "this exact line stands in very many of the pages here"
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(k, f"{line}\n{own(k)}\n{line.upper()} ", "h", "z") for k in range(150)] + [(1000 + k, line, "h", "z") for k in range(3)] + [(2000, own(2000), "h", "z"), (2001, None, "h", "z"), (2002, "a " * 30, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")
    out = {r.doc_id: r.text for r in quality_rules.clean(docs).collect()}
    assert set(out) == {*range(150), 2000}
    assert out[7] == own(7) and out[2000] == own(2000)
    assert quality_rules.clean(docs.limit(0)).collect() == []
    assert quality_rules.quality_rules(docs).count() == len(rows)


def test_many_lines_go_by_a_join(spark, monkeypatch):
    line = "this exact line stands in very many of the pages here"
    rows = [(k, f"{line}\n" + " ".join(f"w{k}x{j}" for j in range(40)), "h") for k in range(150)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, source string")
    want = sorted(map(tuple, quality_rules.quality_rules(docs).collect()))
    monkeypatch.setattr(quality_rules, "SENT_LINES", 0)
    assert sorted(map(tuple, quality_rules.quality_rules(docs).collect())) == want


def test_repeated_words(spark):
    def brute(words):
        seen, covered = {}, set()
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                covered |= {j for i in at for j in range(i, i + 8)}
        return len(covered)

    texts = ["a b c d e f g h " * 3, "x " * 40, "p q r s t u v w p q r s t u v", "one two three", "a b c d e f g h i a b c d e f g h j a b c d e f g h", ""]
    docs = spark.createDataFrame([(k, t, "h") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.base_rules(docs).collect()}
    assert got == {k: brute(t.split()) for k, t in enumerate(texts)}


def test_run(spark, tmp_path):
    """The whole pipeline over rows with nulls, an empty and a very long text, repeats, copies, a leak and a secret, and over none."""
    own = lambda k, n=60: " ".join(f"w{k}x{j}" for j in range(n))
    leak = " ".join(f"item{j}" for j in range(30))
    rows = [(1, own(1)), (1, own(1)), (2, own(1)), (3, own(1) + " more"), (4, own(4)), (5, f"{own(5)} {leak} {own(6)}"), (6, f'{own(7)} token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'), (7, None), (8, ""), (9, "short text"), (10, own(10, 30_000)), (None, own(11)), (12, "same words again and again here now " * 20)]
    docs = spark.createDataFrame([(i, t, "en", "h", len(t or ""), "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, start int")
    for name, part in (("some", docs), ("none", docs.limit(0))):
        part.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = cp.run(spark, str(tmp_path / "some")).collect()
    assert {r.doc_id for r in got} == {1, 4, 6, 10, None}
    assert len({(r.doc_id, r.piece) for r in got}) == len(got) and sum(r.length for r in got if r.doc_id == 10) > 30_000
    assert cp.run(spark, str(tmp_path / "none")).collect() == []
