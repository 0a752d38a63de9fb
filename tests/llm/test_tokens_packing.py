import gc
import struct
import tracemalloc
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioweave.llm import bpe, packing
from folioweave.llm.bpe import PieceCounter, WordIds, is_safe
from folioweave.llm.packing import best_fit, pack
from folioweave.llm.token_counts import token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

HARD = [
    None, "", " ", "\n\n  \t x", "a  b\n\n c's I'LL we'll", "<|endoftext|> a <|endoftext|>b<|startoftext|>", "naïve Ünïcode ǅ İstanbul ΣΑΣ é é",
    "日本語 テスト 🎉🎉 ١٢٣ ½ ⅷ", "x\x1cy\x85z​q w　e", "%%%$$$ ###!!", "don't 'Twas '''", "A" * 5000, "ab " * 3000, "1234 56,789.00", "́a b́",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


def ids(tok, text):
    return tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=40))
def test_any_text_as_the_library(text):
    byte, word = Tokenizer.from_file(BYTE) if not hasattr(test_any_text_as_the_library, "t") else test_any_text_as_the_library.t[0], None
    if not hasattr(test_any_text_as_the_library, "t"):
        test_any_text_as_the_library.t = (byte, Tokenizer.from_file(WORD), PieceCounter(BYTE, {}), WordIds(WORD))
    byte, word, counter, coder = test_any_text_as_the_library.t
    assert counter.count(text) == len(ids(byte, text))
    want = ids(word, text)
    assert coder.encode(text) == struct.pack(f"<{len(want)}I", *want)


def test_every_safe_character_as_the_library(library):
    counter, coder = PieceCounter(BYTE, {}), WordIds(WORD)
    chars = [chr(c) for c in range(1, 0x3000) if is_safe(chr(c))]
    for k in range(0, len(chars), 40):
        text = "".join(f"a{c}b {c}1{c} " for c in chars[k : k + 40])
        assert counter.plain(text)
        assert counter.count(text) == len(ids(library[0], text)), text
        want = ids(library[1], text)
        assert coder.encode(text) == struct.pack(f"<{len(want)}I", *want), text


def test_ids_of_ever_new_words_take_bounded_memory(library):
    """Two workers share an executor with its heap; what a coder keeps doesn't grow with the words it meets."""
    coder, letters = WordIds(WORD), "etaoinshrdlucmfw"
    coder.encode("some words")
    gc.collect()
    tracemalloc.start()
    try:
        for k in range(0, 500_000, 5_000):
            coder.encode(" ".join("".join(letters[n >> s & 15] for s in range(0, 20, 4)) + "." for n in range(k, k + 5_000)))
        gc.collect()
        assert tracemalloc.get_traced_memory()[0] < 60_000_000
    finally:
        tracemalloc.stop()


def test_ids_with_hardly_a_cache(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1_000, raising=False)
    coder = WordIds(WORD)
    for text in [t for t in HARD if t] + ["\u201cN\u00e9e\u201d I'LL \u03a3\u0391\u03a3 e\u0301 \xb5\xaa\xb2'S"]:
        for _ in range(2):
            want = ids(library[1], text)
            assert coder.encode(text) == struct.pack(f"<{len(want)}I", *want), text


def test_counts(docs_of, library):
    rows = [(k, t) for k, t in enumerate(HARD)] + [(3, HARD[3]), (None, "ab")]
    got = sorted(map(tuple, token_counts(docs_of(rows), limit=5).collect()), key=str)
    want = [(i, len((t or "").encode()), len(ids(library[0], t or "")), len(ids(library[0], t or "")) > 5) for i, t in rows]
    assert got == sorted(want, key=str)


def test_counts_of_nothing(docs_of):
    assert token_counts(docs_of([])).collect() == []
    assert pack(docs_of([])).collect() == []


def check_packing(rows, got, library, capacity):
    want = []
    for i, t in rows:
        x = [*ids(library[1], t or ""), 0]
        want += [(i, k, s, len(x[s : s + capacity]), zlib.crc32(struct.pack(f"<{len(x[s : s + capacity])}I", *x[s : s + capacity]))) for k, s in enumerate(range(0, len(x), capacity))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(w[3] for w in want)


def test_packing(docs_of, library):
    rows = [(k, t) for k, t in enumerate(HARD)] + [(3, HARD[3]), (None, "ab"), (90, "word " * 6000)]
    got = pack(docs_of(rows).repartition(20)).collect()
    bins, tokens = check_packing(rows, got, library, 2048)
    assert bins <= -(-tokens // 2048) + 1


def test_packing_of_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = pack(docs.repartition(40), capacity=256).collect()
    bins, tokens = check_packing([(r.doc_id, r.text) for r in docs.collect()], got, library, 256)
    assert bins <= 1.02 * -(-tokens // 256) + 2


@pytest.mark.parametrize("node_pieces", [10, 100_000])
def test_many_underfull_bins(spark, library, monkeypatch, node_pieces):
    """Nodes far smaller than the underfull bins: every piece is packed, and hardly worse than in one node."""
    monkeypatch.setattr(packing, "NODE_PIECES", node_pieces)
    rows = [(k, "word " * (3 + 7 * k % 60)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 8, 40):
        bins, tokens = check_packing(rows, pack(docs.repartition(parts), capacity=100).collect(), library, 100)
        assert bins <= 1.15 * -(-tokens // 100) + 2


@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    bins = best_fit(sizes, 50)
    assert sorted(k for b in bins for k in b) == list(range(len(sizes)))
    assert all(sum(sizes[k] for k in b) <= 50 for b in bins)
    assert len(bins) <= -(-11 * max(1, -(-sum(sizes) // 50)) // 9) + 4 if sizes else not bins
