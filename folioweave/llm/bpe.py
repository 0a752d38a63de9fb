"""Worker-side BPE encoding with caches, equal to the tokenizers library's own output.

A text is cut where the library's pre-tokenizer would cut it, and each distinct piece is
merged once while a cache keeps it.  A worker keeps a coder and its caches until it is idle.  Texts
with characters whose class may differ between regex engines, or with added-token strings, are
handed to the library whole.
"""

from __future__ import annotations

import functools
import re
import struct
import sys
import unicodedata

import regex
from tokenizers import Tokenizer

#: Entries, of some 200 bytes, that a cache of counts holds, and bytes that a cache of ids holds; results do not depend on them.
CACHE_ENTRIES, CACHE_BYTES = 1_200_000, 48_000_000
#: Bytes of an entry in a dict beside its key and value, growth included.
SLOT = 64

GPT_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Letters and numbers of the first 256 characters in lower case, and the same pieces over these for the faster ``re``.
NARROW_L, NARROW_N = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
NARROW_PIECES = rf"[{NARROW_L}]+|[{NARROW_N}]|'(?:s|t|re|ve|m|ll|d)|[^\s{NARROW_L}{NARROW_N}]+"


def _byte_letters() -> dict[int, str]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


@functools.lru_cache(None)
def safe() -> frozenset[str]:
    """Characters whose letter, number or space class is the same in every Unicode version since 3.2."""

    def kind(category: str) -> str:
        return category[0] if category[0] in "LN" else "Z"

    found = []
    for c in range(0x10000):
        x = chr(c)
        old = unicodedata.ucd_3_2_0.category(x)
        if old not in ("Cn", "Cs") and kind(old) == kind(unicodedata.category(x)) and not 0x1C <= c <= 0x1F and c not in (0x85, 0x180E, 0x200B, 0xFEFF):
            found.append(x)
    return frozenset(found)


@functools.lru_cache(None)
def unsafe_bytes() -> tuple[bytes, ...]:
    """Those of the first 256 characters that are not safe."""
    return tuple(bytes([c]) for c in range(256) if chr(c) not in safe())


def narrow(text: str) -> bytes | None:
    """A byte a character, if all are of the first 256."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


def is_safe(text: str) -> bool:
    got = narrow(text)
    return safe().issuperset(text) if got is None else not any(b in got for b in unsafe_bytes())


@functools.lru_cache(2)
def _library(path: str) -> Tokenizer:
    """The library's own coder, some 30 MB, which a worker keeps."""
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    return whole


class Encoder:
    """path: a tokenizers .json file with a byte-level alphabet."""

    def __init__(self, path: str):
        self.whole = _library(path)
        self.model = self.whole.model
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def plain(self, text: str) -> bool:
        return not any(t in text for t in self.added) and is_safe(text)

    def merged(self, piece: str) -> list:
        return self.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_LETTERS))


class PieceCounter(Encoder):
    """Token counts for the byte-level BPE that keeps spaces; ``frequent`` is the broadcast first tier."""

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(path)
        self.frequent, self.seen = frequent, {}
        self.find = regex.compile(GPT_SPLIT).findall

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.plain(text):
            return len(self.whole.encode(text, add_special_tokens=False).ids)
        first, second, n = self.frequent, self.seen, 0
        for piece in self.find(text):
            k = first.get(piece)
            if k is None:
                k = second.get(piece)
                if k is None:
                    k = len(self.merged(piece))
                    if len(second) >= CACHE_ENTRIES:
                        second.clear()
                    if len(piece) < 64:
                        second[piece] = k
            n += k
        return n


class WordIds(Encoder):
    """Ids, as little-endian unsigned 32-bit bytes, for the BPE that lower-cases and drops white space."""

    def __init__(self, path: str):
        super().__init__(path)
        # two generations: what is met again while it is in the older one stays
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0  # bytes of the younger one
        self.find, self.find_narrow = regex.compile(WORD_PIECES).findall, re.compile(NARROW_PIECES).findall

    def _lower(self, text: str) -> str:
        """A safe text as the library's normalizer gives it, blanks aside; only a sigma's lower case depends on what stands around it."""
        text = unicodedata.normalize("NFC", text)
        return self.whole.normalizer.normalize_str(text) if "\u03a3" in text else text.lower()

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            got = self.old.get(word)
            if got is None:
                ids = [t.id for t in self.merged(word)]
                got = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) < 64:
                if self.held >= CACHE_BYTES // 2:
                    self.old, self.words, self.held = self.words, {}, 0
                self.words[word] = got
                self.held += sys.getsizeof(word) + sys.getsizeof(got) + SLOT
        return got

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.plain(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        # the first 256 characters are composed already
        words = self.find(self._lower(text)) if narrow(text) is None else self.find_narrow(text.lower())
        got = list(map(self.words.get, words))
        if None in got:
            word = self._word
            got = [word(w) if g is None else g for w, g in zip(words, got, strict=True)]
        return b"".join(got)
