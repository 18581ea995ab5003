"""Exact token ids of the public word tokenizer, memoised by word.

The tokenizer lower-cases, splits a text into words by a fixed pattern, and encodes each word by itself, so the ids of a
text are the ids of its words, one after the other. Words repeat, hence a bounded memo of word -> packed ids does most of
the work and the library encodes only the misses. Texts within Latin-1, where composing and lower-casing go character by
character, are split here, as bytes; other texts are split at ASCII white space alone, which no word, special string or
composed character spans, and the library does the rest. Texts with `<|`, with which special strings begin, go to the
library whole.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from array import array

import numpy as np

#: Entries of each of the memo's two generations; a full young one takes the old one's place, so a worker's memory is
#: bounded and words that recur stay.
MEMO_ENTRIES = 250_000
#: Words longer than this are encoded but not kept.
MEMO_BYTES = 48
# Fixed values of the tokenizer: its split pattern, for lower-case Latin-1.
LETTERS, NUMBERS, SPACES = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb"\x09-\x0d\x20\x85\xa0"
_split = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[" + LETTERS + rb"]+|[" + NUMBERS + rb"]|[^" + SPACES + LETTERS + NUMBERS + rb"]+").findall
_lower = bytes(ord(c) if len(c := chr(i).lower()) == 1 and ord(c) < 256 else i for i in range(256))


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def file_digest(path: str) -> str:
    """Identifies a tokenizer's version: SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class ChunkEncoder:
    """Encodes texts to packed little-endian unsigned 32-bit ids with a tokenizers file, as the library does."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        assert sys.byteorder == "little" and array("I").itemsize == 4
        self.library = Tokenizer.from_file(path)
        ends = [i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(max(self.library.get_vocab().values()) + 1, dtype=bool)
        self.ends[ends] = True  # tokens that end a word
        self.memos: dict[str, list[dict[bytes, bytes]]] = {"latin-1": [{}, {}], "utf-8": [{}, {}]}  # young, old

    def packed(self, text: str | None) -> bytes:
        """Ids of a text, four bytes each; a null text has none."""
        if not text:
            return b""
        if "<|" in text:
            return self._encoded([text])[0]
        try:
            kind, words = "latin-1", _split(text.encode("latin-1").translate(_lower))
        except UnicodeEncodeError:
            kind, words = "utf-8", text.encode("utf-8", "replace").split()
        memo, old = self.memos[kind]
        found = list(map(memo.get, words))
        if None not in found:
            return b"".join(found)
        fresh = {w: old.get(w) for w, x in zip(words, found, strict=True) if x is None}
        if missing := [w for w, x in fresh.items() if x is None]:
            fresh.update(zip(missing, self._words(missing) if kind == "latin-1" else self._encoded([w.decode(kind) for w in missing]), strict=True))
        if len(memo) + len(fresh) > MEMO_ENTRIES:
            self.memos[kind] = [memo := {}, self.memos[kind][0]]
        memo.update(fresh if max(map(len, fresh)) <= MEMO_BYTES else {w: x for w, x in fresh.items() if len(w) <= MEMO_BYTES})
        return b"".join([fresh[w] if x is None else x for w, x in zip(words, found, strict=True)])

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of single words, by one call: each word's last token says that it ends one."""
        ids = np.array(self.library.encode_batch_fast([b" ".join(words).decode("latin-1")], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(words):
            return self._encoded([w.decode("latin-1") for w in words])
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in encoded]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
