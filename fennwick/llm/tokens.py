"""Tokenizing whole texts with a public tokenizer, word by word, with a bounded cache in each worker."""

from __future__ import annotations

import ctypes
import unicodedata
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

#: Words of a worker's cache (half of them old ones), and the longest chunk that is kept; together they bound its memory.
CACHE_WORDS = 600_000
CACHE_BYTES = 64
# ASCII punctuation; a run of it after a letter or digit is a token run of its own.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: How special tokens begin; texts and chunks with it are left to the tokenizer.
SPECIAL = b"<|"


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: visible ones as they are, others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class Encoder(dict):
    """Token ids of chunks between ASCII white space, as little-endian unsigned 32-bit integers.

    The vocabulary must be a lower-casing one that drops white space and parts letters, digits and marks, as
    word_bpe_49k.json does. No token then spans white space, so a text's ids are those of its chunks, in order. A chunk
    that ends in punctuation is made of two, and a chunk of lower-case Latin letters goes to the merge rules directly;
    anything else goes through the whole tokenizer. Bytes that are not UTF-8 are read as replacement characters.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.half, self.old = Tokenizer.from_file(path), limit // 2, {}
        self.merges, self.letters = self.tokenizer.model, byte_letters()

    def __missing__(self, chunk: bytes) -> bytes:
        out = self.old.get(chunk)
        if out is None:
            out = self._ids(chunk)
        if len(chunk) <= CACHE_BYTES:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[chunk] = out
        return out

    def _ids(self, chunk: bytes) -> bytes:
        if chunk.isalpha() and chunk.islower():
            return array("I", [t.id for t in self.merges.tokenize(chunk.decode())]).tobytes()
        text = chunk.decode("utf-8", "replace")
        if SPECIAL not in chunk:
            base = chunk.rstrip(PUNCTUATION)
            if base and len(base) < len(chunk) and base.decode("utf-8", "replace").lower()[-1].isalnum():
                return self[base] + self[chunk[len(base) :]]
            if text.isalpha() and max(text) < "ɐ" and text == text.lower() and unicodedata.is_normalized("NFC", text):
                return array("I", [t.id for t in self.merges.tokenize("".join(self.letters[b] for b in chunk))]).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, body: bytes) -> bytes:
        if SPECIAL not in body:
            body = body.lower()
        return b"".join(map(self.__getitem__, body.split()))


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, limit: int = CACHE_WORDS) -> Encoder:
    """The worker's encoder for a vocabulary file; workers are reused, so its cache lasts from task to task."""
    if (path, limit) not in _encoders:
        _encoders[path, limit] = Encoder(path, limit)
    return _encoders[path, limit]


@contextmanager
def passing_encoder(path: str, limit: int) -> Iterator[Encoder]:
    """An encoder for one task. Its memory goes back to the system then, for workers that turn to other stages."""
    words = Encoder(path, limit)
    try:
        yield words
    finally:
        words.clear()
        words.old = {}
        words.tokenizer = words.merges = None
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what is freed in small pieces
        if trim:
            trim(0)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
