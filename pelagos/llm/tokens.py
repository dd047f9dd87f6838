"""Token ids of the public tokenizers, with a bounded cache of whole chunks of text.

A chunk is a stretch that no pre-token crosses, so a text's ids are its chunks' ids in order. Chunks
that the cache lacks are split into pre-tokens and go through the tokenizers library's model. Texts
with any character outside SAFE, where library versions could disagree on classes or case, go through
the library as a whole; the ids are the same on either way.

The strings of special tokens in a text are ordinary text, as the description of the tokenizer files has it (a document must
not be able to end a document); with ``special_as_text=False`` the library's own default holds and they become their ids.
"""

from __future__ import annotations

import array
import functools
import json
import re
from collections.abc import Callable

import regex
from tokenizers import Tokenizer

#: Code points whose class, case and normal form every Unicode version agrees on.
SAFE = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\xac\\xae-\\u012f\\u0131-\\u017f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]|<\\|")
CACHE_ENTRIES = 400_000
# The pre-token patterns of the two tokenizer files.
BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: An optional space with what follows it up to white space, or a run of white space as BYTE_PIECES cuts it.
_BYTE_CHUNKS = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+")


def _byte_alphabet() -> dict[int, str]:
    """Printable Latin-1 stands for itself; the other bytes take the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


_ALPHABET = _byte_alphabet()


class _Cache(dict):
    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        ids = self.make(chunk)
        if len(self) < CACHE_ENTRIES:
            self[chunk] = ids
        return ids


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, special_as_text: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            self.words = bool(json.load(f)["model"].get("end_of_word_suffix"))
        self.pieces = WORD_PIECES if self.words else BYTE_PIECES
        self.cache = _Cache(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for piece in self.pieces.findall(chunk):
            ids += [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_ALPHABET))]
        return array.array("I", ids).tobytes()

    def whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SAFE.search(text):
            return self.whole(text)
        chunks = text.lower().split() if self.words else _BYTE_CHUNKS.findall(text)
        return b"".join(map(self.cache.__getitem__, chunks))


@functools.cache
def encoder(path: str, special_as_text: bool = True) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path, special_as_text)
