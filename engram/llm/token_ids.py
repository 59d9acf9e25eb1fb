"""Token ids of whole texts with a public word-level BPE vocabulary.

The vocabulary splits at white space and marks word ends, so the ids of a text
are those of its space-separated chunks in order.  Ids of chunks, and of the
letter runs inside new chunks, are kept in bounded tables as raw bytes: a known
chunk costs one lookup.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

#: Entries after which a table starts anew; bounds a worker's memory.
MOST_CHUNKS = 700_000


def _byte_names() -> dict[int, str]:
    """The printable character by which the vocabulary writes each byte: the
    byte itself where it prints, else the next code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Table(dict):
    """A bounded dict that makes what it lacks."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) >= MOST_CHUNKS:
            self.clear()
        self[key] = value
        return value


class TextTokens:
    """``ids(text)``: little-endian unsigned 32-bit ids of a whole text."""

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        self.names = str.maketrans({chr(b): name for b, name in _byte_names().items()})
        self.raw = [k.to_bytes(4, "little") for k in range(self.full.get_vocab_size())]
        self.plain = re.compile("[a-zà-öø-ÿ]+|[.,]+").findall
        self.pieces = _Table(self._piece)
        self.chunks = _Table(self._chunk)

    def _piece(self, piece: str) -> bytes:
        written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.names)
        return b"".join([self.raw[t.id] for t in self.full.model.tokenize(written)])

    def _chunk(self, chunk: str) -> bytes:
        low = chunk.lower()
        parts = self.plain(low)
        if len(low) == len(chunk) == sum(map(len, parts)):
            return b"".join(map(self.pieces.__getitem__, parts)) if parts else b""
        # anything unusual goes through the whole tokenizer
        return np.array(self.full.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))
