"""Vectorised word and shingle hashing over batches of UTF-8 texts.

Whole batches are processed as one byte array, so the cost per byte is a few
numpy operations and no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Word characters of ``[^\x20\x09-\x0D]+`` and of
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, as tables over bytes.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTER_OR_DIGIT = np.zeros(256, dtype=bool)
LETTER_OR_DIGIT[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_RNG = np.random.Generator(np.random.PCG64(20240101))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x + _U(salt * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, base % 2**64, dtype=np.uint64)]), dtype=np.uint64)
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


class Words:
    """Words of a batch: hash, document, and byte range of each, in order."""

    def __init__(self, texts: list[bytes | None], table: np.ndarray):
        joined = b" ".join(t or b"" for t in texts) + b" "
        lengths = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.doc_start = np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = _LOWER[np.frombuffer(joined, dtype=np.uint8)]
        inside = table[self.bytes]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        with np.errstate(over="ignore"):
            sums = np.cumsum(_BYTE[self.bytes] * _powers(_MUL, len(self.bytes)), dtype=np.uint64)
            before = np.where(self.start > 0, sums[self.start - 1], _U(0))
            self.hash = mix((sums[self.end - 1] - before) * _powers(_INV, len(self.bytes))[self.start])
        #: First word of each document, and the total at the end.
        self.first = np.searchsorted(self.start, self.doc_start)

    def word(self, k: int) -> bytes:
        return self.bytes[self.start[k] : self.end[k]].tobytes()


def word_hash(word: bytes) -> int:
    """The hash that ``Words`` gives to one word."""
    return int(Words([word], np.ones(256, dtype=bool) & (np.arange(256) != 32)).hash[0])


def slices(texts: list[bytes | None], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``limit`` bytes, one document at least."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or b"")
        if size >= limit:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def parts(batch, rows: int = 512) -> Iterator:
    """A batch in slices of so many rows, which bounds what is copied at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def shingle_sets(texts: list[bytes | None], width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order.

    Shorter texts are one shingle of all their words; none without words.
    """
    factors = [(_MUL * (2 * k + 3) ** 5) % 2**64 | 1 for k in range(width)]
    for a, b in slices(texts):
        w = Words(texts[a:b], NOT_SPACE)
        n = len(w.hash)
        with np.errstate(over="ignore"):
            runs = np.zeros(max(n - width + 1, 0), dtype=np.uint64)
            for k, c in enumerate(factors):
                runs += w.hash[k : k + len(runs)] * _U(c)
            runs = mix(runs)
        for k in range(b - a):
            lo, hi = w.first[k], w.first[k + 1]
            if hi - lo >= width:
                yield np.unique(runs[lo : hi - width + 1])
            elif hi > lo:
                with np.errstate(over="ignore"):
                    total = sum((w.hash[lo + k] * _U(factors[k]) for k in range(hi - lo)), _U(0))
                    yield mix(np.array([total + _U(hi - lo)], dtype=np.uint64), 7)
            else:
                yield np.empty(0, dtype=np.uint64)
