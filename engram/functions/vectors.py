"""Vector functions: cosine, norms, hashing embedder, dimension changes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0.0 for empty, zero, or vectors of different length."""
    # the three sums are the one element of an array, so that none is made again for each use
    sums = F.array(F.struct(dot(a, b).alias("dot"), norm(a).alias("a"), norm(b).alias("b")))
    over = F.transform(sums, lambda x: F.when((x["a"] > 0) & (x["b"] > 0), x["dot"] / (x["a"] * x["b"])).otherwise(0.0))[0]
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), over).otherwise(0.0)


def l2_normal(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    # the vector and its norm are each the one element of an array, so that neither is made again for each use
    return F.transform(F.array(a), lambda v: _over(v, norm(v)))[0]


def _over(a: Column, length: Column) -> Column:
    return F.transform(F.array(length), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))[0]


def to_dims(a: Column, dims: int) -> Column:
    """``dims`` numbers: means of equal groups if that divides, else cut or padded
    with zeros; then unit length."""
    n = F.size(a)
    groups = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.aggregate(F.slice(a, k * (n / dims).cast("int") + 1, (n / dims).cast("int")), F.lit(0.0), lambda s, x: s + x) / (n / dims))
    padded = F.slice(F.concat(a, F.array_repeat(F.lit(0.0), dims)), 1, dims)
    return l2_normal(F.when((n > dims) & (n % dims == 0), groups).otherwise(padded))


def digest_vector(text: Column, repeats: int = 64) -> Column:
    """The 32 bytes of the text's sha256 as shares of 255, repeated, unit length: a
    stand-in where there is no embedder."""
    # the digest is the one element of an array, so that a text is digested once, not for each byte
    digest = F.array(F.sha2(F.coalesce(text, F.lit("")), 256))
    one = F.transform(digest, lambda d: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.conv(F.substr(d, 2 * k + 1, F.lit(2)), 16, 10).cast("double") / 255))[0]
    # the norm of all repeats is that of one times the root of their number
    part = F.transform(F.array(one), lambda v: _over(v, norm(v) * math.sqrt(repeats)))[0]
    return F.flatten(F.array_repeat(part, repeats))


def char_vector(text: Column, dims: int = 128) -> Column:
    """Code points of the first ``dims`` characters, lower-cased each for itself, unit
    length; zeros without any."""
    # letter by letter, a case doesn't depend on what stands beside it, and stays one character
    letters = F.split(F.substring(F.coalesce(text, F.lit("")), 1, dims), "")
    codes = F.transform(letters, lambda c: F.ascii(F.lower(c)).cast("double"))
    return l2_normal(F.slice(F.concat(codes, F.array_repeat(F.lit(0.0), dims)), 1, dims))


def rounded(x: Column, places: int) -> Column:
    """To so many decimals as DuckDB does it: the scaled double, halves away from zero;
    ``round`` takes the double's shortest decimal."""
    return F.round(x * 10.0**places) / 10.0**places


class Embedder(Protocol):
    """What a text embedder offers; ``column`` makes an array<double> column."""

    name: str
    dims: int

    def column(self, text: Column) -> Column: ...


_WORD = regex.compile(r"\w+")


def _hashed(grams: Iterable[bytes]) -> np.ndarray:
    """The first 32 bits of each gram's digest, with the next bit as sign on top."""
    raw = b"".join([hashlib.blake2b(g, digest_size=8).digest() for g in grams])
    return np.frombuffer(raw, dtype="<i8") & 0x1FFFFFFFF


#: Numbers of one block of vectors, and characters of its texts, that are held at a time.
BLOCK, CHARS = 1 << 20, 1 << 20
#: Texts of a batch that are Python strings at a time.
HELD = 512


def _blocks(texts: list[str | None], dims: int) -> Iterator[slice]:
    """Texts in order, of ``BLOCK`` numbers and ``CHARS`` characters at most, or one text."""
    at = held = 0
    for k, t in enumerate(texts):
        if k > at and ((k - at + 1) * dims > BLOCK or held + len(t or "") > CHARS):
            yield slice(at, k)
            at, held = k, 0
        held += len(t or "")
    if at < len(texts):
        yield slice(at, len(texts))


def hash_vectors(texts: list[str | None], dims: int) -> np.ndarray:
    """Signed feature hashing of words and word pairs, a line of unit length for each
    text; zeros without words.  Each different word or pair of the batch is hashed once."""
    found = [_WORD.findall((t or "").lower()) for t in texts]
    codes, words = pd.factorize(np.array([w for ws in found for w in ws], dtype=object))
    line = np.repeat(np.arange(len(found)), [len(ws) for ws in found])
    first = np.flatnonzero(line[1:] == line[:-1])
    both, which = np.unique(codes[first] * (len(words) + 1) + codes[first + 1], return_inverse=True)
    words = [w.encode() for w in words]
    ends = np.divmod(both, len(words) + 1)
    pairs = (words[a] + b"_" + words[b] for a, b in zip(ends[0].tolist(), ends[1].tolist()))
    once = np.concatenate([_hashed(words), _hashed(pairs)])
    h = once[np.concatenate([codes, len(words) + which]).astype(np.int64)]
    line = np.concatenate([line, line[first]])
    sums = np.bincount(line * dims + (h & 0xFFFFFFFF) % dims, weights=1.0 - 2.0 * (h >> 32), minlength=len(found) * dims)
    out = sums.astype(np.float64).reshape(len(found), dims)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def hash_vector(text: str | None, dims: int) -> np.ndarray:
    return hash_vectors([text], dims)[0]


class HashingEmbedder:
    """The default embedder: no model, the same vectors everywhere."""

    def __init__(self, dims: int = 384):
        if dims <= 0:
            raise ValueError("dims must be positive")
        self.dims, self.name = dims, f"hashing-{dims}"

    def function(self):
        """The embedder as an Arrow UDF of a text column."""
        dims = self.dims

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def embed(texts: pa.Array) -> pa.Array:
            out = np.empty((len(texts), dims))
            for at in range(0, len(texts), HELD):
                held = texts.slice(at, HELD).to_pylist()
                for block in _blocks(held, dims):
                    out[at + block.start : at + block.stop] = hash_vectors(held[block], dims)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dims), pa.array(out.ravel()))

        return embed

    def column(self, text: Column) -> Column:
        return self.function()(text)


_EMBEDDERS: dict[str, Callable[[int], Embedder]] = {"hashing": HashingEmbedder}


def register_embedder(name: str, make: Callable[[int], Embedder]) -> None:
    _EMBEDDERS[name] = make


def get_embedder(name: str = "hashing", dims: int = 384) -> Embedder:
    return _EMBEDDERS[name](dims)
