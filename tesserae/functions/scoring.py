"""Score arithmetic: inverse document frequency, BM25, cosine, rank fusion, rendering, hashing vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import encoded

K1, B, RRF_K, DIMS = 1.2, 0.75, 60, 256


def idf(n: Column, df: Column) -> Column:
    """0 for a term that stands nowhere: it takes no part, in the best possible score neither."""
    return F.when(df > 0, F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))).otherwise(0.0)


def idf_of(n: int, df: int) -> float:
    """The same on the driver."""
    return float(np.log(1.0 + (n - df + 0.5) / (df + 0.5)))


def bm25(tf: Column, length: Column, average: Column, weight: Column) -> Column:
    return weight * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / average))


def bm25_ceiling(weight: Column) -> Column:
    """What a term could score at most in a text of no length; scores are divided by the sum of these."""
    return weight * F.lit(K1 + 1) / F.lit(K1 * (1 - B) + 1)


def dot(a: Column, b: Column) -> Column:
    """Of arrays of one length; for unit vectors the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def reciprocal_rank(rank: Column, weight: Column | float, depth: Column | int = 0) -> Column:
    weight = F.lit(weight) if isinstance(weight, (int, float)) else weight
    return weight / (F.lit(RRF_K) + rank) * F.pow(F.lit(0.5), depth if isinstance(depth, Column) else F.lit(depth))


def render(score: Column) -> Column:
    """Clamped to 0..1, two decimals, half to even, as a string."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.bround(inside.cast("decimal(20,17)"), 2).cast("string")


def hash_bucket(token: Column, dims: int = DIMS) -> Column:
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % F.lit(dims)).cast("int")


def hash_sign(token: Column) -> Column:
    """+1 or -1 by the parity of the fifth byte of the digest: +1 where it is odd."""
    odd = F.conv(F.substring(F.sha2(token, 256), 10, 1), 16, 10).cast("int") % 2
    return F.when(odd == 1, F.lit(1.0)).otherwise(F.lit(-1.0))


def hashed(token: str, dims: int = DIMS) -> tuple[int, float]:
    """(bucket, sign) of a token, as the Column forms give them."""
    h = hashlib.sha256(token.encode("utf-8", "surrogatepass")).digest()
    return int.from_bytes(h[:4], "big") % dims, 1.0 if h[4] % 2 else -1.0


class Hashed(dict):
    """token -> bucket, with ``dims`` added where the sign is negative; filled on demand and emptied once it holds many."""

    def __init__(self, dims: int = DIMS):
        self.dims = dims

    def __reduce__(self):
        return Hashed, (self.dims,)  # to a worker without what it holds

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = hashlib.sha256(token.encode("utf-8", "surrogatepass")).digest()
        self[token] = code = int.from_bytes(h[:4], "big") % self.dims + (0 if h[4] % 2 else self.dims)
        return code


def hashing_vector(words: list[str], known: Hashed | None = None, dims: int = DIMS) -> np.ndarray:
    """The unit vector of the signed counts of hashed words; without words the zero vector."""
    return hashing_matrix(words, np.zeros(len(words), np.int64), 1, known, dims)[0]


def hashing_matrix(words: list[str] | pa.Array, owner: np.ndarray, n: int, known: Hashed | None = None, dims: int = DIMS) -> np.ndarray:
    """The same for ``n`` texts at once: ``owner`` has the text of every word."""
    known = Hashed(dims) if known is None else known
    distinct, place = encoded(words)
    code = np.fromiter(map(known.__getitem__, distinct.to_pylist()), np.int64, len(distinct))
    counts = np.bincount(owner * (2 * dims) + code[place], minlength=n * 2 * dims).reshape(n, 2, dims)
    out = (counts[:, 0] - counts[:, 1]).astype(np.float64)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def seeded_vector(seed: str, dims: int = 32) -> np.ndarray:
    """A unit vector that a string alone determines, for tests: signed 16-bit big-endian words of SHA-256 over seed#counter."""
    data = b"".join(hashlib.sha256(f"{seed}#{i}".encode()).digest() for i in range(-(-dims // 16)))
    raw = np.frombuffer(data, ">i2")[:dims] / 32768.0
    return raw / np.sqrt((raw * raw).sum())


def cache_key(tag: Column, space: Column, role: Column, text: Column) -> Column:
    zero = F.lit("\x00")
    return F.sha2(F.concat(tag, zero, space, zero, role, zero, text, zero), 256)


def best_columns(s: np.ndarray, order_of: np.ndarray, width: int) -> np.ndarray:
    """Columns of the ``width`` largest of every row, largest first; ties, those at the cut too, go to the smaller ``order_of``."""
    if width < s.shape[1]:
        cut = np.partition(s, s.shape[1] - width, axis=1)[:, s.shape[1] - width]
        most = int((s >= cut[:, None]).sum(1).max())
        some = np.argpartition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most :]
    else:
        some = np.broadcast_to(np.arange(s.shape[1]), s.shape)
    order = np.lexsort((order_of[some], -np.take_along_axis(s, some, 1).astype(np.float64)), axis=1)[:, :width]
    return np.take_along_axis(some, order, 1)
