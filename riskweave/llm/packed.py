"""Integer arrays in binary columns, and texts as arrays of word numbers.

Words and n-grams by the billion are shuffled as sorted arrays, a row for each source and target, not as rows of their own: a
block costs a few bytes an entry. With more targets than a source has entries this becomes a row for each entry, no worse than
a plain shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
CODEC = pa.Codec("zstd", compression_level=1)


def pack(a: np.ndarray) -> bytes:
    """An unsigned integer array, byte plane by byte plane, compressed."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return bytes([a.itemsize]) + len(a).to_bytes(8, "little") + CODEC.compress(raw, asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    size, n = b[0], int.from_bytes(b[1:9], "little")
    raw = CODEC.decompress(b[9:], size * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(f"<u{size}").reshape(n)


def pack_sorted(a: np.ndarray) -> bytes:
    """An ascending 64-bit array by its differences."""
    return pack(np.diff(a, prepend=U(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))


def targets(keys: np.ndarray, n: int) -> np.ndarray:
    """The one of n equal ranges of 64-bit values that each key lies in; ascending for ascending keys."""
    return ((keys >> U(32)) * U(n) >> U(32)).astype(np.int64)


class Numbers(dict):
    """Numbers words as they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint32, len(words))


def steps(raw: bytes, step: int = 1 << 20):
    """raw in pieces of about `step` bytes, cut at spaces."""
    at = 0
    while at < len(raw):
        cut = raw.find(b" ", at + step)
        end = len(raw) if cut < 0 else cut
        yield raw[at:end]
        at = end
