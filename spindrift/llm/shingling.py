"""Word hashes and sets of word shingles, computed batch by batch inside tasks.

A word is a maximal run of characters that are not ASCII white space, of the
text with A-Z lower-cased, and is known by a 64-bit hash of its UTF-8. A
shingle's hash mixes its words' hashes in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Odd multipliers of the 64-bit mixing steps.
MIX = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers, another for each seed."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """The hashes of a text's words, in order; bytes.split() splits at ASCII white space."""
    import xxhash

    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted hashes, as signed integers, of the distinct shingles (of all words where there are fewer)."""
    n = len(words) - width + 1
    if not len(words):
        return np.empty(0, np.int64)
    if n < 1:
        n, width = 1, len(words)
    found = np.full(n, np.uint64(width))
    for k in range(width):
        found += words[k:k + n] * np.uint64(pow(int(MIX[0]), k + 1, 2**64))
    return np.unique(mixed(found).view(np.int64))


def binary_texts(column: pa.Array) -> list[bytes]:
    """A string column's values as bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def lists(parts: list[np.ndarray]) -> pa.Array:
    """64-bit arrays as one Arrow list column."""
    ends = np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int32)
    flat = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def arrays(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """An Arrow list column's values as arrays."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]
