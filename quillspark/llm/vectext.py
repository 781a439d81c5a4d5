"""Vectorised views of a batch of texts: bytes, words and 64-bit word hashes, without a Python object per word.

Words are ``[^\\x20\\x09-\\x0D]+``. UTF-8 never uses these bytes inside a longer character, so all work is on bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from .common import offsets_of

_BYTE = np.arange(256, dtype=np.uint8)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
#: First bytes of characters: everything but UTF-8 continuation bytes.
STARTS_CHAR = (_BYTE & 0xC0) != 0x80


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and the len+1 offsets of the texts in them."""
    offsets = offsets_of(texts)
    data = texts.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a flag or count per text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


@dataclass
class Words:
    """codes: for each word the index of its value in ``values``; bounds: len(texts)+1 offsets of texts in codes; pieces: for
    each word how many bytes that end a piece lie before it, where such bytes were given."""

    codes: np.ndarray
    values: pa.Array
    bounds: np.ndarray
    pieces: np.ndarray | None = None

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash for each distinct word."""
        return np.fromiter((xxhash.xxh64_intdigest(v, seed) for v in self.values.to_pylist()), np.uint64, len(self.values))


def words_of(texts: pa.Array, lower: bool, between: np.ndarray = IS_SPACE, ends: np.ndarray | None = None) -> Words:
    """Words of each text. between: a flag for each byte value that is not part of a word; ends: for each that ends a piece."""
    data, offsets = raw_bytes(texts)
    if lower:
        data = LOWER[data]
    space = between[data]
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] |= word[at]
    counts = per_text(first, offsets)
    packed = np.ascontiguousarray(data[word])
    place = np.cumsum(word) - 1
    begins = np.append(place[first], len(packed)).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(packed)])
    coded = column.dictionary_encode()
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    pieces = None if ends is None else np.cumsum(ends[data])[first]
    return Words(np.asarray(coded.indices), coded.dictionary, bounds, pieces)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_STEP = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(word_hash: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words; the runs across text ends are the caller's to leave out."""
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = word_hash[:n].copy()
    for k in range(1, width):
        out *= _STEP
        out += word_hash[k : k + n]
    return mix(out)


def whole_hash(word_hash: np.ndarray) -> np.uint64:
    """Hash of a whole sequence that is shorter than a window; its length takes part."""
    out = np.array([len(word_hash)], np.uint64)
    for x in word_hash:
        out *= _STEP
        out += x
    return mix(out)[0]
