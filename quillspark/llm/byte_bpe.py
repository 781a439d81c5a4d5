"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are tokens as a whole. Tier two: other
pre-tokens are merged by rank with a heap over linked bytes, O(n log n) for any length. A bounded cache keeps the ids
of pre-tokens seen lately; it changes nothing but the speed.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, filled, passes

#: Pre-tokens whose ids a Python worker keeps; at this size the cache starts anew.
CACHE_PIECES = 400_000
#: Keys for each displacement of the perfect hash.
KEYS_A_BUCKET = 4


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _slot(x: int, y: int, d: int, n: int) -> int:
    """Slot of a key with hashes x and y under displacement d: another one of all slots for each d."""
    return ((x ^ d * 0x9E3779B1) * (y | 1) >> 13 & 0xFFFFFFFF) % n


class PerfectHash:
    """Minimal perfect hash by displacement: n keys fill exactly n slots; a lookup is one hash and one comparison."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // KEYS_A_BUCKET)
        for self.seed in range(64):
            if self._place(keys):
                return
        raise ValueError("no perfect hash found; are the keys distinct?")

    def _place(self, keys: list[bytes]) -> bool:
        groups: list[list[tuple[int, int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in keys:
            h = xxhash.xxh3_128_intdigest(key, self.seed)
            groups[h % self.buckets].append((h >> 32 & 0xFFFFFFFF, h >> 64 & 0xFFFFFFFF, key))
        taken = bytearray(self.n)
        self.shift = np.zeros(self.buckets, np.int64)
        self.keys: list[bytes] = [b""] * self.n
        free = None
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            group = groups[b]
            if not group:
                break
            if len(group) == 1:  # any free slot does: stored as a negative number
                if free is None:
                    free = iter([i for i in range(self.n) if not taken[i]])
                slot = next(free)
                self.shift[b] = -slot - 1
                taken[slot], self.keys[slot] = 1, group[0][2]
                continue
            for d in range(1, 1 << 16):
                slots = {_slot(x, y, d, self.n) for x, y, _ in group}
                if len(slots) == len(group) and not any(taken[s] for s in slots):
                    break
            else:
                return False
            self.shift[b] = d
            for x, y, key in group:
                slot = _slot(x, y, d, self.n)
                taken[slot], self.keys[slot] = 1, key
        self.shifts = self.shift.tolist()
        return True

    def slot(self, key: bytes) -> int:
        """The slot of a key, -1 for bytes that aren't a key."""
        h = xxhash.xxh3_128_intdigest(key, self.seed)
        d = self.shifts[h % self.buckets]
        at = -d - 1 if d < 0 else _slot(h >> 32 & 0xFFFFFFFF, h >> 64 & 0xFFFFFFFF, d, self.n)
        return at if self.keys[at] == key else -1


class ByteBPE:
    """Codec of one vocabulary: ``encode`` text to ids, ``decode`` ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.whole = PerfectHash(list(ranks))
        self.slot_rank = [ranks[k] for k in self.whole.keys]
        self._start()

    def _start(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.cache = _Pieces(self)
        self.token = {str(rank): token for token, rank in self.ranks.items()}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "cache", "token")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        at = self.whole.slot(piece)
        return [self.slot_rank[at]] if at >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is in the vocabulary."""
        n, rank = len(piece), self.ranks.get
        after = list(range(1, n + 1))  # where the symbol that starts here ends; 0: no symbol starts here any more
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            mid = after[i]
            if not mid or mid >= n or after[mid] != end:
                continue
            after[i], after[mid] = end, 0
            before[end] = i
            if end < n and (r := rank(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
            if (j := before[i]) >= 0 and (r := rank(piece[j:end])) is not None:
                heapq.heappush(heap, (r, j, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode_joined(self, text: str) -> str:
        """Ids in decimal, joined by commas."""
        return ",".join(map(self.cache.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return [int(x) for x in joined.split(",")] if joined else []

    def decode_joined(self, joined: str) -> bytes:
        return b"".join(map(self.token.__getitem__, joined.split(","))) if joined else b""

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.token[str(i)] for i in ids)


class _Pieces(dict):
    """Pre-token to its joined ids, filled on demand and bounded."""

    def __init__(self, codec: ByteBPE):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> str:
        if len(self) >= CACHE_PIECES:
            self.clear()
        joined = ",".join(map(str, self.codec.piece(piece.encode())))
        if len(piece) < 64:
            self[piece] = joined
        return joined


def _codec(docs: DataFrame, path: str, pattern: str) -> Shared:
    """The codec, broadcast; its size is the vocabulary's."""
    return Shared(docs.sparkSession, ByteBPE(load_ranks(path), pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every whole text, without special tokens.

    Null text counts as empty and has no ids; repeated rows stay repeated; extra columns are left out; an empty table
    gives an empty result. The vocabulary is read by the driver and broadcast.
    """
    codec = _codec(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec.value
        for batch in batches:
            ids = [bpe.encode(t) for t in filled(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, content (binary) of a table with doc_id and ids.

    Null ids count as none and give empty content; an id that the vocabulary lacks is an error. Rows repeated with one
    doc_id, and those with a null one, are decoded one by one; lists of any length whole. Other columns, whatever their
    names, are left out; an empty table gives an empty result.
    """
    codec = _codec(encoded, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec.value
        for batch in batches:
            content = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], ["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each whole text, then decodes those ids, in one pass.

    Null text counts as empty: no ids. A text of any length is encoded whole. Repeated rows and rows with a null id come
    back one by one; extra columns, whatever their names, are left out; an empty table gives an empty result.
    """
    codec = _codec(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec.value
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in filled(batch, "text"):
                joined = bpe.encode_joined(text.as_py())
                n.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode_joined(joined)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_with_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256: the ids of each whole text, and proof that they decode to it.

    Nulls, long texts, repeats, extra columns and empty tables are as in round_trip_digests().
    """
    codec = _codec(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec.value
        for batch in batches:
            for a, b in passes(filled(batch, "text")):
                joined = [bpe.encode_joined(t.as_py()) for t in filled(batch, "text")[a:b]]
                ids = [np.fromiter(map(int, j.split(",")), np.int32) if j else np.zeros(0, np.int32) for j in joined]
                ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                digests = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in ((j.encode() for j in joined), map(bpe.decode_joined, joined))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(ends).astype(np.int64)), lists, *digests], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
