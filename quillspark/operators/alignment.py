"""Edit distance and alignment of pairs of word lists, many pairs at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Cells of the tables that are held at a time (4 bytes each). A pair with more keeps some rows and makes the others again.
CELLS = 4_000_000
_FAR = np.int32(1 << 30)


class Lists:
    """Word lists as numbers: ``codes[bounds[k] : bounds[k + 1]]`` are those of list k; a null list is empty."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        self.codes, self.bounds, self.sizes = codes, bounds, np.diff(bounds)

    def one(self, k: int) -> np.ndarray:
        return self.codes[self.bounds[k] : self.bounds[k + 1]]

    def padded(self, which: np.ndarray, fill: int) -> np.ndarray:
        out = np.full((len(which), int(self.sizes[which].max(initial=0))), fill, np.int32)
        inside = np.arange(out.shape[1]) < self.sizes[which][:, None]
        out[inside] = np.concatenate([self.one(k) for k in which]) if len(which) else 0
        return out


def coded(a: pa.Array, b: pa.Array) -> tuple[Lists, Lists, pa.Array]:
    """Both columns of word lists by one numbering of their words, and the words."""
    flat = [x.flatten() for x in (a, b)]
    words = pa.concat_arrays(flat).dictionary_encode(null_encoding="encode")
    codes = np.asarray(words.indices).astype(np.int32)
    sizes = [np.asarray(x.value_lengths().fill_null(0)) for x in (a, b)]
    bounds = [np.append(0, np.cumsum(s)).astype(np.int64) for s in sizes]
    return Lists(codes[: len(flat[0])], bounds[0]), Lists(codes[len(flat[0]) :], bounds[1]), words.dictionary


def _next(above: np.ndarray, i: int, ref: np.ndarray, hyp: np.ndarray) -> np.ndarray:
    """Row i of the tables (pairs, len(hyp) + 1): what comes from above, then the least of what lies to the left."""
    row = np.empty_like(above)
    row[:, 0] = i
    np.minimum(above[:, :-1] + (ref[:, None] != hyp), above[:, 1:] + 1, out=row[:, 1:])
    steps = np.arange(row.shape[1], dtype=np.int32)
    row -= steps
    np.minimum.accumulate(row, axis=1, out=row)
    row += steps
    return row


def _chunks(n: np.ndarray, m: np.ndarray, whole: bool) -> Iterator[np.ndarray]:
    """Pairs of about the same lengths, as many as fit into CELLS; those that don't fit alone come alone."""
    order = np.lexsort((m, n))
    start = 0
    while start < len(order):
        end, longest = start, 0
        while end < len(order):
            longest = max(longest, int(m[order[end]]) + 1)
            rows = int(n[order[end]]) + 1 if whole else 2
            if end > start and (end + 1 - start) * rows * longest > CELLS:
                break
            end += 1
        yield order[start:end]
        start = end


def distances(a: Lists, b: Lists) -> np.ndarray:
    """Unit-cost edit distances of the pairs, two rows of each table at a time."""
    out = np.zeros(len(a.sizes), np.int32)
    for which in _chunks(a.sizes, b.sizes, whole=False):
        ref, hyp, n, m = a.padded(which, -1), b.padded(which, -2), a.sizes[which], b.sizes[which]
        row = np.tile(np.arange(hyp.shape[1] + 1, dtype=np.int32), (len(which), 1))
        for i in range(ref.shape[1] + 1):
            if i:
                row = _next(row, i, ref[:, i - 1], hyp)
            done = np.flatnonzero(n == i)
            out[which[done]] = row[done, m[done]]
    return out


def _traced(tables: np.ndarray, ref: np.ndarray, hyp: np.ndarray, i: np.ndarray, j: np.ndarray, low: int = 0) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Steps back from (i, j) of each pair, in place, as far as the rows ``low`` and on are there.

    Of equal ways a match or substitution is taken before a deletion, and that before an insertion. Returns deletions and
    insertions, and the substitutions as (pair, place in ref, place in hyp), the last ones first.
    """
    counts, found, pair = np.zeros((2, len(i)), np.int64), [], np.arange(len(i))
    while True:
        on = pair[(i > low) | ((j > 0) & (low == 0))] if low == 0 else pair[i > low]
        if not len(on):
            return counts, found
        x, y = i[on], j[on]
        here = tables[x - low, on, y]
        up_row = np.maximum(x - 1, low) - low
        differ = ref[on, np.maximum(x - 1, 0)] != hyp[on, np.maximum(y - 1, 0)] if ref.shape[1] and hyp.shape[1] else np.ones(len(on), bool)
        diagonal = np.where((x > low) & (y > 0), tables[up_row, on, np.maximum(y - 1, 0)] + differ, _FAR)
        up = np.where(x > low, tables[up_row, on, y] + 1, _FAR)
        straight = here == diagonal
        deleted = ~straight & (here == up)
        counts[0, on[deleted]] += 1
        counts[1, on[~straight & ~deleted]] += 1
        changed = straight & differ
        found.append((on[changed], x[changed] - 1, y[changed] - 1))
        i[on] = x - (straight | deleted)
        j[on] = y - (straight | ~deleted)


def alignments(a: Lists, b: Lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Substitutions, deletions and insertions of each pair; and of each substitution its pair and the two places, in the
    order of the pairs and then of the text.

    A table larger than CELLS isn't held: about the square root of its rows are, from which the others are made again, a
    part at a time, on the way back.
    """
    counts = np.zeros((3, len(a.sizes)), np.int64)
    owners, places = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
    for which in _chunks(a.sizes, b.sizes, whole=True):
        ref, hyp = a.padded(which, -1), b.padded(which, -2)
        i, j = a.sizes[which].astype(np.int64), b.sizes[which].astype(np.int64)
        rows, width = ref.shape[1], hyp.shape[1] + 1
        step = rows + 1 if len(which) * (rows + 1) * width <= CELLS else int(np.ceil(np.sqrt(rows)))
        row = np.tile(np.arange(width, dtype=np.int32), (len(which), 1))
        kept = {0: row}
        for k in range(1, rows + 1 if step <= rows else 0):
            row = _next(row, k, ref[:, k - 1], hyp)
            if k % step == 0:
                kept[k] = row
        subs: list[tuple[np.ndarray, ...]] = []
        for low in sorted(kept, reverse=True):
            tables = np.empty((min(step, rows - low) + 1, len(which), width), np.int32)
            tables[0] = kept[low]
            for k in range(1, len(tables)):
                tables[k] = _next(tables[k - 1], low + k, ref[:, low + k - 1], hyp)
            more, found = _traced(tables, ref, hyp, i, j, low)
            counts[1:, which] += more
            subs += found
        pair = np.concatenate([x[0] for x in subs[::-1]]) if subs else np.zeros(0, np.int64)
        place = np.stack([np.concatenate([x[k] for x in subs[::-1]]) for k in (1, 2)], 1) if subs else np.zeros((0, 2), np.int64)
        np.add.at(counts[0], which[pair], 1)
        owners.append(which[pair])
        places.append(place)
    owner, place = np.concatenate(owners), np.concatenate(places)
    order = np.lexsort((place[:, 0], owner))
    return counts, owner[order], place[order]


@F.arrow_udf(IntegerType())
def edit_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Unit-cost edit distance of two arrays of words; a null array counts as an empty one."""
    x, y, _ = coded(a, b)
    return pa.array(distances(x, y), pa.int32())


_PAIR = StructType([StructField("ref", StringType()), StructField("hyp", StringType())])
_EDITS = StructType([*(StructField(k, LongType()) for k in ("sub", "del", "ins")), StructField("pairs", ArrayType(_PAIR))])


@F.arrow_udf(_EDITS)
def alignment(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit operations of two arrays of words: how many of each, and the substituted pairs in order. The time is the
    product of the lengths, the memory grows with the larger one and the square root of the other."""
    x, y, words = coded(a, b)
    counts, owner, place = alignments(x, y)
    pairs = pa.StructArray.from_arrays([words.take(pa.array(lists.codes[lists.bounds[owner] + place[:, k]])) for k, lists in enumerate((x, y))], ["ref", "hyp"])
    bounds = np.searchsorted(owner, np.arange(len(a) + 1)).astype(np.int32)
    return pa.StructArray.from_arrays([*(pa.array(c) for c in counts), pa.ListArray.from_arrays(pa.array(bounds), pairs)], ["sub", "del", "ins", "pairs"])
