import random
import resource

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import alignment


def table_of(ref, hyp):
    """Cell by cell: substitutions, deletions, insertions and the substituted words, a match or substitution first."""
    d = [[j if i == 0 else i if j == 0 else 0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i in range(1, len(ref) + 1):
        for j in range(1, len(hyp) + 1):
            d[i][j] = min(d[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    i, j, dels, ins, subs = len(ref), len(hyp), 0, 0, []
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            if ref[i] != hyp[j]:
                subs.append((ref[i], hyp[j]))
        elif i and d[i][j] == d[i - 1][j] + 1:
            i, dels = i - 1, dels + 1
        else:
            j, ins = j - 1, ins + 1
    return len(subs), dels, ins, subs[::-1]


def some_pairs():
    rng = random.Random(7)
    word = lambda letters: rng.choice(letters) + rng.choice(["", "é", "ক"])
    return [([word("abc") for _ in range(rng.choice([0, 1, 2, 9, 33]))], [word("abd") for _ in range(rng.choice([0, 1, 4, 17, 40]))]) for _ in range(150)]


@pytest.mark.parametrize("cells", [4_000_000, 2000, 50])
def test_every_pair(monkeypatch, cells):
    monkeypatch.setattr(alignment, "CELLS", cells)
    pairs = some_pairs()
    a, b, words = alignment.coded(*(pa.array([p[k] for p in pairs], pa.list_(pa.string())) for k in (0, 1)))
    counts, owner, place = alignment.alignments(a, b)
    for k, (ref, hyp) in enumerate(pairs):
        sub, dels, ins, subs = table_of(ref, hyp)
        assert tuple(counts[:, k]) == (sub, dels, ins) and [(ref[x], hyp[y]) for x, y in place[owner == k]] == subs
    assert alignment.distances(a, b).tolist() == [sum(table_of(*p)[:3]) for p in pairs]


def test_columns(spark):
    pairs = [*some_pairs()[:40], (None, ["x"]), ([], []), (["x"], None)]
    df = spark.createDataFrame(pairs, "r array<string>, h array<string>").coalesce(1)
    for row, (ref, hyp) in zip(df.select(alignment.alignment("r", "h").alias("a"), alignment.edit_distance("r", "h").alias("d")).collect(), pairs, strict=True):
        sub, dels, ins, subs = table_of(ref or [], hyp or [])
        assert (row.a["sub"], row.a["del"], row.a["ins"], [tuple(p) for p in row.a["pairs"]]) == (sub, dels, ins, subs) and row.d == sub + dels + ins


def test_a_long_pair_needs_little_memory():
    rng = np.random.default_rng(4)
    ref = rng.integers(0, 500, 6000).astype(np.int32)
    hyp = np.delete(ref, np.arange(0, 6000, 50))
    hyp[::70] = 999
    lists = lambda x: alignment.Lists(x, np.array([0, len(x)]))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    counts, _, place = alignment.alignments(lists(ref), lists(hyp))
    assert counts[1] - counts[2] == 120 and counts.sum() == alignment.distances(lists(ref), lists(hyp))[0] and len(place) == counts[0]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 80_000  # kB; the whole table has 140,000
