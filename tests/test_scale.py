"""Operators whose work is cut into pieces give what plain code gives."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import audit, quality, split, stats
from quillspark.plans import corpus_queries


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_nearest_words_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
    dictionary, tokens = sorted({word() for _ in range(150)}), sorted({word() for _ in range(120)})
    want = {}
    for t in tokens:
        best = min(((-200.0 * lcs(t, w) / (len(t) + len(w)), w) for w in dictionary), default=None)
        if best and -best[0] >= 80:
            want[t] = (best[1], -best[0])
    rows = quality.nearest_words(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w,) for w in dictionary], "word string"))
    got = {r.token: (r.word, r.similarity) for r in rows.collect()}
    assert got.keys() == want.keys() and len(want) > 40
    assert all(got[t][0] == want[t][0] and abs(got[t][1] - want[t][1]) < 1e-9 for t in want)


def test_resampled_sums_equal_brute_force(spark):
    data = [(k, "ab"[k % 2], float(k % 5), 3.0) for k in range(40)]
    df = spark.createDataFrame(data, "key long, g string, e double, n double").repartition(3)
    got = {(r.g, r.resample): (r.e, r.n) for r in stats.resampled_sums(df, 25, "key", ["e", "n"], ["g"]).collect()}
    mask, out = (1 << 64) - 1, {}
    for k, g, e, n in data:
        for b in range(25):
            h = ((k + 42) * stats._STEP + b * stats._MIX_1) & mask
            h = ((h ^ h >> 30) * stats._MIX_1) & mask
            h = ((h ^ h >> 27) * stats._MIX_2) & mask
            w = sum(h >> 32 >= t for t in stats._THRESHOLDS)
            x = out.setdefault((g, b), [0.0, 0.0])
            x[0] += w * e
            x[1] += w * n
    assert got == {k: tuple(v) for k, v in out.items()}
    draws = stats.poisson_weights(np.arange(20_000), np.arange(3), 1)
    assert abs(draws.mean() - 1) < 0.02 and abs(draws.var() - 1) < 0.05


def test_spread_rank(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(200)] + [(900, None)], "key long, g long")
    got = {(r.g, r.key): r.place for r in split.spread_rank(df, ["g"], "place", 7, "key").collect()}
    h = lambda k: hashlib.md5(f"7|{k}".encode()).hexdigest()
    for g in (0, 1, 2):
        order = sorted((k for k in range(200) if k % 3 == g), key=lambda k: (h(k), k))
        assert [got[g, k] for k in order] == list(range(1, len(order) + 1))
    assert got[None, 900] == 1


def test_checksum_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(k,) for k in range(50)], "id long")
    one = audit.checksum(df, "id").first()
    assert one.checksum == hashlib.sha256("\n".join(sorted(map(str, range(50)))).encode()).hexdigest() and one.n == 50
    monkeypatch.setattr(audit, "BLOCK_KEYS", 10)
    a, b = (audit.checksum(df.repartition(n), "id").first() for n in (1, 4))
    assert a == b and a.n == 50 and a.checksum != one.checksum
    assert audit.checksum(df.where(F.lit(False)), "id").count() <= 1


def test_split_checksum_of_long_lists_is_that_of_the_sql(spark, monkeypatch, tmp_path):
    rows = [(k, None if k % 5 == 4 else f"s{k % 5}") for k in range(300)] + [(None, "s0"), (None, "empty")]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string").repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(audit, "BLOCK_KEYS", 10)
    want = {}
    for k, s in rows:
        want.setdefault(s, []).append(k)
    digest = lambda keys: hashlib.sha256("\n".join(keys).encode()).hexdigest() if keys else None
    want = {s: (digest(sorted(str(k) for k in keys if k is not None)), len(keys)) for s, keys in want.items()}
    got = corpus_queries.split_checksum(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.c_mktsegment: (r.checksum, r.n) for r in got} == want


def test_list_checksum_in_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(f"k{k:04d}" * (k % 4),) for k in range(500)], "id string").repartition(5)
    monkeypatch.setattr(audit, "PIECE_BYTES", 50)
    want = hashlib.sha256("\n".join(sorted(r.id for r in df.collect())).encode()).hexdigest()
    assert [tuple(r) for r in audit.list_checksum(df, "id").collect()] == [(want, 500)]
    assert not audit.list_checksum(df.where(F.lit(False)), "id").collect()


def test_components_equal_brute_force(spark, tmp_path):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(80)) for _ in range(75)]
    spark.createDataFrame(edges, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = root(("l", a)), root(("r", b))
        up[max(p, q)] = min(p, q)
    least = {}
    for a, _ in edges:
        least[root(("l", a))] = min(a, least.get(root(("l", a)), a))
    got = {r.l_orderkey: r.component for r in corpus_queries.components(spark, str(tmp_path)).collect()}
    assert got == {a: least[root(("l", a))] for a, _ in edges}
