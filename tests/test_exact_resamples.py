import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import stats


@pytest.mark.parametrize("block", [1024, 16])
def test_every_resample_is_whole(spark, monkeypatch, block):
    monkeypatch.setattr(stats, "BLOCK_ROWS", block)
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), F.lit(1).alias("one"), (F.col("id") % 7).alias("x")).withColumn("g", F.when(F.col("g") < 2, F.col("g")))
    runs = [{(r.g, r.resample): (r.one, r.x) for r in stats.exact_sums(df.repartition(n), 300, "id", ["one", "x"], ["g"]).collect()} for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 900
    sizes = {0: 167, 1: 167, None: 166}
    assert all(one == sizes[g] for (g, _), (one, _) in runs[0].items())
    assert len({x for _, x in runs[0].values()}) > 100


def test_weights_are_those_of_draws(spark):
    """A row's weight has mean 1 and variance 1 - 1/n, two rows' covariance is -1/n: one row in blocks far apart."""
    n, b = 64, 4000
    df = spark.range(n).select("id", *((F.col("id") == k).cast("int").alias(f"w{k}") for k in (0, 1, 40)))
    for rows in (8, 1024):
        stats.BLOCK_ROWS, before = rows, stats.BLOCK_ROWS
        try:
            w = np.array([[r.w0, r.w1, r.w40] for r in stats.exact_sums(df, b, "id", ["w0", "w1", "w40"]).collect()])
        finally:
            stats.BLOCK_ROWS = before
        cov = np.cov(w.T)
        assert np.allclose(w.mean(0), 1, atol=0.07) and np.allclose(np.diag(cov), 1 - 1 / n, atol=0.12)
        assert np.all(np.abs(cov - np.diag(np.diag(cov)) + (1 - np.eye(3)) / n) < 0.07)


def test_intervals_by_either_draw(spark):
    df = spark.range(400).select("id", (F.col("id") % 5).alias("e"), F.lit(4).alias("n"))
    a, b = (stats.bootstrap_interval(df, 800, "id", "e", "n", [], draw=d).first() for d in (stats.exact_sums, stats.resampled_sums))
    assert a.rate == b.rate == 0.5 and abs(a.low - b.low) < 0.02 and abs(a.high - b.high) < 0.02
    x = stats.paired_metric_test(df.withColumn("f", F.col("e") + 1), 500, "id", ["e", "f", "n"], lambda s: s["e"] / s["n"], lambda s: s["f"] / s["n"], draw=stats.exact_sums).first()
    assert x.delta == x.delta_low == x.delta_high == -0.25


def test_holm_by_blocks(spark):
    rng = np.random.default_rng(3)
    data = [(f, i, float(p)) for f in ("a", "b") for i, p in enumerate(np.round(rng.random(300) ** 3, 4))]
    got = {(r.f, r.i): r.p_holm for r in stats.holm(spark.createDataFrame(data, "f string, i long, p double"), "p", "f").collect()}
    for f in ("a", "b"):
        top, own = 0.0, sorted((p, i) for g, i, p in data if g == f)
        for k, (p, i) in enumerate(own):
            top = max(top, min(1.0, p * (len(own) - k)))
            assert got[f, i] == pytest.approx(top)
