import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import split
from quillspark.streaming import segments


def shares(sizes, seats):
    """Largest remainders; the order of equal ones is free, so only the sorted places are compared."""
    total = sum(sizes)
    whole = [n * seats // total for n in sizes]
    rest = sorted(((n * seats % total, n) for n in sizes), reverse=True)
    return sum(whole), rest


@pytest.mark.parametrize("n", [*range(1, 13), 60, 101])
def test_totals_are_those_of_a_fifth_rounded_up(spark, n):
    df = spark.range(n).select(F.col("id").alias("g"), F.expr("id div 4").alias("s"), F.lit(1).alias("o"))
    got = {r.split: r["count"] for r in split.group_split(df, "g", "s", "o").groupBy("split").count().collect()}
    held = 0 if n < 3 else -(-n // 5)
    test = -(-held // 2) if held > 1 else 0
    assert got == {k: v for k, v in (("train", n - held), ("validation", held - test), ("test", test)) if v}


def test_places_follow_the_sizes(spark):
    rng = random.Random(5)
    sizes = [rng.randint(1, 40) for _ in range(50)] + [7] * 20
    rows = [(g, s) for s, n in enumerate(sizes) for g in range(n)]
    df = spark.createDataFrame([(i, None if s == 3 else s, 1) for i, (_, s) in enumerate(rows)], "g long, s long, o int")
    got = split.group_split(df, "g", "s", "o").withColumn("held", F.col("split") != "train").groupBy("s").agg(F.count_if("held").alias("held"), F.count_if(F.col("split") == "test").alias("test"), F.count(F.lit(1)).alias("n")).collect()
    total, seats = len(rows), -(-len(rows) // 5)
    assert sum(r.held for r in got) == seats and sum(r.test for r in got) == -(-seats // 2) and len(got) == len(sizes)
    assert all(0 <= r.held - r.n * seats // total <= 1 for r in got) and all(0 <= r.test - r.held * -(-seats // 2) // seats <= 1 for r in got)
    more = [r.n * seats % total for r in got if r.held > r.n * seats // total]
    less = [r.n * seats % total for r in got if r.held == r.n * seats // total]
    assert min(more) >= max(less)


def walk(speech, padding=10):
    """Frame by frame: a run is closed at a silent frame that so many silent ones, or the end, follow."""
    out, start, n = [], None, len(speech)
    for i, s in enumerate(speech):
        if start is None and s:
            start = max(0, i - padding)
        elif start is not None and not s and not any(speech[i : i + padding]):
            out.append((start, min(n - 1, i + padding)))
            start = None
    return out + ([(start, n - 1)] if start is not None else [])


def sequences():
    rng = random.Random(2)
    out = [[False] * 20 + [True] * 30 + [False] * 40 + [True] * 5 + [False] * 10, [True], [False] * 5, [True] * 3 + [False] * 9 + [True], [False] * 30 + [True]]
    for _ in range(40):
        s = []
        while len(s) < 200:
            s += [rng.random() < 0.5] * rng.choice([1, 2, 5, 9, 10, 11, 12, 25])
        out.append(s[: rng.randint(1, 200)])
    return out


def test_batch_segments(spark):
    rows = [(k, i, s) for k, x in enumerate(sequences()) for i, s in enumerate(x)]
    got = split.speech_segments(spark.createDataFrame(rows, "g long, f long, s boolean"), "g", "f", "s").collect()
    assert sorted(map(tuple, got)) == sorted((k, *r) for k, x in enumerate(sequences()) for r in walk(x))


def test_runs_in_pieces():
    rng = random.Random(9)
    for speech in sequences():
        found, first, spoken, at = [], -1, -1, 0
        while at < len(speech):
            end = min(len(speech), at + rng.choice([1, 3, 17, 90]))
            voiced = np.array([i for i in range(at, end) if speech[i]], np.int64)
            runs, rest = segments.closed_runs(voiced, first, spoken, end - 1, end == len(speech), 10)
            found, (first, spoken), at = found + runs, rest or (-1, -1), end
        assert found == walk(speech)


def test_stream_goes_on_inside_a_run(spark, tmp_path):
    schema, out, mine = "g string, f long, s boolean", {}, sequences()[5]
    whole = [("a", i, s) for i, s in enumerate(mine)] + [("b", i, i % 30 < 4) for i in range(100)]
    for k in range(5):
        rows = [r for r in whole if r[1] * 4 // 200 == k] if k < 4 else [("a", None, None), ("b", None, None)]
        random.Random(k).shuffle(rows)
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        found = segments.speech_segments(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "g", "f", "s")
        found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        out.setdefault(r.g, []).append((r["first"], r["last"]))
    assert sorted(out["a"]) == walk(mine) and sorted(out["b"]) == walk([i % 30 < 4 for i in range(100)])
