"""Bootstrap intervals and tests, effect sizes, corrections. Resampling is by hashes, so results can be repeated."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .split import block_rank, spread_rank

#: Weights (rows times resamples) that a task holds at a time.
HELD_WEIGHTS = 2_000_000
#: Rows of a block of exact_sums().
BLOCK_ROWS = 1024
#: Thresholds of the Poisson(1) distribution for a hash of 32 bits: P(0), P(0) + P(1) and so on.
_THRESHOLDS = [int(2**32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(8)]
#: Odd constants of the mixing of 64-bit numbers (splitmix64).
_STEP, _MIX_1, _MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def order_statistic(values: Column, q: float) -> Column:
    """The value at place floor(q * n) of the sorted array."""
    return F.element_at(F.array_sort(values), F.least(F.floor(F.size(values) * q).cast("int") + 1, F.size(values)))


def poisson_weights(keys: np.ndarray, resamples: np.ndarray, seed: int) -> np.ndarray:
    """A Poisson(1) weight for each key and resample from a hash of both: the thresholds that its upper half reaches."""
    h = (keys.astype(np.int64).view(np.uint64)[:, None] + np.uint64(seed)) * np.uint64(_STEP) + resamples.astype(np.uint64)[None] * np.uint64(_MIX_1)
    h ^= h >> np.uint64(30)
    h *= np.uint64(_MIX_1)
    h ^= h >> np.uint64(27)
    h *= np.uint64(_MIX_2)
    top = (h >> np.uint64(32)).astype(np.uint32)
    out = np.zeros(top.shape, np.float64)
    for t in _THRESHOLDS:
        out += top >= np.uint32(t)
    return out


def _node_draws(n: int, block: int, b: int, seed: int) -> np.ndarray:
    """How many of the n draws of each of b resamples fall into a block of rows, by binomials down a tree of blocks.

    The same node has the same generator in whatever task it is needed, so blocks' draws add up without being exchanged.
    """
    low, high, draws = 0, -(-n // BLOCK_ROWS), np.full(b, n, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        rows, left = min(n, high * BLOCK_ROWS) - low * BLOCK_ROWS, (middle - low) * BLOCK_ROWS
        first = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, n, low, high]))).binomial(draws, left / rows)
        draws, low, high = (first, low, middle) if block < middle else (draws - first, middle, high)
    return draws


def exact_sums(rows: DataFrame, b: int, key: str, sums: list[str], by: list[str] = [], seed: int = 42) -> DataFrame:  # noqa: B006
    """As resampled_sums(), but each resample is a draw of exactly as many rows as there are, with replacement, from the rows
    of each group.

    Rows are numbered in the order of a hash of their key, which has to be unique in a group, and cut into blocks of
    BLOCK_ROWS. Each block finds its own number of draws and deals them among its rows; so results don't depend on
    partitions, and a row for each resample, group and task is shuffled.
    """
    base = rows.select(F.struct(*by).alias("_by") if by else F.lit(0).alias("_by"), F.col(key).alias("_key"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_{i}") for i, c in enumerate(sums)))
    names, kind = [f"_{i}" for i in range(len(sums))], base.schema["_by"].dataType.simpleString()
    sizes = base.groupBy("_by").agg(F.count(F.lit(1)).alias("_all")).withColumnRenamed("_by", "_own")
    ranked = spread_rank(base, ["_by"], "_rank", seed, "_key").join(sizes, F.col("_by").eqNullSafe(F.col("_own")))
    placed = ranked.select("_by", F.to_json(F.struct("_by")).alias("_name"), "_all", F.expr(f"(_rank - 1) div {BLOCK_ROWS}").alias("_block"), "_rank", *names)
    placed = placed.repartition("_name", "_block").sortWithinPartitions("_name", "_block", "_rank").drop("_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, groups = {}, {}

        def add(table: pa.Table) -> None:
            name, n, block, m = table["_name"][0].as_py(), table["_all"][0].as_py(), table["_block"][0].as_py(), table.num_rows
            groups.setdefault(name, table["_by"].chunk(0).slice(0, 1))
            held, values = total.setdefault(name, np.zeros((b, len(names)))), np.stack([np.asarray(table[c]) for c in names], 1)
            draws = _node_draws(n, block, b, seed)
            own = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, n, block])))
            for s in range(0, b, max(1, HELD_WEIGHTS // m)):
                part = slice(s, s + max(1, HELD_WEIGHTS // m))
                held[part] += own.multinomial(draws[part], np.full(m, 1 / m)) @ values

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            marks = np.asarray(table["_block"]), np.asarray(table["_name"].combine_chunks().dictionary_encode().indices)
            cuts = [0, *(np.flatnonzero((marks[0][1:] != marks[0][:-1]) | (marks[1][1:] != marks[1][:-1])) + 1).tolist()]
            for start, end in zip(cuts, cuts[1:], strict=False):
                add(table.slice(start, end - start))
            rest = table.slice(cuts[-1])
        if rest is not None:
            add(rest)
        for name, held in total.items():
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([groups[name]] * b), pa.array(np.arange(b)), *(pa.array(held[:, i]) for i in range(len(names)))], ["_by", "resample", *names])

    drawn = placed.mapInArrow(run, f"_by {kind}, resample long, " + ", ".join(f"{n} double" for n in names))
    whole = drawn.groupBy("_by", "resample").agg(*(F.sum(n).alias(c) for n, c in zip(names, sums, strict=True)))
    return whole.select(*(F.col("_by")[c].alias(c) for c in by), "resample", *sums)


def resampled_sums(rows: DataFrame, b: int, key: str, sums: list[str], by: list[str] = [], seed: int = 42) -> DataFrame:  # noqa: B006
    """by, resample and weighted sums of columns for b Poisson resamples of rows (or of clusters, given their sums).

    A row's weight in a resample is a hash of its key (a whole number, or the hash of anything else), so results don't
    depend on partitions. Each task draws all weights of some rows at a time as a matrix and adds up its products; only a
    row for each resample and group leaves it.
    """
    number = F.col(key).cast("long") if dict(rows.dtypes)[key] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(key)
    picked = rows.select(number.alias("_key"), F.struct(*by).alias("_by") if by else F.lit(0).alias("_by"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_{i}") for i, c in enumerate(sums)))
    kind = picked.schema["_by"].dataType.simpleString()
    names = [f"_{i}" for i in range(len(sums))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws, total, groups = np.arange(b), {}, {}
        for batch in batches:
            keys = np.asarray(batch.column(0).fill_null(0))
            values = np.stack([np.asarray(batch.column(2 + i)) for i in range(len(names))], 1)
            coded = pa.array([str(x) for x in batch.column(1).to_pylist()]).dictionary_encode()
            codes = np.asarray(coded.indices)
            for code, name in enumerate(coded.dictionary.to_pylist()):
                mine = np.flatnonzero(codes == code)
                groups.setdefault(name, batch.column(1).slice(mine[0], 1))
                held = total.setdefault(name, np.zeros((b, len(names))))
                size = max(1, HELD_WEIGHTS // b)
                for s in range(0, len(mine), size):
                    some = mine[s : s + size]
                    held += poisson_weights(keys[some], draws, seed).T @ values[some]
        for name, held in total.items():
            out = pa.concat_arrays([groups[name]] * b) if b else groups[name].slice(0, 0)
            yield pa.RecordBatch.from_arrays([out, pa.array(draws), *(pa.array(held[:, i]) for i in range(len(names)))], ["_by", "resample", *names])

    drawn = picked.mapInArrow(run, f"_by {kind}, resample long, " + ", ".join(f"{n} double" for n in names))
    whole = drawn.groupBy("_by", "resample").agg(*(F.sum(n).alias(c) for n, c in zip(names, sums, strict=True)))
    return whole.select(*(F.col("_by")[c].alias(c) for c in by), "resample", *sums)


def interval(drawn: DataFrame, value: Column, by: list[str] = [], level: float = 0.95) -> DataFrame:  # noqa: B006
    """by, low, high: the percentile interval of a function of resampled sums. b values a group, not rows."""
    tail = (1 - level) / 2
    values = drawn.groupBy(*by).agg(F.collect_list(value).alias("values"))
    return values.select(*by, F.round(order_statistic(F.col("values"), tail), 4).alias("low"), F.round(order_statistic(F.col("values"), 1 - tail), 4).alias("high"))


def metric_interval(rows: DataFrame, b: int, key: str, sums: list[str], metric: Callable[[dict[str, Column]], Column], by: list[str] = [], level: float = 0.95, seed: int = 42, draw: Callable[..., DataFrame] = resampled_sums) -> DataFrame:  # noqa: B006
    """by, value, low, high of any metric that is a function of sums, such as an error rate, F1 or survival. draw:
    resampled_sums, whose Poisson weights need no order of the rows, or exact_sums."""
    whole = rows.groupBy(*by).agg(*(F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in sums))
    of = metric({c: F.col(c) for c in sums})
    ends = interval(draw(rows, b, key, sums, by, seed), of, by, level)
    value = whole.select(*by, F.round(of, 4).alias("value"))
    return value.join(ends, by) if by else value.crossJoin(ends)  # one row each


def bootstrap_interval(rows: DataFrame, b: int, key: str, edits: str, n: str, by: list[str], level: float = 0.95, seed: int = 42, draw: Callable[..., DataFrame] = resampled_sums) -> DataFrame:
    """by, rate, low, high: the rate of all rows and its percentile interval."""
    return metric_interval(rows, b, key, [edits, n], lambda s: F.try_divide(s[edits], s[n]), by, level, seed, draw).withColumnRenamed("value", "rate")


def paired_metric_test(rows: DataFrame, b: int, key: str, sums: list[str], a: Callable[[dict[str, Column]], Column], other: Callable[[dict[str, Column]], Column], seed: int = 42, draw: Callable[..., DataFrame] = resampled_sums) -> DataFrame:
    """One row: the metrics a and other of two systems on the same items, their difference with its interval, relative
    reduction, and p-values. Both get the same weights in a resample; each may have a denominator of its own.

    p_one: share of resamples in which a isn't above other. p_two: twice the smaller tail, each with one added above and
    below, at most 1.
    """
    columns = {c: F.col(c) for c in sums}
    drawn = draw(rows, b, key, sums, [], seed).withColumn("d", a(columns) - other(columns))
    tails = drawn.agg(F.count("d").alias("b"), F.count_if(F.col("d") <= 0).alias("low"), F.count_if(F.col("d") >= 0).alias("high"), F.collect_list("d").alias("ds"))
    whole = rows.agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in sums)).select(a(columns).alias("a"), other(columns).alias("o"))
    both = whole.crossJoin(tails)  # one row each
    p_one = F.try_divide("low", "b")
    return both.select(
        F.round("a", 4).alias("rate_a"), F.round("o", 4).alias("rate_b"), F.round(F.col("a") - F.col("o"), 4).alias("delta"), F.round(order_statistic(F.col("ds"), 0.025), 4).alias("delta_low"),
        F.round(order_statistic(F.col("ds"), 0.975), 4).alias("delta_high"), F.round(100 * F.try_divide(F.col("a") - F.col("o"), F.col("a")), 2).alias("reduction_pct"), F.round(p_one, 4).alias("p_one"),
        F.round(F.least(F.lit(1.0), 2 * F.least((F.col("low") + 1) / (F.col("b") + 1), (F.col("high") + 1) / (F.col("b") + 1))), 4).alias("p_two"), (p_one < 0.05).alias("significant_05"), (p_one < 0.01).alias("significant_01"),
    )


def paired_test(rows: DataFrame, b: int, key: str, edits_a: str, edits_b: str, n: str, seed: int = 42) -> DataFrame:
    """paired_metric_test() of two error rates over one count of words."""
    return paired_metric_test(rows, b, key, [edits_a, edits_b, n], lambda s: F.try_divide(s[edits_a], s[n]), lambda s: F.try_divide(s[edits_b], s[n]), seed)


def paired_predictions(a: DataFrame, b: DataFrame, key: str = "clip_id") -> DataFrame:
    """Two systems' predictions of the same clips side by side: those both have, with hypothesis_a and hypothesis_b."""
    other = b.select(key, F.col("hypothesis").alias("hypothesis_b"))
    return a.withColumnRenamed("hypothesis", "hypothesis_a").join(other, key)


def cluster_resamples(clusters: DataFrame, b: int, key: str, sums: list[str], seed: int = 42, draw: Callable[..., DataFrame] = resampled_sums) -> DataFrame:
    """resample and resampled sums for b resamples of whole clusters (rows that are sums of a source)."""
    return draw(clusters, b, key, sums, [], seed)


def cohens_d(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Difference of means over the root of the mean variance; 0 with fewer than two rows or without spread."""
    spread = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)
    return rows.groupBy(*by).agg(F.round(F.coalesce(F.when((F.count(a) >= 2) & (F.count(b) >= 2) & (spread > 0), (F.avg(a) - F.avg(b)) / F.nullif(spread, F.lit(0.0))), F.lit(0.0)), 4).alias("cohens_d"))


def cohens_dz(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return rows.groupBy(*by).agg(F.round(F.coalesce(F.try_divide(F.avg(d), F.stddev_samp(d)), F.lit(0.0)), 4).alias("cohens_dz"))


def holm(tests: DataFrame, p: str = "p", *by: str) -> DataFrame:
    """tests with p_holm: p times the number of hypotheses left, never below the one before, at most 1.

    Hypotheses are placed in blocks of p-values (a thousandth of the values from 0 to 1 each), and the largest value so far
    comes from a block's own rows and from one row for each block before it; so a family is never ordered in one task.
    """
    sizes = tests.groupBy(*by).agg(F.count(F.lit(1)).alias("_all")).select(*(F.col(c).alias(f"_of_{c}") for c in by), "_all")
    block = F.floor(F.coalesce(F.col(p).cast("double"), F.lit(-0.001)) * 1000).cast("int")
    ranked = block_rank(tests, list(by), "_order", block, [F.col(p)])
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by), F.lit(True))
    ranked = ranked.join(sizes, same) if by else ranked.crossJoin(sizes)  # one row
    ranked = ranked.withColumns({"_step": F.least(F.lit(1.0), F.col(p) * (F.col("_all") - F.col("_order") + 1)), "_block": block})
    own = F.max("_step").over(Window.partitionBy(*by, "_block").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0))
    tops = ranked.groupBy(*by, "_block").agg(F.max("_step").alias("_top"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*(F.col(c).alias(f"_at_{c}") for c in by), F.col("_block").alias("_b"), F.max("_top").over(before).alias("_before"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in by), F.col("_block") == F.col("_b"))
    out = ranked.withColumn("_own", own).join(tops, same)
    return out.withColumn("p_holm", F.greatest("_own", "_before")).select(*tests.columns, "p_holm")


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "*").otherwise("")


def macro_gap(statistics: DataFrame, flag: str, *by: str) -> DataFrame:
    """Mean of rates over the items of each subset, and their difference."""
    wer = F.try_divide("word_edits", "n_words")
    cs, other = F.avg(F.when(F.col(flag), wer)), F.avg(F.when(~F.col(flag), wer))
    return statistics.groupBy(*by).agg(F.round(cs, 4).alias("macro_cs"), F.round(other, 4).alias("macro_other"), F.round(cs - other, 4).alias("gap"))
