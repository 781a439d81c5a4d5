"""Mixing sources to target weights by temperature, realised as budgeted block permutations; DataFrame functions only."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

WORD = r"[^ \t\n\x0B\f\r]+"
#: Exponents are whole multiples of 1/STEPS.
STEPS = 1 << 20
#: Documents of a block on average, and sources up to which their plan is broadcast.
BLOCK_DOCS, BROADCAST_SOURCES = 4096, 100_000
#: Weights are whole billionths.
UNIT = 1_000_000_000


@dataclass(frozen=True)
class Target:
    """entropy: share of the largest possible entropy of the weights, None for no target. repetition: how often a source
    may be repeated at most, None for no limit. The flattest weights that meet both are taken."""

    entropy: float | None = 0.95
    repetition: float | None = 3.0


def _weights(tokens: list[int], k: int) -> list[float]:
    """Weights at an exponent; shares are taken of the largest one, so that a large exponent leaves something of it."""
    top = max(tokens)
    powers = [(t / top) ** (k / STEPS) if t else 0.0 for t in tokens]
    z = sum(powers)
    return [p / z for p in powers]


def _entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w)


def exponent(tokens: list[int], target: Target, budget: int) -> int:
    """The least exponent, in units of 1/STEPS, whose weights meet the target.

    Up to the exponent 1 a larger one lowers the largest repetition, and everywhere it lowers the entropy, so each is
    bisected on its own; the upper end for the entropy is doubled until it meets the target. If the entropy asks for an
    exponent at which a source would be repeated too often, the limit of repetition decides; 1 (the sources' own shares) if
    nothing meets them. Nothing meets an entropy below that of equal weights for all the largest sources.
    """
    known = [t for t in tokens if t]
    total = sum(known)

    def low_entropy(k: int) -> bool:
        return _entropy(_weights(known, k)) <= target.entropy * math.log(len(known)) + 1e-12

    def few_repeats(k: int) -> bool:
        return max(w * total / t for w, t in zip(_weights(known, k), known, strict=True)) * budget / total <= target.repetition + 1e-12

    def least(meets, high: int) -> int:
        low = 0
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if meets(mid) else (mid + 1, high)
        return low

    by_entropy = 0
    if target.entropy is not None:
        by_entropy = STEPS
        if math.log(known.count(max(known))) < target.entropy * math.log(len(known)):  # what the entropy comes down to
            while not low_entropy(by_entropy):
                by_entropy *= 2
            by_entropy = least(low_entropy, by_entropy)
    if target.repetition is None:
        return by_entropy
    by_repetition = least(few_repeats, STEPS)
    return by_entropy if by_entropy > by_repetition and few_repeats(by_entropy) else by_repetition


def entropy_share(tokens: list[int], k: int) -> float:
    """Entropy of the weights at an exponent, as a share of the largest possible."""
    known = [t for t in tokens if t]
    return _entropy(_weights(known, k)) / math.log(len(known)) if len(known) > 1 else 1.0


def _hash(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)).cast("binary"))


def mix_sources(docs: DataFrame, target: Target = Target(), budget: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, n_tokens, pass, block_rank, place: the documents to train on, in the order pass, block_rank, place.

    Tokens are words. A source's weight is its token share to the power found by bisection; its budget is the weight's
    part of ``budget`` (default: all tokens, so sources are up- or down-sampled within the same total). The budget is
    spent in passes; in each, the source's blocks, and the documents of each block, come in an order of their own. All
    passes but the last take every document, the last takes documents until its rest of the budget would be exceeded.

    Null text counts as empty; a null source is the source ''; documents without words cost nothing. Rows repeated with
    one id and source are one document, whose tokens are added up; equal hashes are ordered by id. Texts of any length are
    counted whole. Extra columns, whatever their names, are left out. An empty table, or one without words, gives an empty
    result. One row a source reaches the driver: sources are datasets or collections, whose weights someone sets. An
    entropy that the exponent doesn't reach is warned of: sources are too equal, or the limit of repetition decides.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("n_tokens"))
    units = materialise(rows.groupBy("doc_id", "source").agg(F.sum("n_tokens").alias("n_tokens")), "mix-units")
    by_source = sorted((r.source, r.t, r.n) for r in units.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect())
    total = sum(t for _, t, _ in by_source)
    spark = docs.sparkSession
    plan = []
    if total:
        budget = total if budget is None else budget
        k = exponent([t for _, t, _ in by_source], target, budget)
        if target.entropy is not None and (reached := entropy_share([t for _, t, _ in by_source], k)) > target.entropy + 1e-6:
            warnings.warn(f"the entropy of the weights is {reached:.4f} of the largest, not {target.entropy}: equal sources or the limit of repetition don't allow it", stacklevel=2)
        for (source, t, n), weight in zip(by_source, _weights([t for _, t, _ in by_source], k), strict=True):
            if t:
                passes, rest = divmod(round(weight * UNIT) * budget // UNIT, t)
                plan.append((source, passes, rest, -(-n // BLOCK_DOCS)))
    plan_rows = spark.createDataFrame(plan, "source string, passes long, rest long, blocks long")
    if len(plan) <= BROADCAST_SOURCES:
        plan_rows = F.broadcast(plan_rows)

    number = F.conv(F.substring(_hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    dealt = units.join(plan_rows, "source").withColumn("block", number % F.col("blocks"))
    full = dealt.where("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
    last = dealt.withColumn("pass", F.col("passes"))
    rows = full.unionByName(last)
    block_hash, doc_hash = _hash(seed, F.col("pass"), "block", F.col("block")), _hash(seed, F.col("pass"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    blocks = rows.groupBy("source", "pass", "block").agg(F.sum("n_tokens").alias("t"))
    order = Window.partitionBy("source", "pass").orderBy(block_hash, "block")
    blocks = blocks.select("source", "pass", "block", F.row_number().over(order).alias("block_rank"), (F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")).alias("before"))
    inside = Window.partitionBy("source", "pass", "block").orderBy("h", "doc_id")
    placed = rows.withColumn("h", doc_hash).select("doc_id", "source", "n_tokens", "pass", "passes", "rest", "block", F.row_number().over(inside).alias("place"), F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    placed = placed.join(blocks, ["source", "pass", "block"]).where("pass < passes OR before + upto <= rest")
    return placed.select("doc_id", "source", "n_tokens", "pass", F.col("block_rank").cast("long").alias("block_rank"), F.col("place").cast("long").alias("place"))


def mixed_documents(docs: DataFrame, target: Target = Target(), budget: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as often as mix_sources() takes them: not at all, once, or once in each of several passes.

    Null texts, ids and sources, ties, long texts and empty tables are as there; all columns stay, whatever their names.
    Rows repeated with one id and source are one document, taken whole or not at all: each of its rows comes as often as
    the document, whose tokens are those of all its rows.
    """
    mixed = mix_sources(docs, target, budget, seed, id_col, text_col, source_col)
    taken = mixed.groupBy(F.col("doc_id").alias("taken_id"), F.col("source").alias("taken_source")).agg(F.count(F.lit(1)).cast("int").alias("times"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("taken_id")) & (F.coalesce(F.col(source_col).cast("string"), F.lit("")) == F.col("taken_source"))
    whole = docs.join(taken.hint("merge"), same).select(F.struct(*docs.columns).alias("whole"), F.explode(F.sequence(F.lit(1), "times")).alias("turn"))
    return whole.select(*(F.col("whole")[c].alias(c) for c in docs.columns))
