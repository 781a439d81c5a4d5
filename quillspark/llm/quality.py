"""Quality rules: text statistics, and cutoffs certified on labelled holdouts to reject few good documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, materialise, passes
from .vectext import IS_SPACE, STARTS_CHAR, Words, per_text, raw_bytes, window_hashes, words_of

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
WINDOW = 5
#: Rules: a document is rejected if its value, in thousandths, is at or above the cutoff. One direction each.
RULES = {
    "symbol_share": "symbols per word character",
    "upper_share": "A-Z per word character",
    "dup_line_share": "repeated lines per line with a word",
    "repeat_share": "words in repeated windows per word",
    "long_words": "word characters per word, over 40",
}
LEVELS = 1001
#: Share of good documents that all rules together may reject in a stratum, with this confidence over all tests.
FALSE_REJECTION, ALPHA = 0.02, 0.05

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def repeated_words(words: Words) -> np.ndarray:
    """Per text, the words inside 5-word windows that occur twice or more in that text (first occurrence included)."""
    codes, bounds = words.codes, words.bounds
    n_texts, n = len(bounds) - 1, len(codes) - WINDOW + 1
    if n <= 0:
        return np.zeros(n_texts, np.int64)
    text = np.repeat(np.arange(n_texts), np.diff(bounds))
    at = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    h = window_hashes(words.hashes()[codes], WINDOW)[at] + text[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    order = np.argsort(h, kind="stable")
    near = np.flatnonzero(h[order][1:] == h[order][:-1])
    left, right = at[order[near]], at[order[near + 1]]
    same = text[left] == text[right]
    for k in range(WINDOW):  # hashes only propose; the words decide
        same &= codes[left + k] == codes[right + k]
    mark = np.zeros(len(codes) + 1, np.int64)
    for side in (left[same], right[same]):
        side = np.unique(side)
        np.add.at(mark, side, 1)
        np.add.at(mark, side + WINDOW, -1)
    return per_text(np.cumsum(mark)[:-1] > 0, bounds)


def lines_with_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines (split at \\n) that hold a word, and those of them that equal an earlier line of the text."""
    data, offsets = raw_bytes(texts)
    n_texts = len(offsets) - 1
    newline = data == 10
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True
    begins[1:] |= newline
    begins = np.flatnonzero(begins[: len(data)])
    if not len(begins):
        return np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
    kept = np.append(0, np.cumsum(~newline)).astype(np.int32)
    packed = np.ascontiguousarray(data[~newline])
    ends = np.append(kept[begins], len(packed)).astype(np.int32)
    lines = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
    codes = np.asarray(lines.dictionary_encode().indices).astype(np.int64)
    worded = np.add.reduceat(~IS_SPACE[data], begins, dtype=np.int64) > 0
    text = np.searchsorted(offsets, begins, side="right") - 1
    key = (text[worded] << 32) | codes[worded]
    total = np.bincount(text[worded], minlength=n_texts)
    distinct = np.bincount(np.unique(key) >> 32, minlength=n_texts)
    return total, total - distinct


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """STATS of each text of a small array."""
    data, offsets = raw_bytes(texts)
    words = words_of(texts, lower=False)
    lines, dup = lines_with_words(texts)
    return {
        "n_words": np.diff(words.bounds), "word_chars": per_text(STARTS_CHAR[data] & ~IS_SPACE[data], offsets), "n_symbols": per_text(SYMBOLS[data], offsets),
        "n_dup_lines": dup, "n_repeat_words": repeated_words(words), "n_lines": lines, "n_upper": per_text(_UPPER[data], offsets),
    }


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and STATS of each whole text; null text has zeros, a null stratum is 'und'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch, "text")
            for a, b in passes(texts):
                stats = text_stats(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *(pa.array(stats[k], pa.int64()) for k in STATS)], ["doc_id", "stratum", *STATS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("und")).alias("stratum"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, stratum string, {', '.join(f'{k} long' for k in STATS)}")


def _levels() -> dict:
    """Each rule's value as a whole number of thousandths, 0 to 1000."""

    def share(a, b):
        return F.least(F.lit(LEVELS - 1), F.when(F.col(b) > 0, F.expr(f"{a} * 1000 div {b}")).otherwise(0)).cast("int")

    return {
        "symbol_share": share("n_symbols", "word_chars"), "upper_share": share("n_upper", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "long_words": F.least(F.lit(LEVELS - 1), F.when(F.col("n_words") > 0, F.expr("word_chars * 25 div n_words")).otherwise(0)).cast("int"),
    }


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    log_choose = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i])
    terms = log_choose + i * math.log(p) + (n - i) * math.log1p(-p)
    top = terms.max()
    return float(min(1.0, math.exp(top) * np.exp(terms - top).sum()))


def certified_cutoff(good: np.ndarray, bad: np.ndarray, limit: float, alpha: float) -> int:
    """The best cutoff whose share of rejected good documents is proven to be at most ``limit``.

    good, bad: counts by level. Cutoffs are tested in a fixed order from the highest level down, each by the exact
    binomial tail of its false rejections, and testing stops at the first that isn't proven, so the order needs no
    further correction. Among the proven ones that which rejects most bad documents less five times the good ones is
    taken, the highest of equals; LEVELS (no rejection) if none gains anything.
    """
    n, best, gain = int(good.sum()), LEVELS, 0
    false, hit = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    tested = -1
    for level in range(LEVELS - 1, 0, -1):
        k = int(false[level])
        if k != tested:
            if n == 0 or binomial_cdf(k, n, limit) > alpha:
                break
            tested = k
        if (now := int(hit[level]) - 5 * k) > gain:
            best, gain = level, now
    return best


def certify(stats: DataFrame, labels: DataFrame, limit: float = FALSE_REJECTION, alpha: float = ALPHA) -> dict[str, dict[str, int]]:
    """Cutoffs by stratum and rule. stats: with_stats(); labels: doc_id and good (1 good, 0 bad, others are left out).

    All labelled documents are the holdout: no rule is fitted before. Each rule gets its part of ``limit``, and alpha is
    divided by the number of (stratum, rule) families (Bonferroni). Only counts by level reach the driver: at most
    1,001 levels x rules x strata rows. Labels given more than once with different values count for good only.
    """
    levels = _levels()
    known = labels.where("good IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("good").alias("good"))
    long = stats.join(known, "doc_id").select("stratum", "good", F.explode(F.create_map(*(x for k, v in levels.items() for x in (F.lit(k), v)))).alias("rule", "level"))
    counts = long.groupBy("stratum", "rule", "level", "good").count().collect()
    strata = sorted({r.stratum for r in counts})
    cutoffs: dict[str, dict[str, int]] = {}
    for s in strata:
        for rule in RULES:
            by = np.zeros((2, LEVELS), np.int64)
            for r in counts:
                if r.stratum == s and r.rule == rule:
                    by[r.good, r.level] += r["count"]
            cutoffs.setdefault(s, {})[rule] = certified_cutoff(by[1], by[0], limit / len(RULES), alpha / (len(strata) * len(RULES)))
    return cutoffs


def judge(stats: DataFrame, cutoffs: dict[str, dict[str, int]]) -> DataFrame:
    """stats with base_failed and kept; a stratum without cutoffs is held to the base rules only."""
    failed = F.lit(False)
    levels = _levels()
    for stratum, rules in cutoffs.items():
        over = [levels[rule] >= cut for rule, cut in rules.items() if cut < LEVELS]
        if over:
            any_over = over[0]
            for x in over[1:]:
                any_over = any_over | x
            failed = failed | ((F.col("stratum") == stratum) & any_over)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.withColumn("base_failed", base).withColumn("kept", ~(base | failed))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", good: str = "quality") -> DataFrame:
    """doc_id, STATS, base_failed, kept for every row.

    Null and empty texts have no words and fail the base rules. Rows repeated with one id are judged one by one and
    count as often in the holdout. Without labels, or with too few to prove anything, only the base rules reject.
    A null stratum is
    'und'. Texts of any length are read whole; labels of an id that contradict each other count as good. Copies among the
    labelled count one by one, as the documents to be judged do, so the bounds hold for rows drawn like the holdout.
    Extra columns, whatever their names, are left out; an empty table gives an empty result.
    """
    stats = materialise(with_stats(docs, id_col, text_col, stratum), "quality-stats")
    cutoffs = certify(stats, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(good).cast("int").alias("good")))
    return judge(stats, cutoffs).drop("stratum")


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", good: str = "quality") -> DataFrame:
    """The documents that quality_rules() keeps, whole. The statistics are computed once to find the cutoffs and again
    beside the documents, which costs less than dealing all texts out for a join.

    Null, empty and short texts fail the base rules; a null stratum is one of its own; repeated rows and rows with a null id
    are judged one by one, by their own text; values at a cutoff are kept; long texts are read whole. All columns stay,
    whatever their names. Without labels only the base rules reject; an empty table gives an empty result."""
    stats = materialise(with_stats(docs, id_col, text_col, stratum), "quality-stats")
    cutoffs = certify(stats, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(good).cast("int").alias("good")))
    whole = docs.select(F.struct(*docs.columns).alias("whole"), F.coalesce(F.col(stratum).cast("string"), F.lit("und")).alias("stratum"), F.col(text_col).cast("string").alias("text"))
    kind = whole.schema["whole"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch, "text")
            for a, b in passes(texts):
                found = text_stats(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *(pa.array(found[k], pa.int64()) for k in STATS)], ["whole", "stratum", *STATS])

    rows = whole.mapInArrow(run, f"whole {kind}, stratum string, {', '.join(f'{k} long' for k in STATS)}")
    return judge(rows, cutoffs).where("kept").select(*(F.col("whole")[c].alias(c) for c in docs.columns))
