"""Toxicity by non-negative positive-unlabelled learning: linear classifiers over hashed words, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, crc_mod, materialise, passes
from .vectext import words_of

#: Confirmed positives that the classifiers are fitted on at most (labelled rows; a parameter of learn()). Unlabelled
#: documents have no bound: all of them count, in shards of about SHARD_ROWS.
POSITIVES, SHARD_ROWS = 6_000, 65_536
#: Hash space of words, and words that the classifiers look at.
SPACE, FEATURES = 1 << 20, 512
#: Least gain (G statistic, halved) of a word that is looked at: against chance, and for each positive, against words
#: that only some copied texts share.
LEAST_GAIN, GAIN_SHARE = 5.0, 0.025
SEEDS, STEPS, RATE, DECAY = (1, 2, 3), 300, 0.05, 1e-6
#: The corrected negative risk may fall this far below zero before it is pushed back: its noise in a sample of this size.
SLACK = 0.01
#: Models of shards that one task adds up.
FAN_IN = 256
THRESHOLD = 0.7

#: Bytes between words here: all of ASCII but letters and digits.
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Toxicity:
    """chosen: sorted word buckets; weights, bias: one row for each classifier."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, text: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Mean probability for n texts, from (text, bucket) pairs without repeats."""
        out = np.zeros(n)
        for w, b in zip(self.weights, self.bias, strict=True):
            total = np.full(n, b)
            if len(self.chosen):
                place = np.minimum(np.searchsorted(self.chosen, bucket), len(self.chosen) - 1)
                total += np.bincount(text, np.where(self.chosen[place] == bucket, w[place], 0.0), n)
            out += 1 / (1 + np.exp(-np.clip(total, -50, 50)))
        return out / max(1, len(self.bias))


def word_buckets(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs of lower-cased words; only wanted (sorted) buckets if given."""
    words = words_of(texts, lower=True, between=_BREAK)
    bucket = (words.hashes() % np.uint64(SPACE)).astype(np.int64)[words.codes]
    text = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    if wanted is not None:
        keep = np.zeros(SPACE, bool)
        keep[wanted] = True
        keep = keep[bucket]
        bucket, text = bucket[keep], text[keep]
    key = np.unique(text * SPACE + bucket)
    return key // SPACE, key % SPACE


def _gain(p: Column, u: Column, n_p: int, n_u: int) -> Column:
    """G statistic, halved, of a word in p of n_p positives and u of n_u unlabelled documents, each raised by a half."""
    p, u = p + 0.5, u + 0.5
    both = (p + u) / (n_p + n_u + 2.0)

    def part(k: Column, n: float) -> Column:
        share = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), k / n))
        return k * F.log(share / both) + (n - k) * F.log((1 - share) / F.greatest(F.lit(1e-12), 1 - both))

    return part(p, n_p + 1.0) + part(u, n_u + 1.0)


def choose(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """The words (sorted buckets) whose document share differs most between positives and unlabelled, and how many of
    both there are. rows: text, positive; all of them are unlabelled documents, the positive ones positives too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SPACE + 1), np.int64)
        for batch in batches:
            for a, b in passes(batch.column(0)):
                text, bucket = word_buckets(batch.column(0)[a:b])
                positive = np.asarray(batch.column(1)[a:b].cast(pa.int8())).astype(bool)
                total[0, :SPACE] += np.bincount(bucket, minlength=SPACE)
                total[1, :SPACE] += np.bincount(bucket[positive[text]], minlength=SPACE)
                total[:, SPACE] += b - a, positive.sum()
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["bucket", "u", "p"])

    counts = rows.select("text", "positive").mapInArrow(run, "bucket long, u long, p long").groupBy("bucket").agg(F.sum("u").alias("u"), F.sum("p").alias("p"))
    counts = materialise(counts, "toxic-words")
    whole = counts.where(F.col("bucket") == SPACE).first()
    if whole is None:
        return np.zeros(0, np.int64), 0, 0
    gained = counts.where((F.col("bucket") < SPACE) & (F.col("p") + F.col("u") >= 3)).withColumn("gain", _gain(F.col("p"), F.col("u"), whole.p, whole.u))
    best = gained.where(F.col("gain") >= max(LEAST_GAIN, GAIN_SHARE * whole.p)).orderBy(F.desc("gain"), "bucket").limit(FEATURES).select("bucket").collect()
    return np.sort(np.array([r.bucket for r in best], np.int64)), whole.p, whole.u


def _marks(docs: DataFrame, chosen: np.ndarray) -> DataFrame:
    """id, positive, marks: which of the chosen words (places) each document has."""
    shared = Shared(docs.sparkSession, chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for a, b in passes(batch.column(0)):
                text, bucket = word_buckets(batch.column(0)[a:b], wanted)
                place = np.searchsorted(wanted, bucket).astype(np.uint16)
                at = np.searchsorted(text, np.arange(b - a + 1))
                marks = [place[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], batch.column(2)[a:b], pa.array(marks, pa.binary())], ["id", "positive", "marks"])

    return docs.select("text", "id", "positive").mapInArrow(run, "id long, positive boolean, marks binary")


@dataclass
class Rows:
    """Documents as (doc, word) pairs over ``width`` words; weight: of each document, with sum 1."""

    doc: np.ndarray
    word: np.ndarray
    weight: np.ndarray
    width: int

    @classmethod
    def of(cls, marks: list[bytes], width: int) -> Rows:
        size = np.array([len(m) // 2 for m in marks], np.int64)
        return cls(np.repeat(np.arange(len(marks)), size), np.frombuffer(b"".join(marks), np.uint16).astype(np.int64), np.full(len(marks), 1 / max(1, len(marks))), width)

    def drawn(self, rng: np.random.Generator) -> Rows:
        """A bootstrap sample, as weights."""
        n = len(self.weight)
        return Rows(self.doc, self.word, np.bincount(rng.integers(0, n, n), minlength=n) / n, self.width)

    def logits(self, w: np.ndarray) -> np.ndarray:
        return np.clip(np.bincount(self.doc, w[self.word], len(self.weight)) + w[-1], -50, 50)

    def gradient(self, r: np.ndarray) -> np.ndarray:
        r = r * self.weight
        return np.append(np.bincount(self.word, r[self.doc], self.width), r.sum())


def risk(w: np.ndarray, positive: Rows, unlabelled: Rows, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """prior * R_p(+), the corrected negative risk R_u(-) - prior * R_p(-), and their gradients; logistic loss.

    w: a weight for each word and, last, the bias."""
    zp, zu = positive.logits(w), unlabelled.logits(w)
    sp, su = (1 / (1 + np.exp(-z)) for z in (zp, zu))
    minus = lambda z, rows: float(np.logaddexp(0, z) @ rows.weight)
    plus = prior * minus(-zp, positive)
    return plus, minus(zu, unlabelled) - prior * minus(zp, positive), prior * positive.gradient(sp - 1), unlabelled.gradient(su) - prior * positive.gradient(sp)


def fit(positive: Rows, unlabelled: Rows, prior: float, seeds: Iterable[int] = SEEDS) -> np.ndarray:
    """Weights and, last, the bias of one classifier a seed, each from a bootstrap sample of its own.

    Minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) (Kiryo et al. 2017). Where the corrected negative risk is
    below zero by more than SLACK, its gradient is ascended instead, so the risk can't be driven below what is possible.
    """
    out = []
    for seed in seeds:
        rng = np.random.default_rng(seed)
        w = np.zeros(unlabelled.width + 1)
        m, v = np.zeros_like(w), np.zeros_like(w)
        w[-1] = np.log(prior / (1 - prior))
        u, p = unlabelled.drawn(rng), positive.drawn(rng)
        for step in range(1, STEPS + 1):
            _, negative, up, down = risk(w, p, u, prior)
            g = -down if negative < -SLACK else down + up
            g[:-1] += DECAY * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        out.append(w)
    return np.array(out)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic: str = "toxic", positives: int = POSITIVES) -> Toxicity:
    """Fit on confirmed toxic documents (the first ``positives`` by a hash of the id) and all documents as unlabelled.

    Every document counts in the choice of words and in the unlabelled risk: documents are dealt by a hash of their id
    into shards of about SHARD_ROWS, classifiers are fitted in each shard against all positives, and their weights are
    averaged by shard size, in a tree. The number of shards follows from the table alone, so results don't depend on
    tasks or cluster. The class prior is the share of toxic among all labelled documents; labels of 0 serve that only.
    Without positives or documents the score is the prior.
    """
    known = labels.where(F.col(toxic).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(toxic).alias("toxic"))
    seen = known.agg(F.sum("toxic").alias("k"), F.count(F.lit(1)).alias("n")).first()
    prior = min(0.99, max(0.001, (seen.k or 0) / max(1, seen.n)))
    nothing = Toxicity(np.zeros(0, np.int64), np.zeros((1, 0)), np.array([np.log(prior / (1 - prior))]))
    picked = known.where("toxic = 1").orderBy(F.xxhash64("id"), "id").limit(positives).select("id", F.lit(True).alias("positive"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL AND id IS NOT NULL")
    marked = texts.join(F.broadcast(picked), "id", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))  # at most ``positives`` ids
    chosen, n_p, n_u = choose(marked)
    if not n_p:
        return nothing
    rows = materialise(_marks(marked, chosen), "toxic-rows")
    confirmed = rows.where("positive").select("id", "marks").distinct().orderBy("id", "marks").limit(positives).collect()
    sent = Shared(docs.sparkSession, Rows.of([bytes(r.marks) for r in confirmed], len(chosen)))
    width, shards = len(chosen), -(-n_u // SHARD_ROWS)
    dealt = rows.select(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(shards)).alias("shard"), "id", "marks")
    kind = "shard long, n long, weights binary"

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "marks"])
        w = fit(sent.value, Rows.of([bytes(x) for x in group["marks"]], width), prior, [1000 * int(key[0]) + s for s in SEEDS])
        return pd.DataFrame({"shard": [key[0]], "n": [len(group)], "weights": [(w * len(group)).tobytes()]})

    def added(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        total = np.sum([np.frombuffer(x, np.float64) for x in group["weights"]], axis=0)
        return pd.DataFrame({"shard": [key[0]], "n": [group["n"].sum()], "weights": [total.tobytes()]})

    sums = materialise(dealt.groupBy("shard").applyInPandas(one, kind), "toxic-models")
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        sums = materialise(sums.groupBy(F.expr(f"shard div {FAN_IN}").alias("upper")).applyInPandas(added, kind), "toxic-models")
    parts = sums.orderBy("shard").collect()
    total = np.sum([np.frombuffer(r.weights, np.float64) for r in parts], axis=0) / sum(r.n for r in parts)
    w = total.reshape(len(SEEDS), width + 1)
    return Toxicity(chosen, w[:, :-1], w[:, -1])


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every whole text; null and empty texts get the score of no words."""
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxicity = shared.value
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for a, b in passes(texts):
                s = toxicity.scores(*word_buckets(texts[a:b], toxicity.chosen), b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def detect_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic: str = "toxic", folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted. Rows whose crc32(id as text) mod folds is held_out teach nothing.

    Null and empty texts get the score of no words; rows with a null text or id teach nothing and are scored. Repeated
    rows stay, count as often and get one score; contradicting labels of an id count as toxic. A text of any length is
    read whole, as a pass of its own. Extra columns, whatever their names, are left out. Without labels every score is
    the least prior, and an empty table gives an empty result.
    """
    train = docs.where(crc_mod(id_col, folds) != held_out)
    model = learn(train, labels.where(crc_mod("doc_id", folds) != held_out), id_col, text_col, toxic)
    return score(docs, model, id_col, text_col).select("doc_id", (crc_mod("doc_id", folds) == held_out).alias("held_out"), "score", "predicted")
