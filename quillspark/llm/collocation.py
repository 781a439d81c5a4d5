"""Phrase collocations by level-wise passes (Apriori).

Each pass counts phrases of one length over all texts, and emits a phrase only where both phrases that are one word shorter
were frequent; scores of all cuts come from the tables of these counts. The frequent phrases of a level are broadcast as a
filter of bounded size: what it lets through wrongly is counted and then not frequent, so no result depends on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, filled, materialise, passes, release, text_or_empty
from .vectext import Words, mix, window_hashes, words_of

#: Bytes that end a piece of text, and bytes between words; only blanks and tabs lie between words of one piece.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = ENDS.copy()
BETWEEN[[0x20, 0x09]] = True
BLANK = np.zeros(256, bool)
BLANK[0x20] = True
#: Bits of a filter: so many for each frequent phrase, and 16 MB at most.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Bytes of text that are counted together: with more the arrays of a worker, beside a heap full of counts, are too much.
PASS_BYTES = 1_000_000
#: Parts in which the candidates of a language are ranked before their best meet.
PARTS = 64
#: Language of documents without one; the phrase under which all of a language's words are counted.
UNKNOWN, ALL_WORDS = "und", ""


class Filter:
    """A Bloom filter over 64-bit hashes, with two places each. bits: a power of two."""

    def __init__(self, bits: int):
        self.mask = np.uint64(bits - 1)
        self.words = np.zeros(bits // 64, np.uint64)

    def places(self, keys: np.ndarray) -> list[np.ndarray]:
        return [keys & self.mask, (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)) & self.mask]

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for p in self.places(keys):
            found &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x, 7) for x in langs.cast(pa.binary()).to_pylist()), np.uint64, len(langs))


def _keys(words: Words, of_lang: np.ndarray, width: int) -> np.ndarray:
    """A hash of language and words for every run of ``width`` words, those across texts and pieces too."""
    runs = window_hashes(words.hashes()[words.codes], width) if len(words.codes) else np.zeros(0, np.uint64)
    return mix(runs ^ of_lang[: len(runs)])


def _counted(words: Words, lang: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first occurrence, and number, of each different (language, phrase) that begins at one of ``at``."""
    n_words = max(1, len(words.values))
    key = lang[at].astype(np.int64)
    for k in range(width):
        if len(key) and int(key.max()) >= (1 << 62) // n_words:
            key = np.unique(key, return_inverse=True)[1]
        key = key * n_words + words.codes[at + k]
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    return at[first], times


def phrase_counts(texts: DataFrame, width: int, frequent: Filter | None) -> DataFrame:
    """lang, phrase, n: occurrences of all phrases of ``width`` words whose parts of one word less pass the filter; texts:
    lang, text. For single words also the number of all words, as the empty phrase."""
    shared = None if frequent is None else Shared(texts.sparkSession, frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            lang_of, names = np.asarray(langs.indices), langs.dictionary
            body = filled(batch, "text")
            for a, b in passes(body, PASS_BYTES):
                words = words_of(body[a:b], lower=True, between=BETWEEN, ends=ENDS)
                sizes = np.diff(words.bounds)
                lang = np.repeat(lang_of[a:b], sizes)
                piece = words.pieces + np.repeat(np.arange(b - a), sizes)  # rises with the piece and with the text
                n = len(words.codes) - width + 1
                at = np.arange(max(0, n))
                if width > 1 and n > 0:
                    common = shared.value.has(_keys(words, _lang_hashes(names)[lang], width - 1))
                    at = np.flatnonzero(common[:n] & common[1 : n + 1] & (piece[:n] == piece[width - 1 :]))
                at, times = _counted(words, lang, at, width)
                columns = [words.values.take(pa.array(words.codes[at + k])) for k in range(width)]
                phrase = (pc.binary_join_element_wise(*columns, b" ") if width > 1 else columns[0]).cast(pa.string())
                name = names.take(pa.array(lang[at]))
                if width == 1:
                    all_words = np.bincount(lang, minlength=len(names))
                    name, phrase = pa.concat_arrays([name, names]), pa.concat_arrays([phrase, pa.array([ALL_WORDS] * len(names), pa.string())])
                    times = np.append(times, all_words)
                out = pa.RecordBatch.from_arrays([name, phrase, pa.array(times, pa.int64())], ["lang", "phrase", "n"])
                yield out
            pa.default_memory_pool().release_unused()

    rows = texts.select("lang", "text").mapInArrow(run, "lang string, phrase string, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_filter(level: DataFrame, width: int, most_bits: int = MOST_BITS) -> Filter | None:
    """The filter of a level's phrases; None if there are none. Its size follows their number up to ``most_bits``; what
    reaches the driver is 16 bytes for each of its words."""
    n = level.count()
    if not n:
        return None
    bits = min(1 << 16, most_bits)
    while bits < BITS_EACH * n and bits < most_bits:
        bits *= 2
    out = Filter(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column(1), lower=False, between=BLANK)
            langs = batch.column(0).dictionary_encode()
            of_lang = np.repeat(_lang_hashes(langs.dictionary)[np.asarray(langs.indices)], np.diff(words.bounds)) if batch.num_rows else np.zeros(0, np.uint64)
            keys = _keys(words, of_lang, width)[words.bounds[:-1]] if batch.num_rows else np.zeros(0, np.uint64)
            p = np.concatenate(out.places(keys))
            bit = np.left_shift(np.uint64(1), p & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array(bit)], ["word", "bits"])

    made = level.select("lang", "phrase").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out.words[np.asarray(made["word"])] = np.asarray(made["bits"]).view(np.uint64)
    return out


def _part(words: Column, first: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def scored(levels: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two words and more, by their lowest cut (of equals the first).

    levels[k] has lang, phrase, n of the frequent phrases of k + 1 words. The score of a cut is floor(1,000,000 * a * a /
    (l * r)), exact for counts below 10 ** 16.
    """
    parts = levels[0]
    for level in levels[1:-1]:
        parts = parts.unionByName(level)
    rows = levels[1]
    for level in levels[2:]:
        rows = rows.unionByName(level)
    words = rows.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = words.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(F.col("w"), 1, F.col("cut")).alias("left"), _part(F.col("w"), F.col("cut") + 1, F.size("w") - F.col("cut")).alias("right"))
    side = lambda part, f: parts.select("lang", F.col("phrase").alias(part), F.col("n").alias(f)).hint("merge")
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    long = "decimal(19,0)"
    score = F.expr(f"(cast(a as {long}) * cast(a as {long}) * 1000000) div (cast(l as {long}) * cast(r as {long}))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), F.col("cut"), F.col("l"), F.col("r"))).alias("x"))
    return best.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def inside_longer(levels: list[DataFrame], percent: int) -> DataFrame:
    """lang, phrase of those contained in a longer frequent phrase with percent or more of their occurrences.

    A phrase one word longer is enough to look at: any longer one contains such a phrase, which is as frequent or more.
    """
    out = None
    for short, long in zip(levels[1:], levels[2:], strict=False):
        w = F.split("phrase", " ")
        both = F.array(_part(w, 1, F.size(w) - 1), _part(w, 2, F.size(w) - 1))
        most = long.select("lang", F.explode(both).alias("phrase"), F.col("n").alias("m")).groupBy("lang", "phrase").agg(F.max("m").alias("m"))
        one = short.join(most.hint("merge"), ["lang", "phrase"]).where(100 * F.col("m") >= percent * F.col("n")).select("lang", "phrase")
        out = one if out is None else out.unionByName(one)
    return out


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, least: int = 10, inside_percent: int = 50, top: int = 2000, most_bits: int = MOST_BITS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``max_words`` words by score, then a,
    both descending, then phrase by bytes.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and bytes 0A to 0D, words at blanks and tabs. a counts all occurrences of a
    phrase inside pieces, overlapping ones too; those with a >= ``least`` are candidates. The cut of the lowest score
    counts, with l and r the counts of its parts. Candidates whose words lie inside a longer one with ``inside_percent`` or
    more of their occurrences are dropped. n counts all words of the language.

    A null language is ``und``; null and empty texts have no words; repeated rows count as often as they are there; texts
    of any length are read whole. Extra columns are left out; an empty table, or one without frequent phrases, gives an empty
    result. Arithmetic is in whole numbers. Filters hold 64-bit hashes and only spare work: counts are of the words
    themselves. Rows leave a worker counted, so a phrase that is everywhere is a row for each pass and task.
    """
    if max_words < 2:
        raise ValueError("max_words must be 2 or more")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty(F.col(text_col).cast("string")).alias("text"))
    words = materialise(phrase_counts(texts, 1, None).where((F.col("n") >= least) | (F.col("phrase") == ALL_WORDS)), "phrases-1")
    levels = [words.where((F.col("phrase") != ALL_WORDS) & (F.col("n") >= least))]
    written = [words]
    for width in range(2, max_words + 1):
        found = frequent_filter(levels[-1], width - 1, most_bits)
        if found is None:
            break
        written.append(materialise(phrase_counts(texts, width, found).where(F.col("n") >= least), f"phrases-{width}"))
        levels.append(written[-1])
    if len(levels) < 2:
        release(*written)
        nothing = docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
        return nothing
    rows = scored(levels)
    dropped = inside_longer(levels, inside_percent)
    if dropped is not None:
        rows = rows.join(dropped.hint("merge"), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = words.where(F.col("phrase") == ALL_WORDS).select("lang", "n")
    out = materialise(rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    release(*written)
    return out
