"""Language identification by rank-order profiles of character n-grams and the out-of-place distance."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, crc_mod, passes

#: n-gram lengths, and n-grams in a profile.
SIZES, PROFILE = (1, 2, 3), 300
#: Distinct n-grams per language that a task holds before it hands on its counts.
HELD = 2_000_000
BITS = 21  # of a code point
EDGE = 1  # stands for any run of characters that are not letters


class Letters:
    """For each code point its lower-case letter, or itself if it is a mark inside words, or EDGE; and which are letters.

    Letters are the Unicode categories L*, marks M*, in all planes; unassigned planes have neither.
    """

    def __init__(self):
        self.table = np.full(0x110000, EDGE, np.int64)
        self.letter = np.zeros(0x110000, bool)
        for c in (*range(0x40000), *range(0xE0000, 0xE0200)):
            x = chr(c)
            kind = unicodedata.category(x)[0]
            if kind == "L":
                low = x.lower()
                self.table[c] = ord(low) if len(low) == 1 else c
                self.letter[c] = True
            elif kind == "M":
                self.table[c] = c


_letters: list[Letters] = []
_NONE = np.zeros(0, np.int64)


def letter_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters and marks of all texts, one EDGE for each run of others and one before each text; texts'
    offsets; whether a text has a letter."""
    if not _letters:
        _letters.append(Letters())
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.append(0, np.cumsum(sizes))
    at = np.arange(len(texts)) + bounds[:-1]  # where each text's leading EDGE goes
    codes = np.full(len(data) + len(texts), EDGE, np.int64)
    body = np.ones(len(codes), bool)
    body[at] = False
    codes[body] = _letters[0].table[data]
    seen = np.append(0, np.cumsum(_letters[0].letter[data]))
    begins = np.zeros(len(codes), bool)
    begins[at] = True
    keep = begins.copy()
    keep[1:] |= (codes[1:] != EDGE) | (codes[:-1] != EDGE)
    places = np.append(0, np.cumsum(keep))
    return codes[keep], places[np.append(at, len(keep))], seen[bounds[1:]] > seen[bounds[:-1]]


def grams(codes: np.ndarray, bounds: np.ndarray | None = None) -> np.ndarray:
    """n-grams of one text, or of several at bounds, as 64-bit numbers, without those that are only EDGE."""
    parts, last = [], None if bounds is None else np.repeat(bounds[1:], np.diff(bounds))
    for n in SIZES:
        if len(codes) >= n:
            m = len(codes) - n + 1
            g = codes[:m].copy()
            for k in range(1, n):
                g <<= BITS
                g |= codes[k : k + m]
            parts.append(g if last is None else g[np.arange(n, m + n) <= last[:m]])
    all_grams = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return all_grams[all_grams != EDGE]


def ranked(codes: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent n-grams, most frequent first, ties by number."""
    g = grams(codes)
    g.sort()
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(g)))
    return g[first][np.argsort(-n, kind="stable")[:PROFILE]]


def gram_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, gram, n over all given documents with a language; each task sums its own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out(langs):
            for lang in langs:
                g, n = held.pop(lang)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = batch.column(1).filter(pa.array(langs == lang))
                for a, b in passes(texts):
                    codes, bounds, _ = letter_codes(texts[a:b].to_pylist())
                    g, n = np.unique(grams(codes, bounds), return_counts=True)
                    if lang in held:
                        g, inverse = np.unique(np.concatenate([held[lang][0], g]), return_inverse=True)
                        n = np.bincount(inverse, np.concatenate([held[lang][1], n])).astype(np.int64)
                    held[lang] = g, n
                    if len(g) > HELD:
                        yield from out([lang])
        yield from out(list(held))

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Profile of each language from all given documents: at most PROFILE n-grams a language reach the driver."""
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = gram_counts(docs, id_col, text_col, lang_col).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list] = {}
    for r in rows.orderBy("lang", "rank").collect():
        profiles.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(g, np.int64) for lang, g in profiles.items()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text.

    The distance to a profile is the sum over the text's ranked n-grams of the difference of ranks, PROFILE for one
    that the profile lacks; the nearest language wins, the alphabetically first of equals. score is one less the share
    of the largest possible distance. 'und' and 0 if the text is null or empty or has no letter (categories L*), or
    nothing was learned. A text of any length is one pass of its own. Repeated rows stay, each with its prediction, and
    so do rows with a null id; extra columns, whatever their names, are left out; an empty table gives an empty result.
    """
    known = {lang: (g[o], o) for lang, g in sorted(profiles.items()) for o in [np.argsort(g, kind="stable")]}
    shared = Shared(docs.sparkSession, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for a, b in passes(texts):
                codes, bounds, lettered = letter_codes(texts[a:b].to_pylist())
                names, scores = [], []
                for k in range(b - a):
                    mine = ranked(codes[bounds[k] : bounds[k + 1]]) if lettered[k] else _NONE
                    at, best = np.arange(len(mine)), ("und", 0.0)
                    least = None
                    for lang, (sorted_grams, rank) in models.items():
                        if not len(mine):
                            break
                        place = np.minimum(np.searchsorted(sorted_grams, mine), len(sorted_grams) - 1)
                        away = np.where(sorted_grams[place] == mine, np.abs(rank[place] - at), PROFILE).sum()
                        if least is None or away < least:
                            least, best = away, (lang, 1 - away / (PROFILE * len(mine)))
                    names.append(best[0])
                    scores.append(float(best[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Documents whose crc32(id as text) mod folds is held_out teach nothing.

    Nulls, empty and long texts, repeats, empty tables and extra columns are as in predict(); a document without a
    language or text teaches nothing; repeated rows teach as often as they occur.
    """
    away = crc_mod(id_col, folds) == held_out
    profiles = learn(docs.where(~away), id_col, text_col, lang_col)
    return predict(docs, profiles, id_col, text_col).select("doc_id", (crc_mod("doc_id", folds) == held_out).alias("held_out"), "lang_pred", "score")
