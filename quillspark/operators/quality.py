"""Filters, tiers, lexicon labels and suspicion scores of transcripts and their tokens."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..sources.shared import written

# Thresholds of the tiers, and the weights of the reasons.
HIGH_BELOW, MEDIUM_BELOW, MIN_NATIVE_CHARS, ENGLISH_BAND = 0.30, 0.59, 3, (0.05, 0.65)
WEIGHTS = {
    "known_noise": 5, "replacement_character": 5, "devanagari_token": 4, "foreign_script_character": 4, "mixed_script_token": 3,
    "repeated_character": 3, "too_many_consonants": 3, "rare_unknown": 2, "single_dialect_unknown": 1, "low_vowel_ratio": 1, "too_short_token": 1,
}
#: Lexicons from the one that decides first to the last.
PRECEDENCE = ("NOISE", "DIALECT", "STANDARD", "ENGLISH")


def no_speech(segments: Column) -> Column:
    """Mean no-speech probability of a recogniser's segments, null without any."""
    total = F.aggregate(segments, F.lit(0.0), lambda s, x: s + F.coalesce(x["no_speech_prob"], F.lit(0.0)))
    return total / F.nullif(F.size(segments), F.lit(0))


def blanked(transcript: Column, no_speech_prob: Column, most: float = 0.60) -> Column:
    """The transcript, or blank if speech is unlikely, native script is absent, or another Indic script outweighs it."""
    n = T.script_counts(transcript)
    other = n["devanagari"] + n["other_indic"]
    return F.when((no_speech_prob >= most) | (n["bengali"] == 0) | (other > n["bengali"]), "").otherwise(transcript)


def ratio_in_band(is_cs: Column, en_ratio: Column, band: tuple[float, float] = ENGLISH_BAND) -> Column:
    return ~F.coalesce(is_cs, F.lit(False)) | F.coalesce(en_ratio, F.lit(0.0)).between(*band)


def tier(transcript: Column, is_cs: Column, en_ratio: Column, no_speech_prob: Column, native: str = T.BENGALI, min_native: int = MIN_NATIVE_CHARS, high: float = HIGH_BELOW, medium: float = MEDIUM_BELOW) -> Column:
    """struct(tier, reason): HIGH or MEDIUM, or a null tier with the first reason that rejects."""
    accept = lambda t: F.struct(F.lit(t).alias("tier"), F.lit(None).cast("string").alias("reason"))
    reject = lambda r: F.struct(F.lit(None).cast("string").alias("tier"), F.lit(r).alias("reason"))
    return (
        F.when(T.blank(transcript), reject("empty_transcript"))
        .when(T.count_of(transcript, native) < min_native, reject("too_short"))
        .when(~ratio_in_band(is_cs, en_ratio), reject("cs_en_ratio_out_of_range"))
        .when(no_speech_prob.isNull(), accept("MEDIUM"))
        .when(no_speech_prob < high, accept("HIGH"))
        .when(no_speech_prob < medium, accept("MEDIUM"))
        .otherwise(reject("high_no_speech_prob"))
    )


def drop_noise_clips(clips: DataFrame, noise: DataFrame, text: str = "transcript", token: str = "token") -> DataFrame:
    """Clips none of whose tokens is in the noise lexicon."""
    bad = clips.select("clip_id", F.explode(T.tokens(text)).alias(token)).join(noise.select(token), token, "left_semi").select("clip_id").distinct()
    return clips.join(bad, "clip_id", "left_anti")


def clean_noise(clips: DataFrame, noise: list[str], text: str = "transcript", only_raw_matches: bool = True) -> DataFrame:
    """clips with noise tokens deleted from the text, and ``changed``.

    noise: folded tokens, a short list. only_raw_matches leaves a text alone unless one of its white-space words, as
    written, is a noise token; that spares capitalised and punctuated ones.
    """
    words = F.array(*(F.lit(x) for x in noise)) if noise else F.array().cast("array<string>")
    cleaned = T.delete_tokens(text, words)
    if only_raw_matches:
        cleaned = F.when(F.arrays_overlap(T.words(text), words), cleaned).otherwise(F.col(text))
    return clips.withColumn("cleaned", cleaned).withColumn("changed", ~F.col("cleaned").eqNullSafe(F.col(text))).withColumn(text, F.col("cleaned")).drop("cleaned")


def one_lexicon(lexicons: dict[str, DataFrame]) -> DataFrame:
    """token, lexicon: for each token the label of the lexicon that decides first."""
    rows = [lexicons[k].select("token", F.lit(i).alias("rank"), F.lit(k).alias("lexicon")) for i, k in enumerate(PRECEDENCE) if k in lexicons]
    return reduce(DataFrame.unionByName, rows).groupBy("token").agg(F.min_by("lexicon", "rank").alias("lexicon"))


def explode_tokens(clips: DataFrame, pattern: str = T.TOKEN, text: str = "transcript") -> DataFrame:
    """clip_id, dialect, token: one row for each token of each clip."""
    return clips.select("clip_id", F.coalesce("dialect", F.lit("unknown")).alias("dialect"), F.explode(T.tokens(text, pattern)).alias("token"))


def token_statistics(tokens: DataFrame) -> DataFrame:
    """token, count, doc_count, dialect_count, top_dialects: two-level sums, so that no token's clips meet in one task."""
    in_clip = tokens.groupBy("token", "dialect", "clip_id").agg(F.count(F.lit(1)).alias("n"))
    in_dialect = in_clip.groupBy("token", "dialect").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("docs")).alias("docs"), "dialect")))
    named = F.transform(F.slice(pairs, 1, 5), lambda x: F.concat(x["dialect"], F.lit(":"), (-x["docs"]).cast("string")))
    return in_dialect.groupBy("token").agg(F.sum("n").alias("count"), F.sum("docs").alias("doc_count"), F.count(F.lit(1)).alias("dialect_count"), F.array_join(named, ";").alias("top_dialects"))


def lexicon_label(token: Column, lexicon: Column) -> Column:
    script = T.script_label(token)
    return F.coalesce(lexicon, F.when(script == "DEVANAGARI", "DEVANAGARI_CANDIDATE").when(script == "LATIN", "ENGLISH_CANDIDATE").otherwise("UNKNOWN"))


def suspicion(token: Column, count: Column, doc_count: Column, dialect_count: Column, label: Column) -> Column:
    """struct(score, reasons)."""
    unknown = label == "UNKNOWN"
    tests = {
        "known_noise": label == "NOISE", "devanagari_token": label == "DEVANAGARI_CANDIDATE", "rare_unknown": unknown & (count <= 2), "single_dialect_unknown": unknown & (dialect_count <= 1),
        "mixed_script_token": T.script_label(token) == "MIXED", "replacement_character": token.contains("�"), "foreign_script_character": T.has_foreign_letter(token),
        "repeated_character": T.repeats_character(token), "too_many_consonants": T.many_consonants(token), "low_vowel_ratio": (F.length(token) >= 8) & (T.vowel_ratio(token) < 0.18), "too_short_token": F.length(token) <= 1,
    }
    reasons = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))
    total = reduce(lambda a, b: a + b, (F.when(test, WEIGHTS[name]).otherwise(0) for name, test in tests.items()))
    mild = [x for x in tests if x not in ("rare_unknown", "single_dialect_unknown")]
    only_unknown = ~reduce(lambda a, b: a | b, (tests[x] for x in mild))
    score = F.when(only_unknown, F.least(total, F.lit(2))).otherwise(total)
    score = F.when((doc_count >= 20) | (dialect_count >= 4), F.greatest(F.lit(0), score - 2)).otherwise(score)
    return F.struct(score.alias("score"), reasons.alias("reasons"))


def score_tokens(statistics: DataFrame, lexicon: DataFrame) -> DataFrame:
    """token_statistics() with script, lexicon_label, suspicion_score, suspicion_reasons."""
    rows = statistics.join(lexicon, "token", "left").withColumn("lexicon_label", lexicon_label(F.col("token"), F.col("lexicon")))
    found = suspicion(F.col("token"), F.col("count"), F.col("doc_count"), F.col("dialect_count"), F.col("lexicon_label"))
    rows = rows.withColumn("script", T.script_label("token")).withColumn("found", found).drop("lexicon")
    return rows.withColumns({"suspicion_score": F.col("found.score"), "suspicion_reasons": F.array_join("found.reasons", ";")}).drop("found")


def score_clips(clips: DataFrame, scored: DataFrame, at_least: int = 3, min_wps: float = 0.8, min_seconds: float = 4.0, pattern: str = T.TOKEN) -> DataFrame:
    """Suspicion of each clip with a positive score.

    clips: clip_id, dialect, transcript, duration_sec and avg_no_speech_prob. A clip's score is the sum over its tokens
    of scores of at_least or more, and increments for its own faults; reasons come most frequent first, then by name.
    """
    looked = T.bound(T.tokens("transcript", pattern), lambda x: F.struct(F.size(x).alias("n"), T.repeated_ngram(x).alias("loop")))
    own = clips.withColumn("looked", looked).withColumns({"n": F.col("looked.n"), "loop": F.col("looked.loop")}).drop("looked")
    wps = F.when((F.col("duration_sec") >= min_seconds) & (F.col("n") > 0), F.col("n") / F.col("duration_sec"))
    faults = [
        (T.empty_if_null("transcript").contains("�"), "replacement_character", 5), (F.coalesce(F.col("avg_no_speech_prob") >= 0.30, F.lit(False)), "high_no_speech_prob", 2),
        (F.coalesce(wps < min_wps, F.lit(False)), "under_transcription", 3), (F.col("loop"), "word_loop_hallucination", 4), (T.truncated("transcript"), "truncated_transcript", 2),
    ]
    own = own.withColumn("wps", wps).withColumn("faults", F.array_compact(F.array(*(F.when(t, F.lit(r)) for t, r, _ in faults))))
    weights = F.create_map(*(F.lit(x) for _, r, w in faults for x in (r, w)))
    # texts are gone through here, and not again for each use of what they have
    own = written(own.select("clip_id", "dialect", "duration_sec", "wps", "n", "faults"), "clip-faults")
    own = own.withColumn("extra", F.aggregate("faults", F.lit(0), lambda s, r: s + F.element_at(weights, r)))
    per = written(explode_tokens(clips, pattern).groupBy("clip_id", "token").agg(F.count(F.lit(1)).alias("times")), "clip-tokens")
    scored = written(scored.select("token", "lexicon_label", "suspicion_score", "suspicion_reasons"), "clip-scored")
    per = per.join(scored.hint("merge"), "token")
    bad = F.col("suspicion_score") >= at_least
    sums = per.groupBy("clip_id").agg(
        F.sum(F.when(F.col("lexicon_label") == "UNKNOWN", F.col("times")).otherwise(0)).alias("unknown"), F.sum(F.when(bad, F.col("times")).otherwise(0)).alias("suspicious"),
        F.sum(F.when(bad, F.col("times") * F.col("suspicion_score")).otherwise(0)).alias("score"), F.array_join(F.sort_array(F.collect_set(F.when(bad, F.col("token")))), ";").alias("suspicious_tokens"),
    )
    named = per.where(bad & (F.col("suspicion_reasons") != "")).select("clip_id", "times", F.explode(F.split("suspicion_reasons", ";")).alias("reason"))
    named = named.unionByName(own.select("clip_id", F.lit(1).cast("long").alias("times"), F.explode("faults").alias("reason"))).groupBy("clip_id", "reason").agg(F.sum("times").alias("times"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("times")).alias("n"), "reason")))
    named = named.groupBy("clip_id").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["reason"], F.lit(":"), (-x["n"]).cast("string"))), ";").alias("suspicion_reasons"))
    rows = own.join(sums, "clip_id", "left").join(named, "clip_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = rows.withColumn("suspicion_score", zero("score") + F.col("extra")).where("suspicion_score > 0")
    return rows.select(
        "clip_id", "dialect", "duration_sec", F.round("wps", 3).alias("words_per_sec"), F.col("n").cast("long").alias("token_count"), zero("unknown").alias("unknown_token_count"),
        zero("suspicious").alias("suspicious_token_count"), F.col("suspicion_score").cast("long").alias("suspicion_score"), F.coalesce("suspicion_reasons", F.lit("")).alias("suspicion_reasons"), F.coalesce("suspicious_tokens", F.lit("")).alias("suspicious_tokens"),
    )


def seeds(scored: DataFrame, kind: str, at_least: int = 3) -> DataFrame:
    """Candidate tokens for a lexicon: dialect, noise or unknown."""
    unknown = F.col("lexicon_label") == "UNKNOWN"
    return scored.where({
        "dialect": unknown & (F.col("count") >= 5) & (F.col("dialect_count") >= 2) & (F.col("suspicion_score") <= 1), "noise": F.col("suspicion_score") >= at_least,
        "unknown": unknown | (F.col("lexicon_label") == "DEVANAGARI_CANDIDATE"),
    }[kind])


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, the rows of its table kept as the bits of one number."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole = row = (1 << len(a)) - 1
    for c in b:
        same = row & at.get(c, 0)
        row = (row + same | row - same) & whole
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def _indel_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([200.0 * _lcs(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(a, b, strict=True)], dtype=float)


def similarity(a: Column, b: Column) -> Column:
    """Indel similarity from 0 to 100: twice the longest common subsequence over both lengths; 100 for two empty words."""
    return _indel_similarity(a, b)


def nearest_words(tokens: DataFrame, dictionary: DataFrame, least: float = 80.0) -> DataFrame:
    """token, word, similarity: the most similar dictionary word with at least that similarity, the first of equals.

    A similarity of ``least`` allows a number of insertions and deletions that follows from both lengths. A token cut into
    one piece more than that has a piece that no edit touches, so the word holds it at nearly the same place: tokens and
    words are joined by such pieces, and no other pair is formed. Of these the built-in edit distance, which isn't more
    than insertions and deletions, lets few through to the exact comparison. Every word in reach is found. A piece is never
    longer than (200 - least) / (200 - 2 * least) letters, rounded up, so a word of any length has a few pieces a place,
    and a token as many as it has letters for each length that words have.
    """
    share = (100.0 - least) / 100.0
    longest = F.lit(math.ceil((200 - least) / (200 - 2 * least))) if least < 100 else F.col("size")
    sizes = dictionary.select(F.length("word").alias("size")).where("size > 0").distinct()
    reach = lambda n: F.sequence(F.ceil(n * least / (200 - least)).cast("int"), F.floor(n * (200 - least) / least).cast("int"))
    left = tokens.select("token").where("token <> ''").distinct().withColumn("size", F.explode(reach(F.length("token")))).join(sizes, "size")
    left = left.withColumn("edits", F.floor((F.length("token") + F.col("size")) * share + 1e-9).cast("int"))
    left = left.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    cut = lambda i: F.floor(i * F.length("token") / (F.col("edits") + 1)).cast("int")
    left = left.withColumns({"at": cut(F.col("i")) + 1, "long": cut(F.col("i") + 1) - cut(F.col("i"))})
    left = left.select("token", "size", "edits", "at", "long", F.substring("token", F.col("at"), F.col("long")).alias("piece"))
    # a piece without a letter (more edits than letters) is in every word
    right = dictionary.select("word").where("word <> ''").distinct().withColumn("size", F.length("word")).withColumn("place", F.explode(F.sequence(F.lit(1), F.col("size"))))
    right = right.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.col("size") - F.col("place") + 1, longest)))).select("word", "size", "place", F.substring("word", F.col("place"), F.col("n")).alias("piece"))
    pairs = left.where("long > 0").join(right, ["size", "piece"]).where("abs(at - place) <= edits").select("token", "word", "edits")
    short = left.where("long = 0").join(right.select("word", "size").distinct(), "size").select("token", "word", "edits")
    pairs = pairs.unionByName(short).distinct().where(F.levenshtein("token", "word", 1000) <= F.col("edits"))
    pairs = pairs.withColumn("similarity", similarity(F.col("token"), F.col("word"))).where(F.col("similarity") >= least)
    best = F.min_by(F.struct("word", "similarity"), F.struct(-F.col("similarity"), F.col("word")))
    return pairs.groupBy("token").agg(best.alias("best")).select("token", "best.word", "best.similarity")


def quality_overlap(clips: DataFrame, text: str = "transcript") -> DataFrame:
    """Counts of texts with U+FFFD, with foreign letters, with both, excluded and kept."""
    damaged, foreign = F.col(text).contains("�"), F.col(text).rlike(r"[\p{L}&&[^\x00-\x7F\x{0980}-\x{09FF}]]")
    return clips.agg(*(F.count_if(x).alias(k) for k, x in {"damaged": damaged, "foreign": foreign, "both": damaged & foreign, "excluded": damaged | foreign, "kept": ~(damaged | foreign)}.items()))


def clean_in_steps(clips: DataFrame, noise: list[str], *steps, text: str = "transcript") -> DataFrame:
    """clips whose text goes through the caller's steps (functions of the text and the array of noise tokens, such as a
    masked model or a dictionary), and whose noise tokens that remain are deleted at last."""
    words = F.array(*(F.lit(x) for x in noise)) if noise else F.array().cast("array<string>")
    value = F.col(text)
    for step in steps:
        value = step(value, words)
    return clips.withColumn(text, T.delete_tokens(value, words))
