"""Language tags of words, switches between languages, and the code-mixing label of a clip."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .borrowed import borrowed_map
from .text import BENGALI, is_bengali_word, is_english_word, strip_edges, words

TAG = "array<struct<word:string,lang:string,start:double,end:double>>"


def tag_words(found: Column, native: str = BENGALI) -> Column:
    """Tags of recognised words (array of struct word, start, end): native script or any non-ASCII is BN, two or more
    ASCII letters EN, anything else is dropped."""
    trimmed = F.transform(found, lambda w: F.struct(F.trim(w["word"]).alias("word"), w["start"].alias("start"), w["end"].alias("end")))
    lang = lambda w: F.when(w.rlike(native) | w.rlike(r"[^\x00-\x7F]"), "BN").when(w.rlike("^[A-Za-z]{2,}$"), "EN")
    tagged = F.transform(trimmed, lambda w: F.struct(w["word"].alias("word"), lang(w["word"]).alias("lang"), w["start"].alias("start"), w["end"].alias("end")))
    return F.filter(tagged, lambda t: t["lang"].isNotNull())


def recogniser_words(segments: Column) -> Column:
    """All words of a recogniser's segments in order."""
    return F.flatten(F.transform(segments, lambda s: s["words"]))


def plain_lang(lang: Column) -> Column:
    """Borrowed English counts as English."""
    return F.when(lang.isin("EN", "EN_BORROWED"), "EN").otherwise(lang)


def switch_count(langs: Column) -> Column:
    """Neighbouring pairs of different languages in an array of languages."""
    return F.when(F.size(langs) < 2, 0).otherwise(F.size(F.filter(F.zip_with(F.slice(langs, F.lit(1), F.greatest(F.size(langs) - 1, F.lit(1))), F.slice(langs, F.lit(2), F.greatest(F.size(langs) - 1, F.lit(1))), lambda a, b: a != b), lambda x: x)))


# Least words, native words and English words, and the band of the English share, of both grades of CS.
HIGH, MEDIUM = (4, 2, 2, 0.1, 0.7), (4, 2, 1, 0.05, 0.8)


def _facts(tags: Column) -> Column:
    """Counts of both languages and switches of an array of tags, in one pass over it."""
    start = F.struct(F.lit(0).alias("bn"), F.lit(0).alias("en"), F.lit(0).alias("switches"), F.lit("").alias("last"))

    def add(x: Column, t: Column) -> Column:
        lang = plain_lang(t["lang"])
        one = lambda is_so: F.when(is_so, 1).otherwise(0)
        return F.struct((x["bn"] + one(lang == "BN")).alias("bn"), (x["en"] + one(lang == "EN")).alias("en"), (x["switches"] + one((x["last"] != "") & (x["last"] != lang))).alias("switches"), F.coalesce(lang, F.lit("")).alias("last"))

    return F.aggregate(tags, start, add)


def _within(x: Column, grade: tuple[int, int, int, float, float]) -> Column:
    total, bn, en, low, high = grade
    return (x["bn"] + x["en"] >= total) & (x["bn"] >= bn) & (x["en"] >= en) & x["en_share"].between(low, high) & (x["switches"] >= 1)


def _shares(x: Column) -> Column:
    total = x["bn"] + x["en"]
    share = lambda n: F.when(total > 0, n / total).otherwise(F.lit(0.0))
    return F.struct(x["bn"].alias("bn"), x["en"].alias("en"), x["switches"].alias("switches"), share(x["bn"]).alias("bn_share"), share(x["en"]).alias("en_share"))


def classify(tags: Column) -> Column:
    """Label, confidence, ratios (two places), counts, words and switches of an array of tags."""

    def verdict_of(label: str, confidence: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))

    def verdict(x: Column) -> Column:
        return (
            F.when(F.size(tags) == 0, verdict_of("NOISE", "NONE"))
            .when((x["en_share"] >= 0.9) & (x["bn"] <= 1), verdict_of("EN_ONLY", "NONE"))
            .when(_within(x, HIGH), verdict_of("CS", "HIGH"))
            .when(_within(x, MEDIUM), verdict_of("CS", "MEDIUM"))
            .when((x["bn"] >= 2) & (x["en"] >= 1), verdict_of("BN_ONLY", "LOW"))
            .when(x["bn_share"] >= 0.95, verdict_of("BN_ONLY", "NONE"))
            .when(x["en_share"] >= 0.6, verdict_of("EN_ONLY", "NONE"))
            .otherwise(verdict_of("BN_ONLY", "NONE"))
        )

    of = lambda k: F.transform(F.filter(tags, lambda t: k(t["lang"])), lambda t: t["word"])

    def whole(x: Column) -> Column:
        return T.bound(verdict(x), lambda v: T.bound(of(lambda lang: lang == "EN_BORROWED"), lambda borrowed: F.struct(
            v["label"].alias("label"), v["confidence"].alias("cs_confidence"), F.round(x["bn_share"], 2).alias("bn_ratio"), F.round(x["en_share"], 2).alias("en_ratio"),
            x["bn"].alias("bn_word_count"), x["en"].alias("en_word_count"), F.size(borrowed).alias("borrowed_en_word_count"), x["switches"].alias("switch_count"),
            of(lambda lang: plain_lang(lang) == "EN").alias("en_words"), borrowed.alias("borrowed_en_words"), (v["label"] == "CS").alias("is_code_switched"),
        )))

    return T.bound(T.bound(_facts(tags), _shares), whole)


def classify_relaxed(tags: Column, known: list[str]) -> Column:
    """Label and ratios of a trial run: only plausible English words count (known: a short list), switches don't."""
    en_word = lambda t: (t["lang"] == "EN") & plausible_english(t["word"], known)
    start = F.struct(F.lit(0).alias("bn"), F.lit(0).alias("en"), F.lit(0).alias("switches"))
    one = lambda is_so: F.when(F.coalesce(is_so, F.lit(False)), 1).otherwise(0)
    counted = F.aggregate(tags, start, lambda x, t: F.struct((x["bn"] + one(t["lang"] == "BN")).alias("bn"), (x["en"] + one(en_word(t))).alias("en"), x["switches"].alias("switches")))

    def verdict(x: Column) -> Column:
        label = F.when(x["bn"] + x["en"] == 0, "NOISE").when((x["bn"] == 0) | (x["en_share"] >= 0.9), "EN_ONLY").when((x["bn_share"] >= 0.95) | (x["en"] == 0), "BN_ONLY").otherwise("CS")
        words = F.transform(F.filter(tags, lambda t: F.coalesce(en_word(t), F.lit(False))), lambda t: t["word"])
        return F.struct(label.alias("label"), F.round(x["bn_share"], 2).alias("bn_ratio"), F.round(x["en_share"], 2).alias("en_ratio"), words.alias("en_words"))

    return T.bound(T.bound(counted, _shares), verdict)


def accepted_label(label: Column) -> Column:
    """Whether a recognised clip goes on: plain English and noise are rejected without a look."""
    return ~F.coalesce(label.isin("EN_ONLY", "NOISE"), F.lit(False))


def retag_borrowed(tags: Column) -> Column:
    """Tags with EN_BORROWED and the English word where a BN word, without its edges, is a known loan."""
    known = borrowed_map()

    def one(t):
        english = F.when(t["lang"] == "BN", F.element_at(known, strip_edges(t["word"])))
        return F.struct(
            t["word"].alias("word"), F.when(english.isNotNull(), "EN_BORROWED").otherwise(t["lang"]).alias("lang"), t["start"].alias("start"), t["end"].alias("end"),
            english.isNotNull().alias("borrowed_en"), english.alias("canonical_en"),
        )

    return F.transform(tags, one)


def is_code_switched_text(c: str | Column, bn=is_bengali_word, en=is_english_word) -> Column:
    """Scoring-time detection on text: four words or more in all, two native, one English, an English share in band."""
    w = words(c)
    n_bn, n_en = F.size(F.filter(w, bn)), F.size(F.filter(w, en))
    total = n_bn + n_en
    share = n_en / F.nullif(total, F.lit(0))
    return F.coalesce((total >= 4) & (n_bn >= 2) & (n_en >= 1) & share.between(0.05, 0.8), F.lit(False))


def plausible_english(word: Column, known: list[str]) -> Column:
    """An English word of a code-switched clip: three letters or more, known, or capitalised with four or more."""
    return word.rlike("^[A-Za-z]{3,}$") & (word.rlike("^[A-Z][A-Za-z]{3,}$") | F.lower(word).isin(known))
