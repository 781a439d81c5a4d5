"""Text functions over columns: normalisation, tokens, scripts. All stay in the JVM but ``nfc``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes that decide what normalisation removes.
PUNCTUATION = r"""[.,!?;:"'()\[\]{}<>|/\\`~@#$%^&*_+=\-\x{0964}\x{0965}]+"""
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}\x{00AD}]+"
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}"
    r"\x{10000}-\x{10FFFF}\x{2600}-\x{2B55}\x{200D}\x{23CF}\x{23E9}\x{231A}\x{FE0F}\x{3030}]+"
)
URL, HASHTAG, MENTION = r"(?i)https?://(?U:\S)+|www\.(?U:\S)+", r"#[\p{L}\p{N}_]+", r"@[\p{L}\p{N}_]+"
BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"
TOKEN = r"[\x{0900}-\x{09FF}A-Za-z][\x{0900}-\x{09FF}A-Za-z'\-]*"
BENGALI, DEVANAGARI, LATIN = r"[\x{0980}-\x{09FF}]", r"[\x{0900}-\x{097F}]", "[A-Za-z]"
# Suffixes in the order in which they are tried.
SUFFIXES = ("টা", "টি", "খানা", "খান", "গুলো", "গুলা", "গুলোর", "গুলার", "দের", "টার", "টির", "এ", "তে", "য়ে", "য়", "র", "এর", "কে")
# Bengali letters that count as vowels (signs aren't letters and never count).
BENGALI_VOWELS = "অআইঈউঊঋএঐওঔ"
EDGES = r"""^[(?U:\s),।.!?;:"'()\[\]{}<>“”‘’\-–—]+|[(?U:\s),।.!?;:"'()\[\]{}<>“”‘’\-–—]+$"""
EDGES = EDGES.replace("(?U:\\s)", "\\s")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f uses it, inside of lambdas too."""
    return F.element_at(F.transform(F.array(value), f), 1)


def empty_if_null(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(""))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def nfc(c: str | Column) -> Column:
    """Unicode NFC. Plain ASCII, which NFC leaves as it is, doesn't reach Python's normaliser with any content."""
    return F.when(col(c).rlike(r"^\p{ASCII}*$"), col(c)).otherwise(_nfc(F.when(~col(c).rlike(r"^\p{ASCII}*$"), col(c))))


def blank(c: str | Column) -> Column:
    return ~empty_if_null(c).rlike(r"(?U)\S")


def squeeze(c: str | Column) -> Column:
    """White space (Unicode) to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def words(c: str | Column) -> Column:
    """White-space words; none for a blank or null text."""
    return F.filter(F.split(squeeze(empty_if_null(c)), " "), lambda w: w != "")


def strip_invisible(c: str | Column) -> Column:
    return F.regexp_replace(col(c), INVISIBLE, " ")


def strip_links(c: str | Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, " "), (URL, HASHTAG, MENTION), col(c))


def strip_emoji(c: str | Column) -> Column:
    return F.regexp_replace(col(c), EMOJI, " ")


def ascii_digits(c: str | Column) -> Column:
    return F.translate(col(c), BENGALI_DIGITS, "0123456789")


def cap_characters(c: str | Column) -> Column:
    """At most two of a character in a row."""
    return F.regexp_replace(col(c), r"(.)\1{2,}", "$1$1")


def strip_punctuation(c: str | Column) -> Column:
    return F.regexp_replace(col(c), PUNCTUATION, " ")


def cap_words(c: str | Column, run: int = 2) -> Column:
    """At most ``run`` equal words in a row; white space squeezed."""
    return F.regexp_replace(squeeze(empty_if_null(c)), r"(?<!\S)(\S+)(?: \1){%d,}(?!\S)" % run, " ".join(["$1"] * run))


def normalize_transcript(c: str | Column, collapse: bool = True, unicode: bool = True) -> Column:
    """Surface normalisation. collapse=False keeps repeated characters and words; unicode=False leaves out NFC."""
    x = strip_emoji(strip_links(strip_invisible(nfc(c) if unicode else col(c))))
    x = ascii_digits(x)
    x = strip_punctuation(cap_characters(x) if collapse else x)
    return F.when(blank(c), "").otherwise(cap_words(x) if collapse else squeeze(x))


def primary_normalize(c: str | Column, unicode: bool = True) -> Column:
    """Unicode, case, punctuation and white space; repeats are kept."""
    return F.lower(normalize_transcript(c, collapse=False, unicode=unicode))


def repeat_collapsed(c: str | Column, unicode: bool = True) -> Column:
    return F.lower(normalize_transcript(c, unicode=unicode))


def fold(c: str | Column) -> Column:
    """Case folding: lower case, and sharp s as ss."""
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


def variant_token(token: Column, variants: Column) -> Column:
    """Canonical form of a token: itself, or what is left without the first suffix that fits, in the map of variants."""
    folded = fold(token)
    tries = [F.element_at(variants, folded)]
    for s in SUFFIXES:
        stem = F.substring(folded, F.lit(1), F.length(folded) - len(s))
        tries.append(F.when(folded.endswith(s) & (F.length(folded) > len(s)), F.element_at(variants, stem)))
    return F.coalesce(*tries, token)


def normalize_variants(c: str | Column, variants: Column) -> Column:
    """Each white-space token to its canonical form; variants: map of folded surface to canonical."""
    return F.array_join(F.transform(words(c), lambda w: variant_token(w, variants)), " ")


def full_normalize(c: str | Column, variants: Column, unicode: bool = True) -> Column:
    return normalize_variants(normalize_transcript(c, unicode=unicode), variants)


def tokens(c: str | Column, pattern: str = TOKEN) -> Column:
    return F.transform(F.regexp_extract_all(empty_if_null(c), F.lit(pattern), F.lit(0)), fold)


def delete_tokens(c: str | Column, noise: Column) -> Column:
    """The text without tokens (as found by TOKEN) whose folded form is in the array ``noise``; blanks squeezed.

    The text is cut at every boundary between token and gap, so that everything between tokens stays as it is.
    """
    marked = F.regexp_replace(empty_if_null(c), f"({TOKEN})", "\u0001$1\u0001")
    parts = F.split(marked, "\u0001")
    kept = F.filter(parts, lambda p, i: (i % 2 == 0) | ~F.array_contains(noise, fold(p)))
    return squeeze(F.array_join(kept, ""))


def strip_edges(c: str | Column) -> Column:
    return F.regexp_replace(col(c), EDGES, "")


def count_of(c: str | Column, pattern: str) -> Column:
    return F.regexp_count(empty_if_null(c), F.lit(pattern))


def script_counts(c: str | Column) -> Column:
    """Characters by script: Bengali, Devanagari, other Indic, Latin."""
    return F.struct(count_of(c, BENGALI).alias("bengali"), count_of(c, DEVANAGARI).alias("devanagari"), count_of(c, r"[\x{0A00}-\x{0D7F}]").alias("other_indic"), count_of(c, LATIN).alias("latin"))


def script_label(c: str | Column, bengali: str = BENGALI, devanagari: str = DEVANAGARI, latin: str = LATIN) -> Column:
    b, d, x = (col(c).rlike(p) for p in (bengali, devanagari, latin))
    n = b.cast("int") + d.cast("int") + x.cast("int")
    return F.when(n > 1, "MIXED").when(d, "DEVANAGARI").when(b, "BN").when(x, "LATIN").otherwise("OTHER")


def has_foreign_letter(c: str | Column) -> Column:
    return col(c).rlike(r"[\p{L}&&[^A-Za-z\x{0900}-\x{09FF}]]")


def repeats_character(c: str | Column) -> Column:
    return col(c).rlike(r"(.)\1{3,}")


def many_consonants(c: str | Column) -> Column:
    return col(c).rlike("(?i)[bcdfghjklmnpqrstvwxyz]{5,}")


def vowel_ratio(c: str | Column) -> Column:
    letters = count_of(c, r"\p{L}")
    return F.when(letters > 0, count_of(c, f"[aeiouAEIOU{BENGALI_VOWELS}]") / letters).otherwise(F.lit(0.0))


def truncated(c: str | Column) -> Column:
    return F.regexp_replace(empty_if_null(c), r"(?U)\s+$", "").endswith("...")


def repeated_ngram(array: Column, n: int = 3, at_least: int = 6) -> Column:
    """Whether a run of n items occurs twice in an array of at_least items or more."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(array) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(array, i, F.lit(n)), "\u0001"))
    return (F.size(array) >= max(at_least, n + 1)) & (F.size(F.array_distinct(runs)) < F.size(runs))


def low_quality(c: str | Column) -> Column:
    """Blank, or with U+FFFD, or with a letter outside ASCII and Bengali."""
    return blank(c) | col(c).contains("\ufffd") | col(c).rlike(r"[\p{L}&&[^\x00-\x7F\x{0980}-\x{09FF}]]")


def is_bengali_word(w: Column) -> Column:
    return w.rlike(BENGALI)


def is_english_word(w: Column) -> Column:
    """ASCII letters only, two or more, without punctuation at the ends."""
    return F.regexp_replace(w, r"""^[.,!?;:"'()\-]+|[.,!?;:"'()\-]+$""", "").rlike(r"^[A-Za-z]{2,}$")


def percent(c: Column, none: str = "—") -> Column:
    """A share as a percentage with one place, a dash for null."""
    return F.when(c.isNull(), F.lit(none)).otherwise(F.format_string("%.1f", 100 * c))


def latex(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"([&%$#_{}])", r"\\$1")


def wrap(c: str | Column, width: int = 16) -> Column:
    """Lines of whole words up to ``width`` characters."""
    def add(lines, w):
        last = F.element_at(lines, -1)
        fits = (F.size(lines) > 0) & (F.length(last) + 1 + F.length(w) <= width)
        return F.when(fits, F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.concat_ws(" ", last, w)))).otherwise(F.concat(lines, F.array(w)))

    return F.array_join(F.aggregate(words(c), F.array().cast("array<string>"), add), "\n")
