import pytest
from pyspark.sql import functions as F

from quillspark.functions import codemix as C
from quillspark.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        (None, ""), ("   ", ""), ("hello!!!", "hello"), ("আমি ১২৩ টাকা", "আমি 123 টাকা"), ("see https://a.b/c now", "see now"), ("WWW.X.org ok", "ok"), ("lollll", "loll"), ("017111", "01711"),
        ("ভালো।", "ভালো"), ("no no no no yes", "no no yes"), ("a b a b", "a b a b"), ("hi 😀 there", "hi there"), ("zero\u200bwidth", "zero width"), ("@you hi #tag end", "hi end"), ("tab\tand\u00a0space", "tab and space"),
        ("হাহাহাহাহা", "হাহাহাহাহা"), ("cafe\u0301", "café"),
    ],
)
def test_normalize(spark, raw, clean):
    assert one(spark, T.normalize_transcript("t"), t=raw) == clean


def test_normalize_is_idempotent(spark):
    texts = ["Hmmmm... okay okay okay okay", "কি কি কি কি!", "a,,b;;c", "x 😀😀 y", "#a @b http://c d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalize_transcript("t").alias("once"))
    assert all(r.once == r.twice for r in df.select("once", T.normalize_transcript("once").alias("twice")).collect())


def test_primary_keeps_repeats(spark):
    assert one(spark, T.primary_normalize("t"), t="Nooo no no no!") == "nooo no no no"


def test_variants(spark):
    known = F.create_map(*(F.lit(x) for x in ("চ্যানেল", "channel", "mtg", "meeting")))
    assert one(spark, T.normalize_variants("t", known), t="MTG চ্যানেলটা আমি mtg") == "meeting channel আমি meeting"


def test_delete_tokens(spark):
    noise = F.array(F.lit("uh"), F.lit("hmm"))
    assert one(spark, T.delete_tokens("t", noise), t="uh, I was Hmm there uh") == ", I was there"
    assert one(spark, T.delete_tokens("t", noise), t="") == ""


@pytest.mark.parametrize(("token", "label"), [("abc", "LATIN"), ("আমি", "BN"), ("नमस्ते", "DEVANAGARI"), ("।", "DEVANAGARI"), ("ভালো।", "MIXED"), ("aআ", "MIXED"), ("123", "OTHER")])
def test_script_label(spark, token, label):
    assert one(spark, T.script_label("t"), t=token) == label


def test_low_quality(spark):
    texts = {"": True, "ok": False, "আমি ok": False, "bad \ufffd": True, "привет": True, "12 !": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.x for r in df.select("t", T.low_quality("t").alias("x")).collect()} == texts


@pytest.mark.parametrize(("words", "loops"), [("a b c a b c", True), ("a b c d e f", False), ("a a a", False), ("a a a a a a", True)])
def test_repeated_ngram(spark, words, loops):
    assert one(spark, T.repeated_ngram(T.words("t")), t=words) is loops


def test_report_text(spark):
    assert one(spark, T.latex("t"), t="a_b & 5%") == r"a\_b \& 5\%"
    assert one(spark, T.wrap("t", 9), t="one two three four") == "one two\nthree\nfour"
    assert one(spark, T.percent(F.lit(None).cast("double")), t="") == "—"


def tags(langs):
    return F.array(*(F.struct(F.lit(f"w{i}").alias("word"), F.lit(x).alias("lang"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end")) for i, x in enumerate(langs)))


@pytest.mark.parametrize(
    ("langs", "label", "confidence"),
    [
        (["EN"] * 9 + ["BN"], "EN_ONLY", "NONE"), (["BN", "BN", "EN", "EN"], "CS", "HIGH"), (["BN"] * 5 + ["EN"], "CS", "MEDIUM"), (["BN"] * 30 + ["EN"], "BN_ONLY", "LOW"), (["BN", "BN"], "BN_ONLY", "NONE"),
        (["BN", "EN", "EN"], "EN_ONLY", "NONE"), (["BN", "EN"], "BN_ONLY", "NONE"), (["BN", "BN", "EN_BORROWED", "EN"], "CS", "HIGH"),
    ],
)
def test_classify(spark, langs, label, confidence):
    x = one(spark, C.classify(tags(langs)), t="")
    plain = ["EN" if v != "BN" else v for v in langs]
    assert (x.label, x.cs_confidence, x.switch_count) == (label, confidence, sum(a != b for a, b in zip(plain, plain[1:], strict=False)))


def test_no_tags_are_noise(spark):
    assert one(spark, C.classify(F.array().cast(C.TAG)), t="").label == "NOISE"


def test_tagging_and_loans(spark):
    found = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end")) for w in (" ফোন, ", "hello", "a", "12", "ü")))
    tagged = C.tag_words(found)
    assert [(t.word, t.lang) for t in one(spark, tagged, t="")] == [("ফোন,", "BN"), ("hello", "EN"), ("ü", "BN")]
    again = one(spark, C.retag_borrowed(tagged), t="")
    assert [(t.lang, t.canonical_en) for t in again] == [("EN_BORROWED", "phone"), ("EN", None), ("BN", None)]


def test_text_detection(spark):
    assert one(spark, C.is_code_switched_text("t"), t="আমি আজ office যাব") is True
    assert one(spark, C.is_code_switched_text("t"), t="আমি যাব") is False
