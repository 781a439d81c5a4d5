"""Word and character error rates, their parts, and detection of code-switching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codemix, text as T
from .alignment import alignment, edit_distance

def word_distance(ref: Column, hyp: Column) -> Column:
    """Unit-cost edit distance of two arrays of words, of any number of different words."""
    return edit_distance(ref, hyp)


def pair_statistics(pairs: DataFrame, ref: str = "reference", hyp: str = "hypothesis", native=T.is_bengali_word, english=T.is_english_word) -> DataFrame:
    """pairs with edits and lengths in words and characters, whole and by language, and both detections of switching.

    Everything that metrics sum up, computed once for each pair: a metric is then one pass of sums.
    """
    r, h = T.words(ref), T.words(hyp)
    rows = pairs.withColumns({"_r": r, "_h": h, "_rs": T.squeeze(T.empty_if_null(ref)), "_hs": T.squeeze(T.empty_if_null(hyp))})
    en = lambda c: F.transform(F.filter(F.col(c), english), F.lower)
    raw = lambda c: F.filter(F.col(c), english)
    bn = lambda c: F.filter(F.col(c), native)
    rows = rows.withColumns({"_rb": bn("_r"), "_hb": bn("_h"), "_re": en("_r"), "_he": en("_h"), "_rr": raw("_r"), "_hr": raw("_h")})
    filled = lambda c: F.when(F.size(c) == 0, F.array(F.lit("<empty>"))).otherwise(F.col(c))
    some = F.size("_r") > 0
    counted = lambda d, n: F.when(n > 0, d).otherwise(0)
    rows = rows.withColumns({
        "n_words": F.size("_r"), "word_edits": counted(word_distance(F.col("_r"), F.col("_h")), F.size("_r")),
        "n_chars": F.length("_rs"), "char_edits": F.when(some, F.levenshtein("_rs", "_hs")).otherwise(0),
        "n_bn": F.size("_rb"), "bn_edits": counted(word_distance(F.col("_rb"), filled("_hb")), F.size("_rb")),
        "n_en": F.size("_re"), "en_edits": counted(word_distance(F.col("_re"), filled("_he")), F.size("_re")),
        "en_cased_edits": counted(word_distance(F.col("_rr"), filled("_hr")), F.size("_rr")),
        "detected": codemix.is_code_switched_text(hyp, native, english),
        "en_kept": F.size(F.filter("_re", lambda w: F.array_contains(F.col("_he"), w))), "native_in_hyp": F.size("_hb") > 0,
    })
    return rows.drop("_r", "_h", "_rs", "_hs", "_rb", "_hb", "_re", "_he", "_rr", "_hr")


def rate(edits: str | Column, n: str | Column, where: Column | None = None, places: int = 4) -> Column:
    """Sum of edits over sum of lengths, null without any."""
    e, k = (F.col(x) if isinstance(x, str) else x for x in (edits, n))
    if where is not None:
        e, k = F.when(where, e), F.when(where, k)
    return F.round(F.try_divide(F.sum(e), F.sum(k)), places)


def detection(flag: Column, found: Column) -> dict[str, Column]:
    """Confusion counts, and precision, recall and F1 with 0 for an empty denominator."""
    tp, fp, fn, tn = F.count_if(flag & found), F.count_if(~flag & found), F.count_if(flag & ~found), F.count_if(~flag & ~found)
    zero = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 4)
    return {
        "tp": tp, "fp": fp, "fn": fn, "tn": tn, "cs_precision": zero(F.try_divide(tp, tp + fp)), "cs_recall": zero(F.try_divide(tp, tp + fn)),
        "cs_f1": zero(F.try_divide(2 * tp, 2 * tp + fp + fn)),
    }


def metric_bundle(statistics: DataFrame, *by: str, flag: str = "is_code_switched") -> DataFrame:
    """All metrics of pair_statistics() rows, by model or other columns, in one pass of sums."""
    cs = F.coalesce(F.col(flag), F.lit(False))
    parts = [F.coalesce(F.try_divide(F.sum(F.when(cs, F.col(e))), F.sum(F.when(cs, F.col(n)))), F.lit(0.0)) for e, n in (("bn_edits", "n_bn"), ("en_cased_edits", "n_en"))]
    measures = {
        "n": F.count(F.lit(1)), "n_cs": F.count_if(cs), "wer": rate("word_edits", "n_words"), "cer": rate("char_edits", "n_chars"), "wer_cs": rate("word_edits", "n_words", cs), "wer_bn_only": rate("word_edits", "n_words", ~cs),
        "wer_bn": rate("bn_edits", "n_bn"), "wer_en": rate("en_edits", "n_en"), "wer_bn_cs": rate("bn_edits", "n_bn", cs), "wer_en_cs": rate("en_edits", "n_en", cs), "mix_er": F.round((parts[0] + parts[1]) / 2, 4),
        "en_survival": F.round(F.try_divide(F.sum(F.when(cs, F.col("en_kept"))), F.sum(F.when(cs, F.col("n_en")))), 4), **detection(cs, F.col("detected")),
    }
    return statistics.groupBy(*by).agg(*(c.alias(k) for k, c in measures.items()))


def error_breakdown(pairs: DataFrame, *by: str, ref: str = "reference", hyp: str = "hypothesis") -> DataFrame:
    """Substitutions, deletions, insertions and their rates. Of a blank reference only insertions count."""
    rows = pairs.select(*by, F.size(T.words(ref)).alias("n"), alignment(T.words(ref), T.words(hyp)).alias("a"))
    sums = {k: F.sum(f"a.{k}") for k in ("sub", "del", "ins")}
    return rows.groupBy(*by).agg(F.sum("n").alias("n_words"), *(c.alias(k) for k, c in sums.items()), *(F.round(F.try_divide(c, F.sum("n")), 4).alias(f"{k}_rate") for k, c in sums.items()))


def english_deletions(pairs: DataFrame, *by: str, ref: str = "reference", hyp: str = "hypothesis", english=T.is_english_word) -> DataFrame:
    """English reference words, those that an alignment with the hypothesis's English words deletes, and their share.

    A hypothesis without English words counts as one word that fits none; references without any aren't counted."""
    en = lambda c: F.transform(F.filter(T.words(c), english), F.lower)
    rows = pairs.select(*by, en(ref).alias("_r"), en(hyp).alias("_h")).where(F.size("_r") > 0)
    filled = F.when(F.size("_h") == 0, F.array(F.lit("<empty>"))).otherwise(F.col("_h"))
    rows = rows.select(*by, F.size("_r").alias("n"), alignment(F.col("_r"), filled)["del"].alias("d"))
    return rows.groupBy(*by).agg(F.sum("n").alias("en_words"), F.sum("d").alias("en_deleted"), F.round(F.try_divide(F.sum("d"), F.sum("n")), 4).alias("en_deletion_rate"))


def english_survival(statistics: DataFrame, *by: str, flag: str = "is_code_switched") -> DataFrame:
    """English words of code-switched references, kept and deleted ones, and those deleted where the hypothesis has
    native words, so that they may have been transliterated."""
    rows = statistics.where(F.coalesce(F.col(flag), F.lit(False))).withColumn("_gone", F.col("n_en") - F.col("en_kept"))
    gone, n = F.sum("_gone"), F.sum("n_en")
    return rows.groupBy(*by).agg(
        n.alias("en_words"), F.sum("en_kept").cast("long").alias("kept"), F.round(F.try_divide(F.sum("en_kept"), n), 4).alias("survival"), gone.cast("long").alias("deleted"),
        F.sum(F.when(F.col("native_in_hyp"), F.col("_gone")).otherwise(0)).cast("long").alias("transliterated"), F.round(F.try_divide(gone, n), 4).alias("deletion_rate"),
    )


def f1_of(tp: str, fp: str, fn: str):
    """F1 as a function of sums, 0 for an empty denominator."""
    return lambda s: F.coalesce(F.try_divide(2 * s[tp], 2 * s[tp] + s[fp] + s[fn]), F.lit(0.0))


def views(pairs: DataFrame, variants: Column, ref: str = "reference", hyp: str = "hypothesis", unicode: bool = True) -> DataFrame:
    """pairs twice, by ``view``: 'surface' with both texts surface-normalised, 'variants' with known variants of words
    in their canonical form as well. What is stored stays as it is."""
    surface = pairs.withColumns({c: T.normalize_transcript(c, unicode=unicode) for c in (ref, hyp)})
    canonical = surface.withColumns({c: T.normalize_variants(c, variants) for c in (ref, hyp)})
    return surface.withColumn("view", F.lit("surface")).unionByName(canonical.withColumn("view", F.lit("variants")))


def training_error_rate(pairs: DataFrame, *by: str, ref: str = "reference", hyp: str = "hypothesis") -> DataFrame:
    """Word error rate while training: pairs without a reference are left out, and without any pair it is 1."""
    r, h = T.words(ref), T.words(hyp)
    rows = pairs.select(*by, F.size(r).alias("n"), F.when(F.size(r) > 0, word_distance(r, h)).otherwise(0).alias("e"))
    return rows.groupBy(*by).agg(F.round(F.coalesce(F.try_divide(F.sum("e"), F.sum("n")), F.lit(1.0)), 4).alias("wer"))


def restored_labels(ids: Column, pad: int) -> Column:
    """Label ids with the padding id where training has put -100."""
    return F.transform(ids, lambda x: F.when(x == -100, F.lit(pad)).otherwise(x))


def with_human_references(predictions: DataFrame, human: DataFrame, key: str = "clip_id") -> DataFrame:
    """Predictions of the clips that people have transcribed, with ``silver`` (the old reference) and their reference."""
    truth = human.select(key, F.col("human_transcript").alias("_truth")).where(~T.blank("_truth"))
    return predictions.join(truth, key).withColumns({"silver": F.col("reference"), "reference": F.col("_truth")}).drop("_truth")


def counted_substitutions(pairs: DataFrame, ref: str = "reference", hyp: str = "hypothesis") -> DataFrame:
    """All substituted pairs and how often they occur."""
    rows = pairs.where(~T.blank(ref)).select(F.explode(alignment(T.words(ref), T.words(hyp))["pairs"]).alias("p"))
    return rows.groupBy(F.col("p.ref").alias("ref_word"), F.col("p.hyp").alias("hyp_word")).agg(F.count(F.lit(1)).alias("n"))


def substitutions(pairs: DataFrame, n: int = 20, ref: str = "reference", hyp: str = "hypothesis") -> DataFrame:
    """The n most frequent substituted pairs, of equals in alphabetical order."""
    return counted_substitutions(pairs, ref, hyp).orderBy(F.desc("n"), "ref_word", "hyp_word").limit(n)


def spelling_variants(found: DataFrame, most: float = 0.34) -> DataFrame:
    """Substitutions whose words differ in a small part of their characters."""
    share = F.levenshtein("ref_word", "hyp_word") / F.greatest(F.length("ref_word"), F.length("hyp_word"))
    return found.withColumn("distance_share", F.round(share, 4)).where(share <= most)


def deleted_words(pairs: DataFrame, n: int = 20, ref: str = "reference", hyp: str = "hypothesis", english=T.is_english_word) -> DataFrame:
    """The n English reference words that are most often missing from the hypothesis."""
    lower = lambda c: F.transform(F.filter(T.words(c), english), F.lower)
    rows = pairs.select(lower(ref).alias("r"), lower(hyp).alias("h")).select(F.explode(F.filter("r", lambda w: ~F.array_contains(F.col("h"), w))).alias("word"))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(n)


def worst_pairs(statistics: DataFrame, key: str, n: int = 25) -> DataFrame:
    """The n pairs with the highest word error rate, of equals by key."""
    wer = F.round(F.try_divide("word_edits", "n_words"), 4)
    return statistics.where("n_words > 0").withColumn("wer", wer).orderBy(F.desc("wer"), key).limit(n)


def switch_recall(pairs: DataFrame, *by: str) -> DataFrame:
    """Sum of min(switches of hypothesis, of reference) over the sum of the reference's. Columns ref_tags, hyp_tags."""
    n = {k: codemix.switch_count(F.transform(F.col(k), lambda t: codemix.plain_lang(t["lang"]))) for k in ("ref_tags", "hyp_tags")}
    return pairs.groupBy(*by).agg(F.round(F.try_divide(F.sum(F.least(*n.values())), F.sum(n["ref_tags"])), 4).alias("switch_recall"))


def accepted_pseudo_labels(pairs: DataFrame, most: float = 0.30, new: str = "hypothesis", old: str = "reference") -> DataFrame:
    """Pairs whose character error rate is at most ``most``; two blank texts agree, one blank one doesn't."""
    a, b = T.squeeze(T.empty_if_null(new)), T.squeeze(T.empty_if_null(old))
    cer = F.when(F.length(b) > 0, F.levenshtein(a, b) / F.length(b)).otherwise(F.when(F.length(a) == 0, 0.0).otherwise(1.0))
    return pairs.withColumn("cer", cer).where(F.col("cer") <= most)


def real_time_factor(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.round(F.try_divide(F.sum("decode_sec"), F.sum("duration_sec")), 4).alias("rtf"))


def annotator_agreement(rows: DataFrame, a: str = "annotator_a", b: str = "annotator_b") -> DataFrame:
    """Error rates in both directions and the share of equal texts."""
    one, two = pair_statistics(rows, a, b), pair_statistics(rows, b, a)
    pick = lambda s, x: s.agg(rate("word_edits", "n_words").alias(f"wer_{x}"), rate("char_edits", "n_chars").alias(f"cer_{x}"))
    same = rows.agg(F.round(F.avg((T.squeeze(T.empty_if_null(a)) == T.squeeze(T.empty_if_null(b))).cast("int")), 4).alias("exact"))
    return pick(one, "ab").crossJoin(pick(two, "ba")).crossJoin(same)  # one row each
