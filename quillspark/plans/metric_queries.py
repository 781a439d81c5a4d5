"""Queries of error rates, detection, statistics and judges over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import judge, metrics, report, stats
from . import speech_tables as D
from .registry import query

#: Reference and hypothesis pairs, whole turns as words.
TURNS = r"""
WITH RECURSIVE cut AS (SELECT conv_id, turn, role, list_filter(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT u.conv_id, u.turn, u.conv_id % 4 AS grp, u.w AS r, a.w AS h, array_to_string(u.w, ' ') AS rs, array_to_string(a.w, ' ') AS hs FROM cut u JOIN cut a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      WHERE u.role = 'user' AND a.role = 'assistant'),
"""
#: The table of edit distances of {pairs} (conv_id, turn, kind, r, h), one list of columns a row i of each pair. In a
#: row, insertions are a running minimum of what the row above gives, less the column's number.
DISTANCES = """
dp AS (SELECT conv_id, turn, kind, r, h, 0 AS i, list_transform(range(0, len(h) + 1), lambda j: j::INT) AS d FROM {pairs} UNION ALL
       SELECT conv_id, turn, kind, r, h, i + 1, list_transform(range(1, len(u) + 1), lambda j: (j - 1 + list_min(u[1:j]))::INT) FROM (
         SELECT *, [i + 1] || list_transform(range(1, len(h) + 1), lambda j: (least(d[j + 1] + 1, d[j] + (h[j] <> r[i + 1])::INT) - j)::INT) AS u FROM dp WHERE i < len(r))),
"""
_WHOLE = "w0 AS (SELECT conv_id, turn, 'all' AS kind, r, h FROM p)," + DISTANCES.format(pairs="w0")
#: Pairs with word edits.
PAIRS = TURNS + _WHOLE + "s AS (SELECT p.*, len(p.r) AS n_words, d[len(p.h) + 1] AS word_edits FROM p JOIN dp USING (conv_id, turn) WHERE i = len(p.r)) "
#: Edit operations back from the end of each pair of {pairs}: a match or substitution before a deletion, that before an insertion.
_BACK = """
t AS MATERIALIZED (SELECT conv_id, turn, i, d FROM dp),
bt AS (SELECT conv_id, turn, grp, r, h, len(r) AS i, len(h) AS j, NULL::VARCHAR AS op FROM {pairs} UNION ALL
       SELECT conv_id, turn, grp, r, h, CASE WHEN nxt = 'i' THEN i ELSE i - 1 END, CASE WHEN nxt = 'd' THEN j ELSE j - 1 END, nxt FROM (
         SELECT bt.*, CASE WHEN bt.i > 0 AND j > 0 AND a.d[j + 1] = b.d[j] + (r[bt.i] <> h[j])::INT THEN CASE WHEN r[bt.i] = h[j] THEN 'm' ELSE 's' END
                           WHEN bt.i > 0 AND a.d[j + 1] = b.d[j + 1] + 1 THEN 'd' ELSE 'i' END AS nxt
         FROM bt JOIN t a ON a.conv_id = bt.conv_id AND a.turn = bt.turn AND a.i = bt.i LEFT JOIN t b ON b.conv_id = bt.conv_id AND b.turn = bt.turn AND b.i = bt.i - 1 WHERE bt.i > 0 OR j > 0)),
subs AS (SELECT r[i + 1] AS ref_word, h[j + 1] AS hyp_word, count(*) AS n FROM bt WHERE op = 's' GROUP BY ALL)
"""
OPERATIONS = TURNS + _WHOLE + _BACK.format(pairs="p")


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with word edits only: what most queries need."""
    r, h = T.words("reference"), T.words("hypothesis")
    return D.pairs(spark, sf_dir).withColumns({"n_words": F.size(r), "word_edits": metrics.word_distance(r, h)})


@query(PAIRS + "SELECT grp, count(*) AS n, round(sum(word_edits) / sum(n_words), 4) AS wer FROM s GROUP BY grp")
def corpus_wer_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate of all pairs of a group, as edits over words."""
    return _statistics(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), metrics.rate("word_edits", "n_words").alias("wer"))


@query(PAIRS + "SELECT conv_id, turn, n_words, word_edits, round(word_edits / n_words, 4) AS wer FROM s WHERE n_words > 0 ORDER BY wer DESC, conv_id, turn LIMIT 25")
def worst_pairs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _statistics(spark, sf_dir).withColumn("key", F.struct("conv_id", "turn"))
    return metrics.worst_pairs(rows, "key").select("conv_id", "turn", F.col("n_words").cast("long").alias("n_words"), "word_edits", "wer")


@query(PAIRS + """SELECT grp, round(avg(word_edits / n_words) FILTER (conv_id % 3 = 0), 4) AS macro_cs, round(avg(word_edits / n_words) FILTER (conv_id % 3 <> 0), 4) AS macro_other,
round(avg(word_edits / n_words) FILTER (conv_id % 3 = 0) - avg(word_edits / n_words) FILTER (conv_id % 3 <> 0), 4) AS gap FROM s GROUP BY grp""")
def wer_subset_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.macro_gap(_statistics(spark, sf_dir).withColumn("flag", F.col("conv_id") % 3 == 0), "flag", "grp")


#: Per-language parts: native words hold an accented letter, English ones are two plain letters or more after stripping.
_PARTS = r"""w AS (SELECT *, list_filter(r, lambda x: regexp_matches(x, '[À-ɏ]')) AS rb, list_filter(h, lambda x: regexp_matches(x, '[À-ɏ]')) AS hb,
   list_filter(r, lambda x: regexp_matches(regexp_replace(x, '^[.,!?;:"''()-]+|[.,!?;:"''()-]+$', '', 'g'), '^[A-Za-z]{2,}$')) AS rn,
   list_filter(h, lambda x: regexp_matches(regexp_replace(x, '^[.,!?;:"''()-]+|[.,!?;:"''()-]+$', '', 'g'), '^[A-Za-z]{2,}$')) AS hn, conv_id % 3 = 0 AS flag FROM p),
 d0 AS (SELECT *, len(rb) AS n_bn, len(rn) AS n_en, len(hb) AS m_bn, len(hn) AS m_en, len(list_filter(rn, lambda x: list_contains(hn, x))) AS en_kept FROM w),
 f AS (SELECT *, m_bn + m_en >= 4 AND m_bn >= 2 AND m_en >= 1 AND m_en / (m_bn + m_en) BETWEEN 0.05 AND 0.8 AS detected FROM d0)"""
PARTS = TURNS + _PARTS + " "
#: All edits of a pair: whole, native and English words, and characters, which become symbols of one byte each.
BUNDLE = TURNS + _PARTS + r""",
 w0 AS (SELECT conv_id, turn, 'all' AS kind, r, h FROM p UNION ALL SELECT conv_id, turn, 'bn', rb, CASE WHEN len(hb) = 0 THEN ['<empty>'] ELSE hb END FROM w
   UNION ALL SELECT conv_id, turn, 'en', rn, CASE WHEN len(hn) = 0 THEN ['<empty>'] ELSE hn END FROM w),""" + DISTANCES.format(pairs="w0") + r"""
 e AS (SELECT conv_id, turn, max(d[len(h) + 1]) FILTER (kind = 'all') AS word_edits, max(CASE WHEN len(r) > 0 THEN d[len(h) + 1] ELSE 0 END) FILTER (kind = 'bn') AS bn_edits,
   max(CASE WHEN len(r) > 0 THEN d[len(h) + 1] ELSE 0 END) FILTER (kind = 'en') AS en_edits FROM dp WHERE i = len(r) GROUP BY ALL),
 cv AS (SELECT conv_id, turn, rs, hs, list_distinct(string_split(rs || hs, '')) AS v FROM p),
 ce AS (SELECT conv_id, turn, length(rs) AS n_chars, levenshtein(array_to_string(list_transform(string_split(rs, ''), lambda x: chr(list_position(v, x)::INT)), ''),
   array_to_string(list_transform(string_split(hs, ''), lambda x: chr(list_position(v, x)::INT)), '')) AS char_edits FROM cv),
 b AS (SELECT *, len(r) AS n_words FROM f JOIN e USING (conv_id, turn) JOIN ce USING (conv_id, turn)) """


def _bundle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    native = lambda w: w.rlike(D.NATIVE)
    return metrics.pair_statistics(D.pairs(spark, sf_dir), native=native).withColumn("is_code_switched", F.col("conv_id") % 3 == 0)


_CONFUSION = """count(*) FILTER (flag AND detected) AS tp, count(*) FILTER (NOT flag AND detected) AS fp, count(*) FILTER (flag AND NOT detected) AS fn,
count(*) FILTER (NOT flag AND NOT detected) AS tn, round(coalesce(count(*) FILTER (flag AND detected) / nullif(count(*) FILTER (detected), 0), 0.0), 4) AS cs_precision,
round(coalesce(count(*) FILTER (flag AND detected) / nullif(count(*) FILTER (flag), 0), 0.0), 4) AS cs_recall,
round(coalesce(2 * count(*) FILTER (flag AND detected) / nullif(count(*) FILTER (flag) + count(*) FILTER (detected), 0), 0.0), 4) AS cs_f1"""


@query(PARTS + f"SELECT grp, {_CONFUSION} FROM f GROUP BY grp")
def confusion_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bundle_rows(spark, sf_dir)
    return rows.groupBy("grp").agg(*(c.alias(k) for k, c in metrics.detection(F.col("is_code_switched"), F.col("detected")).items()))


@query(PARTS + """SELECT grp, CAST(sum(n_en) AS BIGINT) AS en_words, CAST(sum(en_kept) AS BIGINT) AS kept, round(sum(en_kept) / nullif(sum(n_en), 0), 4) AS survival,
CAST(sum(n_en - en_kept) AS BIGINT) AS deleted, CAST(sum(CASE WHEN m_bn > 0 THEN n_en - en_kept ELSE 0 END) AS BIGINT) AS transliterated, round(sum(n_en - en_kept) / nullif(sum(n_en), 0), 4) AS deletion_rate FROM f WHERE flag GROUP BY grp""")
def english_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.english_survival(_bundle_rows(spark, sf_dir), "grp")


@query(BUNDLE + f"""SELECT grp, count(*) AS n, count(*) FILTER (flag) AS n_cs, round(sum(word_edits) / sum(n_words), 4) AS wer, round(sum(char_edits) / sum(n_chars), 4) AS cer,
round(sum(word_edits) FILTER (flag) / sum(n_words) FILTER (flag), 4) AS wer_cs, round(sum(word_edits) FILTER (NOT flag) / sum(n_words) FILTER (NOT flag), 4) AS wer_bn_only,
round(sum(bn_edits) / sum(n_bn), 4) AS wer_bn, round(sum(en_edits) / sum(n_en), 4) AS wer_en, round(sum(bn_edits) FILTER (flag) / sum(n_bn) FILTER (flag), 4) AS wer_bn_cs,
round(sum(en_edits) FILTER (flag) / sum(n_en) FILTER (flag), 4) AS wer_en_cs,
round((coalesce(sum(bn_edits) FILTER (flag) / nullif(sum(n_bn) FILTER (flag), 0), 0.0) + coalesce(sum(en_edits) FILTER (flag) / nullif(sum(n_en) FILTER (flag), 0), 0.0)) / 2, 4) AS mix_er,
round(sum(en_kept) FILTER (flag) / nullif(sum(n_en) FILTER (flag), 0), 4) AS en_survival, {_CONFUSION} FROM b GROUP BY grp""")
def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_bundle(_bundle_rows(spark, sf_dir), "grp")


@query(PAIRS + """, g AS (SELECT grp, round(sum(word_edits) / sum(n_words), 4) AS wer, count(*) AS n FROM s GROUP BY grp)
SELECT grp, 'wer' AS metric, wer AS value FROM g UNION ALL SELECT grp, 'n', CAST(n AS DOUBLE) FROM g""")
def metric_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus_wer_by_group(spark, sf_dir).withColumn("n", F.col("n").cast("double"))
    return report.long(rows, "grp", ["wer", "n"])


@query(OPERATIONS + """, o AS (SELECT grp, CAST(sum(CASE WHEN op IN ('m', 's', 'd') THEN 1 ELSE 0 END) AS BIGINT) AS n_words, count(*) FILTER (op = 's') AS sub, count(*) FILTER (op = 'd') AS del,
count(*) FILTER (op = 'i') AS ins FROM bt GROUP BY grp) SELECT *, round(sub / n_words, 4) AS sub_rate, round(del / n_words, 4) AS del_rate, round(ins / n_words, 4) AS ins_rate FROM o""")
def error_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_breakdown(D.pairs(spark, sf_dir), "grp")


#: Deletions of English words in an alignment of the English words alone.
_EN_OPERATIONS = TURNS + _PARTS + """,
w0 AS (SELECT conv_id, turn, 'en' AS kind, rn AS r, CASE WHEN len(hn) = 0 THEN ['<empty>'] ELSE hn END AS h, grp FROM w WHERE len(rn) > 0),""" + DISTANCES.format(pairs="w0") + _BACK.format(pairs="w0")


@query(_EN_OPERATIONS + "SELECT grp, count(*) FILTER (op IN ('m', 's', 'd')) AS en_words, count(*) FILTER (op = 'd') AS en_deleted, round(count(*) FILTER (op = 'd') / count(*) FILTER (op IN ('m', 's', 'd')), 4) AS en_deletion_rate FROM bt GROUP BY grp")
def english_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English words that an alignment of the English words alone deletes."""
    return metrics.english_deletions(D.pairs(spark, sf_dir), "grp")


@query(OPERATIONS + "SELECT * FROM subs ORDER BY n DESC, ref_word, hyp_word LIMIT 20")
def top_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.substitutions(D.pairs(spark, sf_dir))


#: Characters of both words as symbols of one byte, for the distance.
_SYMBOLS = "list_distinct(string_split(ref_word || hyp_word, ''))"
_AS_SYMBOLS = "array_to_string(list_transform(string_split({0}, ''), lambda x: chr(list_position(v, x)::INT)), '')"


@query(OPERATIONS + f""", v AS (SELECT *, {_SYMBOLS} AS v FROM subs), x AS (SELECT ref_word, hyp_word, n, levenshtein({_AS_SYMBOLS.format('ref_word')}, {_AS_SYMBOLS.format('hyp_word')})
/ greatest(length(ref_word), length(hyp_word)) AS share FROM v) SELECT ref_word, hyp_word, n, round(share, 4) AS distance_share FROM x WHERE share <= 0.34""")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All substitutions of words that differ in a small part of their characters."""
    return metrics.spelling_variants(metrics.counted_substitutions(D.pairs(spark, sf_dir)))


@query(PARTS + """SELECT x AS word, count(*) AS n FROM (SELECT unnest(list_filter(rn, lambda x: NOT list_contains(hn, x))) AS x FROM f) GROUP BY x ORDER BY n DESC, word LIMIT 20""")
def top_deleted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.deleted_words(D.pairs(spark, sf_dir))


@query(BUNDLE + "SELECT grp, round(sum(char_edits) / sum(n_chars), 4) AS cer, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM b GROUP BY grp")
def corpus_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundle_rows(spark, sf_dir).groupBy("grp").agg(metrics.rate("char_edits", "n_chars").alias("cer"), F.sum("n_chars").alias("n_chars"))


#: Resamples of all bootstraps.
RESAMPLES = 10_000

#: Poisson weights of (key, b), as stats.poisson_weights() makes them: 64-bit products in 128 bits, cut to 64.
_CUT = "18446744073709551616::HUGEINT"


def _weights(rows: str, n: int = RESAMPLES) -> str:
    """CTEs x: rows with b and w. The constants are cut into parts that keep products within 127 bits."""
    def product(x: str, c: int) -> str:
        high, low = c >> 32, c & 0xFFFFFFFF
        return f"((({x} * {high}::HUGEINT) % 4294967296::HUGEINT) * 4294967296::HUGEINT + {x} * {low}::HUGEINT) % {_CUT}"

    a, b_, c = stats._STEP, stats._MIX_1, stats._MIX_2
    steps = " + ".join(f"(top >= {t})::INT" for t in stats._THRESHOLDS)
    return f"""
k0 AS (SELECT *, {product('(key + 42)::HUGEINT', a)} AS hk FROM {rows}),
b0 AS (SELECT b, {product('b::HUGEINT', b_)} AS hb FROM (SELECT unnest(range(0, {n})) AS b)),
h1 AS (SELECT *, (hk + hb) % {_CUT} AS h FROM k0, b0), h2 AS (SELECT * EXCLUDE (h), xor(h, h >> 30) AS h FROM h1), h3 AS (SELECT * EXCLUDE (h), {product('h', b_)} AS h FROM h2),
h4 AS (SELECT * EXCLUDE (h), xor(h, h >> 27) AS h FROM h3), h5 AS (SELECT * EXCLUDE (h), ({product('h', c)}) >> 32 AS top FROM h4),
x AS (SELECT *, {steps} AS w FROM h5)"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statistics(spark, sf_dir).withColumn("key", F.col("conv_id") * 100 + F.col("turn"))


_KEYED = PAIRS + ", keyed AS (SELECT grp, conv_id * 100 + turn AS key, word_edits, n_words FROM s),"
_ENDS = "round(rates[CAST(floor(len(rates) * 0.025) AS INT) + 1], 4) AS low, round(rates[least(CAST(floor(len(rates) * 0.975) AS INT) + 1, len(rates))], 4) AS high"


@query(_KEYED + _weights("keyed") + f""", t AS (SELECT grp, b, sum(w * word_edits) / sum(w * n_words) AS rate FROM x GROUP BY grp, b),
l AS (SELECT grp, list_sort(list(rate)) AS rates FROM t GROUP BY grp)
SELECT grp, (SELECT round(sum(word_edits) / sum(n_words), 4) FROM s WHERE s.grp = l.grp) AS rate, {_ENDS} FROM l""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap_interval(_keyed(spark, sf_dir), RESAMPLES, "key", "word_edits", "n_words", ["grp"])


@query(_KEYED[:-1] + f""" SELECT grp, count(*) AS rows, CAST({RESAMPLES} AS BIGINT) AS resamples, true AS whole, true AS spread, (SELECT round(sum(word_edits) / sum(n_words), 3) FROM s WHERE s.grp = keyed.grp) AS rate FROM keyed GROUP BY grp""")
def exact_resamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resamples of exactly as many pairs as there are: whether each one's weights add up to that, whether the resampled
    rates have the mean and spread that they should, and their mean."""
    rows = _keyed(spark, sf_dir).withColumn("one", F.lit(1))
    drawn = stats.exact_sums(rows, RESAMPLES, "key", ["word_edits", "n_words", "one"], ["grp"])
    own = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), (F.sum("word_edits") / F.sum("n_words")).alias("of_all"), F.sum("n_words").alias("words"))
    # standard error of a ratio by linearisation
    error = rows.join(own, "grp").groupBy("grp").agg(F.sqrt(F.sum(F.pow(F.col("word_edits") - F.col("of_all") * F.col("n_words"), 2))).alias("_e"), F.first("words").alias("_w"))
    error = error.select("grp", (F.col("_e") / F.col("_w")).alias("error"))
    seen = drawn.withColumn("r", F.col("word_edits") / F.col("n_words")).groupBy("grp").agg(F.count(F.lit(1)).alias("resamples"), F.min("one").alias("low"), F.max("one").alias("high"), F.avg("r").alias("mean"), F.stddev("r").alias("sd"))
    out = own.join(seen, "grp").join(error, "grp")
    near = (F.abs(F.col("sd") / F.col("error") - 1) < 0.1) & (F.abs(F.col("mean") - F.col("of_all")) < 0.1 * F.col("error") + 0.002)
    return out.select("grp", "rows", "resamples", ((F.col("low") == F.col("rows")) & (F.col("high") == F.col("rows"))).alias("whole"), near.alias("spread"), F.round("of_all", 3).alias("rate"))


_TAILS = """c AS (SELECT count(*) AS b, count(*) FILTER (d <= 0) AS low, count(*) FILTER (d >= 0) AS high, list_sort(list(d)) AS ds FROM t)"""
_TEST = """SELECT round(a, 4) AS rate_a, round(bb, 4) AS rate_b, round(a - bb, 4) AS delta, round(ds[CAST(floor(b * 0.025) AS INT) + 1], 4) AS delta_low, round(ds[CAST(floor(b * 0.975) AS INT) + 1], 4) AS delta_high,
round(100 * (a - bb) / a, 2) AS reduction_pct, round(low / b, 4) AS p_one, round(least(1.0, 2 * least((low + 1) / (b + 1), (high + 1) / (b + 1))), 4) AS p_two, low / b < 0.05 AS significant_05, low / b < 0.01 AS significant_01 FROM a, c"""


@query(_KEYED + _weights("keyed") + f""", t AS (SELECT b, sum(w * word_edits) / sum(w * n_words) - sum(w * (n_words - 1)) / sum(w * n_words) AS d FROM x GROUP BY b), {_TAILS},
a AS (SELECT sum(word_edits) / sum(n_words) AS a, sum(n_words - 1) / sum(n_words) AS bb FROM s) {_TEST}""")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keyed(spark, sf_dir).withColumn("other_edits", F.col("n_words") - 1)
    return stats.paired_test(rows, RESAMPLES, "key", "word_edits", "other_edits", "n_words")


@query(PAIRS + ", keyed AS (SELECT conv_id AS key, sum(word_edits) AS edits, sum(n_words) AS words FROM s GROUP BY conv_id)," + _weights("keyed") + """
SELECT b AS resample, CAST(sum(w * edits) AS DOUBLE) AS edits, CAST(sum(w * words) AS DOUBLE) AS words, round(sum(w * edits) / sum(w * words), 6) AS rate FROM x GROUP BY b""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled rates over whole conversations."""
    rows = _statistics(spark, sf_dir).groupBy("conv_id").agg(F.sum("word_edits").alias("edits"), F.sum("n_words").alias("words"))
    return stats.cluster_resamples(rows, RESAMPLES, "conv_id", ["edits", "words"]).withColumn("rate", F.round(F.col("edits") / F.col("words"), 6))


_FLAGS = PARTS + """, keyed AS (SELECT conv_id * 100 + turn AS key, grp, (flag AND detected)::INT AS tp, (NOT flag AND detected)::INT AS fp, (flag AND NOT detected)::INT AS fn,
(flag AND m_en > 0)::INT AS tp2, (NOT flag AND m_en > 0)::INT AS fp2, (flag AND m_en = 0)::INT AS fn2, CASE WHEN flag THEN en_kept ELSE 0 END AS kept, CASE WHEN flag THEN n_en ELSE 0 END AS en FROM f),"""


def _flagged_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion of the detector, of one that takes any English word for switching, and English survival, pair by pair."""
    one = lambda c: c.cast("int")
    rows = _bundle_rows(spark, sf_dir).withColumn("any", F.size(F.filter(T.words("hypothesis"), T.is_english_word)) > 0)
    cs, found, other = F.col("is_code_switched"), F.col("detected"), F.col("any")
    return rows.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("key"), "grp", one(cs & found).alias("tp"), one(~cs & found).alias("fp"), one(cs & ~found).alias("fn"), one(cs & other).alias("tp2"), one(~cs & other).alias("fp2"),
        one(cs & ~other).alias("fn2"), F.when(cs, F.col("en_kept")).otherwise(0).alias("kept"), F.when(cs, F.col("n_en")).otherwise(0).alias("en"),
    )


@query(_FLAGS + _weights("keyed") + f""", t AS (SELECT grp, b, coalesce(2 * sum(w * tp) / nullif(sum(w * (2 * tp + fp + fn)), 0), 0.0) AS rate FROM x GROUP BY grp, b), l AS (SELECT grp, list_sort(list(rate)) AS rates FROM t GROUP BY grp)
SELECT grp, (SELECT round(coalesce(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 0.0), 4) FROM keyed WHERE keyed.grp = l.grp) AS value, {_ENDS} FROM l""")
def cs_f1_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.metric_interval(_flagged_sums(spark, sf_dir), RESAMPLES, "key", ["tp", "fp", "fn"], metrics.f1_of("tp", "fp", "fn"), ["grp"])


@query(_FLAGS + _weights("keyed") + f""", t AS (SELECT grp, b, sum(w * kept) / nullif(sum(w * en), 0) AS rate FROM x GROUP BY grp, b), l AS (SELECT grp, list_sort(list(rate) FILTER (rate IS NOT NULL)) AS rates FROM t GROUP BY grp)
SELECT grp, (SELECT round(sum(kept) / nullif(sum(en), 0), 4) FROM keyed WHERE keyed.grp = l.grp) AS value, {_ENDS} FROM l""")
def survival_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.metric_interval(_flagged_sums(spark, sf_dir), RESAMPLES, "key", ["kept", "en"], lambda s: F.try_divide(s["kept"], s["en"]), ["grp"])


@query(PAIRS + ", keyed AS (SELECT grp, conv_id * 100 + turn AS key, CASE WHEN conv_id % 3 = 0 THEN word_edits ELSE 0 END AS e, CASE WHEN conv_id % 3 = 0 THEN n_words ELSE 0 END AS n FROM s)," + _weights("keyed") + f"""
, t AS (SELECT grp, b, sum(w * e) / nullif(sum(w * n), 0) AS rate FROM x GROUP BY grp, b), l AS (SELECT grp, list_sort(list(rate) FILTER (rate IS NOT NULL)) AS rates FROM t GROUP BY grp)
SELECT grp, (SELECT round(sum(e) / nullif(sum(n), 0), 4) FROM keyed WHERE keyed.grp = l.grp) AS value, {_ENDS} FROM l""")
def wer_cs_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keyed(spark, sf_dir).withColumns({"e": F.when(F.col("conv_id") % 3 == 0, F.col("word_edits")), "n": F.when(F.col("conv_id") % 3 == 0, F.col("n_words"))})
    return stats.metric_interval(rows, RESAMPLES, "key", ["e", "n"], lambda s: F.try_divide(s["e"], s["n"]), ["grp"])


@query(_FLAGS + _weights("keyed") + f""", t AS (SELECT b, coalesce(2 * sum(w * tp) / nullif(sum(w * (2 * tp + fp + fn)), 0), 0.0) - coalesce(2 * sum(w * tp2) / nullif(sum(w * (2 * tp2 + fp2 + fn2)), 0), 0.0) AS d FROM x GROUP BY b), {_TAILS},
a AS (SELECT coalesce(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 0.0) AS a, coalesce(2 * sum(tp2) / nullif(sum(2 * tp2 + fp2 + fn2), 0), 0.0) AS bb FROM keyed) {_TEST}""")
def cs_f1_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired difference of F1 of two detectors, each with its own denominator."""
    return stats.paired_metric_test(_flagged_sums(spark, sf_dir), RESAMPLES, "key", ["tp", "fp", "fn", "tp2", "fp2", "fn2"], metrics.f1_of("tp", "fp", "fn"), metrics.f1_of("tp2", "fp2", "fn2"))


@query("""SELECT l_returnflag, round(coalesce((avg(l_discount) - avg(l_tax)) / nullif(sqrt((var_samp(l_discount) + var_samp(l_tax)) / 2), 0), 0.0), 4) AS cohens_d FROM lineitem GROUP BY l_returnflag""")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cohens_d(D.table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", "l_returnflag")


@query("""SELECT l_returnflag, round(coalesce(avg(l_discount - l_tax) / nullif(stddev_samp(l_discount - l_tax), 0), 0.0), 4) AS cohens_dz FROM lineitem GROUP BY l_returnflag""")
def cohens_dz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cohens_dz(D.table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", "l_returnflag")


@query("""WITH t AS (SELECT s_suppkey, (s_suppkey * 37 % 101) / 1000.0 AS p FROM supplier),
r AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, s_suppkey) + 1)) AS step FROM t)
SELECT s_suppkey, round(p, 4) AS p, round(max(step) OVER (ORDER BY p, s_suppkey ROWS UNBOUNDED PRECEDING), 4) AS p_holm FROM r""")
def holm_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "supplier").select("s_suppkey", F.struct(((F.col("s_suppkey") * 37 % 101) / 1000.0).alias("p"), "s_suppkey").alias("order"))
    tests = rows.select("s_suppkey", F.col("order.p").alias("p"))
    return stats.holm(tests, "p").select("s_suppkey", F.round("p", 4).alias("p"), F.round("p_holm", 4).alias("p_holm"))


_VOTES = "SELECT l_orderkey AS k, CASE WHEN l_quantity < 15 THEN 'ACCEPT' WHEN l_quantity < 30 THEN 'REJECT' WHEN l_quantity < 45 THEN 'UNCERTAIN' END AS d FROM lineitem"


@query(f"""WITH v AS ({_VOTES}), c AS (SELECT k AS l_orderkey, count(*) AS judges, count(*) FILTER (d = 'ACCEPT') AS accept, count(*) FILTER (d = 'REJECT') AS reject,
count(*) FILTER (d = 'UNCERTAIN') AS uncertain, count(*) FILTER (d IS NULL) AS failed FROM v GROUP BY k)
SELECT *, CASE WHEN failed = judges THEN 'REJECT' WHEN accept >= judges // 2 + 1 THEN 'ACCEPT' WHEN reject >= judges // 2 + 1 THEN 'REJECT' ELSE 'UNCERTAIN' END AS ensemble_decision FROM c""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    votes = D.table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(q < 15, "ACCEPT").when(q < 30, "REJECT").when(q < 45, "UNCERTAIN").alias("decision"))
    return judge.majority_vote(votes, "l_orderkey")


_SCORES = "SELECT l_orderkey, 'd' || (l_linenumber % 2) AS dimension, CAST(l_quantity AS INT) % 6 AS score FROM lineitem"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("d"), (F.col("l_linenumber") % 2).cast("string")).alias("dimension"), (F.col("l_quantity").cast("int") % 6).alias("score"))


@query(f"""WITH s AS ({_SCORES}), g AS (SELECT l_orderkey, dimension, round(avg(score), 2) AS mean, coalesce(stddev_samp(score), 0.0) AS sd FROM s GROUP BY ALL)
SELECT l_orderkey, dimension, mean, round(sd, 3) AS sd, round(1 - sd / 5, 3) AS confidence, CASE WHEN mean >= 3 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g""")
def judge_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.ensemble(_scores(spark, sf_dir), "l_orderkey")


@query(f"""WITH s AS (SELECT *, row_number() OVER () AS id FROM ({_SCORES})), p AS (SELECT a.l_orderkey, count(*) AS pairs, count(*) FILTER (abs(a.score - b.score) <= 1) AS near
FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.dimension = b.dimension AND a.id < b.id GROUP BY 1),
m AS (SELECT l_orderkey, round(avg(m) + 1e-9, 2) AS overall FROM (SELECT l_orderkey, dimension, round(avg(score), 2) AS m FROM s GROUP BY ALL) GROUP BY 1)
SELECT l_orderkey, overall, round(coalesce(near / nullif(pairs, 0), 0.0), 3) AS agreement_rate FROM m LEFT JOIN p USING (l_orderkey)""")
def ensemble_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.agreement(_scores(spark, sf_dir), "l_orderkey")


@query(f"""WITH s AS (SELECT l_orderkey, avg(score) AS overall, avg(score) / 6 AS agreement_rate, max(score) > 4 AS flag FROM ({_SCORES}) GROUP BY 1)
SELECT CASE WHEN grouping(flag) = 1 THEN 'all' WHEN flag THEN 'cs' ELSE 'bn' END AS subset, count(*) AS n, round(avg(overall), 3) AS overall, round(avg(agreement_rate), 3) AS agreement_rate
FROM s GROUP BY GROUPING SETS ((flag), ())""")
def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).groupBy("l_orderkey").agg(F.avg("score").alias("overall"), (F.avg("score") / 6).alias("agreement_rate"), (F.max("score") > 4).alias("flag"))
    return judge.judge_summary(rows, "flag")


@query(r"""WITH r AS (SELECT event_id, 'Sure: {"decision": "' || CASE WHEN event_id % 4 = 0 THEN 'accept' WHEN event_id % 4 = 1 THEN 'REJECT' WHEN event_id % 4 = 2 THEN 'maybe' ELSE 'Uncertain' END
|| '", "not_noise": "' || CASE WHEN value > 1 THEN 'YES' ELSE 'no' END || '"} ' || props AS reply FROM events WHERE event_id % 4 <> 5)
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'ACCEPT' WHEN event_id % 4 = 1 THEN 'REJECT' WHEN event_id % 4 = 3 THEN 'UNCERTAIN' END AS decision,
CASE WHEN event_id % 4 <> 2 THEN contains(reply, 'YES') END AS not_noise FROM r""")
def json_reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id") % 4
    reply = F.concat(F.lit('Sure: {"decision": "'), F.when(e == 0, "accept").when(e == 1, "REJECT").when(e == 2, "maybe").otherwise("Uncertain"), F.lit('", "not_noise": "'), F.when(F.col("value") > 1, "YES").otherwise("no"), F.lit('"}'))
    rows = D.table(spark, sf_dir, "events").select("event_id", judge.parse_decision(reply).alias("d"))
    return rows.select("event_id", "d.decision", "d.not_noise")


@query(PAIRS + """, g AS (SELECT CAST(grp AS VARCHAR) AS model, CAST(round((100 * round(sum(word_edits) / sum(n_words), 4))::DECIMAL(18, 2), 1)::DECIMAL(18, 1) AS VARCHAR) AS cell FROM s GROUP BY grp)
SELECT model, model || ',' || cell AS csv, rpad(model, 24, ' ') || ' ' || lpad(cell, 8, ' ') AS plain, model || ' & ' || cell || ' ' || chr(92) || chr(92) AS latex FROM g""")
def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus_wer_by_group(spark, sf_dir).select(F.col("grp").cast("string").alias("model"), "wer")
    return report.comparison(rows, "model", ["wer"])
