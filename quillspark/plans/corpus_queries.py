"""Queries of normalisation, tokens, tiers, merging, splitting and auditing over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codemix, text as T
from ..operators import audit, ingest, quality, report, split
from ..sources.shared import new_path
from ..streaming import resume, segments
from . import speech_tables as D
from .registry import query

CLIPS = "c AS (SELECT doc_id AS clip_id, text AS transcript, lang AS dialect, source AS source_id, n_chars / 15.0 AS duration_sec FROM documents)"
FLAGGED = CLIPS + ", fl AS (SELECT c.*, coalesce(toxic = 1, false) AS is_code_switched, coalesce(quality, 0) AS quality FROM c LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id) ON doc_id = clip_id)"
TOKENS = CLIPS + ", t AS (SELECT clip_id, dialect, unnest(regexp_extract_all(lower(transcript), '[a-zà-ɏ]+')) AS token FROM c)"
LEXICON = "lex AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zà-ɏ]+')) AS token FROM benchmark)"
WORD = D.LOWER_WORD


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower("transcript"), F.lit(WORD), F.lit(0))
    return D.clips(spark, sf_dir).select("clip_id", "dialect", F.explode(found).alias("token"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(html, '(?i)https?://\\S+|www\\.\\S+', ' ', 'g'), '#[\\p{L}\\p{N}_]+', ' ', 'g'),
'@[\\p{L}\\p{N}_]+', ' ', 'g'), '০১২৩৪৫৬৭৮৯', '0123456789'), '[.,!?;:"''()\\[\\]{}<>|/\\\\`~@#$%^&*_+=\\-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM pages""")
def surface_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, digits, punctuation and white space; repeats stay."""
    x = T.squeeze(T.strip_punctuation(T.ascii_digits(T.strip_links("html"))))
    return D.table(spark, sf_dir, "pages").select("page_id", x.alias("clean"))


_CLASSES = {
    "invisible": r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}\x{00AD}]+", "links": r"(?i)https?://\S+|www\.\S+", "tags": r"#[\p{L}\p{N}_]+", "names": r"@[\p{L}\p{N}_]+",
    "emoji": r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}\x{10000}-\x{10FFFF}\x{2600}-\x{2B55}\x{200D}\x{23CF}\x{23E9}\x{231A}\x{FE0F}\x{3030}]+",
}
_SURFACE = "nfc_normalize(text)"
for _pattern in _CLASSES.values():
    _SURFACE = f"regexp_replace({_SURFACE}, '{_pattern}', ' ', 'g')"
_SURFACE = f"translate({_SURFACE}, '০১২৩৪৫৬৭৮৯', '0123456789')"
_NO_PUNCTUATION = r"regexp_replace({0}, '[.,!?;:\"''()\[\]{{}}<>|/\\`~@#$%^&*_+=\-\x{{0964}}\x{{0965}}]+', ' ', 'g')"


@query(rf"""WITH s AS (SELECT conv_id, turn, {_SURFACE} AS s FROM conversations), c AS (SELECT *, string_split(s, '') AS ch FROM s),
k AS (SELECT conv_id, turn, {_NO_PUNCTUATION.format('s')} AS plain, {_NO_PUNCTUATION.format("array_to_string(list_transform(list_filter(range(1, len(ch) + 1), lambda i: i <= 2 OR NOT (ch[i] = ch[i - 1] AND ch[i] = ch[i - 2] AND ch[i] <> chr(10))), lambda i: ch[i]), '')")} AS capped FROM c),
w AS (SELECT *, list_filter(string_split(trim(regexp_replace(capped, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM k)
SELECT conv_id, turn, sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: i <= 2 OR NOT (w[i] = w[i - 1] AND w[i] = w[i - 2])), lambda i: w[i]), ' ')) AS clean_sha256,
sha256(lower(trim(regexp_replace(plain, '\s+', ' ', 'g')))) AS primary_sha256 FROM w""")
def full_surface_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps, with NFC and both caps."""
    return D.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(T.normalize_transcript("text"), 256).alias("clean_sha256"), F.sha2(T.primary_normalize("text"), 256).alias("primary_sha256"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_transform(range(1, len(w) + 1), lambda i: {'i': i, 'w': w[i]}), lambda s: s.i <= 2 OR NOT (w[s.i - 1] = s.w AND w[s.i - 2] = s.w)), lambda s: s.w), ' ') AS capped FROM w""")
def word_run_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.cap_words("text").alias("capped"))


@query("WITH " + CLIPS + """, w AS (SELECT clip_id, regexp_extract_all(lower(transcript), '[a-zà-ɏ]+') AS w FROM c)
SELECT clip_id, len(w) >= 6 AND len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) < len(w) - 2 AS loops FROM w""")
def word_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower("transcript"), F.lit(WORD), F.lit(0))
    return D.clips(spark, sf_dir).withColumn("w", found).select("clip_id", T.repeated_ngram(F.col("w")).alias("loops"))


@query("WITH " + CLIPS + """ SELECT clip_id, len(regexp_extract_all(transcript, '[A-Za-z]')) AS latin, len(regexp_extract_all(transcript, '[À-ɏ]')) AS accented,
len(regexp_extract_all(transcript, '[ঀ-৿]')) AS bengali FROM c""")
def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: T.count_of("transcript", p).cast("long")
    return D.clips(spark, sf_dir).select("clip_id", n(T.LATIN).alias("latin"), n(D.NATIVE).alias("accented"), n(T.BENGALI).alias("bengali"))


@query("WITH " + CLIPS + """ SELECT clip_id, trim(transcript) = '' OR contains(transcript, chr(65533)) OR regexp_matches(regexp_replace(transcript, '[\\x00-\\x7Fঀ-৿]', '', 'g'), '\\p{L}') AS low FROM c""")
def low_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.clips(spark, sf_dir).select("clip_id", T.low_quality("transcript").alias("low"))


@query("WITH " + CLIPS + """, f AS (SELECT contains(transcript, chr(65533)) AS d, regexp_matches(regexp_replace(transcript, '[\\x00-\\x7Fঀ-৿]', '', 'g'), '\\p{L}') AS f FROM c)
SELECT count(*) FILTER (d) AS damaged, count(*) FILTER (f) AS "foreign", count(*) FILTER (d AND f) AS both, count(*) FILTER (d OR f) AS excluded, count(*) FILTER (NOT (d OR f)) AS kept FROM f""")
def quality_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_overlap(D.clips(spark, sf_dir))


_TAGGED = "WITH " + CLIPS + """, g AS (SELECT clip_id, list_filter(list_transform(regexp_extract_all(transcript, '[A-Za-zÀ-ɏ]+'), lambda x: CASE WHEN regexp_matches(x, '[À-ɏ]') THEN 'BN'
WHEN regexp_matches(x, '^[A-Za-z]{2,}$') THEN 'EN' END), lambda x: x IS NOT NULL) AS l FROM c),
n AS (SELECT clip_id, l, len(list_filter(l, lambda x: x = 'BN')) AS bn, len(list_filter(l, lambda x: x = 'EN')) AS en,
len(list_filter(range(1, len(l)), lambda i: l[i] <> l[i + 1])) AS switches FROM g),
r AS (SELECT *, CASE WHEN bn + en > 0 THEN bn / (bn + en) ELSE 0.0 END AS bs, CASE WHEN bn + en > 0 THEN en / (bn + en) ELSE 0.0 END AS es FROM n) """


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform(F.regexp_extract_all("transcript", F.lit(D.WORD), F.lit(0)), lambda w: F.struct(w.alias("word"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end")))
    return D.clips(spark, sf_dir).select("clip_id", codemix.tag_words(words, D.NATIVE).alias("tags"))


@query(_TAGGED + "SELECT clip_id, switches FROM r")
def switch_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("clip_id", codemix.switch_count(F.transform("tags", lambda t: t["lang"])).cast("long").alias("switches"))


@query(_TAGGED + """SELECT clip_id, CASE WHEN len(l) = 0 THEN 'NOISE' WHEN es >= 0.9 AND bn <= 1 THEN 'EN_ONLY' WHEN bn + en >= 4 AND bn >= 2 AND en >= 2 AND switches >= 1 AND es BETWEEN 0.1 AND 0.7 THEN 'CS'
WHEN bn + en >= 4 AND bn >= 2 AND en >= 1 AND switches >= 1 AND es BETWEEN 0.05 AND 0.8 THEN 'CS' WHEN bn >= 2 AND en >= 1 THEN 'BN_ONLY' WHEN bs >= 0.95 THEN 'BN_ONLY' WHEN es >= 0.6 THEN 'EN_ONLY' ELSE 'BN_ONLY' END AS label,
CASE WHEN len(l) = 0 OR (es >= 0.9 AND bn <= 1) THEN 'NONE' WHEN bn + en >= 4 AND bn >= 2 AND en >= 2 AND switches >= 1 AND es BETWEEN 0.1 AND 0.7 THEN 'HIGH'
WHEN bn + en >= 4 AND bn >= 2 AND en >= 1 AND switches >= 1 AND es BETWEEN 0.05 AND 0.8 THEN 'MEDIUM' WHEN bn >= 2 AND en >= 1 THEN 'LOW' ELSE 'NONE' END AS cs_confidence,
bn AS bn_word_count, en AS en_word_count, switches AS switch_count, round(bs, 2) AS bn_ratio, round(es, 2) AS en_ratio FROM r""")
def code_mix_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tagged(spark, sf_dir).select("clip_id", codemix.classify(F.col("tags")).alias("x"))
    return rows.select("clip_id", "x.label", "x.cs_confidence", "x.bn_ratio", "x.en_ratio", *(F.col(f"x.{k}").cast("long").alias(k) for k in ("bn_word_count", "en_word_count", "switch_count")))


@query("WITH " + FLAGGED + """, x AS (SELECT clip_id, CASE WHEN trim(transcript) = '' THEN 'empty_transcript' WHEN len(regexp_extract_all(transcript, '[À-ɏ]')) < 3 THEN 'too_short'
WHEN is_code_switched AND NOT (quality * 0.5 BETWEEN 0.05 AND 0.65) THEN 'cs_en_ratio_out_of_range' WHEN (clip_id % 100) / 100.0 >= 0.59 THEN 'high_no_speech_prob' END AS reason, clip_id % 100 AS p FROM fl)
SELECT clip_id, CASE WHEN reason IS NULL THEN CASE WHEN p / 100.0 < 0.30 THEN 'HIGH' ELSE 'MEDIUM' END END AS tier, reason FROM x""")
def tier_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.flagged(spark, sf_dir)
    found = quality.tier(F.col("transcript"), F.col("is_code_switched"), F.col("quality") * 0.5, (F.col("clip_id") % 100) / 100.0, native=D.NATIVE)
    return rows.select("clip_id", found.alias("x")).select("clip_id", "x.tier", "x.reason")


@query("WITH " + FLAGGED + """, x AS (SELECT CASE WHEN trim(transcript) = '' THEN 'empty_transcript' WHEN len(regexp_extract_all(transcript, '[À-ɏ]')) < 3 THEN 'too_short'
WHEN is_code_switched AND NOT (quality * 0.5 BETWEEN 0.05 AND 0.65) THEN 'cs_en_ratio_out_of_range' WHEN (clip_id % 100) / 100.0 >= 0.59 THEN 'high_no_speech_prob' END AS reason FROM fl)
SELECT reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY reason""")
def reject_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.histogram(tier_reasons(spark, sf_dir).where("reason IS NOT NULL"), "reason")


@query("WITH " + TOKENS + ", d AS (SELECT token, dialect, count(*) AS n, count(DISTINCT clip_id) AS docs FROM t GROUP BY ALL) SELECT token, CAST(sum(n) AS BIGINT) AS count, CAST(sum(docs) AS BIGINT) AS doc_count, count(*) AS dialect_count FROM d GROUP BY token")
def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.token_statistics(_tokens(spark, sf_dir)).drop("top_dialects")


@query("WITH " + TOKENS + """, d AS (SELECT token, dialect, count(DISTINCT clip_id) AS docs FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY docs DESC, dialect) AS k FROM d)
SELECT token, string_agg(dialect || ':' || docs, ';' ORDER BY k) AS top_dialects FROM r WHERE k <= 5 GROUP BY token""")
def top_langs_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.token_statistics(_tokens(spark, sf_dir)).select("token", "top_dialects")


@query("WITH " + TOKENS + ", " + LEXICON + """ SELECT DISTINCT t.token, CASE WHEN length(t.token) = 1 THEN 'NOISE' WHEN lex.token IS NOT NULL THEN 'STANDARD' WHEN regexp_matches(t.token, '[a-z]') THEN 'ENGLISH_CANDIDATE' ELSE 'UNKNOWN' END AS label
FROM t LEFT JOIN lex USING (token)""")
def lexicon_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _tokens(spark, sf_dir).select("token").distinct()
    lexicons = quality.one_lexicon({"NOISE": tokens.where(F.length("token") == 1), "STANDARD": D.lexicon(spark, sf_dir)})
    return tokens.join(lexicons, "token", "left").select("token", quality.lexicon_label(F.col("token"), F.col("lexicon")).alias("label"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_tokens(quality.token_statistics(_tokens(spark, sf_dir)), quality.one_lexicon({"STANDARD": D.lexicon(spark, sf_dir)}))


_SUSPICION = "WITH " + TOKENS + ", " + LEXICON + """, d AS (SELECT token, dialect, count(*) AS n, count(DISTINCT clip_id) AS docs FROM t GROUP BY ALL),
a AS (SELECT token, sum(n) AS cnt, sum(docs) AS docs, count(*) AS dialects FROM d GROUP BY token),
b AS (SELECT a.*, CASE WHEN lex.token IS NOT NULL THEN 'STANDARD' WHEN regexp_matches(a.token, '[a-z]') THEN 'ENGLISH_CANDIDATE' ELSE 'UNKNOWN' END AS label,
  len(regexp_extract_all(a.token, '\\p{L}')) AS letters, len(regexp_extract_all(a.token, '[aeiou]')) AS vowels FROM a LEFT JOIN lex USING (token)),
x AS (SELECT *, list_filter([CASE WHEN label = 'UNKNOWN' AND cnt <= 2 THEN 'rare_unknown' END, CASE WHEN label = 'UNKNOWN' AND dialects <= 1 THEN 'single_dialect_unknown' END,
  CASE WHEN regexp_matches(regexp_replace(token, '[a-z]', '', 'g'), '\\p{L}') THEN 'foreign_script_character' END,
  CASE WHEN len(list_filter(range(1, length(token) - 2), lambda i: token[i] = token[i+1] AND token[i] = token[i+2] AND token[i] = token[i+3])) > 0 THEN 'repeated_character' END,
  CASE WHEN regexp_matches(token, '[bcdfghjklmnpqrstvwxyz]{5,}') THEN 'too_many_consonants' END, CASE WHEN length(token) >= 8 AND vowels / letters < 0.18 THEN 'low_vowel_ratio' END,
  CASE WHEN length(token) <= 1 THEN 'too_short_token' END], lambda r: r IS NOT NULL) AS reasons FROM b),
s AS (SELECT *, coalesce(list_sum(list_transform(reasons, lambda r: CASE r WHEN 'foreign_script_character' THEN 4 WHEN 'repeated_character' THEN 3 WHEN 'too_many_consonants' THEN 3 WHEN 'rare_unknown' THEN 2 ELSE 1 END)), 0) AS total FROM x),
z AS (SELECT *, CASE WHEN len(list_filter(reasons, lambda r: r NOT IN ('rare_unknown', 'single_dialect_unknown'))) = 0 THEN least(total, 2) ELSE total END AS capped FROM s),
sc AS (SELECT token, label, CAST(CASE WHEN docs >= 20 OR dialects >= 4 THEN greatest(0, capped - 2) ELSE capped END AS BIGINT) AS score, reasons FROM z) """


@query(_SUSPICION + "SELECT token, label AS lexicon_label, score AS suspicion_score, array_to_string(reasons, ';') AS suspicion_reasons FROM sc")
def token_suspicion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("token", "lexicon_label", F.col("suspicion_score").cast("long").alias("suspicion_score"), "suspicion_reasons")


@query(_SUSPICION + """, pc AS (SELECT clip_id, count(*) AS token_count, count(*) FILTER (label = 'UNKNOWN') AS unknown_token_count, count(*) FILTER (score >= 3) AS suspicious_token_count, coalesce(sum(score) FILTER (score >= 3), 0) AS s FROM t JOIN sc USING (token) GROUP BY clip_id),
lw AS (SELECT clip_id, transcript, duration_sec, regexp_extract_all(lower(transcript), '[a-zà-ɏ]+') AS w FROM c),
fx AS (SELECT clip_id, len(w) AS n, CASE WHEN duration_sec >= 4 AND len(w) > 0 THEN len(w) / duration_sec END AS wps, transcript, w FROM lw),
ex AS (SELECT clip_id, n, wps, CASE WHEN wps < 0.8 THEN 3 ELSE 0 END + CASE WHEN len(w) >= 6 AND len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) < len(w) - 2 THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(transcript, '\\.\\.\\.\\s*$') THEN 2 ELSE 0 END AS extra FROM fx)
SELECT clip_id, n AS token_count, coalesce(unknown_token_count, 0) AS unknown_token_count, coalesce(suspicious_token_count, 0) AS suspicious_token_count, CAST(coalesce(s, 0) + extra AS BIGINT) AS suspicion_score, CASE WHEN n IS NOT NULL THEN round(wps, 3) END AS words_per_sec
FROM ex LEFT JOIN pc USING (clip_id) WHERE coalesce(s, 0) + extra > 0""")
def clip_suspicion(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = D.clips(spark, sf_dir).withColumns({"transcript": F.lower("transcript"), "avg_no_speech_prob": F.lit(None).cast("double")})
    return quality.score_clips(clips, _scored(spark, sf_dir), pattern=WORD).select("clip_id", "token_count", "unknown_token_count", "suspicious_token_count", "suspicion_score", "words_per_sec")


@query(_SUSPICION + """, pt AS (SELECT clip_id, token, count(*) AS times FROM t GROUP BY ALL), sp AS (SELECT clip_id, token, times, reasons FROM pt JOIN sc USING (token) WHERE score >= 3),
lw AS (SELECT clip_id, lower(transcript) AS transcript, duration_sec, regexp_extract_all(lower(transcript), '[a-zà-ɏ]+') AS w FROM c),
ft AS (SELECT clip_id, unnest(list_filter([CASE WHEN contains(transcript, chr(65533)) THEN 'replacement_character' END, CASE WHEN duration_sec >= 4 AND len(w) > 0 AND len(w) / duration_sec < 0.8 THEN 'under_transcription' END,
  CASE WHEN len(w) >= 6 AND len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) < len(w) - 2 THEN 'word_loop_hallucination' END,
  CASE WHEN regexp_matches(transcript, '\\.\\.\\.\\s*$') THEN 'truncated_transcript' END], lambda r: r IS NOT NULL)) AS reason FROM lw),
rs AS (SELECT clip_id, reason, sum(times) AS n FROM (SELECT clip_id, unnest(reasons) AS reason, times FROM sp UNION ALL SELECT clip_id, reason, 1 FROM ft) GROUP BY ALL),
rl AS (SELECT clip_id, string_agg(reason || ':' || n, ';' ORDER BY n DESC, reason) AS suspicion_reasons FROM rs GROUP BY clip_id), tl AS (SELECT clip_id, string_agg(DISTINCT token, ';' ORDER BY token) AS suspicious_tokens FROM sp GROUP BY clip_id)
SELECT clip_id, suspicion_reasons, coalesce(suspicious_tokens, '') AS suspicious_tokens FROM rl LEFT JOIN tl USING (clip_id)""")
def clip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why clips are suspicious, the most frequent reasons first, and their suspicious tokens."""
    clips = D.clips(spark, sf_dir).withColumns({"transcript": F.lower("transcript"), "avg_no_speech_prob": F.lit(None).cast("double")})
    return quality.score_clips(clips, _scored(spark, sf_dir), pattern=WORD).select("clip_id", "suspicion_reasons", "suspicious_tokens")


@query("WITH " + TOKENS + ", " + LEXICON + " SELECT DISTINCT token FROM t WHERE length(token) > 3 AND token NOT IN (SELECT token FROM lex)")
def new_lexicon_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.writers import new_tokens

    return new_tokens(_tokens(spark, sf_dir).where(F.length("token") > 3), D.lexicon(spark, sf_dir))


@query()
def nearest_dictionary_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens outside the lexicon and the most similar word of the whole lexicon."""
    words = D.lexicon(spark, sf_dir)
    tokens = _tokens(spark, sf_dir).select("token").distinct().join(words, "token", "left_anti")
    return quality.nearest_words(tokens, words.withColumnRenamed("token", "word"))


@query("""WITH u AS (SELECT o_custkey % 5000 AS k, o_orderkey, 0 AS priority, 'a' AS origin FROM orders UNION ALL SELECT l_orderkey % 5000, l_orderkey * 10 + l_linenumber, 1, 'b' FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority, o_orderkey) AS n FROM u) SELECT k, o_orderkey, origin FROM r WHERE n = 1""")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_wins(_merged(spark, sf_dir), "k", [F.col("priority"), F.col("o_orderkey")]).select("k", "o_orderkey", "origin")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = D.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5000).alias("k"), "o_orderkey")
    b = D.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5000).alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o_orderkey"))
    return ingest.union_in_order([a, b], ["a", "b"])


@query("""WITH u AS (SELECT o_custkey % 5000 AS k, o_orderkey, 0 AS priority, 'a' AS origin FROM orders UNION ALL SELECT l_orderkey % 5000, l_orderkey * 10 + l_linenumber, 1, 'b' FROM lineitem),
r AS (SELECT *, row_number() OVER w AS n, first(origin) OVER w AS f FROM u WINDOW w AS (PARTITION BY k ORDER BY priority, o_orderkey)) SELECT k, f AS kept_from, origin AS skipped_from FROM r WHERE n > 1""")
def duplicates_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.duplicates_report(_merged(spark, sf_dir), "k", [F.col("priority"), F.col("o_orderkey")])


@query("SELECT event_type, min_by(props, event_id) AS props FROM events WHERE trim(props) <> '' GROUP BY event_type")
def first_filled_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_filled(D.table(spark, sf_dir, "events"), "event_type", "props", [F.col("event_id")])


@query("WITH " + CLIPS + " SELECT sha256(coalesce(transcript, '')) AS content_hash, count(*) AS n FROM c GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_groups(audit.with_hash(D.clips(spark, sf_dir), "transcript"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(url, '^https?://[^/]+/*', '') AS path,
regexp_replace('clip_' || page_id || '_' || (page_id % 7), '_[0-9]+$', '') AS source FROM pages""")
def url_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clip = F.concat_ws("_", F.lit("clip"), F.col("page_id").cast("string"), (F.col("page_id") % 7).cast("string"))
    return D.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), ingest.canonical_path(F.regexp_replace("url", "^https?://[^/]+", ""), "\u0000").alias("path"), ingest.source_id(F.lit(None).cast("string"), clip).alias("source"))


#: Held-out places of {n} groups: a fifth, rounded up, half of it (rounded up) for the test; whole parts of each stratum's
#: share, then the largest remainders.
APPORTIONED = """z AS (SELECT count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS t FROM g), st AS (SELECT s, count(*) AS c FROM g GROUP BY s),
h1 AS (SELECT s, t, c * t // n AS q, row_number() OVER (ORDER BY c * t % n DESC, md5('42|' || s), s) AS r FROM st, z),
h2 AS (SELECT s, t, (t + 1) // 2 AS k, CAST(q + CASE WHEN r <= t - sum(q) OVER () THEN 1 ELSE 0 END AS BIGINT) AS held FROM h1),
h3 AS (SELECT s, held, k, held * k // t AS q, row_number() OVER (ORDER BY held * k % t DESC, md5('42|' || s), s) AS r FROM h2),
h4 AS (SELECT s, held, CAST(q + CASE WHEN r <= k - sum(q) OVER () THEN 1 ELSE 0 END AS BIGINT) AS tested FROM h3),
gr AS (SELECT g, s, row_number() OVER (PARTITION BY s ORDER BY md5('42|' || g), g) AS r FROM g),
spl AS (SELECT g, s, CASE WHEN r <= tested THEN 'test' WHEN r <= held THEN 'validation' ELSE 'train' END AS split FROM gr JOIN h4 USING (s)) """
_SPLIT = "g AS (SELECT user_id AS g, user_id % 5 AS s FROM events GROUP BY user_id), " + APPORTIONED


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), (F.col("user_id") % 5).alias("s"), "event_id")
    return split.group_split(rows, "g", "s", "event_id")


@query("WITH " + _SPLIT + "SELECT * FROM spl")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)


@query("WITH g AS (SELECT c_custkey AS g, c_custkey // 4 AS s FROM customer), " + APPORTIONED + "SELECT * FROM spl")
def small_strata_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata of four groups each, of which a fifth has to be found over all of them."""
    rows = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("g"), F.expr("c_custkey div 4").alias("s"), F.lit(1).alias("o"))
    return split.group_split(rows, "g", "s", "o")


@query("WITH " + _SPLIT + ", pin AS (SELECT event_id, user_id AS g FROM events WHERE event_id % 3 = 0) SELECT event_id, g FROM pin WHERE g NOT IN (SELECT g FROM spl WHERE split <> 'train')")
def split_leakage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "events").where("event_id % 3 = 0").select("event_id", F.col("user_id").alias("g"))
    return split.leakage_guard(rows, _groups(spark, sf_dir), "g").select("event_id", "g")


@query("WITH " + FLAGGED + """, x AS (SELECT *, CASE clip_id % 10 WHEN 8 THEN 'validation' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM fl)
SELECT coalesce(split, 'total') AS split, count(*) AS clips, round(sum(duration_sec) / 3600, 4) AS hours, count(*) FILTER (is_code_switched) AS cs_clips, count(DISTINCT source_id) AS sources FROM x GROUP BY ROLLUP (split)""")
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("clip_id") % 10 == 8, "validation").when(F.col("clip_id") % 10 == 9, "test").otherwise("train")
    return split.split_statistics(D.flagged(spark, sf_dir).withColumn("split", part))


@query("WITH " + FLAGGED + """ SELECT dialect, count(*) AS clips, round(sum(duration_sec) / 3600, 4) AS hours, count(*) FILTER (is_code_switched) AS cs_clips, round(100 * count(*) FILTER (is_code_switched) / count(*), 1) AS cs_pct FROM fl GROUP BY dialect""")
def dialect_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_dialect(D.flagged(spark, sf_dir))


@query("WITH " + FLAGGED + """, q AS (SELECT *, 60 // (SELECT count(DISTINCT dialect) FROM fl) AS per, row_number() OVER (PARTITION BY dialect, is_code_switched ORDER BY md5('42|' || clip_id), clip_id) AS r,
count(*) FILTER (is_code_switched) OVER (PARTITION BY dialect) AS k FROM fl), f AS (SELECT *, r <= CASE WHEN is_code_switched THEN per // 2 ELSE per - least(per // 2, k) END AS first FROM q)
SELECT clip_id, dialect, is_code_switched FROM f ORDER BY first DESC, md5('43|' || clip_id), clip_id LIMIT 60""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_sample(D.flagged(spark, sf_dir), 60, "dialect", "is_code_switched", "clip_id").select("clip_id", "dialect", "is_code_switched")


@query("WITH " + FLAGGED + """, l AS (SELECT * FROM fl WHERE clip_id % 11 <> 0), f AS (SELECT *, row_number() OVER (PARTITION BY source_id, is_code_switched ORDER BY md5('7|' || clip_id), clip_id) AS r FROM l),
w AS (SELECT *, CASE WHEN is_code_switched AND r = 1 THEN 0 WHEN NOT is_code_switched THEN 1 ELSE 2 END AS wish FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY wish, md5('7|' || clip_id), clip_id) AS n FROM w) SELECT clip_id, source_id, is_code_switched FROM k WHERE n <= 2""")
def k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.flagged(spark, sf_dir)
    return split.k_per_group(rows, 2, "source_id", "is_code_switched", "clip_id", used=rows.where("clip_id % 11 = 0")).select("clip_id", "source_id", "is_code_switched")


@query("SELECT c_custkey FROM customer ORDER BY md5('42|' || c_custkey), c_custkey LIMIT 100")
def simple_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.simple_sample(D.table(spark, sf_dir, "customer").select("c_custkey"), 100, "c_custkey")


@query("""WITH RECURSIVE c AS (SELECT s_nationkey, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, s_nationkey) AS k FROM supplier GROUP BY s_nationkey),
f AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0]::BIGINT[] AS load, NULL::BIGINT AS s_nationkey, NULL::BIGINT AS rows, NULL::INT AS shard UNION ALL
SELECT c.k, list_transform(range(1, 5), lambda i: load[i] + CASE WHEN i = list_position(load, list_min(load)) THEN c.rows ELSE 0 END), c.s_nationkey, c.rows, CAST(list_position(load, list_min(load)) - 1 AS INT) FROM f JOIN c ON c.k = f.k + 1)
SELECT s_nationkey, rows, shard FROM f WHERE shard IS NOT NULL""")
def greedy_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.shards(D.table(spark, sf_dir, "supplier"), "s_nationkey", 4)


#: A run of speech is closed by ten silent frames, at the tenth after the first of them or at the last frame of all.
_SEGMENTS = """WITH v AS (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events WHERE value > 0.5),
r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM v)
SELECT user_id, greatest(min(event_id) - 10, 0) AS first, least(max(event_id) + 11, any_value(n)) AS last FROM r JOIN (SELECT user_id, max(event_id) AS n FROM events GROUP BY user_id) USING (user_id) GROUP BY user_id, run"""


@query(_SEGMENTS)
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "events").withColumn("speech", F.col("value") > 0.5)
    return split.speech_segments(rows, "user_id", "event_id", "speech")


@query(_SEGMENTS)
def streamed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream that is stopped and started again three times between frames, then told of the ends."""
    e = D.table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") > 0.5).alias("speech"))
    folder, out, state = (new_path(spark, f"frames-{k}") for k in ("in", "out", "state"))
    n = (e.agg(F.max("event_id")).first()[0] or 0) + 1
    parts = [e.where(F.expr(f"event_id * 4 div {n}") == k) for k in range(4)]
    ends = e.select("user_id").distinct().select("user_id", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("boolean").alias("speech"))
    for rows in (*parts, ends):
        rows.write.mode("append").parquet(folder)
        found = segments.speech_segments(spark.readStream.schema(e.schema).parquet(folder), "user_id", "event_id", "speech")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("""WITH v AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM v)
SELECT user_id, min(ts) AS first, max(ts) + INTERVAL 1 HOUR AS last, count(*) AS n FROM r GROUP BY user_id, run""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.sessions(D.table(spark, sf_dir, "events"), "user_id", "ts", "1 hour")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey % 5 <> 0")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = D.table(spark, sf_dir, "orders").select("o_orderkey")
    done = D.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return ingest.pending(orders, done, orders.where("o_orderkey % 5 = 0"), key="o_orderkey")


@query("SELECT coalesce(max(o_orderkey), -1) + 1 AS start FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def resume_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = D.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return ingest.resume_position(D.table(spark, sf_dir, "orders"), known, "o_custkey", "o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r BETWEEN 500 AND 900")
def row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.row_range(D.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], 500, 900).select("o_orderkey")


@query("WITH " + FLAGGED + """ SELECT clip_id, unnest(['clean_all'] || CASE WHEN is_code_switched THEN ['clean_code_switched'] ELSE [] END) AS route FROM fl""")
def routed_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.routed(D.flagged(spark, sf_dir)).select("clip_id", "route")


@query("WITH " + FLAGGED + " SELECT clip_id, unnest(['all', CASE WHEN is_code_switched THEN 'cs_only' ELSE 'bn_only' END]) AS subset FROM fl")
def training_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.subsets(D.flagged(spark, sf_dir)).select("clip_id", "subset")


@query("""WITH g AS (SELECT DISTINCT n_regionkey FROM nation), k AS (SELECT DISTINCT s_nationkey % 3 AS m FROM supplier), v AS (SELECT n_regionkey, n_nationkey % 3 AS m, count(*) AS n FROM nation GROUP BY ALL)
SELECT g.n_regionkey, k.m, v.n FROM g CROSS JOIN k LEFT JOIN v ON v.n_regionkey = g.n_regionkey AND v.m = k.m""")
def metric_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "nation").withColumn("m", F.col("n_nationkey") % 3).groupBy("n_regionkey", "m").agg(F.count(F.lit(1)).alias("n"))
    return report.grid(rows, "n_regionkey", "m", "n")


@query("""WITH s AS (SELECT DISTINCT unnest(string_split(rs, '')) AS symbol FROM (SELECT text AS rs FROM benchmark)) SELECT symbol, row_number() OVER (ORDER BY symbol) + 2 AS id FROM s WHERE symbol NOT IN ('', ' ')
UNION ALL SELECT * FROM (VALUES ('<pad>', 0), ('<unk>', 1), ('|', 2))""")
def char_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.character_vocabulary(D.table(spark, sf_dir, "benchmark"), "text")


@query("""SELECT n.n_name AS dialect, r.r_name AS domain, ['news in ' || n.n_name, r.r_name || ' by ' || n.n_name] AS queries, n.n_name || '__' || r.r_name AS bucket FROM nation n CROSS JOIN region r""")
def query_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = D.table(spark, sf_dir, "nation").select(F.col("n_name").alias("dialect"), F.col("n_name").alias("place"))
    domains = D.table(spark, sf_dir, "region").select(F.col("r_name").alias("domain"))
    templates = domains.select("domain", F.posexplode(F.array(F.lit("news in {place}"), F.concat("domain", F.lit(" by {dialect}")))).alias("position", "template"))
    return split.query_catalogue(profiles, domains, templates)


_PICK = "CAST('0x' || substr(md5('42|' || attempt || '|{0}'), 1, 8) AS BIGINT) % len({1}) + 1"


@query(f"""WITH b AS (SELECT list_sort(list(DISTINCT p_brand)) AS brand, list_sort(list(DISTINCT p_type)) AS kind, ['{{brand}} sells {{kind}}', 'no {{kind}} but {{kind}} of {{brand}}', '{{kind}} only'] AS t FROM part),
a AS (SELECT unnest(range(0, 1000)) AS attempt), x AS (SELECT attempt, replace(replace(t[{_PICK.format('template', 't')}], '{{brand}}', brand[{_PICK.format('brand', 'brand')}]), '{{kind}}', kind[{_PICK.format('kind', 'kind')}]) AS text FROM a, b)
SELECT min(attempt) AS attempt, text FROM x GROUP BY text ORDER BY attempt LIMIT 100""")
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences from templates and the names of parts, brands and nations."""
    part = D.table(spark, sf_dir, "part").agg(F.sort_array(F.collect_set("p_brand")).alias("brand"), F.sort_array(F.collect_set("p_type")).alias("kind"))
    banks = part.select(F.create_map(F.lit("brand"), F.col("brand"), F.lit("kind"), F.col("kind")).alias("banks"))
    templates = spark.range(1).select(F.array(F.lit("{brand} sells {kind}"), F.lit("no {kind} but {kind} of {brand}"), F.lit("{kind} only")).alias("templates"))
    return split.fill_templates(100, templates, banks)


@query()
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all orders that share parts. Recursive SQL over the whole table is too slow; tests use brute force."""
    return audit.components(D.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("""WITH RECURSIVE r AS (SELECT s_suppkey, s_suppkey AS c FROM supplier UNION SELECT x.s_suppkey, r.c FROM r JOIN supplier y ON y.s_suppkey = r.s_suppkey
JOIN supplier x ON x.s_nationkey % 7 = y.s_nationkey % 7 AND (x.s_suppkey + 3) // 10 = (y.s_suppkey + 3) // 10 OR x.s_suppkey // 4 = y.s_suppkey // 4),
k AS (SELECT s_suppkey, min(c) AS component FROM r GROUP BY 1)
SELECT component, count(*) AS n, CASE WHEN substr(md5('42|' || component), 1, 4) < 'cccd' THEN 'train' WHEN substr(md5('42|' || component), 1, 4) < 'e666' THEN 'validation' ELSE 'test' END AS split FROM k GROUP BY component""")
def component_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers linked by two kinds of keys, split by whole components."""
    s = D.table(spark, sf_dir, "supplier")
    block = F.concat_ws("|", F.lit("a"), (F.col("s_nationkey") % 7).cast("string"), F.floor((F.col("s_suppkey") + 3) / 10).cast("string"))
    four = F.concat_ws("|", F.lit("b"), F.floor(F.col("s_suppkey") / 4).cast("string"))
    edges = s.select("s_suppkey", F.explode(F.array(block, four)).alias("key"))
    found = audit.component_split(audit.components(edges, "s_suppkey", "key"), "component")
    return found.groupBy("component", "split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, sha256(string_agg(CAST(c_custkey AS VARCHAR), chr(10) ORDER BY CAST(c_custkey AS VARCHAR))) AS checksum, count(*) AS n FROM customer GROUP BY c_mktsegment")
def split_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted keys of each segment in one SHA-256, in a stream of pieces."""
    return audit.list_checksum(D.table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment")


@query("WITH " + CLIPS + " SELECT source_id, count(*) AS n, count(DISTINCT clip_id % 3) AS splits FROM c GROUP BY source_id HAVING count(DISTINCT clip_id % 3) > 1")
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.leakage(D.clips(spark, sf_dir).withColumn("split", F.col("clip_id") % 3), "source_id")


@query("""WITH w AS (SELECT string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM benchmark)
SELECT x AS ngram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS x FROM w) GROUP BY x""")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.ngram_counts(D.table(spark, sf_dir, "benchmark"), T.words("text"))


@query("""SELECT c_custkey, unnest(['train', 'test']) AS role, s FROM (SELECT c_custkey, c_nationkey % 2 AS s FROM customer)""")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 2).alias("s"))
    parts = [split.leave_one_out(rows, "s", g) for g in split.groups_of(rows, "s")]
    return reduce(lambda a, b: a.unionByName(b), parts).select("c_custkey", "role", "s")


@query("""WITH x AS (SELECT event_id, user_id * 1000 AS a, user_id * 1000 + CAST(floor(value * 10000) AS BIGINT) AS b FROM events), y AS (SELECT *, CAST(ceil((b - a) / 15000.0) AS BIGINT) AS k FROM x WHERE b - a >= 5000),
z AS (SELECT *, greatest(k, 1) AS parts, unnest(range(0, greatest(k, 1))) AS part FROM y) SELECT event_id, part, a + CAST(floor(part * (b - a) / parts) AS BIGINT) AS start_ms, a + CAST(floor((part + 1) * (b - a) / parts) AS BIGINT) AS end_ms FROM z""")
def equal_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 1000).alias("start_ms"), (F.col("user_id") * 1000 + F.floor(F.col("value") * 10000)).alias("end_ms"))
    return split.equal_parts(rows).select("event_id", F.col("part").cast("long").alias("part"), "start_ms", "end_ms")
