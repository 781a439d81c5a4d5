"""Queries of normalisation, tags, reviews, splits and reports whose inputs need a script of their own.

Letters of the tables' texts become Bengali ones by translation where an operator works on that script.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codemix, text as T
from ..operators import audit, ingest, judge, metrics, quality, report, split, stats
from ..sources import readers
from ..streaming import resume
from . import speech_tables as D
from .record_queries import CLIP_SQL, audio_listing, clip_records
from .registry import query

#: Latin letters and the Bengali letters that stand for them.
LATIN, BENGALI = "abcdeghijklmnoprstu", "অবচদএগহইজকলমনওপরসতউ"


def bengali(c: str | Column) -> Column:
    return F.translate(F.lower(F.col(c) if isinstance(c, str) else c), LATIN, BENGALI)


def sql_bengali(c: str) -> str:
    return f"translate(lower({c}), '{LATIN}', '{BENGALI}')"


# review and defaults


@query("""WITH """ + CLIP_SQL + """, sh AS (SELECT CAST(o_custkey % 1200 AS VARCHAR) AS clip_id, o_orderkey AS row, CASE WHEN o_orderkey % 2 = 0 THEN 'seen ' || o_orderstatus ELSE ' ' END AS human,
CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS dialect FROM orders), la AS (SELECT clip_id, max_by(human, row) AS human, max_by({'d': dialect}, row).d AS d FROM sh GROUP BY clip_id)
SELECT cl.clip_id, CASE WHEN la.clip_id IS NOT NULL THEN sha256(coalesce(nullif(trim(la.human), ''), transcript, '')) END AS human_sha256, coalesce(nullif(trim(la.d), ''), cl.dialect) AS dialect, la.clip_id IS NOT NULL AS reviewed
FROM cl LEFT JOIN la USING (clip_id)""")
def review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review sheet's edits, the last row of a clip counting and blank ones keeping what is there."""
    n = F.col("o_orderkey")
    sheet = D.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 1200).cast("string").alias("clip_id"), n.alias("row"), F.when(n % 2 == 0, F.concat(F.lit("seen "), "o_orderstatus")).otherwise(" ").alias("human_transcript"),
        F.when(n % 3 == 0, F.col("o_orderstatus")).alias("dialect"), F.lit(None).cast("string").alias("domain"),
    )
    rows = ingest.merge_review(clip_records(spark, sf_dir), sheet)
    return rows.select("clip_id", F.when(F.col("reviewed"), F.sha2(F.coalesce("human_transcript", F.lit("")).cast("binary"), 256)).alias("human_sha256"), "dialect", "reviewed")


@query("WITH " + CLIP_SQL + " SELECT clip_id, coalesce(dialect, 'unknown') AS dialect, coalesce(domain, 'General') AS domain, is_code_switched, CAST(bn_ratio AS DOUBLE) AS bn_ratio FROM cl")
def defaults_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.with_defaults(clip_records(spark, sf_dir)).select("clip_id", "dialect", "domain", "is_code_switched", "bn_ratio")


@query("SELECT event_id, coalesce(nullif(trim(CASE WHEN event_id % 3 = 0 THEN ' ' || event_type || ' ' WHEN event_id % 3 = 1 THEN '  ' END), ''), trim(props)) AS text FROM events")
def filled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id") % 3
    human = F.when(e == 0, F.concat(F.lit(" "), "event_type", F.lit(" "))).when(e == 1, F.lit("  "))
    return D.table(spark, sf_dir, "events").select("event_id", ingest.filled_text(human, F.col("props")).alias("text"))


@query("SELECT c_custkey, lower(trim(f)) IN ('true', '1') AS flag FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' TRUE' WHEN 1 THEN '1' WHEN 2 THEN 'no' WHEN 3 THEN '' ELSE 'True ' END AS f FROM customer)")
def parsed_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    written = F.when(k == 0, " TRUE").when(k == 1, "1").when(k == 2, "no").when(k == 3, "").otherwise("True ")
    return D.table(spark, sf_dir, "customer").select("c_custkey", ingest.parse_flag(written).alias("flag"))


@query("SELECT c_custkey, TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE CAST(c_custkey / 8.0 AS VARCHAR) END AS DOUBLE) AS p FROM customer")
def nullable_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return D.table(spark, sf_dir, "customer").select("c_custkey", ingest.nullable_number(F.when(c % 3 == 0, "n/a").otherwise((c / 8.0).cast("string"))).alias("p"))


@query("WITH " + CLIP_SQL + """ SELECT clip_id, '[' || replace(dialect || ' x', ' ', '_') || '] ' || clip_id AS tagged, regexp_replace('[' || dialect || '] ' || clip_id, '^\\[[^\\]]*\\]\\s*', '') AS plain FROM cl""")
def dialect_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clip_records(spark, sf_dir)
    return rows.select("clip_id", ingest.tag_text(F.concat("dialect", F.lit(" x")), F.col("clip_id")).alias("tagged"), ingest.untag_text(F.concat(F.lit("["), "dialect", F.lit("] "), "clip_id")).alias("plain"))


@query("WITH " + CLIP_SQL + " SELECT clip_id, CASE WHEN CAST(clip_id AS BIGINT) % 7 = 0 THEN 'test' WHEN CAST(clip_id AS BIGINT) % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM cl")
def split_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clip_records(spark, sf_dir).select("clip_id")
    n = F.col("clip_id").cast("long")
    return ingest.split_of(rows, rows.where(n % 7 == 0), rows.where(n % 5 == 0))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'r__' || s_name ELSE 'r__b' || s_nationkey || '__' || s_name END AS prefix FROM supplier""")
def output_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_nationkey")
    bucket = F.concat(F.lit("b"), k.cast("string"))
    return D.table(spark, sf_dir, "supplier").select("s_suppkey", ingest.output_prefix(F.col("s_name"), bucket, F.when(k % 3 == 0, bucket).otherwise("other"), F.lit("r")).alias("prefix"))


@query("""WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'root/known' || page_id % 3 || '/x.wav' WHEN 1 THEN 'known1/sub/x.wav' WHEN 2 THEN 'root/north__News/x.wav' ELSE 'root/other/x.wav' END AS path FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'd' || page_id % 3 WHEN 1 THEN 'd1' WHEN 2 THEN 'north' ELSE 'unknown' END AS dialect, CASE page_id % 4 WHEN 0 THEN 'dom' || page_id % 3 WHEN 1 THEN 'dom1' WHEN 2 THEN 'News' ELSE 'General' END AS domain FROM f""")
def bucket_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialect and domain of a file's folder, of its parent, or from the folder's name."""
    k = F.col("page_id") % 4
    path = F.when(k == 0, F.concat(F.lit("root/known"), (F.col("page_id") % 3).cast("string"), F.lit("/x.wav"))).when(k == 1, "known1/sub/x.wav").when(k == 2, "root/north__News/x.wav").otherwise("root/other/x.wav")
    folders = spark.createDataFrame([(f"known{i}", f"d{i}", f"dom{i}") for i in range(3)], "folder string, dialect string, domain string")
    return ingest.bucket_metadata(D.table(spark, sf_dir, "pages").select("page_id", path.alias("path")), folders).select("page_id", "dialect", "domain")


@query("""SELECT coalesce(k.folder, d.folder) AS folder, coalesce(k.dialect, d.dialect) AS dialect FROM (SELECT n_name AS folder, CASE WHEN n_nationkey % 2 = 0 THEN 'known' END AS dialect FROM nation WHERE n_nationkey < 15) k
FULL JOIN (SELECT n_name AS folder, 'default' AS dialect FROM nation WHERE n_nationkey > 5) d ON k.folder = d.folder""")
def folder_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = D.table(spark, sf_dir, "nation"), F.col("n_nationkey")
    known = n.where(k < 15).select(F.col("n_name").alias("folder"), F.when(k % 2 == 0, "known").alias("dialect"))
    return ingest.merge_folder_metadata(known, n.where(k > 5).select(F.col("n_name").alias("folder"), F.lit("default").alias("dialect")))


_KEYS = ("ft_whisper_bn_only", "ft_whisper_cs_only", "ft_wav2vec2_all", "ft_wavlm_x", "ft_whisper_all_lm", "whisper_large")
_MODELS = f"(SELECT o_orderkey, {list(_KEYS)}[o_orderkey % 6 + 1] || CASE WHEN o_orderkey % 12 < 6 THEN '' ELSE '_' || o_orderstatus || CASE o_custkey % 3 WHEN 0 THEN '_lm' ELSE '' END END AS model FROM orders)"


@query(f"""SELECT o_orderkey, model, CASE WHEN model LIKE '%\\_lm' ESCAPE '\\' THEN 'lm' WHEN model LIKE 'ft\\_whisper\\_%' ESCAPE '\\' THEN 'whisper' WHEN model LIKE 'ft\\_wav2vec2\\_%' ESCAPE '\\' OR model LIKE 'ft\\_wavlm\\_%' ESCAPE '\\' THEN 'ctc' ELSE 'unknown' END AS family,
CASE WHEN model = 'ft_whisper_bn_only' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey % 3 = 0) THEN 'ft_bn_only' ELSE model END AS folder FROM {_MODELS}""")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of model keys, and folders under legacy names."""
    o, c = D.table(spark, sf_dir, "orders"), D.table(spark, sf_dir, "customer")
    key = F.element_at(F.array(*map(F.lit, _KEYS)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    run = F.concat(F.lit("_"), F.col("o_orderstatus"), F.when(F.col("o_custkey") % 3 == 0, "_lm").otherwise(""))
    models = o.select("o_orderkey", F.concat(key, F.when(F.col("o_orderkey") % 12 < 6, "").otherwise(run)).alias("model"))
    kind = F.col("c_custkey") % 3
    folders = c.select(F.when(kind == 0, "ft_bn_only").when(kind == 1, "ft_whisper_cs_only").otherwise("ft_cs_only").alias("folder"))
    return ingest.model_folder(models, folders).select("o_orderkey", "model", ingest.model_family(F.col("model")).alias("family"), "folder")


@query("""WITH """ + CLIP_SQL + """, a AS (SELECT audio_path FROM cl WHERE CAST(clip_id AS BIGINT) % 5 > 0) SELECT clip_id FROM cl WHERE audio_path IN (SELECT audio_path FROM a) AND trim(transcript) <> ''""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.training_rows(clip_records(spark, sf_dir), audio_listing(spark, sf_dir)).select("clip_id")


@query("""WITH """ + CLIP_SQL + """, a AS (SELECT DISTINCT audio_path FROM cl WHERE CAST(clip_id AS BIGINT) % 5 > 0), m AS (SELECT transcript, a.audio_path IS NULL AS gone FROM cl LEFT JOIN a ON cl.audio_path = a.audio_path)
SELECT count(*) FILTER (NOT gone AND trim(coalesce(transcript, '')) <> '') AS kept, count(*) FILTER (gone) AS no_audio, count(*) FILTER (NOT gone AND trim(coalesce(transcript, '')) = '') AS no_text FROM m""")
def training_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.training_losses(clip_records(spark, sf_dir), audio_listing(spark, sf_dir))


@query("""WITH s AS (SELECT DISTINCT unnest(string_split(text, '')) AS symbol FROM benchmark), v AS (SELECT symbol, row_number() OVER (ORDER BY symbol) + 2 AS id FROM s WHERE symbol NOT IN ('', ' ') UNION ALL SELECT '|', 2),
m AS (SELECT map(list(symbol), list(id)) AS m FROM v) SELECT n_nationkey, list_transform(list_filter(string_split(replace(lower(n_name), ' ', '|'), ''), lambda c: c <> ''), lambda c: coalesce(m[c], 1)) AS labels FROM nation, m""")
def label_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as label ids of a character vocabulary."""
    vocabulary = report.character_vocabulary(D.table(spark, sf_dir, "benchmark"), "text")
    return D.table(spark, sf_dir, "nation").select("n_nationkey", ingest.symbols_of(F.lower("n_name"), vocabulary).cast("array<bigint>").alias("labels"))


@query("SELECT n_nationkey, list_transform(range(0, 3), lambda k: CASE WHEN (n_nationkey + k) % 3 = 0 THEN 50257 ELSE CAST(n_nationkey + k AS BIGINT) END) AS ids FROM nation")
def restored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array(*(F.when((F.col("n_nationkey") + k) % 3 == 0, F.lit(-100).cast("long")).otherwise((F.col("n_nationkey") + k).cast("long")) for k in range(3)))
    return D.table(spark, sf_dir, "nation").select("n_nationkey", metrics.restored_labels(ids, 50257).cast("array<bigint>").alias("ids"))


@query("WITH " + CLIP_SQL + ", x AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY md5('3|' || clip_id), clip_id) AS r FROM cl) SELECT clip_id, source_id FROM x WHERE r <= 4")
def first_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_k(clip_records(spark, sf_dir), "source_id", [split.shuffle_key(3, "clip_id"), F.col("clip_id")]).select("clip_id", "source_id")


@query("WITH " + CLIP_SQL + " SELECT clip_id, upper(clip_id || dialect) AS target FROM cl")
def target_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clip_records(spark, sf_dir).withColumn("transcript", F.concat("clip_id", "dialect"))
    return ingest.with_target_text(rows, rewrite=F.upper).select("clip_id", "target")


@query("WITH " + CLIP_SQL + """ SELECT clip_id, CASE WHEN CAST(clip_id AS BIGINT) % 3 = 0 THEN audio_path ELSE 'segments/' || source_id || '/' || clip_id || '.wav' END AS audio_path FROM cl WHERE CAST(clip_id AS BIGINT) % 5 > 0 AND source_id IS NOT NULL""")
def resolved_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale paths found again by their file names."""
    rows = clip_records(spark, sf_dir)
    stale = F.when(F.col("clip_id").cast("long") % 3 == 0, F.col("audio_path")).otherwise(F.concat(F.lit("\\old\\disk\\"), "clip_id", F.lit(".wav")))
    return ingest.resolved_audio(rows.withColumn("audio_path", stale), audio_listing(spark, sf_dir).where("audio_path IS NOT NULL")).select("clip_id", "audio_path")


# augmentation and pinning


@query("WITH " + CLIP_SQL + ", o AS (SELECT * FROM cl WHERE CAST(clip_id AS BIGINT) % 6 > 0), n AS (SELECT dialect, count(*) AS n FROM o GROUP BY dialect) SELECT clip_id FROM o JOIN n USING (dialect) WHERE is_code_switched OR n < 150")
def augmentation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clip_records(spark, sf_dir).withColumn("augmented", F.col("clip_id").cast("long") % 6 == 0)
    return split.augmentation_candidates(rows, rare_below=150).select("clip_id")


_KINDS = "[{'t': 'speed', 'p': 0.9}, {'t': 'speed', 'p': 1.1}, {'t': 'noise', 'p': 20.0}, {'t': 'pitch', 'p': 2.0}, {'t': 'pitch', 'p': -2.0}]"


@query("WITH " + CLIP_SQL + f""", k AS (SELECT clip_id, CAST(duration_sec AS DOUBLE) / 40 AS dur, source_id, unnest({_KINDS}) AS kind FROM cl), r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY md5('42|' || clip_id || '|' || kind.t || '|' || CAST(kind.p AS DOUBLE))) AS r FROM k),
x AS (SELECT clip_id || '_' || kind.t || '_' || replace(CAST(CAST(kind.p AS DOUBLE) AS VARCHAR), '.', 'p') AS clip_id, kind.t AS aug_type, round(CASE WHEN kind.t = 'speed' THEN dur / CAST(kind.p AS DOUBLE) ELSE dur END, 3) AS duration_sec FROM r WHERE r <= 2)
SELECT clip_id, aug_type, duration_sec, 'train' AS split_pin FROM x WHERE duration_sec BETWEEN 1 AND 20""")
def augmented_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two derived rows a clip, pinned to train."""
    rows = clip_records(spark, sf_dir).withColumn("duration_sec", F.col("duration_sec") / 40)
    return split.augmented_rows(rows, 2).select("clip_id", "aug_type", "duration_sec", "split_pin")


@query("""SELECT s_suppkey, s_suppkey % 4 = 0 OR s_suppkey % 5 = 0 OR s_suppkey % 6 = 0 AS pinned FROM supplier""")
def pinned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    path = F.when(k % 6 == 0, "a\\Augmented\\x.wav").otherwise("a/x.wav")
    return D.table(spark, sf_dir, "supplier").select("s_suppkey", split.pinned(path, F.when(k % 4 == 0, "train"), F.when(k % 5 == 0, F.lit(True))).alias("pinned"))


@query("SELECT page_id, page_id % 3 = 0 AS augmented FROM pages")
def augmented_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("page_id") % 3 == 0, "data\\SYNTHETIC\\x.wav").otherwise("data/x.wav")
    return D.table(spark, sf_dir, "pages").select("page_id", ingest.is_augmented(path).alias("augmented"))


_FEW = (("returnflag", "lineitem", "l_returnflag"), ("priority", "orders", "o_orderpriority"), ("status", "lineitem", "l_linestatus"), ("segment", "customer", "c_mktsegment"), ("event", "events", "event_type"))
_FEW_GROUPS = " UNION ALL ".join(f"SELECT '{kind}' AS kind, {c} AS g FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}" for kind, t, c in _FEW)


@query(f"""WITH g AS ({_FEW_GROUPS}), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('42|' || g), g) AS r, count(*) OVER (PARTITION BY kind) AS n FROM g),
h AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE CAST(ceil(0.2 * n) AS BIGINT) END AS held FROM r)
SELECT kind, g, CASE WHEN held > 1 AND r <= (held + 1) // 2 THEN 'test' WHEN r <= held THEN 'validation' ELSE 'train' END AS split FROM h""")
def few_groups_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer than ten groups: one or two are held out, and none of fewer than three."""
    out = None
    for kind, name, c in _FEW:
        rows = D.table(spark, sf_dir, name).where(F.col(c).isNotNull()).select(F.col(c).alias("g"), F.lit("a").alias("s"), F.lit(1).alias("o"))
        one = split.group_split(rows, "g", "s", "o").select(F.lit(kind).alias("kind"), "g", "split")
        out = one if out is None else out.unionByName(one)
    return out


# filters and blanking


@query("""WITH s AS (SELECT l_orderkey, list(l_discount) AS p FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, round(CAST(list_avg(p) AS DOUBLE), 6) AS p FROM s""")
def mean_no_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_discount").cast("double").alias("no_speech_prob"))).alias("segments"))
    return rows.select("l_orderkey", F.round(quality.no_speech(F.col("segments")), 6).alias("p"))


_BN_DOCS = f"bd AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {sql_bengali('substr(text, 1, length(text))')} WHEN 1 THEN text ELSE {sql_bengali('text')} || repeat('क', length(text)) END AS t, (doc_id % 10) / 10.0 AS p FROM documents)"


def _bengali_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    t = F.when(k == 0, bengali("text")).when(k == 1, F.col("text")).otherwise(F.concat(bengali("text"), F.expr("repeat('क', length(text))")))
    return D.table(spark, sf_dir, "documents").select("doc_id", t.alias("t"), ((F.col("doc_id") % 10) / 10.0).alias("p"))


@query("WITH " + _BN_DOCS + """, n AS (SELECT *, len(regexp_extract_all(coalesce(t, ''), '[\\x{0980}-\\x{09FF}]')) AS bn, len(regexp_extract_all(coalesce(t, ''), '[\\x{0900}-\\x{097F}\\x{0A00}-\\x{0D7F}]')) AS o FROM bd)
SELECT doc_id, p >= 0.6 OR bn = 0 OR o > bn AS blanked FROM n""")
def blanked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts blanked for silence, a missing script or the wrong one."""
    return _bengali_docs(spark, sf_dir).select("doc_id", (quality.blanked(F.coalesce("t", F.lit("")), F.col("p")) == "").alias("blanked"))


_TAGS = r"""g AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ɏ]+'), lambda x: CASE WHEN regexp_matches(x, '[À-ɏ]') THEN 'BN' WHEN regexp_matches(x, '^[A-Za-z]{2,}$') THEN 'EN' END), lambda x: x IS NOT NULL) AS l FROM documents),
n AS (SELECT doc_id, l, len(list_filter(l, lambda x: x = 'BN')) AS bn, len(list_filter(l, lambda x: x = 'EN')) AS en FROM g)"""


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(D.WORD), F.lit(0)), lambda w: F.struct(w.alias("word"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end")))
    return D.table(spark, sf_dir, "documents").select("doc_id", "lang", codemix.tag_words(words, D.NATIVE).alias("tags"))


@query("WITH " + _TAGS + "SELECT doc_id FROM n WHERE NOT (len(l) = 0 OR (en / nullif(bn + en, 0) >= 0.9 AND bn <= 1) OR (NOT (bn + en >= 4 AND bn >= 2 AND en >= 1 AND len(list_filter(range(1, len(l)), lambda i: l[i] <> l[i + 1])) >= 1 AND en / nullif(bn + en, 0) BETWEEN 0.05 AND 0.8) AND NOT (bn >= 2 AND en >= 1) AND bn / (bn + en) < 0.95 AND en / (bn + en) >= 0.6))")
def accepted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips that aren't rejected as plain English or noise."""
    rows = _tags(spark, sf_dir).withColumn("x", codemix.classify(F.col("tags")))
    return rows.where(codemix.accepted_label(F.col("x.label"))).select("doc_id")


@query(r"""WITH k AS (SELECT list(DISTINCT t) AS known FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zà-ɏ]+')) AS t FROM benchmark)),
g AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ɏ]+'), lambda x: {'w': x, 'l': CASE WHEN regexp_matches(x, '[À-ɏ]') THEN 'BN' WHEN regexp_matches(x, '^[A-Za-z]{2,}$') THEN 'EN' END}), lambda x: x.l IS NOT NULL) AS l FROM documents),
n AS (SELECT doc_id, len(list_filter(l, lambda x: x.l = 'BN')) AS bn, list_transform(list_filter(l, lambda x: x.l = 'EN' AND regexp_matches(x.w, '^[A-Za-z]{3,}$') AND (list_contains(known, lower(x.w)) OR regexp_matches(x.w, '^[A-Z][A-Za-z]{3,}$'))), lambda x: x.w) AS ew FROM g, k),
r AS (SELECT *, len(ew) AS en, CASE WHEN bn + len(ew) > 0 THEN bn / (bn + len(ew)) ELSE 0.0 END AS bs, CASE WHEN bn + len(ew) > 0 THEN len(ew) / (bn + len(ew)) ELSE 0.0 END AS es FROM n)
SELECT doc_id, CASE WHEN bn + en = 0 THEN 'NOISE' WHEN bn = 0 OR es >= 0.9 THEN 'EN_ONLY' WHEN bs >= 0.95 OR en = 0 THEN 'BN_ONLY' ELSE 'CS' END AS label, round(bs, 2) AS bn_ratio, round(es, 2) AS en_ratio, CAST(en AS INT) AS en_words FROM r""")
def relaxed_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trial run's label, over plausible English words only."""
    known = [r.token for r in D.lexicon(spark, sf_dir).collect()]  # the short list that a trial run is held against
    return _tags(spark, sf_dir).select("doc_id", codemix.classify_relaxed(F.col("tags"), known).alias("x")).select("doc_id", "x.label", "x.bn_ratio", "x.en_ratio", F.size("x.en_words").alias("en_words"))


_TAG_SQL = """w AS (SELECT event_id, ['ফোন', '(ব্যাংক)', 'লোন।', 'বাংলা', 'নদী'][event_id % 5 + 1] AS a, ['word', 'বাংলা', 'other'][event_id % 3 + 1] AS b FROM events)"""


@query("WITH " + _TAG_SQL + """ SELECT event_id, event_id % 5 < 3 AS borrowed_en, ['phone', 'bank', 'loan', NULL, NULL][event_id % 5 + 1] AS canonical_en, CAST(CASE WHEN event_id % 5 < 3 THEN 1 ELSE 0 END + CASE WHEN event_id % 3 <> 1 THEN 1 ELSE 0 END AS INT) AS en_word_count,
CASE WHEN event_id % 5 < 3 THEN ['EN_BORROWED'] ELSE ['BN'] END || CASE WHEN event_id % 3 = 1 THEN ['BN'] ELSE ['EN'] END AS langs FROM w""")
def retagged_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans in native script retagged as borrowed English, and the counts that follow."""
    k, m = F.col("event_id") % 5, F.col("event_id") % 3
    word = lambda w, lang: F.struct(w.alias("word"), lang.alias("lang"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"))
    a = F.element_at(F.array(*map(F.lit, ("ফোন", "(ব্যাংক)", "লোন।", "বাংলা", "নদী"))), (k + 1).cast("int"))
    b = F.element_at(F.array(*map(F.lit, ("word", "বাংলা", "other"))), (m + 1).cast("int"))
    tags = codemix.retag_borrowed(F.array(word(a, F.lit("BN")), word(b, F.when(m == 1, "BN").otherwise("EN"))))
    rows = D.table(spark, sf_dir, "events").select("event_id", tags.alias("tags")).withColumn("x", codemix.classify(F.col("tags")))
    return rows.select("event_id", F.col("tags")[0]["borrowed_en"].alias("borrowed_en"), F.col("tags")[0]["canonical_en"].alias("canonical_en"), F.col("x.en_word_count").alias("en_word_count"), F.transform("tags", lambda t: t["lang"]).alias("langs"))


@query("WITH " + _TAG_SQL + """, l AS (SELECT event_id, 'BN_ONLY' AS before, CASE WHEN event_id % 5 < 3 THEN 'CS' ELSE 'BN_ONLY' END AS after FROM w)
SELECT label, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after FROM (SELECT before AS label, 1 AS b, 0 AS a FROM l UNION ALL SELECT after, 0, 1 FROM l) GROUP BY label""")
def label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels before and after retagging."""
    rows = D.table(spark, sf_dir, "events").select(F.lit("BN_ONLY").alias("before"), F.when(F.col("event_id") % 5 < 3, "CS").otherwise("BN_ONLY").alias("after"))
    return report.label_changes(rows, "before", "after")


@query(r"""SELECT value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ɏ]+')) AS value FROM documents) GROUP BY value ORDER BY n DESC, min(doc_id), value LIMIT 50""")
def most_common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most frequent words, of equals the one seen first."""
    rows = D.table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(D.WORD), F.lit(0)).alias("w"))
    return report.top_values(rows, "w", 50, "doc_id")


@query(r"""WITH x AS (SELECT lang, doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ɏ]+') AS w FROM documents), e AS (SELECT lang, doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS place FROM x),
f AS (SELECT lang, word, min(doc_id * 1000000 + place) AS pos FROM e GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pos, word) AS r FROM f),
c AS (SELECT lang, count(*) AS clips, count(*) FILTER (doc_id % 3 = 0) AS cs, count(*) FILTER (doc_id % 6 = 0) AS high, count(*) FILTER (doc_id % 3 = 1) AS bn FROM documents GROUP BY lang)
SELECT c.*, coalesce((SELECT list(word ORDER BY r) FROM q WHERE q.lang = c.lang AND r <= 6), []) AS words FROM c WHERE lang IS NOT NULL""")
def trial_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by language and the first six different words."""
    k = F.col("doc_id")
    rows = D.table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(
        "lang", "doc_id", F.when(k % 3 == 0, "CS").when(k % 3 == 1, "BN_ONLY").otherwise("EN_ONLY").alias("label"), F.when(k % 6 == 0, "HIGH").otherwise("NONE").alias("cs_confidence"),
        F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(D.WORD), F.lit(0)).alias("w"),
    )
    return report.trial_report(rows, "lang", "w", "doc_id")


@query(r"""WITH x AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), e AS (SELECT item_id, unnest(w) AS word, unnest(range(0, len(w))) AS place FROM x), f AS (SELECT item_id, word, min(place) AS p FROM e GROUP BY ALL)
SELECT item_id, array_to_string(list(word ORDER BY p), ' ') AS words FROM f GROUP BY item_id""")
def ordered_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(report.ordered_distinct(F.split("text", " ")), " ").alias("words"))


@query("SELECT page_id, row_number() OVER (ORDER BY CASE WHEN page_id % 4 = 0 THEN NULL ELSE page_id % 7 END NULLS LAST, page_id) AS place FROM pages ORDER BY place LIMIT 60")
def nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pages by a key whose nulls come last."""
    k = F.col("page_id")
    rows = report.ranked_last(D.table(spark, sf_dir, "pages").select("page_id", F.when(k % 4 > 0, k % 7).alias("wer")), "wer", "page_id").limit(60)
    from pyspark.sql import Window

    return rows.select("page_id", F.row_number().over(Window.orderBy(F.col("wer").asc_nulls_last(), "page_id")).cast("long").alias("place"))  # 60 rows


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_totalprice, o_orderkey LIMIT 100")
def mixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest orders, of a day the cheapest first."""
    return D.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_totalprice", "o_orderkey").limit(100)


@query("SELECT r_name, CAST(CASE r_name WHEN 'ASIA' THEN 1 WHEN 'EUROPE' THEN 2 ELSE 3 END AS BIGINT) AS place FROM region")
def fixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.in_order(D.table(spark, sf_dir, "region").select("r_name"), ["ASIA", "EUROPE"], "r_name")


# noise and variants

@query("""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), k AS (SELECT *, string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' ') AS w FROM d),
c AS (SELECT doc_id, t, CASE WHEN list_has_any(w, ['the', 'and']) THEN trim(regexp_replace(array_to_string(list_filter(regexp_extract_all(t, '[a-z][a-z''-]*|[^a-z]+'), lambda x: x NOT IN ('the', 'and')), ''), '\\s+', ' ', 'g')) ELSE t END AS cleaned FROM k)
SELECT doc_id, cleaned <> t AS changed, sha256(cleaned) AS cleaned_sha256 FROM c""")
def noise_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts from which noise tokens are deleted."""
    clips = D.table(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("transcript"))
    return quality.clean_noise(clips, ["the", "and"]).select("doc_id", "changed", F.sha2("transcript", 256).alias("cleaned_sha256"))


@query("""WITH d AS (SELECT s_suppkey, 'um the ' || lower(s_name) || ' um, uh' AS t FROM supplier) SELECT s_suppkey, 'the ' || regexp_replace(lower(s_name), '#', '#', 'g') || ' , uh' AS text FROM supplier""")
def deleted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens deleted, and what stands between them kept."""
    t = F.concat(F.lit("um the "), F.lower("s_name"), F.lit(" um, uh"))
    return D.table(spark, sf_dir, "supplier").select("s_suppkey", T.delete_tokens(t, F.array(F.lit("um"))).alias("text"))


@query("""SELECT s_suppkey, lower(upper(s_name)) || ' , x' AS text FROM supplier""")
def cleaned_in_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's steps, then what is left of the noise."""
    clips = D.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("um "), "s_name", F.lit(" um, x")).alias("transcript"))
    return quality.clean_in_steps(clips, ["um"], lambda text, noise: F.lower(text)).select("s_suppkey", F.col("transcript").alias("text"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 4 > 0")
def clips_without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("clip_id"), F.when(F.col("c_custkey") % 4 == 0, "so Um yes").otherwise("so yes").alias("transcript"))
    kept = quality.drop_noise_clips(clips, spark.createDataFrame([("um",)], "token string"))
    return kept.select(F.col("clip_id").cast("long").alias("c_custkey"))


#: Surfaces of two canonical words, and tokens with suffixes.
_FORMS = ["ফোন", "ফোনটা", "Phone", "phones", "নদীর", "নদী"]
_CANON = ["ফোন", "ফোন", "ফোন", "phones", "নদী", "নদী"]


@query(f"SELECT event_id, {_CANON!r}[event_id % 6 + 1] || ' ' || {_CANON!r}[event_id % 5 + 1] AS text FROM events")
def variants_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants, with and without suffixes, in their canonical form."""
    known = readers.variant_map(spark.createDataFrame([("ফোন", "ফোন"), ("phone", "ফোন"), ("নদী", "নদী")], "surface string, canonical string"))
    forms = F.array(*map(F.lit, _FORMS))
    pick = lambda n: F.element_at(forms, (F.col("event_id") % n + 1).cast("int"))
    return D.table(spark, sf_dir, "events").select("event_id", T.normalize_variants(F.concat_ws("  ", pick(6), pick(5)), known).alias("text"))


@query(f"""SELECT event_id, 'surface' AS view, lower({_FORMS!r}[event_id % 6 + 1]) = lower({_FORMS!r}[event_id % 5 + 1]) OR {_FORMS!r}[event_id % 6 + 1] = {_FORMS!r}[event_id % 5 + 1] AS near, {_FORMS!r}[event_id % 6 + 1] AS reference FROM events
UNION ALL SELECT event_id, 'variants', {_CANON!r}[event_id % 6 + 1] = {_CANON!r}[event_id % 5 + 1], {_CANON!r}[event_id % 6 + 1] FROM events""")
def two_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as surface-normalised and as variant-normalised texts."""
    known = readers.variant_map(spark.createDataFrame([("ফোন", "ফোন"), ("phone", "ফোন"), ("নদী", "নদী")], "surface string, canonical string"))
    forms = F.array(*map(F.lit, _FORMS))
    pick = lambda n: F.element_at(forms, (F.col("event_id") % n + 1).cast("int"))
    pairs = D.table(spark, sf_dir, "events").select("event_id", F.concat(pick(6), F.lit("।")).alias("reference"), F.concat(F.lit(" "), pick(5), F.lit("!")).alias("hypothesis"))
    rows = metrics.views(pairs, known, unicode=False)
    return rows.select("event_id", "view", (F.lower("reference") == F.lower("hypothesis")).alias("near"), "reference")


@query(f"SELECT event_id, {_CANON!r}[event_id % 6 + 1] AS text FROM events")
def fully_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface, then variants."""
    known = readers.variant_map(spark.createDataFrame([("ফোন", "ফোন"), ("phone", "ফোন"), ("নদী", "নদী")], "surface string, canonical string"))
    forms = F.array(*map(F.lit, _FORMS))
    return D.table(spark, sf_dir, "events").select("event_id", T.full_normalize(F.concat(F.lit("। "), F.element_at(forms, (F.col("event_id") % 6 + 1).cast("int")), F.lit(" !!")), known, unicode=False).alias("text"))


@query("SELECT event_id, ['soo good', 'soo soo'][event_id % 2 + 1] AS collapsed, ['sooo good', 'sooo sooo sooo'][event_id % 2 + 1] AS kept FROM events")
def repeats_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("event_id") % 2 == 0, "Sooo GOOD!").otherwise("sooo sooo sooo")
    return D.table(spark, sf_dir, "events").select("event_id", T.repeat_collapsed(t, unicode=False).alias("collapsed"), T.primary_normalize(t, unicode=False).alias("kept"))


@query("SELECT event_id, event_type AS word FROM events")
def stripped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "events").select("event_id", T.strip_edges(F.concat(F.lit("“(।"), "event_type", F.lit("!?’ "))).alias("word"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'BN' WHEN 1 THEN 'LATIN' WHEN 2 THEN 'DEVANAGARI' WHEN 3 THEN 'MIXED' ELSE 'OTHER' END AS script FROM supplier""")
def script_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 5
    word = F.when(k == 0, "নদী").when(k == 1, "river").when(k == 2, "नदी").when(k == 3, "নদীx").otherwise("123")
    return D.table(spark, sf_dir, "supplier").select("s_suppkey", T.script_label(word).alias("script"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '—' ELSE CAST(CAST(round((100 * s_suppkey / 1000.0)::DECIMAL(18, 4), 1) AS DECIMAL(18, 1)) AS VARCHAR) END AS share, replace(replace(s_name, '#', '\\#'), '_', '\\_') AS latex FROM supplier")
def formatted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return D.table(spark, sf_dir, "supplier").select("s_suppkey", T.percent(F.when(k % 3 > 0, k / 1000.0)).alias("share"), T.latex("s_name").alias("latex"))


@query("""WITH RECURSIVE w AS (SELECT page_id, string_split('page ' || page_id || ' with some words to wrap here', ' ') AS w FROM pages), f AS (SELECT page_id, w, 1 AS i, '' AS line, '' AS done FROM w UNION ALL
SELECT page_id, w, i + 1, CASE WHEN line = '' THEN w[i] WHEN length(line) + 1 + length(w[i]) <= 16 THEN line || ' ' || w[i] ELSE w[i] END, CASE WHEN line <> '' AND length(line) + 1 + length(w[i]) > 16 THEN done || line || chr(10) ELSE done END FROM f WHERE i <= len(w))
SELECT page_id, done || line AS wrapped FROM f WHERE i = len(w) + 1""")
def wrapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "pages").select("page_id", T.wrap(F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(" with some words to wrap here"))).alias("wrapped"))


@query("SELECT symbol, CASE WHEN regexp_matches(symbol, '[A-Za-z]') THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM (SELECT DISTINCT unnest(string_split(text, '')) AS symbol FROM benchmark) WHERE symbol NOT IN ('', ' ')")
def token_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = report.character_vocabulary(D.table(spark, sf_dir, "benchmark"), "text", specials=())
    return report.token_weights(vocabulary).select("symbol", "weight")


# judges and metrics


@query("SELECT s_suppkey, CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM (SELECT s_suppkey, (s_suppkey * 37 % 101) / 1000.0 AS p FROM supplier)")
def significance_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "supplier").select("s_suppkey", stats.stars((F.col("s_suppkey") * 37 % 101) / 1000.0).alias("stars"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN n >= 3 THEN 'ACCEPT' WHEN n = 2 THEN 'UNCERTAIN' ELSE 'REJECT' END AS verdict FROM (SELECT *, (l_quantity > 10)::INT + (l_discount > 0.04)::INT + (l_tax > 0.03)::INT + (l_returnflag = 'N')::INT AS n FROM lineitem)""")
def criteria_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = [F.col("l_quantity") > 10, F.col("l_discount") > 0.04, F.col("l_tax") > 0.03, F.col("l_returnflag") == "N"]
    return D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", judge.criteria_verdict(passed).alias("verdict"))


@query("WITH " + CLIP_SQL + """, q AS (SELECT *, 50 // (SELECT count(DISTINCT dialect) FROM cl WHERE dialect IS NOT NULL) AS per, row_number() OVER (PARTITION BY dialect, is_code_switched ORDER BY md5('42|' || clip_id), clip_id) AS r,
count(*) FILTER (is_code_switched) OVER (PARTITION BY dialect) AS k FROM cl WHERE dialect IS NOT NULL), f AS (SELECT *, r <= CASE WHEN is_code_switched THEN least(per // 2, per // 2) ELSE per - least(per // 2, k) END AS first FROM q),
s AS (SELECT clip_id FROM f ORDER BY first DESC, md5('43|' || clip_id), clip_id LIMIT 50) SELECT sha256(string_agg(clip_id, chr(10) ORDER BY clip_id)) AS checksum, count(*) AS n FROM s""")
def judge_sample_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of a stratified sample of 50 that all judges share."""
    rows = clip_records(spark, sf_dir).where("dialect IS NOT NULL")
    return audit.checksum(split.stratified_sample(rows, 50, "dialect", "is_code_switched", "clip_id"), "clip_id")


@query("SELECT o_orderpriority, round(sum(o_totalprice / 100) / sum(o_totalprice), 4) AS rtf FROM orders GROUP BY o_orderpriority")
def real_time_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").cast("double").alias("duration_sec"), (F.col("o_totalprice").cast("double") / 100).alias("decode_sec"))
    return metrics.real_time_factor(rows, "o_orderpriority")


@query("""WITH p AS (SELECT event_id, event_type AS a, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN event_type || 'x' ELSE '' END AS b FROM events)
SELECT event_id, CASE WHEN length(b) > 0 THEN levenshtein(a, b) / length(b) ELSE 1.0 END AS cer FROM p WHERE CASE WHEN length(b) > 0 THEN levenshtein(a, b) / length(b) ELSE 1.0 END <= 0.30""")
def accepted_pseudo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    old = F.when(k == 0, F.col("event_type")).when(k == 1, F.concat("event_type", F.lit("x"))).otherwise("")
    return metrics.accepted_pseudo_labels(D.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("hypothesis"), old.alias("reference"))).select("event_id", "cer")


@query("""SELECT round(sum(CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 1 END) / count(*), 4) AS wer_ab, round(sum(CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 1 END) / sum(length(n_name)), 4) AS cer_ab,
round(sum(CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 1 END) / count(*), 4) AS wer_ba, round(sum(CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 1 END) / sum(length(n_name) + CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 1 END), 4) AS cer_ba,
round(avg((n_nationkey % 2 = 0)::INT), 4) AS exact FROM (SELECT n_nationkey, replace(n_name, ' ', '_') AS n_name FROM nation)""")
def annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace("n_name", F.lit(" "), F.lit("_"))
    return metrics.annotator_agreement(D.table(spark, sf_dir, "nation").select(name.alias("annotator_a"), F.when(F.col("n_nationkey") % 2 == 0, name).otherwise(F.concat(name, F.lit("x"))).alias("annotator_b")))


@query("""SELECT n_regionkey, round(sum(least(h, r)) / sum(r), 4) AS switch_recall FROM (SELECT n_regionkey, n_nationkey % 3 AS r, n_nationkey % 4 AS h FROM nation) GROUP BY n_regionkey""")
def switch_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switches of references that the hypotheses have too."""
    def tags(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.struct(F.when(i % 2 == 0, "EN").otherwise("BN").alias("lang")))

    k = F.col("n_nationkey")
    return metrics.switch_recall(D.table(spark, sf_dir, "nation").select("n_regionkey", tags(k % 3).alias("ref_tags"), tags(k % 4).alias("hyp_tags")), "n_regionkey")


@query("SELECT c_nationkey, CASE WHEN count(*) FILTER (c_custkey % 3 > 0) = 0 THEN 1.0::DOUBLE ELSE round(count(*) FILTER (c_custkey % 3 = 1) / (2 * count(*) FILTER (c_custkey % 3 > 0)), 4) END AS wer FROM customer GROUP BY c_nationkey UNION ALL SELECT -1, 1.0")
def training_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates while training; 1 for a group without references."""
    k = F.col("c_custkey") % 3
    c = D.table(spark, sf_dir, "customer").select("c_nationkey", F.when(k > 0, "one two").otherwise(" ").alias("reference"), F.when(k == 1, "one too").otherwise("one two").alias("hypothesis"))
    none = spark.createDataFrame([(-1, "", "word")], c.schema)
    return metrics.training_error_rate(c.unionByName(none), "c_nationkey")


@query("SELECT s_nationkey, count(*) AS n, round(count(*) FILTER (s_suppkey % 2 = 0) / (2 * count(*)), 4) AS wer, round(count(*) FILTER (s_suppkey % 3 = 0) / (2 * count(*)), 4) AS silver_wer FROM supplier WHERE s_suppkey % 5 > 0 GROUP BY s_nationkey")
def human_reference_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models and silver transcripts held against what people wrote."""
    s, k = D.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    predictions = s.select(k.cast("string").alias("clip_id"), "s_nationkey", F.when(k % 3 == 0, "good wrd").otherwise("good word").alias("reference"), F.when(k % 2 == 0, "god word").otherwise("good word").alias("hypothesis"))
    human = s.select(k.cast("string").alias("clip_id"), F.when(k % 5 > 0, "good word").otherwise(" ").alias("human_transcript"))
    rows = metrics.with_human_references(predictions, human)
    of = lambda c: metrics.pair_statistics(rows, "reference", c).groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), metrics.rate("word_edits", "n_words").alias("wer"))
    return of("hypothesis").join(of("silver").select("s_nationkey", F.col("wer").alias("silver_wer")), "s_nationkey")


@query("SELECT c_custkey AS clip_id, c_name AS hypothesis_a, lower(c_name) AS hypothesis_b FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0")
def paired_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips that two systems have both recognised."""
    c = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip_id"), F.col("c_name").alias("hypothesis"))
    return stats.paired_predictions(c.where("clip_id % 2 = 0"), c.where("clip_id % 3 = 0").withColumn("hypothesis", F.lower("hypothesis")))


@query("""SELECT event_id, event_type AS brief_reason, CAST(least(5, event_id % 9) AS INT) AS semantic_correctness FROM events WHERE event_id % 4 > 0""")
def parsed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of judges' replies, cut to their range; replies without a number are left out."""
    k = F.col("event_id")
    score = F.when(k % 4 > 0, (k % 9).cast("string")).otherwise('"none"')
    reply = F.concat(F.lit('Here: {"semantic_correctness": '), score, F.lit(', "cs_preservation": 3, "dialect_naturalness": "2.0", "brief_reason": "'), "event_type", F.lit('"} done'))
    rows = D.table(spark, sf_dir, "events").select("event_id", judge.parse_scores(reply).alias("s")).where("s IS NOT NULL")
    return rows.select("event_id", "s.brief_reason", "s.semantic_correctness")


# streams


@query("SELECT DISTINCT o_custkey AS clip_id FROM orders")
def processed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over files in two runs; each key is processed once."""
    from ..sources.shared import new_path

    where = new_path(spark, "stream")
    keys = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("clip_id"))
    for part in (keys.where("clip_id % 2 = 0"), keys):
        part.distinct().write.mode("append").json(f"{where}/in")
        resume.process_new(spark, f"{where}/in", "clip_id long", lambda rows: rows, f"{where}/out", f"{where}/state").awaitTermination()
    return spark.read.parquet(f"{where}/out")
