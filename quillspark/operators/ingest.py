"""Merging, deduplicating, projecting and routing of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_in_order(parts: list[DataFrame], names: list[str] | None = None) -> DataFrame:
    """All rows of the parts with ``priority`` (place of the part) and ``origin`` (its name); missing columns are null."""
    named = [p.withColumn("priority", F.lit(i)).withColumn("origin", F.lit(names[i] if names else str(i))) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def _ranked(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).withColumn("_first", F.first("origin").over(w))


def first_wins(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rank = 1").drop("_rank")


def duplicates_report(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """key, kept_from, skipped_from for each row that first_wins() leaves out; rows need ``origin``."""
    return _ranked(rows, key, order).where("_rank > 1").select(key, F.col("_first").alias("kept_from"), F.col("origin").alias("skipped_from"))


def first_filled(rows: DataFrame, key: str, value: str, order: list[Column]) -> DataFrame:
    """key and its first value that isn't blank."""
    return first_wins(rows.where(F.trim(value) != ""), key, order).select(key, value)


def source_id(explicit: Column, clip_id: Column) -> Column:
    """The given source, or the clip id without its trailing number."""
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), F.regexp_replace(clip_id, r"_[0-9]+$", ""))


def filled_text(human: Column, automatic: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(human), F.lit("")), F.trim(automatic))


def canonical_path(path: Column, root: str = "segments/") -> Column:
    """Forward slashes, none in front, and from the last ``root`` on where there is one."""
    clean = F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")
    return F.when(F.instr(clean, root) > 0, F.concat(F.lit(root), F.substring_index(clean, root, -1))).otherwise(clean)


def bucket_metadata(files: DataFrame, folders: DataFrame, path: str = "path") -> DataFrame:
    """files with dialect and domain: of the folder by name, of its parent, or from a name like ``dialect__domain``."""
    parts = F.split(canonical_path(F.col(path), "\u0000"), "/")
    named = files.withColumn("_own", F.element_at(parts, -2)).withColumn("_up", F.when(F.size(parts) > 2, F.element_at(parts, -3)))
    one = folders.select(F.col("folder").alias("_own"), F.struct("dialect", "domain").alias("_a"))
    two = folders.select(F.col("folder").alias("_up"), F.struct("dialect", "domain").alias("_b"))
    split = F.split("_own", "__")
    guess = F.when(F.size(split) == 2, F.struct(split[0].alias("dialect"), split[1].alias("domain")))
    found = named.join(one, "_own", "left").join(two, "_up", "left").withColumn("_meta", F.coalesce("_a", "_b", guess))
    return found.withColumns({"dialect": F.coalesce("_meta.dialect", F.lit("unknown")), "domain": F.coalesce("_meta.domain", F.lit("General"))}).drop("_own", "_up", "_a", "_b", "_meta")


def merge_folder_metadata(known: DataFrame, defaults: DataFrame, key: str = "folder") -> DataFrame:
    """All keys of both, values of ``known`` first."""
    columns = [c for c in known.columns if c != key]
    both = known.alias("k").join(defaults.alias("d"), key, "full_outer")
    return both.select(key, *(F.coalesce(F.col(f"k.{c}"), F.col(f"d.{c}")).alias(c) for c in columns))


def output_prefix(stem: Column, bucket: Column, dialect: Column, root: Column) -> Column:
    """A name for cut clips that can't clash between buckets of different roots."""
    return F.when(bucket == dialect, F.concat_ws("__", root, stem)).otherwise(F.concat_ws("__", root, bucket, stem))


def with_defaults(clips: DataFrame) -> DataFrame:
    """Missing values as the constants that stand for them."""
    fixed = {"dialect": "unknown", "domain": "General", "cs_confidence": "NONE", "is_code_switched": False, "bn_ratio": 0.0, "en_ratio": 0.0, "bn_word_count": 0, "en_word_count": 0, "switch_count": 0, "clip_label": "BN_ONLY"}
    return clips.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in fixed.items() if k in clips.columns})


def parse_flag(c: Column) -> Column:
    """Booleans written as text."""
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1"), F.lit(False))


def merge_review(clips: DataFrame, sheet: DataFrame) -> DataFrame:
    """clips with a review sheet's edits: a blank edit keeps what is there; the last row of a clip counts.

    sheet: clip_id, row, human_transcript, dialect, domain.
    """
    last = sheet.groupBy("clip_id").agg(F.max_by(F.struct("human_transcript", "dialect", "domain"), "row").alias("edit"))
    keep = lambda c: F.coalesce(F.nullif(F.trim(f"edit.{c}"), F.lit("")), F.col(c))
    rows = clips.join(last, "clip_id", "left")
    text = F.coalesce(F.nullif(F.trim("edit.human_transcript"), F.lit("")), F.col("transcript"))
    return rows.withColumns({"human_transcript": F.when(F.col("edit").isNotNull(), text), "dialect": keep("dialect"), "domain": keep("domain"), "reviewed": F.col("edit").isNotNull()}).drop("edit")


def pending(rows: DataFrame, *done: DataFrame, key: str = "clip_id") -> DataFrame:
    """Rows whose key is in none of the given tables."""
    return reduce(lambda a, d: a.join(d.select(key).distinct(), key, "left_anti"), done, rows)


def resume_position(manifest: DataFrame, known: DataFrame, key: str = "clip_id", position: str = "position") -> DataFrame:
    """One row: one more than the last position whose key is known, 0 if none is."""
    return manifest.join(known.select(key).distinct(), key, "left_semi").agg((F.coalesce(F.max(position), F.lit(-1)) + 1).cast("long").alias("start"))


def row_range(rows: DataFrame, order: list[Column], first: int, last: int) -> DataFrame:
    """Rows first to last, counted from 1, in the order given. Rows are numbered without meeting in one task.

    The order is dealt by range into a fixed number of parts, which nothing merges later, each part is numbered for
    itself, and the sizes of the parts before are added.
    """
    if first < 1 or last < first:
        raise ValueError("1 <= first <= last is required")
    parts = rows.withColumn("_sort", F.struct(*order)).repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("_sort")).sortWithinPartitions("_sort").withColumn("_id", F.monotonically_increasing_id())
    parts = parts.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = parts.join(F.broadcast(before), "_part").withColumn("_row", F.col("_before") + F.col("_at") + 1)  # a row for each partition
    return numbered.where(F.col("_row").between(first, last)).drop("_sort", "_id", "_part", "_at", "_n", "_before", "_row")


def routed(clips: DataFrame, text: str = "transcript", flag: str = "is_code_switched") -> DataFrame:
    """clips with ``route``: clean or encoding_review, each for all and for code-switched ones."""
    damaged = F.coalesce(F.col(text).contains("�"), F.lit(False))
    base = F.when(damaged, "encoding_review").otherwise("clean")
    routes = F.array_compact(F.array(F.concat(base, F.lit("_all")), F.when(F.coalesce(F.col(flag), F.lit(False)), F.concat(base, F.lit("_code_switched")))))
    return clips.withColumn("route", F.explode(routes))


def subsets(rows: DataFrame, flag: str = "is_code_switched") -> DataFrame:
    """Each row once as 'all' and once as 'cs_only' or 'bn_only'."""
    return rows.withColumn("subset", F.explode(F.array(F.lit("all"), F.when(F.col(flag), "cs_only").otherwise("bn_only"))))


def tag_text(dialect: Column, text: Column) -> Column:
    return F.concat(F.lit("["), F.replace(dialect, F.lit(" "), F.lit("_")), F.lit("] "), text)


def untag_text(text: Column) -> Column:
    return F.regexp_replace(text, r"^\[[^\]]*\]\s*", "")


# Names that model folders once had.
LEGACY_NAMES = {"ft_whisper_bn_only": "ft_bn_only", "ft_whisper_cs_only": "ft_cs_only"}


def model_family(key: Column) -> Column:
    """Architecture by a model's key."""
    return F.when(key.endswith("_lm"), "lm").when(key.startswith("ft_whisper_"), "whisper").when(key.startswith("ft_wav2vec2_") | key.startswith("ft_wavlm_"), "ctc").otherwise("unknown")


def model_folder(models: DataFrame, folders: DataFrame, key: str = "model") -> DataFrame:
    """models with ``folder``: that of their key, that of its legacy name where only that exists, else that of the key."""
    names = F.create_map(*(F.lit(x) for pair in LEGACY_NAMES.items() for x in pair))
    there = folders.select("folder").distinct()
    own = there.select(F.col("folder").alias("_own"))
    old = there.select(F.col("folder").alias("_old"))
    both = models.join(own, F.col(key) == F.col("_own"), "left").join(old, F.element_at(names, F.col(key)) == F.col("_old"), "left")
    return both.withColumn("folder", F.coalesce("_own", "_old", key)).drop("_own", "_old")


def nullable_number(c: Column) -> Column:
    """A confidence as a number, null for whatever isn't one."""
    return c.cast("string").try_cast("double")


def prediction_rows(clips: DataFrame, hypothesis: Column) -> DataFrame:
    """Prediction records of clips, in the columns and types of the schema, with defaults for what is missing."""
    from ..functions.schemas import PREDICTIONS

    fixed = {"dialect": "unknown", "domain": "General", "is_code_switched": False, "bn_ratio": 0.0, "en_ratio": 0.0}
    made = {"reference": F.col("transcript"), "hypothesis": hypothesis}
    fields = [f.split() for f in PREDICTIONS.split(", ")]
    cell = lambda c: made.get(c, F.col(c) if c in clips.columns else F.lit(None))
    return clips.select(*((F.coalesce(cell(c).cast(t), F.lit(fixed[c]).cast(t)) if c in fixed else cell(c).cast(t)).alias(c) for c, t in fields))


def split_of(rows: DataFrame, test: DataFrame, validation: DataFrame, key: str = "clip_id") -> DataFrame:
    """rows with ``split``: test if the key is among the test ids, else validation, else train."""
    marks = [d.select(key).distinct().withColumn(m, F.lit(True)) for d, m in ((test, "_t"), (validation, "_v"))]
    both = rows.join(marks[0], key, "left").join(marks[1], key, "left")
    return both.withColumn("split", F.when(F.col("_t"), "test").when(F.col("_v"), "validation").otherwise("train")).drop("_t", "_v")


def training_rows(rows: DataFrame, files: DataFrame, text: str = "transcript") -> DataFrame:
    """Rows with text whose audio exists (a path in ``files``)."""
    return rows.where(F.trim(text) != "").join(files.select("audio_path").distinct(), "audio_path", "left_semi")


def training_losses(rows: DataFrame, files: DataFrame, text: str = "transcript") -> DataFrame:
    """One row: how many rows training_rows() keeps, and drops for missing audio and, of the others, for blank text."""
    there = files.select("audio_path").distinct().withColumn("_there", F.lit(True))
    marked = rows.join(there, "audio_path", "left")
    gone, blank = F.col("_there").isNull(), F.coalesce(F.trim(text), F.lit("")) == ""
    return marked.agg(F.count_if(~gone & ~blank).alias("kept"), F.count_if(gone).alias("no_audio"), F.count_if(~gone & blank).alias("no_text"))


def symbols_of(text: Column, vocabulary: DataFrame) -> Column:
    """Label ids of a text for a character vocabulary (symbol, id; small): blanks are '|', unknown characters <unk>."""
    ids = {r.symbol: r.id for r in vocabulary.collect()}
    known = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))
    characters = F.filter(F.split(F.replace(text, F.lit(" "), F.lit("|")), ""), lambda c: c != "")
    return F.transform(characters, lambda c: F.coalesce(F.element_at(known, c), F.lit(ids["<unk>"])))


def is_augmented(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/")).rlike("augment|synthetic")


def first_k(rows: DataFrame, group: str, order: list[Column], k: int = 4) -> DataFrame:
    """The first k rows of each group in the given order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def with_target_text(rows: DataFrame, text: str = "transcript", rewrite=None) -> DataFrame:
    """rows with ``target``: the text, or what ``rewrite`` (a function of a column) makes of it."""
    return rows.withColumn("target", rewrite(F.col(text)) if rewrite else F.col(text))


def synthesised(rows: DataFrame, speak, seconds) -> DataFrame:
    """rows with audio_path and duration_sec from the caller's functions of the text; rows that failed are left out."""
    made = rows.withColumn("audio_path", speak(F.col("transcript")))
    return made.where(F.coalesce("audio_path", F.lit("")) != "").withColumn("duration_sec", seconds(F.col("audio_path")))


def resolved_audio(rows: DataFrame, files: DataFrame, path: str = "audio_path") -> DataFrame:
    """rows whose path, or whose file name where the path is stale, is in a listing with audio_path; others are left out."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    known = files.select(F.col("audio_path").alias("_found"), name(F.col("audio_path")).alias("_name"))
    exact = known.select(F.col("_found").alias("_exact"))
    by_name = known.groupBy("_name").agg(F.min("_found").alias("_by_name"))
    clean = canonical_path(F.col(path))
    both = rows.withColumn("_path", clean).join(exact, F.col("_path") == F.col("_exact"), "left").withColumn("_name", name(F.col("_path"))).join(by_name, "_name", "left")
    return both.withColumn(path, F.coalesce("_exact", "_by_name")).where(F.col(path).isNotNull()).drop("_path", "_exact", "_name", "_by_name")
