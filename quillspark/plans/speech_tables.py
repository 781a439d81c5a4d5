"""The driver's tables seen as transcripts, pairs, lexicons and judges' votes.

documents stand for clips (the text is the transcript, lang the dialect, n_chars / 15 the duration), a user turn and the
assistant's next for reference and hypothesis, benchmark words for a lexicon, order lines for scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scripts of the tagger on these Latin-script tables: words with an accented letter are native, plain ones English.
NATIVE, ENGLISH_WORD, WORD = r"[À-ɏ]", r"^[A-Za-z]{2,}$", r"[A-Za-zÀ-ɏ]+"
LOWER_WORD = r"[a-zà-ɏ]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("clip_id"), F.col("text").alias("transcript"), F.col("lang").alias("dialect"), F.col("source").alias("source_id"), (F.col("n_chars") / 15.0).alias("duration_sec"))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clips; is_code_switched is the label toxic = 1, and quality 0 where there is no label."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("clip_id")).agg((F.max("toxic") == 1).alias("is_code_switched"), F.max("quality").alias("quality"))
    rows = clips(spark, sf_dir).join(labels, "clip_id", "left")
    return rows.withColumns({"is_code_switched": F.coalesce("is_code_switched", F.lit(False)), "quality": F.coalesce("quality", F.lit(0))})


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, grp, reference, hypothesis: a user turn and the assistant's answer, whole."""
    c = table(spark, sf_dir, "conversations")
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    user = c.where("role = 'user'").select("conv_id", "turn", plain("text").alias("reference"))
    answer = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), plain("text").alias("hypothesis"))
    return user.join(answer, ["conv_id", "turn"]).withColumn("grp", F.col("conv_id") % 4)


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(LOWER_WORD), F.lit(0))
    return table(spark, sf_dir, "benchmark").select(F.explode(words).alias("token")).distinct()
