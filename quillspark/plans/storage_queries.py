"""Queries of parts of files, damaged records, sinks that count once; the SQL is what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers, writers
from ..sources.shared import new_path
from ..streaming import resume
from . import speech_tables as D
from .registry import query


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def arrow_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as Arrow files, read again in parts of a megabyte."""
    path = new_path(spark, "arrow")
    writers.arrow_files(D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), path)
    return readers.arrow_files(spark, path, part_bytes=1 << 20)


@query("""WITH d AS (SELECT doc_id, text, doc_id % 5 AS part, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id) - 1 AS row FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS clip_id, sha256(coalesce(text, '')) AS transcript_sha256, NULL AS part, NULL AS row, NULL AS line FROM d WHERE doc_id % 13 > 1
UNION ALL SELECT NULL, NULL, CAST(part AS VARCHAR), row, CASE WHEN doc_id % 13 = 0 THEN '{"clip_id":"' || doc_id || '","transcript"' ELSE '{"clip_id":"' || doc_id || '","duration_sec":"long"}' END FROM d WHERE doc_id % 13 < 2""")
def quarantined_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of records with torn lines and values that don't fit; the good rows, and file and row of the others."""
    path = new_path(spark, "damaged")
    d = D.table(spark, sf_dir, "documents")
    name, kind = F.concat(F.lit('{"clip_id":"'), F.col("doc_id").cast("string")), F.col("doc_id") % 13
    whole = F.concat(F.to_json(F.struct(F.col("doc_id").cast("string").alias("clip_id"), F.col("text").alias("transcript"))), F.lit(","))
    line = F.when(kind == 0, F.concat(name, F.lit('","transcript"'))).when(kind == 1, F.concat(name, F.lit('","duration_sec":"long"}'))).otherwise(whole)
    d.select("doc_id", (F.col("doc_id") % 5).alias("part"), line.alias("value")).repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    good, bad = readers.quarantined(spark, path)
    nothing = F.lit(None).cast("string")
    rows = good.select("clip_id", F.sha2(F.coalesce("transcript", F.lit("")), 256).alias("transcript_sha256"), nothing.alias("part"), F.lit(None).cast("long").alias("row"), nothing.alias("line"))
    return rows.unionByName(bad.select(nothing.alias("clip_id"), nothing.alias("transcript_sha256"), F.regexp_extract("file", "part=([0-9]+)", 1).alias("part"), "row", F.col("value").alias("line")))


@query("""SELECT CAST(doc_id AS VARCHAR) AS clip_id, CASE doc_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'uncertain' END AS verdict, CASE WHEN doc_id % 7 = 0 THEN 'before' WHEN doc_id % 4 < 2 THEN 'first' ELSE 'second' END AS run FROM documents""")
def judged_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of an earlier run's three outputs, and of two runs over files whose records overlap; the first batch is
    written once more, as after a crash."""
    before, folder, out, state = (new_path(spark, f"judged-{k}") for k in ("before", "in", "out", "state"))
    n = F.col("clip_id").cast("long")
    verdict = F.when(n % 3 == 0, "accepted").when(n % 3 == 1, "rejected").otherwise("uncertain")
    clips = D.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("clip_id"))
    judge = lambda rows: rows.withColumn("verdict", verdict)
    resume.judge_outputs(judge(clips.where(n % 7 == 0)), before)
    outputs = [f"{before}/{k}" for k in ("accepted", "rejected", "uncertain")]
    known, ledger = resume.judged_keys(spark, *outputs, f"{before}/none"), resume.Ledger(spark, out)
    for some in (n % 4 < 2, n % 4 > 0):
        writers.json_lines(clips.where(some), folder, "append")
        resume.judge_stream(spark, folder, "clip_id string", judge, ledger, state, known).awaitTermination()
    ledger.write(judge(clips), ledger.done()[0])
    rows = ledger.read("clip_id string, verdict string")
    first = rows.agg(F.min("batch")).first()[0]
    earlier = None
    for k, path in zip(("accepted", "rejected", "uncertain"), outputs, strict=True):
        one = readers.records(spark, path).select("clip_id", F.lit(k).alias("verdict"), F.lit("before").alias("run"))
        earlier = one if earlier is None else earlier.unionByName(one)
    return earlier.unionByName(rows.select("clip_id", "verdict", F.when(F.col("batch") == first, "first").otherwise("second").alias("run")))
