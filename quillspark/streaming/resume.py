"""Structured Streaming: processing each clip once, and speech sessions from a stream of frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def process_new(spark: SparkSession, folder: str, schema: str, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "clip_id", stamp: str | None = None, delay: str = "1 day") -> StreamingQuery:
    """Run ``step`` on the records of files that are new since the last run, each key once, and append the results.

    What is done lies in the checkpoint, so a run that broke off goes on where it was. With a timestamp column keys are
    forgotten after ``delay``; without one they are kept for good.
    """
    rows = spark.readStream.schema(schema).json(folder)
    rows = rows.withWatermark(stamp, delay).dropDuplicatesWithinWatermark([key]) if stamp else rows.dropDuplicates([key])
    return step(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def sessions(events: DataFrame, key: str, stamp: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """key, first, last, n of runs of events with no pause of ``gap``; works on a batch and on a stream."""
    rows = events.withWatermark(stamp, delay) if events.isStreaming else events
    found = rows.groupBy(key, F.session_window(stamp, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n")


def append_results(batch: DataFrame, path: str, key: str) -> None:
    """For foreachBatch: the batch's rows whose key isn't at ``path`` yet are appended, so a repeated batch adds nothing."""
    from ..sources.readers import AnalysisException
    from ..sources.writers import append_new

    try:
        known = batch.sparkSession.read.parquet(path)
    except AnalysisException:
        known = None
    append_new(batch, path, key, known)


class Ledger:
    """A sink of micro-batches in which each counts once, however often it is written.

    A batch's rows lie in a folder of their own, which a batch that is written again replaces; what is in the ledger is
    the batches that were written whole. A reader sees these and nothing else, so a batch that broke off is not there, and
    one that is repeated after a crash adds nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def done(self) -> list[int]:
        """Numbers of the batches that are there, in order; one file each."""
        if not self._fs.exists(self._at("ledger")):
            return []
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(self._at("ledger")) if x.getPath().getName().isdigit())

    def write(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        if self._fs.exists(self._at(f"ledger/{number}")):
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/batches/{number}")
        self._fs.create(self._at(f"ledger/{number}"), True).close()

    def read(self, schema: str) -> DataFrame:
        """All rows of the batches in the ledger, with their ``batch``."""
        done = self.done()
        if not done:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/batches/{n}" for n in done))
        return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batches/(\d+)/[^/]*$", 1).cast("long"))


def judge_stream(spark: SparkSession, folder: str, schema: str, judge: Callable[[DataFrame], DataFrame], ledger: Ledger, checkpoint: str, judged: DataFrame | None = None, key: str = "clip_id") -> StreamingQuery:
    """Judge the records of files that are new since the last run, each key once, into a ledger.

    judged: keys with a verdict from elsewhere, such as judged_keys() of an earlier run's outputs; they are left out. judge
    gives the records a verdict. A run that breaks off in a batch repeats that batch and no other.
    """
    rows = spark.readStream.schema(schema).json(folder).dropDuplicates([key])

    def step(batch: DataFrame, number: int) -> None:
        left = batch if judged is None else batch.join(judged.select(key).distinct(), key, "left_anti")
        ledger.write(judge(left), number)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def judged_keys(spark: SparkSession, *paths: str, key: str = "clip_id") -> DataFrame:
    """Keys of the records in the outputs of a judge (accepted, rejected, uncertain); one that isn't there has none."""
    from ..sources.readers import records_if_any

    found = None
    for path in paths:
        one = records_if_any(spark, path).select(key)
        found = one if found is None else found.unionByName(one)
    return found.where(F.col(key).isNotNull()).distinct()


def judge_outputs(verdicts: DataFrame, path: str, names: tuple[str, ...] = ("accepted", "rejected", "uncertain"), by: str = "verdict") -> None:
    """The three outputs of a judge, each as arrays of records, for people and for the next run's judged_keys()."""
    from ..sources.writers import json_array

    for name in names:
        json_array(verdicts.where(F.col(by) == name).drop(by), f"{path}/{name}")
