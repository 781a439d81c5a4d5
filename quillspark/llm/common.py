"""Small helpers that the corpus operators share: shared-folder tables, null-safe text, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised pass holds; a longer document is a pass of its own.
PASS_BYTES = 3_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a temporary one on a local
    master, as in tests; on a cluster that is an error, since no machine's own folder would do."""
    where = spark.sparkContext.getCheckpointDir()
    if where is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="quill-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quill_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables of materialise() that nothing will read again; others are left alone."""
    for df in tables:
        path = getattr(df, "quill_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the decimal text of an integer id, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit("")).cast("binary")) % n


class Shared:
    """An object of bounded size that each Python worker unpickles once and keeps, with what it caches, for its life."""

    def __init__(self, spark: SparkSession, value: object):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        kept = self.sent.__dict__  # a worker holds one Broadcast object for all its tasks
        if "_quill" not in kept:
            kept["_quill"] = cloudpickle.loads(self.sent.value)
        return kept["_quill"]


def passes(texts: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array that hold about ``limit`` bytes each, whole documents only."""
    n = len(texts)
    if not n:
        return
    size = np.cumsum(np.diff(offsets_of(texts)))
    start = 0
    while start < n:
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield start, end
        start = end


def offsets_of(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def filled(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with nulls as empty texts."""
    return batch.column(batch.schema.get_field_index(name)).fill_null("")
