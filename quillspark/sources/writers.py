"""Writers of records, sheets, splits and reports. Nothing is overwritten in place: versions go beside each other."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import schemas as S
from ..operators.ingest import routed
from . import arrow


def json_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def json_array(rows: DataFrame, path: str) -> None:
    """Every part file is one JSON array with a record a line, so that each can be read by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, opened = None, "["
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if not lines:
                continue
            out = ([] if held is None else [f"{opened}{held},"]) + [f"{opened if held is None and i == 0 else ''}{x}," for i, x in enumerate(lines[:-1])]
            if held is not None or len(lines) > 1:
                opened = ""
            held = lines[-1]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if held is None else f"{opened}{held}]"], pa.string())], ["value"])

    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInArrow(run, "value string").write.text(path)


def single_file(lines: DataFrame, path: str) -> None:
    """A small text column as one file of the given name: lists and maps that people and other tools look up by name."""
    spark = lines.sparkSession
    lines.coalesce(1).write.text(f"{path}.parts")
    hadoop = spark._jvm.org.apache.hadoop.fs
    parts, whole = hadoop.Path(f"{path}.parts"), hadoop.Path(path)
    fs = parts.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in fs.listStatus(parts) if x.getPath().getName().startswith("part-"))
    fs.rename(part, whole)
    fs.delete(parts, True)


def flat(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without them."""
    nested = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    return rows.withColumns({c: F.to_json(c) for c in nested})


def sheet(rows: DataFrame, path: str, sep: str = ",", columns: tuple[str, ...] | None = None, byte_order_mark: bool = False) -> None:
    """CSV or TSV with a header. With a byte order mark the first column's name carries it, as spreadsheets expect."""
    out = flat(rows.select(*columns) if columns else rows)
    if byte_order_mark:
        out = out.withColumnRenamed(out.columns[0], "﻿" + out.columns[0])
    out.write.csv(path, header=True, sep=sep, escape='"')


def review_sheet(clips: DataFrame, path: str | None = None, code_switched: bool = False, sep: str = "\t") -> DataFrame:
    """The sheet for reviewers, written if a path is given: 13 columns, or 12 without the flag for code-switched clips.
    Missing columns and values have their defaults."""
    names = [c for c in S.REVIEW_LAYOUT if not (code_switched and c == "is_code_switched")]
    given = {"auto_transcript": "transcript"}
    cell = lambda c: F.coalesce(F.col(given.get(c, c)).cast("string"), F.lit(S.REVIEW_LAYOUT[c])) if given.get(c, c) in clips.columns else F.lit(S.REVIEW_LAYOUT[c])
    out = clips.select(*(cell(c).alias(c) for c in names))
    if path:
        sheet(out, path, sep)
    return out


def routes(clips: DataFrame, path: str) -> None:
    """Clean and damaged clips, all and code-switched, in a folder each."""
    routed(clips).write.partitionBy("route").parquet(path)


def merged_outputs(records: DataFrame, duplicates: DataFrame, path: str) -> None:
    """All seven outputs of a merge: the records; sheets of clean clips, all (TSV and CSV) and code-switched (TSV and
    CSV); sheets of damaged clips, all and code-switched; and the duplicates that were skipped."""
    json_array(records, f"{path}/transcripts")
    damaged = F.coalesce(F.col("transcript").contains("\ufffd"), F.lit(False))
    cs = F.coalesce(F.col("is_code_switched"), F.lit(False))
    for name, rows, short in (("for_human_review", records.where(~damaged), False), ("code_switched", records.where(~damaged & cs), True)):
        review_sheet(rows, f"{path}/{name}.tsv", short)
        review_sheet(rows, f"{path}/{name}.csv", short, ",")
    review_sheet(records.where(damaged), f"{path}/needs_encoding_review.csv", False, ",")
    review_sheet(records.where(damaged & cs), f"{path}/needs_code_switched_encoding_review.csv", True, ",")
    json_array(duplicates, f"{path}/duplicates")


def with_audio(rows: DataFrame, audio: DataFrame) -> DataFrame:
    """rows with ``audio_missing``: whether their audio_path isn't in the listing."""
    there = audio.select("audio_path").distinct().withColumn("_there", F.lit(True))
    return rows.join(there, "audio_path", "left").withColumn("audio_missing", F.col("_there").isNull()).drop("_there")


def split_manifests(rows: DataFrame, audio: DataFrame, path: str, names: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """Manifests split by split of the rows whose audio is there; split, written, missing: how many that were.

    The counts are observed while the manifests are written, in the one job that there is. Splits of other names are
    written too, and counted together as a null split.
    """
    marked = with_audio(rows, audio)
    here = {n: F.col("split").eqNullSafe(F.lit(n)) for n in names}
    other = ~F.coalesce(F.col("split").isin(*names), F.lit(False))
    seen = Observation()
    measures = []
    for k, of in enumerate([*here.values(), other]):
        measures += [F.count_if(of & ~F.col("audio_missing")).alias(f"written_{k}"), F.count_if(of & F.col("audio_missing")).alias(f"missing_{k}")]
    marked.observe(seen, *measures).where("NOT audio_missing").drop("audio_missing").write.partitionBy("split").csv(path, header=True, escape='"')
    counts = [(n, seen.get[f"written_{k}"], seen.get[f"missing_{k}"]) for k, n in enumerate([*names, None])]
    return rows.sparkSession.createDataFrame([c for c in counts if c[1] or c[2]], "split string, written long, missing long")


def arrow_files(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Arrow IPC files, a file a task; nothing is there until all are, and nothing stays of a write that failed."""
    arrow.register(rows.sparkSession)
    rows.write.format(arrow.NAME).mode("overwrite" if overwrite else "append").save(path)


def splits(rows: DataFrame, path: str, subset: bool = False) -> None:
    rows.write.partitionBy(*(("subset", "split") if subset else ("split",))).parquet(path)


def public(rows: DataFrame, path: str) -> None:
    """Only the columns that are published, split by split."""
    rows.select(*(c for c in S.PUBLIC if c in rows.columns)).write.partitionBy("split").parquet(path)


def append_new(rows: DataFrame, path: str, key: str, known: DataFrame | None) -> None:
    """Rows whose key isn't stored yet are appended, so a run that broke off can be repeated."""
    new = rows if known is None else rows.join(known.select(key).distinct(), key, "left_anti")
    new.write.mode("append").parquet(path)


def new_tokens(found: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens to append to a lexicon: those it lacks."""
    return found.select("token").distinct().join(lexicon.select("token"), "token", "left_anti")


def mirrored(rows: DataFrame, *paths: str) -> None:
    for path in paths:
        rows.write.mode("errorifexists").parquet(path)


class VersionTaken(RuntimeError):
    """Another writer has made the version that this one was about to make."""


def _versions(spark: SparkSession, path: str) -> list[int]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(where)]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)\.manifest", n)))


def _claim(spark: SparkSession, path: str, n: int, folder: str) -> bool:
    """Make version n's manifest, which names its folder, unless there is one: at once, and with its content."""
    jvm = spark._jvm
    hadoop, conf = jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    mine, manifest = hadoop.Path(f"{path}/.{folder}.manifest"), hadoop.Path(f"{path}/v{n}.manifest")
    fs = mine.getFileSystem(conf)
    out = fs.create(mine, True)
    out.write(bytearray(folder.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":  # a link is made only where nothing is
            jvm.java.nio.file.Files.createLink(jvm.java.io.File(manifest.toUri().getPath()).toPath(), jvm.java.io.File(mine.toUri().getPath()).toPath())
            fs.delete(mine, False)
        else:  # a rename that doesn't replace
            none = spark._jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            hadoop.FileContext.getFileContext(mine.toUri(), conf).rename(mine, manifest, none)
    except Py4JJavaError as e:
        fs.delete(mine, False)
        if "AlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    return True


def new_version(rows: DataFrame, path: str) -> int:
    """Write the next version beside the last one, which stays as its backup; rows may have been read from it.

    The rows go to a folder of their own, and become version n when the manifest vN.manifest is made, which only one writer
    can do. Of two writers that began from the same version the later one gets VersionTaken and leaves nothing behind, so
    that it can read the other's version and begin again. A folder without a manifest is never read.
    """
    spark = rows.sparkSession
    n = (_versions(spark, path) or [0])[-1] + 1
    folder = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    if not _claim(spark, path, n, folder):
        data = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        data.getFileSystem(spark._jsc.hadoopConfiguration()).delete(data, True)
        raise VersionTaken(f"{path}: version {n} has been made meanwhile")
    return n


def version(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """A version by number, or the last one."""
    n = n or _versions(spark, path)[-1]
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/v{n}.manifest').first().value}")


def stored_or_made(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What is stored at ``path``; if nothing is, what ``make`` gives, stored first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)


def catalogue(buckets: DataFrame, path: str) -> None:
    buckets.select("bucket", "dialect", "domain", "queries").write.json(path)


def metrics_json(metrics: DataFrame, by: str = "model") -> DataFrame:
    """by, json: each row's measures as a JSON object."""
    return metrics.select(by, F.to_json(F.struct(*(c for c in metrics.columns if c != by))).alias("json"))
