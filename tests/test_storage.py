import glob
import hashlib
import json
import os
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.plans import record_queries
from quillspark.sources import arrow, readers, shared, writers
from quillspark.streaming import resume


def test_arrow_file_is_read_in_parts(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(0, 400_000, 1, 2).select("id", (F.col("id") / 3).alias("x"), F.concat(F.lit("ü"), F.col("id").cast("string")).alias("s"), F.array("id").alias("a"), F.when(F.col("id") % 2 == 0, 1).alias("n"))
    writers.arrow_files(rows, path)
    assert len([f for f in os.listdir(path) if f.endswith(".arrow")]) == 2 and "_SUCCESS" in os.listdir(path)
    got = readers.arrow_files(spark, path, part_bytes=2_000_000)
    assert got.schema.simpleString() == rows.schema.simpleString() and got.select(F.spark_partition_id()).distinct().count() > 4
    assert not got.exceptAll(rows).count() and got.count() == 400_000
    some = readers.arrow_files(spark, path, "s string, missing int")
    assert some.count() == 400_000 and some.where("missing IS NOT NULL").count() == 0
    writers.arrow_files(rows.limit(3), path, overwrite=True)
    assert readers.arrow_files(spark, path).count() == 3


def test_arrow_streams_and_single_files(spark, tmp_path):
    table = pa.table({"k": [1, 2, 3]})
    with pa.OSFile(f"{tmp_path}/a.arrows", "wb") as f, pa.ipc.new_stream(f, table.schema) as out:
        out.write_table(table, max_chunksize=1)
    with pa.OSFile(f"{tmp_path}/b.arrow", "wb") as f, pa.ipc.new_file(f, table.schema) as out:
        out.write_table(table, max_chunksize=1)
    assert sorted(r.k for r in readers.arrow_files(spark, f"file:{tmp_path}", part_bytes=64).collect()) == [1, 1, 2, 2, 3, 3]
    assert readers.arrow_files(spark, f"{tmp_path}/b.arrow").count() == 3


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    bad = spark.range(0, 100_000, 1, 4).select("id", F.when(F.col("id") == 99_999, F.raise_error(F.lit("no"))).cast("string").alias("s"))
    with pytest.raises(Exception, match="no"):
        writers.arrow_files(bad, path)
    assert not os.path.exists(path) or not os.listdir(path)
    with pytest.raises(Exception, match="no Arrow file"):
        readers.arrow_files(spark, path)


def test_damaged_lines_in_blocks(spark, tmp_path):
    lines = ["[" + json.dumps({"clip_id": "0"}) + ","]
    for k in range(1, 3000):
        lines.append({5: '{"clip_id": "5"', 6: "", 7: "[1, 2],", 8: '"text",', 2900: '{"clip_id": 1, "duration_sec": {}},'}.get(k % 100 if k < 2900 else k, json.dumps({"clip_id": str(k), "transcript": "a]},[{ b"}) + ","))
    lines.append(json.dumps({"clip_id": "last", "word_tags": [{"word": "w", "lang": "EN"}]}) + "]")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.json").write_text("\n".join(lines))
    (tmp_path / "x" / "b.json").write_text("[]\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        good, bad = readers.quarantined(spark, f"{tmp_path}/x")
        assert good.rdd.getNumPartitions() > 5
        ids, wrong = [r.clip_id for r in good.collect()], {r.row: r.value for r in bad.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    damaged = {k for k, x in enumerate(lines) if x.startswith(('{"clip_id": "5"', "[1", '"text', '{"clip_id": 1,'))} - {0}
    damaged = {k for k in damaged if lines[k] != json.dumps({"clip_id": "5", "transcript": "a]},[{ b"}) + ","}
    damaged = {k for k in damaged if not lines[k].endswith("b\"},")}
    assert set(wrong) == damaged and all(lines[k] == x for k, x in wrong.items())
    assert len(ids) == len(lines) - len(damaged) - sum(x == "" for x in lines) and {"0", "last", "10"} <= set(ids)


def test_counts_are_observed_in_the_one_job(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", "train"), ("b", "y", "train"), ("c", None, "test"), ("d", "x", "other"), ("e", "z", None)], "clip_id string, audio_path string, split string")
    audio = spark.createDataFrame([("x",)], "audio_path string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("manifests", "manifests")
    made = writers.split_manifests(rows, audio, f"{tmp_path}/m")
    spark.sparkContext.setJobGroup("", "")
    # what adaptive execution makes of the one write: its shuffles or broadcasts, and the write itself
    assert len(tracker.getJobIdsForGroup("manifests")) <= 4
    assert {r.split: (r.written, r.missing) for r in made.collect()} == {"train": (1, 1), "test": (0, 1), None: (1, 1)}
    assert spark.read.csv(f"{tmp_path}/m", header=True).count() == 2


def test_two_writers_of_one_version(spark, tmp_path):
    path, results = f"{tmp_path}/v", []
    assert writers.new_version(spark.range(3), path) == 1
    barrier, listed = threading.Barrier(2), writers._versions
    calls = []

    def together(*args):
        found = listed(*args)
        if len(calls) < 2:
            calls.append(1)
            barrier.wait(60)
        return found

    def write(n):
        try:
            results.append(writers.new_version(spark.range(n), path))
        except writers.VersionTaken:
            results.append("taken")

    writers._versions = together
    try:
        threads = [threading.Thread(target=write, args=(n,)) for n in (5, 6)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    finally:
        writers._versions = listed
    assert sorted(results, key=str) == [2, "taken"]
    assert writers.version(spark, path).count() in (5, 6) and writers.version(spark, path, 1).count() == 3
    assert len([f for f in os.listdir(path) if f.startswith("data-")]) == 2 and not [f for f in os.listdir(path) if f.startswith(".data") and f.endswith("manifest")]


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    ledger = resume.Ledger(spark, f"{tmp_path}/l")
    assert ledger.done() == [] and ledger.read("id long").count() == 0
    ledger.write(spark.range(4), 0)
    spark.range(9).write.parquet(f"{tmp_path}/l/batches/1")  # broke off before the ledger
    assert ledger.read("id long").count() == 4
    ledger.write(spark.range(4, 6), 1)
    ledger.write(spark.range(100), 1)
    assert sorted((r.id, r.batch) for r in ledger.read("id long").collect()) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1)]


def test_a_stream_that_fails_goes_on(spark, tmp_path):
    clips = spark.createDataFrame([(str(k),) for k in range(10)], "clip_id string")
    clips.write.json(f"{tmp_path}/in")
    resume.judge_outputs(clips.where("clip_id < 3").withColumn("verdict", F.lit("accepted")), f"{tmp_path}/old")
    known = resume.judged_keys(spark, f"{tmp_path}/old/accepted", f"{tmp_path}/old/rejected", f"{tmp_path}/none")
    ledger, broken = resume.Ledger(spark, f"{tmp_path}/out"), [True]

    def judge(rows):
        if broken:
            broken.clear()
            raise RuntimeError("the judge is away")
        return rows.withColumn("verdict", F.lit("rejected"))

    run = lambda: resume.judge_stream(spark, f"{tmp_path}/in", "clip_id string", judge, ledger, f"{tmp_path}/state", known)
    with pytest.raises(Exception, match="away"):
        run().awaitTermination()
    assert ledger.read("clip_id string, verdict string").count() == 0
    for _ in range(2):
        run().awaitTermination()
    assert sorted(r.clip_id for r in ledger.read("clip_id string, verdict string").collect()) == [str(k) for k in range(3, 10)]


def test_predictions_lie_in_parts_of_many_tasks(spark, tmp_path):
    texts = ["a\n[b],\r", None, "", "]", "é, [", '"x"']
    docs = [(k, texts[k % 6], "en", "web", 4) for k in range(-3, 60)] + [(None, "no id", "en", "web", 4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    there = set(glob.glob(f"{shared.folder(spark).removeprefix('file:')}/predictions-*"))
    got = {(r.k, r.clip_id, r.model, r.hypothesis_sha256) for r in record_queries.predictions_by_model(spark, str(tmp_path)).collect()}
    rest = lambda a, b: a % b if a >= 0 else -(-a % b)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert got == {(None if d is None else rest(d, 7), None if d is None else str(d), None if d is None else f"m{rest(d, 2)}", sha(t)) for d, t, *_ in docs}
    (made,) = set(glob.glob(f"{shared.folder(spark).removeprefix('file:')}/predictions-*")) - there
    parts = glob.glob(f"{made}/m0_predictions.json/part-*")
    assert len(parts) > 1 and sum(len(json.load(open(p))) for p in parts) == 31
