import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import schemas
from quillspark.functions import text as T
from quillspark.operators import audit, ingest, judge, metrics, quality, split, stats
from quillspark.sources import readers, writers
from quillspark.streaming import resume


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


word = st.sampled_from(["a", "b", "cc", "আমি", "x"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(word, max_size=8), st.lists(word, max_size=8)), min_size=1, max_size=12))
def test_word_distance_and_alignment(spark, pairs):
    rows = [(" ".join(r), " ".join(h)) for r, h in pairs]
    df = spark.createDataFrame(rows, "r string, h string")
    r, h = T.words("r"), T.words("h")
    for x, (ref, hyp) in zip(df.select(metrics.word_distance(r, h).alias("d"), metrics.alignment(r, h).alias("a")).collect(), pairs, strict=True):
        d = levenshtein(ref, hyp)
        assert x.d == d == x.a["sub"] + x.a["del"] + x.a["ins"]
        assert x.a["ins"] - x.a["del"] == len(hyp) - len(ref)


def test_metric_bundle(spark):
    rows = [("m", "আমি আজ office যাব", "আমি আজ office যাব", True), ("m", "আমি আজ meeting করব", "আমি মিটিং করব", True), ("m", "সে ভালো", "সে ভাল", False), ("m", "", "x", False)]
    df = spark.createDataFrame(rows, "model string, reference string, hypothesis string, is_code_switched boolean")
    x = metrics.metric_bundle(metrics.pair_statistics(df), "model").first()
    assert (x.n, x.n_cs, x.wer, x.wer_cs) == (4, 2, 0.3, 0.25)
    assert (x.wer_bn, x.wer_en) == (round(2 / 8, 4), 0.5) and x.en_survival == 0.5 and x.mix_er == round((1 / 6 + 1 / 2) / 2, 4)
    assert (x.tp, x.fp, x.fn, x.tn) == (1, 0, 1, 2) and x.cs_f1 == 0.6667


def test_perfect_and_missing_references(spark):
    df = spark.createDataFrame([("a b", "a b"), ("", "x")], "reference string, hypothesis string")
    s = metrics.pair_statistics(df)
    assert s.agg(metrics.rate("word_edits", "n_words").alias("w")).first().w == 0.0
    assert s.where("reference = ''").agg(metrics.rate("word_edits", "n_words").alias("w")).first().w is None


def test_tiers(spark):
    rows = [("", False, 0.0, 0.1), ("আ", False, 0.0, 0.1), ("আমিইইই", True, 0.9, 0.1), ("আমিইইই", False, 0.9, 0.1), ("আমিইইই", False, 0.9, 0.4), ("আমিইইই", None, None, None), ("আমিইইই", False, 0.0, 0.595)]
    df = spark.createDataFrame(rows, "t string, cs boolean, en double, p double")
    got = [tuple(r.x) for r in df.select(quality.tier(F.col("t"), F.col("cs"), F.col("en"), F.col("p")).alias("x")).collect()]
    assert got == [(None, "empty_transcript"), (None, "too_short"), (None, "cs_en_ratio_out_of_range"), ("HIGH", None), ("MEDIUM", None), ("MEDIUM", None), (None, "high_no_speech_prob")]


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "abed"), ("same", "same"), ("ab", "xy")], "a string, b string")
    assert [r.x for r in df.select(quality.similarity(F.col("a"), F.col("b")).alias("x")).collect()] == [75.0, 100.0, 0.0]
    words = spark.createDataFrame([("telefon",)], "token string"), spark.createDataFrame([("telephone",), ("telefono",), ("x",)], "word string")
    assert quality.nearest_words(*words).first().word == "telefono"


def test_clean_noise(spark):
    df = spark.createDataFrame([("1", "uh hello"), ("2", "Uh hello"), ("3", None)], "clip_id string, transcript string")
    got = {r.clip_id: (r.transcript, r.changed) for r in quality.clean_noise(df, ["uh"]).collect()}
    assert got == {"1": ("hello", True), "2": ("Uh hello", False), "3": (None, False)}
    assert {r.transcript for r in quality.clean_noise(df, ["uh"], only_raw_matches=False).collect()} == {"hello", ""}


def test_merge_conserves_rows(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "clip_id string, t string")
    b = spark.createDataFrame([("2", "z"), ("3", "w"), ("3", "v")], "clip_id string, t string")
    rows, order = ingest.union_in_order([a, b], ["A", "B"]), [F.col("priority"), F.col("t")]
    kept, out = ingest.first_wins(rows, "clip_id", order), ingest.duplicates_report(rows, "clip_id", order)
    assert {(r.clip_id, r.t) for r in kept.collect()} == {("1", "x"), ("2", "y"), ("3", "v")}
    assert kept.count() + out.count() == 5 and ("2", "A", "B") in {tuple(r) for r in out.collect()}


def test_paths_and_sources(spark):
    df = spark.createDataFrame([(r"C:\d\segments\a\b.wav", "", "x_12_3"), ("/e/f.wav", "s", "y_1")], "p string, s string, c string")
    got = [tuple(r) for r in df.select(ingest.canonical_path(F.col("p")), ingest.source_id(F.col("s"), F.col("c"))).collect()]
    assert got == [("segments/a/b.wav", "x_12"), ("e/f.wav", "s")]


def test_split_is_disjoint_and_guarded(spark):
    df = spark.range(3000).select((F.col("id") % 150).alias("g"), (F.col("id") % 3).alias("s"), "id")
    x = split.group_split(df, "g", "s", "id")
    n = {r.split: r["count"] for r in x.groupBy("split").count().collect()}
    assert x.count() == 150 and n["train"] == 120 and n["validation"] + n["test"] == 30
    held = {r.g for r in x.where("split <> 'train'").collect()}
    assert not held & {r.g for r in split.leakage_guard(df, x, "g").select("g").distinct().collect()}
    assert {r.split for r in split.group_split(df.where("g < 2"), "g", "s", "id").collect()} == {"train"}


def test_shards_balance(spark):
    df = spark.createDataFrame([(g,) for g, n in {"a": 9, "b": 5, "c": 4, "d": 1}.items() for _ in range(n)], "g string")
    load = {}
    for r in split.shards(df, "g", 2).collect():
        load[r.shard] = load.get(r.shard, 0) + r.rows
    assert sorted(load.values()) == [9, 10]


def test_augmentation(spark):
    df = spark.createDataFrame([("c_1", None, 4.0, "d", True), ("c_2", "s", 30.0, "d", True)], "clip_id string, source_id string, duration_sec double, dialect string, is_code_switched boolean")
    rows = split.augmented_rows(df, 2).collect()
    assert len(rows) == 2 and all(r.source_id == "c" and r.split_pin == "train" and 1 <= r.duration_sec <= 20 for r in rows)


def test_judges(spark):
    texts = ['ok {"decision": " accept ", "not_noise": "yes"} bye', '{"decision": "no"}', "nothing", None, '{"decision": "REJECT", broken']
    df = spark.createDataFrame([(t,) for t in texts], "r string")
    assert [r.x and (r.x.decision, r.x.not_noise) for r in df.select(judge.parse_decision(F.col("r")).alias("x")).collect()] == [("ACCEPT", True), None, None, None, None]
    s = spark.createDataFrame([('{"semantic_correctness": 9, "cs_preservation": -1, "dialect_naturalness": 3}',), ('{"semantic_correctness": 1}',)], "r string")
    assert [r.x and tuple(r.x)[:3] for r in s.select(judge.parse_scores(F.col("r")).alias("x")).collect()] == [(5, 0, 3), None]


def test_votes(spark):
    rows = [("a", "ACCEPT"), ("a", "ACCEPT"), ("a", None), ("b", None), ("b", None), ("c", "ACCEPT"), ("c", "REJECT"), ("c", "UNCERTAIN")]
    got = {r.k: r.ensemble_decision for r in judge.majority_vote(spark.createDataFrame(rows, "k string, decision string"), "k").collect()}
    assert got == {"a": "ACCEPT", "b": "REJECT", "c": "UNCERTAIN"}


def test_statistics(spark):
    same = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "a double, b double")
    assert stats.cohens_d(same, "a", "b").first().cohens_d == 0.0
    p = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "t string, p double")
    assert {r.t: round(r.p_holm, 4) for r in stats.holm(p).collect()} == {"x": 0.03, "z": 0.06, "y": 0.06}
    rows = spark.range(60).select("id", (F.col("id") % 4).alias("e"), F.lit(10).alias("n"))
    x = stats.bootstrap_interval(rows, 80, "id", "e", "n", []).first()
    assert x.low <= x.rate == 0.15 <= x.high
    t = stats.paired_test(rows.withColumn("f", F.col("e") - 1), 80, "id", "e", "f", "n").first()
    assert t.delta == 0.1 and t.p_one == 0.0 and 0 < t.p_two < 0.05


def test_components(spark):
    df = spark.createDataFrame([("s1", "h1"), ("s2", "h1"), ("s2", "h2"), ("s3", "h2"), ("s4", "h4"), (None, "h1")], "s string, h string")
    assert {r.s: r.component for r in audit.components(df, "s", "h").collect()} == {"s1": "s1", "s2": "s1", "s3": "s1", "s4": "s4"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "part_2.json").write_text(json.dumps([{"clip_id": "b"}, {"clip_id": "c"}]))
    (tmp_path / "part_10_4.json").write_text(json.dumps([{"clip_id": "a"}]))
    got = {(r.clip_id, r.priority) for r in readers.shards(spark, f"{tmp_path}/part_*.json").collect()}
    assert got == {("b", 2), ("c", 2), ("a", 10)}
    assert readers.records_if_any(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "bad.json").write_text("{broken")
    with pytest.raises(Exception):  # noqa: B017
        readers.records(spark, f"{tmp_path}/bad.json").collect()
    (tmp_path / "ids.json").write_text('{"x": 1, "y": 2}')
    assert {r.clip_id for r in readers.id_set(spark, f"{tmp_path}/ids.json").collect()} == {"x", "y"}
    (tmp_path / "lex.txt").write_text("# note\nFoo\n\nbar\n")
    assert {r.token for r in readers.lexicon(spark, f"{tmp_path}/lex.txt").collect()} == {"foo", "bar"}
    assert readers.lexicon(spark, f"{tmp_path}/missing.txt").count() == 0
    (tmp_path / "v.json").write_text(json.dumps({"_note": ["x"], "meeting": ["mtg", "mitting"]}))
    assert {(r.surface, r.canonical) for r in readers.variants(spark, f"{tmp_path}/v.json").collect()} == {("mtg", "meeting"), ("mitting", "meeting"), ("meeting", "meeting")}
    df = spark.createDataFrame([("1", "a,b", ["x"])], "clip_id string, transcript string, tags array<string>")
    writers.sheet(df, f"{tmp_path}/sheet", byte_order_mark=True)
    back = readers.sheet(spark, f"{tmp_path}/sheet")
    assert back.columns[0] == "clip_id" and back.first().transcript == "a,b" and json.loads(back.first().tags) == ["x"]


def test_routes(spark, tmp_path):
    df = spark.createDataFrame([("1", "ok", True), ("2", "b\ufffd", False)], "clip_id string, transcript string, is_code_switched boolean")
    writers.routes(df, f"{tmp_path}/r")
    assert {(r.clip_id, r.route) for r in spark.read.parquet(f"{tmp_path}/r").selectExpr("cast(clip_id as string) clip_id", "route").collect()} == {("1", "clean_all"), ("1", "clean_code_switched"), ("2", "encoding_review_all")}


def test_stream_processes_each_clip_once(spark, tmp_path):
    folder, out = tmp_path / "in", f"{tmp_path}/out"
    folder.mkdir()
    for i, ids in enumerate((["a", "b"], ["b", "c"])):
        (folder / f"{i}.json").write_text("\n".join(json.dumps({"clip_id": x, "transcript": f"t{x}"}) for x in ids))
        resume.process_new(spark, str(folder), "clip_id string, transcript string", lambda d: d.withColumn("n", F.length("transcript")), out, f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.clip_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_schemas_parse(spark):
    for name in ("SEGMENTS", "RECOGNISED", "TRANSCRIPTS", "REVIEWED", "MANIFEST", "PREDICTIONS", "TRAINER_STATE"):
        assert spark.createDataFrame([], getattr(schemas, name)).columns
