"""Metrics and corpus queries over whole turns, all rows and all words."""

from quillspark.functions import text as T
from quillspark.operators import alignment, metrics
from quillspark.plans import corpus_queries, metric_queries, registry


def conversations(spark, path):
    turn = " ".join(f"w{k}" for k in range(60))
    rows = [(c, 2 * t + s, "user" if s == 0 else "assistant", turn if s == 0 else turn.replace("w50", "w5o").replace("w55 ", "")) for c in range(4) for t in range(2) for s in range(2)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_words_after_the_fortieth_count(spark, tmp_path):
    sf = conversations(spark, tmp_path)
    for name in ("corpus_wer_by_group", "metric_bundle"):
        assert {r.wer for r in registry.queries()[name](spark, sf).collect()} == {round(2 / 60, 4)}
    assert {(r["sub"], r["del"], r.n_words) for r in metric_queries.error_breakdown(spark, sf).collect()} == {(2, 2, 120)}
    assert {r.cer for r in metric_queries.corpus_cer(spark, sf).collect()} != {0.0}
    assert metric_queries.worst_pairs_topk(spark, sf).first().wer == round(2 / 60, 4)


def test_distance_beyond_the_table(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CELLS", 2)
    row = spark.createDataFrame([("a b c d", "a x c")], "r string, h string")
    assert row.select(metrics.word_distance(T.words("r"), T.words("h")).alias("d")).first().d == 2


def test_rare_spelling_variants(spark, tmp_path):
    """More than 2,000 frequent substitutions before the only spelling variant."""
    rows = [(c, t, "user" if t == 0 else "assistant", f"{chr(97 + t) * 3}{c // 2}" if c < 4200 else ("colour" if t == 0 else "color")) for c in range(4201) for t in range(2)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert "colour" in {r.ref_word for r in metric_queries.spelling_variants(spark, str(tmp_path)).collect()}


def test_resamples(spark, tmp_path):
    sf = conversations(spark, tmp_path)
    assert metric_queries.cluster_bootstrap(spark, sf).count() == 10_000
    x = registry.queries()["paired_bootstrap"](spark, sf).first()
    assert x.p_two < 0.001 and registry.queries()["bootstrap_ci"](spark, sf).count() == 4


def test_components_of_all_rows(spark, tmp_path):
    spark.createDataFrame([(10, 7), (11, 7), (11, 3), (20, 3), (30, 14)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: r.component for r in corpus_queries.components(spark, str(tmp_path)).collect()}
    assert got == {10: 10, 11: 10, 20: 10, 30: 30}


def test_nearest_words_of_any_length(spark, tmp_path):
    spark.createDataFrame([(1, "dictionaries wonderfull cat", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "dictionaries wonderful dog")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.token, r.word) for r in corpus_queries.nearest_dictionary_words(spark, str(tmp_path)).collect()] == [("wonderfull", "wonderful")]
