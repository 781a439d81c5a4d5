"""run() of the pipeline against a brute-force version of all its stages on a small table."""

import collections
import hashlib
import math

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quillspark.llm import byte_bpe, mixing, queries

from .conftest import shingles, words
from .test_operators import brute_lines, brute_stats, union_find


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def brute_near(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    ids = sorted(sets)
    root = union_find([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    return [r for r in rows if root(r[0]) == r[0]]


def brute_mix(rows, seed=17):
    """How often each document is taken, with budgets and orders as documented."""
    units = collections.Counter()
    for i, t, _, s, _ in rows:
        units[(i, s or "")] += len(words(t))
    by = collections.defaultdict(list)
    for (i, s), n in units.items():
        by[s].append((i, n))
    total = sum(units.values())
    sizes = {s: sum(n for _, n in x) for s, x in by.items()}
    names = sorted(sizes)
    k = mixing.exponent([sizes[s] for s in names], mixing.Target(), total)
    powers = {s: (sizes[s] / total) ** (k / mixing.STEPS) if sizes[s] else 0.0 for s in names}
    taken = collections.Counter()
    for s in names:
        if not sizes[s]:
            continue
        budget = round(powers[s] / sum(powers.values()) * mixing.UNIT) * total // mixing.UNIT
        passes, rest = divmod(budget, sizes[s])
        blocks = math.ceil(len(by[s]) / mixing.BLOCK_DOCS)
        for i, _ in by[s]:
            taken[(i, s)] += passes
        at = {i: int(md5(seed, i)[:8], 16) % blocks for i, _ in by[s]}
        spent = 0
        for i, n in sorted(by[s], key=lambda x: (md5(seed, passes, "block", at[x[0]]), at[x[0]], md5(seed, passes, x[0]), x[0])):
            spent += n
            taken[(i, s)] += spent <= rest
    return [r for r in rows for _ in range(taken[(r[0], r[3] or "")])]


@pytest.fixture(scope="module")
def folder(docs, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).write.parquet(f"{path}/documents.parquet")
    spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{path}/labels.parquet")
    return path


def test_run(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()]
    good = []
    for r in rows:
        n, _, _, _, repeated = brute_stats(r[1])
        if n >= 10 and 100 * repeated <= 20 * n:
            good.append(r)
    clean = brute_lines(good)
    cleaned = [(r[0], clean(r[0], r[1]), *r[2:]) for r in good]
    mixed = brute_mix(brute_near(cleaned))
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(corpus_pipeline.VOCABULARY), special_tokens={})
    want = sorted((i, hashlib.sha256(t.encode()).hexdigest(), codec.encode_ordinary(t)) for i, t, *_ in mixed)
    got = sorted((r.doc_id, r.decoded_sha256, r.ids) for r in queries.pipeline(spark, folder).collect())
    assert got == want and len({i for i, *_ in got}) > 50


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "mix", "encode"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).columns == docs.columns


def test_any_rows(spark, docs, folder):
    """Nulls in every column, repeated rows, and columns that clash with inner names go through every stage."""
    more = docs.limit(40).unionByName(docs.where("doc_id IS NULL")).unionByName(spark.createDataFrame([(7000, None, None, None, None)], docs.schema))
    rows = more.withColumns({c: F.lit("x") for c in ("id", "line", "turn", "component", "whole", "stratum", "kept", "row", "pass", "block", "lines", "gone")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, folder)
        if name == "encode":
            assert out.count() == rows.count()
        else:
            assert out.columns == rows.columns and out.count() <= 3 * rows.count()
            assert name == "quality" or out.where("doc_id IS NULL").count() > 0


def test_empty_table(spark, docs, folder, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.pipeline(spark, str(tmp_path)).count() == 0
