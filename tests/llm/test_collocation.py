import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import collocation

from .conftest import TRANS


def brute(rows, max_words, least, inside, top):
    counts, total = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(TRANS)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, max_words + 1):
                counts.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {g: n for g, n in counts.items() if n >= least and len(g) > 2}
    out = collections.defaultdict(list)
    for (lang, *w), a in found.items():
        if any(g[0] == lang and len(g) > len(w) + 1 and 100 * n >= inside * a and any(list(g[i : i + len(w)]) == w for i in range(1, len(g) - len(w) + 1)) for g, n in found.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (counts[lang, *w[:k]] * counts[lang, *w[k:]]), k, counts[lang, *w[:k]], counts[lang, *w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k, p.decode(), -a, left, right, total[lang], -s) for lang, x in out.items() for k, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


@pytest.fixture(scope="module")
def table(rows):
    rng = random.Random(3)
    out = list(rows)
    for k in range(60):
        w = [rng.choice(["New", "york", "city", "a", "a", "b", "ñandú", "日本"]) for _ in range(rng.randint(0, 30))]
        out.append((2000 + k, "".join(x + rng.choice([" ", "  ", "\t", " ", ", ", ".", "\n", "\x0b", "\r\n", "\xa0", "-"]) for x in w), rng.choice(["en", "fr", None, "und", ""]), "s", 1))
    return out + [(1, "a a a a a a a a a a a a a a", "aa", "s", 1), (2, "b b", "aa", "s", 1), (3, "x\x00y z\x0cx\x00y z " * 12, "zz", "s", 1)]


@pytest.mark.parametrize(("max_words", "least", "inside", "top", "bits"), [(3, 10, 50, 2000, 1 << 27), (2, 3, 50, 5, 1 << 27), (4, 2, 70, 2000, 1 << 27), (3, 3, 50, 40, 64)])
def test_phrases(spark, table, max_words, least, inside, top, bits):
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("phrase", "n", "a", "rank", "w", "cut", "left", "score")})
    got = collocation.collocations(df.repartition(3), max_words=max_words, least=least, inside_percent=inside, top=top, most_bits=bits)
    assert sorted(tuple(r) for r in got.collect()) == brute(table, max_words, least, inside, top)


def test_nothing_frequent(spark, empty, docs):
    assert collocation.collocations(empty).count() == 0
    few = spark.createDataFrame([("one two three", "en"), (None, "en"), ("", None)], "text string, lang string")
    got = collocation.collocations(few)
    assert got.count() == 0 and got.columns == collocation.collocations(docs).columns


def test_exact_beyond_64_bits(spark):
    big = 3_000_000_019
    level = lambda rows: spark.createDataFrame([("en", *r) for r in rows], "lang string, phrase string, n long")
    got = collocation.scored([level([("a", big), ("b", big + 7)]), level([("a b", big - 1)])]).first()
    assert got.score == 10**6 * (big - 1) ** 2 // (big * (big + 7)) and (got.l, got.r) == (big, big + 7)


def test_filter():
    f = collocation.Filter(1 << 12)
    keys = np.random.default_rng(1).integers(0, 1 << 63, 100, dtype=np.uint64)
    for p in f.places(keys):
        np.bitwise_or.at(f.words, (p >> np.uint64(6)).astype(int), np.left_shift(np.uint64(1), p & np.uint64(63)))
    assert f.has(keys).all() and f.has(np.random.default_rng(2).integers(0, 1 << 63, 10000, dtype=np.uint64)).mean() < 0.02
