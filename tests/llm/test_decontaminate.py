import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontaminate

from .conftest import TRANS

ITEMS = "item_id long, text string, id string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TRANS))


def brute(rows, items, window, width, containment):
    """Every window at every place of every text."""
    windows = {}
    for item, text, *_ in items:
        w = words(text)
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add("" if item is None else str(item))
    out = []
    for doc, text, *_ in rows:
        w, spans, found = words(text), set(), set()
        for x, owners in windows.items():
            n = len(x)
            own = min(width, n)
            places = range(n - own + 1)
            for s in range(len(w) - n + 1):
                y = tuple(w[s : s + n])
                same = y == x if containment >= 1 else sum(y[i : i + own] == x[i : i + own] for i in places) >= math.ceil(containment * len(places))
                if same:
                    spans.add((s, n))
                    found |= owners
        hit = {p for s, n in spans for p in range(s, s + n)}
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit), tuple(sorted(spans))))
    return sorted(out, key=str)


def got(df):
    return sorted(((*r[:6], tuple((s.start, s.size) for s in r.spans)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def table(rows):
    passage = words(rows[0][1]) + words(rows[1][1])
    w = words(rows[3][1])
    long = words(rows[2][1])[:12]
    items = [
        (1, " ".join(passage[:30]).upper(), "x"), (2, "; ".join(w[:4]), "x"), (3, w[5], "x"), (4, " ".join(w[6:8]), "x"), (5, " ".join(w[3:6]), "x"), (6, None, "x"), (7, "", "x"), (8, "?!", "x"), (None, " ".join(w[:9]), "x"),
        (9, " ".join(long), "x"), (9, " ".join(long), "x"), (10, " ".join(long), "x"), (10, " ".join(reversed(long)), "x"), (11, "日本 語 Ü", "x"), (12, "ÜBER straße", "x"), (13, "one two", "x"),
    ]
    changed = [*long[:5], "other", *long[6:]]
    docs = rows[:150] + [(500 + k, t, "en", "s", 1) for k, t in enumerate((" ".join(long) + "\n" + " ".join(long), " ".join(changed), "a " + " ".join(long[:9]), "a-" + "-".join(long) * 3, " ".join(long[:10]) + " " + " ".join(long[:10]), "x " * 30))]
    return docs + [(500, "another text of this id " + w[5], "en", "s", 1), docs[-6], docs[-6]] + rows[150:], items


@pytest.mark.parametrize(("window", "width", "containment", "most"), [(10, 3, 1.0, 1000), (10, 3, 1.0, 0), (4, 2, 1.0, 1000), (10, 1, 1.0, 1000), (10, 3, 0.6, 1000), (6, 2, 0.75, 0), (3, 5, 1.0, 1000)])
def test_windows(spark, table, window, width, containment, most):
    docs, items = table
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("doc", "w", "hash", "wid", "text_key", "place", "item", "spans")})
    bench = spark.createDataFrame(items, ITEMS).withColumns({c: F.lit(1) for c in ("words", "wid", "doc_id")})
    out = decontaminate.decontaminate(df, bench, window=window, width=width, containment=containment, broadcast_windows=most)
    assert got(out) == brute(docs, items, window, width, containment)


def test_empty_sides(spark, docs, empty, table):
    bench = spark.createDataFrame(table[1], ITEMS)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    none = decontaminate.decontaminate(docs, bench.limit(0)).collect()
    assert len(none) == docs.count() and not any(r.contaminated or r.n_hit or r.n_items or r.spans for r in none)
    assert all(r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in none)


def test_prefix_is_the_rarest_shingle(spark):
    docs = spark.createDataFrame([(k, "a b c d" if k else "c d e f") for k in range(9)], "doc_id long, text string")
    words_of = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_key"), decontaminate.words_of(F.col("text")).alias("w"))
    windows, _ = decontaminate.item_windows(spark.createDataFrame([(1, "a b c d e")], "item_id long, text string"), "item_id", "text", 10, 2)
    one = decontaminate.prefixes(windows, words_of, 2, 1.0, True).collect()
    assert [w.at for r in one for w in r.windows] == [3]
    three = decontaminate.prefixes(windows, words_of, 2, 0.5, True).collect()
    assert sorted(w.at for r in three for w in r.windows)[-1] == 3 and sum(len(r.windows) for r in three) == 3


def test_no_python_on_the_main_path(spark, docs, table):
    plan = decontaminate.decontaminate(docs, spark.createDataFrame(table[1], ITEMS))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
