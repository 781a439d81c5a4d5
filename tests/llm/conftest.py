import random
import re

import pytest

WORDS = "the of and tion ing her man car table over river stone light walk green seven cloud paper glass north".split()
TRANS = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(TRANS) if lower else text or "")


def shingles(text):
    w = words(text, True)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared passages, repeated lines, empties, nulls, a long one and repeated rows."""
    rng = random.Random(4)
    sentence = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    out = []
    for i in range(120):
        out.append("\n".join(sentence(rng.randint(8, 20)) for _ in range(rng.randint(1, 5))))
    base = sentence(120)
    for _ in range(25):
        w = base.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w))
    passage = sentence(30)
    out += [f"{passage}\n{sentence(10)}" for _ in range(12)]
    out += out[:10] + ["", "", None, "   \n ", "one two", "One two", "ÜBER straße über", "x" * 50_000, sentence(9000), "a\n\nb\na", "###$$$ %%%", "日本 語 テキスト 🎉 é́"]
    langs = ["en", "fr", None, "de"]
    table = [(i, t, langs[i % 4], f"s{i % 3}" if i % 17 else None, len(t or "")) for i, t in enumerate(out)]
    return table + [table[5], table[5], (None, "null id", "en", "s1", 7)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with columns that have the operators' inner names."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("id", "body", "bucket", "component", "whole", "stratum", "kept", "line", "row", "n_words", "pass", "block")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
