import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string"


def ordered(rows):
    """Turns of each conversation: by number, null first, then by the digest of role and text."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[conv].append((turn is not None, turn or 0, mark, (role, text)))
    return {c: [x[3] for x in sorted(t, key=lambda x: x[:3])] for c, t in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(c - 5 * int(c / 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    out = []
    for k, own in members.items():
        below = [x for x in members if x[: len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(k))))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out.append((min(own), len(k), min(members[k[:-1]]) if k else None, len(own), children[k], sum(not children[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            out.append((c, t, rng.choice(["user", "assistant"]) if t % 3 else "user", rng.choice(["a", "b", "ü é"])))
    out += [(7, 2, None, None), (7, None, "user", "first"), (7, 2, "user", "a"), (7, 2, "user", "a"), (None, 0, "user", "nobody"), (9, 1, "us", "er"), (9, 1, "user", "")]
    out += [(c, t, "user", "same") for c in range(1000, 1300) for t in range(3)]  # one conversation, very often
    return out + [(-7, 0, "user", "a"), (-5, 0, "user", "b"), (-5, 1, "user", "c"), (1 << 40, 0, "user", "x" * 100_000), (77, 0, "user", "alone")]


@pytest.mark.parametrize("rebuild", [True, False])
def test_nodes(spark, rows, rebuild):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("conv", "place", "mark", "size", "digest", "depth", "up", "paths")})
    want = ordered(rows)
    assert got(prefix_trie.prefix_trie(df, rebuild=rebuild)) == brute(rebuilt(want) if rebuild else want)


@pytest.mark.parametrize("block", [2, 3])
def test_deep_tries_go_by_blocks(spark, block):
    rng = random.Random(block)
    rows, line = [], [(rng.choice("ab"), rng.choice("ab")) for _ in range(40)]
    for c in range(25):
        keep = rng.randint(0, 40)
        turns = line[:keep] + [(rng.choice("ab"), rng.choice("xy")) for _ in range(rng.randint(0, 12))]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(prefix_trie.prefix_trie(df, block=block)) == brute(ordered(rows))


def test_no_rows(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA), rebuild=True).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)).count() == 0
