"""Near-duplicate documents by SetSketch registers.

Registers are exponentially spaced truncated minima (Ertl, "SetSketch", VLDB 2021): mergeable by maximum and locality-
sensitive. Bands of registers propose pairs, the joint likelihood of two sketches estimates their Jaccard similarity,
and whole shingle sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, materialise, passes, release
from .components import connected_components
from .vectext import whole_hash, window_hashes, words_of

WIDTH = 5  # words of a shingle
#: Bands of registers: 20 x 6 find a pair at 0.85 with probability 0.9999.
BANDS, ROWS = 20, 6
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate and largest value of the registers.
BASE, RATE, TOP = 1.02, 20.0, 3000
#: Members of a block; buckets that a pivot leaves in several components are compared block by block. Unpacked sets that
#: a task keeps meanwhile.
BLOCK, KEPT_SETS = 512, 20_000
#: Members outside of a bucket's largest component beyond which it is split by prefix elements before it is compared.
LARGE = 1 << 15
#: Standard deviations below the threshold at which the estimate alone drops a pair.
MARGIN = 4.0

_rng = np.random.default_rng(20210)
_XOR = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, REGISTERS).astype(np.uint64)
_MUL = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_for(percent: int) -> int:
    """Bands that find a pair at percent with probability 0.9999: BANDS at 85, 31 at 80."""
    return math.ceil(math.log(1e-4) / math.log(1 - (percent / 100) ** ROWS))


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Constants of n hash functions."""
    rng = np.random.default_rng(20211)
    more = rng.integers(0, 1 << 63, (2, max(0, n - REGISTERS)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.append(_XOR, more[0])[:n], np.append(_MUL, more[1])[:n]


def registers(shingles: np.ndarray, xor: np.ndarray = _XOR, mul: np.ndarray = _MUL) -> np.ndarray:
    """A value for each hash function of a set of 64-bit hashes; zeros for the empty set."""
    if not len(shingles):
        return np.zeros(len(xor), np.uint16)
    least = np.full(len(xor), np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(shingles), 1024):
        np.minimum(least, ((shingles[s : s + 1024, None] ^ xor) * mul).min(axis=0), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(uniform, 1 - 1e-12)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches (rows) with known set sizes, by maximum likelihood (golden section)."""
    plus, minus = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - plus - minus
    u = n_a / (n_a + n_b)
    v = 1 - u
    step = (BASE - 1) / BASE

    def log_likelihood(j):
        p = -np.log(np.clip(1 - np.clip(u - v * j, 0, 1) * step, 1e-12, 1)) / np.log(BASE)
        m = -np.log(np.clip(1 - np.clip(v - u * j, 0, 1) * step, 1e-12, 1)) / np.log(BASE)
        return plus * np.log(np.maximum(p, 1e-12)) + minus * np.log(np.maximum(m, 1e-12)) + same * np.log(np.maximum(1 - p - m, 1e-12))

    low, high, ratio = np.zeros(len(u)), np.minimum(u / v, v / u), (5**0.5 - 1) / 2
    for _ in range(30):
        x, y = high - ratio * (high - low), low + ratio * (high - low)
        left = log_likelihood(x) > log_likelihood(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes: WIDTH words, the whole sequence if shorter, none if empty."""
    words = words_of(texts, lower=True)
    h = words.hashes()[words.codes]
    runs = window_hashes(h, WIDTH)
    for s, e in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if e - s >= WIDTH:
            yield np.unique(runs[s : e - WIDTH + 1])
        else:
            yield np.array([whole_hash(h[s:e])] if e > s else [], np.uint64)


def sketches(docs: DataFrame, bands_of: int = BANDS) -> DataFrame:
    """row, id, n_shingles, set_key, registers, bands of (id, text). row: a number of each row of its own; set_key: 128
    bits of the set. Null text counts as empty, without shingles or bands; repeated rows and null ids stay; of other
    columns none is read. A text of any length is a pass of its own."""
    xor, mul = _family(bands_of * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = filled(batch, "text")
            for a, b in passes(texts):
                n, keys, regs, bands = [], [], [], []
                for s in shingle_sets(texts[a:b]):
                    r = registers(s, xor, mul)
                    n.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    regs.append(r.tobytes())
                    bands.append([xxhash.xxh3_64_intdigest(r[k : k + ROWS].tobytes(), k) - (1 << 63) for k in range(0, len(r), ROWS)] if len(s) else [])
                columns = [pa.array(np.arange(row, row + b - a)), batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "n_shingles", "set_key", "registers", "bands"])
                row += b - a

    return docs.select("id", "text").mapInArrow(run, "row long, id long, n_shingles long, set_key binary, registers binary, bands array<long>")


def _plausible(pairs: DataFrame, sketch: DataFrame, threshold: float, registers_of: int = REGISTERS) -> DataFrame:
    """Pairs (a, b) whose estimated similarity isn't far below the threshold."""
    least = threshold - MARGIN * (threshold * (1 - threshold) / registers_of) ** 0.5
    side = lambda x: sketch.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cols = dict(zip(batch.schema.names, batch.columns, strict=True))
                r_a, r_b = (np.frombuffer(b"".join(cols[x].to_pylist()), np.uint16).reshape(-1, registers_of) for x in ("r_a", "r_b"))
                keep = estimate(r_a, r_b, *(np.asarray(cols[x]).astype(float) for x in ("n_a", "n_b"))) >= least
                yield pa.RecordBatch.from_arrays([cols["a"], cols["b"]], ["a", "b"]).filter(pa.array(keep))

    joined = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    # sizes alone rule a pair out: the similarity is at most the smaller size over the larger
    joined = joined.where(f"least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)")
    return joined.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def stored(elements: bytes) -> np.ndarray:
    return np.frombuffer(elements, np.uint64)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, unpack: Callable[[bytes], np.ndarray] = stored) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (unpack(z.as_py()) for z in (x, y))
                common = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    side = lambda x: sets.select(F.col("id").alias(x), F.col("elements").alias(f"s_{x}"))
    joined = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").select("a", "b", "s_a", "s_b")
    return joined.mapInArrow(run, "a long, b long, linked boolean")


def _common(rows: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes of sorted distinct arrays; only elements of two rows or more are looked at."""
    values, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    rank = np.cumsum(times > 1) - 1
    column, owner = rank[column[shared]], owner[shared]
    out = np.zeros((len(rows), len(rows)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    columns = int(rank[-1]) + 1 if len(rank) else 0
    for c in range(0, columns, 4096):
        lo, hi = np.searchsorted(column, [c, c + 4096])
        part = np.zeros((len(rows), min(4096, columns - c)), np.float32)
        part[owner[lo:hi], column[lo:hi] - c] = 1
        out += part @ part.T
    return out


def _forest(ids: np.ndarray, comp: np.ndarray, n: np.ndarray, prints: list[np.ndarray], failed: list[list[int] | None], percent: int) -> list[tuple[int, int]]:
    """Pairs that join different components of the group, as few as needed, by an upper bound of their similarity.

    The bound is the intersection of 32-bit fingerprints plus what they lose inside a set, so no link is below it.
    """
    lost = n - np.array([len(x) for x in prints])
    if len(ids) <= 4:
        common = np.zeros((len(ids), len(ids)))
        for x in range(len(ids) - 1):
            for y in range(x + 1, len(ids)):
                if comp[x] != comp[y]:
                    common[x, y] = len(np.intersect1d(prints[x], prints[y], assume_unique=True))
    else:
        common = _common(prints)
    most = common + np.minimum(lost[:, None], lost[None])
    fits = np.triu(100 * most >= percent * (n[:, None] + n[None] - most), 1) & (comp[:, None] != comp[None])
    if any(failed):
        place = {x: k for k, x in enumerate(ids.tolist())}
        for k, others in enumerate(failed):
            for x in others or ():
                if x in place:
                    fits[min(k, place[x]), max(k, place[x])] = False
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = parent[x]
        return x

    found = []
    for x, y in zip(*(z.tolist() for z in np.nonzero(fits)), strict=True):
        if (p := root(comp[x])) != (q := root(comp[y])):
            parent[p] = q
            found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
    return found


def _tallies(rows: DataFrame) -> DataFrame:
    """band, key, most (members of the largest component and its id, of equals the larger), others (members outside)."""
    sizes = rows.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.groupBy("band", "key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all"))
    return found.select("band", "key", "most", (F.col("all") - F.col("most.n")).alias("others"))


def _refined(rows: DataFrame, sets: DataFrame, percent: int, unpack: Callable[[bytes], np.ndarray], name: str) -> DataFrame:
    """Buckets (band, key, size, id, component) in which no more than LARGE members lie outside of the largest component, or
    that have an element in common which is among each member's rarest.

    Buckets with more are replaced: their members are dealt anew by the elements of their prefixes. Of the elements in the
    order of how few of these sets have them, a set of n has its first n - ceil(percent * n / 100) + 1 as its prefix. Sets
    that are linked have an element of their prefixes in common, so no link is lost. Elements of one set alone come first
    and need no rows.
    """
    many = materialise(_tallies(rows).where(F.col("others") > LARGE).select("band", "key"), f"{name}-many")
    if many.isEmpty():
        release(many)
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [unpack(x.as_py()) for x in part.column(1)]
                n = np.array([len(x) for x in found])
                columns = (np.repeat(np.asarray(part.column(0)), n), np.repeat(n, n), np.concatenate(found).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "n", "element"])

    ids = materialise(rows.join(many.hint("merge"), ["band", "key"], "left_semi").select("id", "component").distinct(), f"{name}-many-ids")
    elements = materialise(sets.join(ids.select("id").hint("merge"), "id").select("id", "elements").mapInArrow(run, "id long, n long, element long"), f"{name}-elements")
    times = materialise(elements.groupBy("element").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), f"{name}-times")
    shared = elements.join(times.hint("merge"), "element").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("times", "element"))).alias("x"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("x"))  # those of one set are spent
    dealt = shared.select("id", F.explode(F.slice("x", 1, F.greatest(prefix, F.lit(0)).cast("int"))).alias("x")).select("id", F.col("x.element").alias("key"))
    dealt = materialise(dealt.join(ids.hint("merge"), "id"), f"{name}-dealt")
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", "size")
    sizes = materialise(sizes, f"{name}-dealt-sizes")
    new = dealt.join(sizes.hint("merge"), "key").select(F.lit(-1).alias("band"), "key", "size", "id", "component")
    out = materialise(rows.join(many.hint("merge"), ["band", "key"], "left_anti").select(*new.columns).unionByName(new), f"{name}-refined")
    release(many, ids, elements, times, dealt, sizes)
    return out


def _block_pairs(rows: DataFrame, prints: DataFrame, failed: DataFrame | None, percent: int, unpack: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """band, key, a, b: untested pairs that may join components of a bucket, from comparing its members block by block.

    Pairs inside of a component needn't be compared, so members of the largest one meet only the blocks of the others: of n
    members with s outside of it, n * s / BLOCK rows or so, not n * n / BLOCK. In each pair of blocks the candidates form a
    forest over the components, so their number is linear; if one fails, the bucket is compared again without it, and
    another takes its place. Blocks lie sorted in their partition and are read one after the other, so that small ones cost
    little. failed: candidates (a, b) that weren't links; the bound that proposes them misses only by equal fingerprints, so
    a set has few.
    """
    rows = rows.join(_tallies(rows).withColumnsRenamed({"band": "band_", "key": "key_"}), (F.col("band") == F.col("band_")) & (F.col("key") == F.col("key_")))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    large = F.col("others") + F.col("most.n") > BLOCK
    rows = rows.withColumns({"major": blocks(F.col("most.n")), "minor": F.when(large, blocks(F.col("others"))).otherwise(1), "h": F.xxhash64("id")})
    within = lambda n: F.pmod(F.col("h"), F.col(n)).cast("int")
    to = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    of_major = F.transform(upto("minor"), lambda i: to(i, -1 - within("major")))
    of_minor = F.concat(F.transform(upto("major"), lambda j: to(within("minor"), -1 - j)), F.transform(upto("minor"), lambda j: to(F.least(j, within("minor")), F.greatest(j, within("minor")))))
    places = F.when(~large, F.array(to(F.lit(0), F.lit(0)))).when(F.col("component") == F.col("most.component"), of_major).otherwise(of_minor)
    rows = rows.select("band", "key", "id", "component", F.explode(places).alias("x")).select("band", "key", "x.i", "x.j", "id", "component")
    rows = rows.join(prints.hint("merge"), "id")
    if failed is None:
        rows = rows.withColumn("failed", F.lit(None).cast("array<bigint>"))
    else:
        rows = rows.join(failed.select(F.col("a").alias("id"), F.col("b").alias("not")).groupBy("id").agg(F.collect_set("not").alias("failed")), "id", "left")
    if unpack:
        rows = rows.withColumn("n_shingles", F.lit(0).cast("long"))
    key = ["band", "key", "i", "j"]
    rows = rows.select(*key, "id", "component", "n_shingles", "prints", "failed").repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[int, np.ndarray]] = {}

        def set_of(x: int, n: int, stored_prints: pa.Scalar) -> tuple[int, np.ndarray]:
            if not unpack:
                return n, np.frombuffer(stored_prints.as_py(), np.uint32)
            if (found := known.get(x)) is None:  # the same set comes back in other bands
                if len(known) > KEPT_SETS:
                    known.clear()
                elements = unpack(stored_prints.as_py())
                found = known[x] = len(elements), _short(elements)
            return found

        def compared(batch: pa.RecordBatch, ends: np.ndarray) -> pa.RecordBatch:
            out, start = [], 0
            ids, comp, n = (np.asarray(batch.column(k)) for k in (4, 5, 6))
            band, value, failed = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(8)
            for end in ends:
                if (comp[start:end] != comp[start]).any():
                    sets = [set_of(int(ids[k]), int(n[k]), batch.column(7)[k]) for k in range(start, end)]
                    links = _forest(ids[start:end], comp[start:end], np.array([x[0] for x in sets]), [x[1] for x in sets], failed[start:end].to_pylist(), percent)
                    out += [(band[start], value[start], x, y) for x, y in links]
                start = end
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["band", "key", "a", "b"])

        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            marks = [np.asarray(batch.column(k)) for k in range(4)]
            ends = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            if len(ends):
                yield compared(batch, ends)
                held = batch.slice(ends[-1])
            else:
                held = batch
        if held is not None and held.num_rows:
            yield compared(held, np.array([held.num_rows]))

    return rows.mapInArrow(run, "band int, key long, a long, b long")


def bucket_components(buckets: DataFrame, sets: DataFrame, percent: int, plausible: Callable[[DataFrame], DataFrame], name: str, unpack: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """id, component (its least id) of all ids in buckets, by links between sets whose similarity is percent or more.

    buckets: band, key, id, size (of the bucket); sets: id, elements (sorted distinct 64-bit hashes, as bytes, or
    something smaller that ``unpack`` turns into them where it is needed). First
    all members of a bucket are compared with its least one, as far as ``plausible`` lets the pairs through. Buckets
    that then span several components are compared in full, block by block, those with more than LARGE members outside of
    their largest component by the elements of prefixes; only pairs that may join two components go on, as a forest, so
    that no bucket is expanded into all pairs: buckets in which a candidate failed are compared again, until none is
    untested. Links are confirmed on whole sets, and none between members of a bucket is lost, whatever its size.
    """
    wanted = buckets.select("id").distinct()
    prints = sets.withColumnRenamed("elements", "prints") if unpack else sets.mapInArrow(_prints, "id long, n_shingles long, prints binary")
    links, failed, component, turn = None, None, wanted.withColumn("component", F.col("id")), 0
    while True:
        if turn < 2:
            now_in = buckets
        placed = (now_in if turn < 2 else now_in.join(again, ["band", "key"], "left_semi")).join(component, "id")
        mixed = placed.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("pivot")).where("low <> high")
        rows = placed.join(materialise(mixed, f"{name}-mixed").hint("merge"), ["band", "key"])
        if turn == 0:
            pairs = plausible(rows.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
        else:
            rows = rows.select("band", "key", "size", "id", "component")
            if turn == 1:
                rows = _refined(materialise(rows, f"{name}-unrefined"), sets, percent, unpack or stored, name)
                now_in = rows.drop("component")
            of_buckets = materialise(_block_pairs(rows, prints, failed, percent, unpack), f"{name}-candidates")
            pairs = of_buckets.select("a", "b").distinct()
        now = materialise(_confirmed(pairs, sets, percent, unpack or stored), f"{name}-pairs")
        if turn and now.isEmpty():
            return component
        if turn:  # a bucket all of whose candidates are links is done
            again = of_buckets.join(now.where("NOT linked"), ["a", "b"]).select("band", "key").distinct()
            missed = now.where("NOT linked")
            failed = missed if failed is None else failed.unionByName(missed)
        links = now.where("linked") if links is None else links.unionByName(now.where("linked"))
        if turn == 0 or not now.where("linked").isEmpty():
            found = connected_components(links.select("a", "b"), f"{name}-components")
            old, component = component, materialise(wanted.join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component")), f"{name}-labels")
            release(old)
        turn += 1


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Rows with equal shingle sets are one node; nodes that share a bucket are linked by bucket_components(), and those
    that share an id are linked too; component_id is the smallest id reachable.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; whole texts are read, of any length. Null and empty texts
    have no shingles and are linked with nothing but rows of the same id; rows with a null id stand alone with a null
    component and are kept. Rows repeated with one id are one document, whatever their texts: each is returned, with its
    own n_shingles and the component of all. Extra columns, whatever their names, are left out; an empty table gives an
    empty result.
    """
    threshold = percent / 100
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n_bands = bands_for(percent)
    sketch = materialise(sketches(texts, n_bands), "near-sketches")
    known = sketch.where("n_shingles > 0 AND id IS NOT NULL")
    nodes = materialise(known.groupBy("set_key").agg(F.min("row").alias("node")), "near-nodes")
    # tables are written before joins by a key that may be hot: then both sides are dealt anew, and a hot part is split
    own_key = F.when(F.expr("n_shingles > 0 AND id IS NOT NULL"), F.col("set_key"))
    placed = materialise(sketch.select("id", "n_shingles", own_key.alias("set_key")).join(nodes.hint("merge"), "set_key", "left").select("id", "n_shingles", "node"), "near-placed")
    heads = known.join(nodes.select(F.col("node").alias("row")).hint("merge"), "row", "left_semi").drop("id").withColumnRenamed("row", "id")
    banded = heads.select("id", F.posexplode("bands").alias("band", "key"))
    shared = materialise(banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-shared")
    buckets = materialise(banded.join(shared.hint("merge"), ["band", "key"]), "near-buckets")

    wanted = materialise(heads.join(buckets.select("id").distinct().hint("merge"), "id", "left_semi").select("id", "n_shingles", "set_key", "registers"), "near-registers")
    # the texts of these sets, found by document, since a text has no row number of its own
    where = known.join(wanted.select(F.col("id").alias("row")).hint("merge"), "row", "left_semi").select("id").distinct()
    found = texts.join(where.hint("merge"), "id", "left_semi").mapInArrow(_elements, "set_key binary, elements binary")
    sets = materialise(found.join(wanted.select("id", "set_key").hint("merge"), "set_key").select("id", "elements").dropDuplicates(["id"]), "near-sets")
    sketch_of = wanted.select("id", "n_shingles", "registers")
    component = bucket_components(buckets, sets, percent, lambda pairs: _plausible(pairs, sketch_of, threshold, n_bands * ROWS), "near")

    component = component.withColumnRenamed("id", "node")
    several = placed.where("node IS NOT NULL").groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("id", "low")
    several = materialise(several, "near-several")
    if not several.isEmpty():
        links = placed.join(several.hint("merge"), "id").select("low", "node").distinct().unionByName(component.select(F.col("component").alias("low"), "node"))
        component = connected_components(links.select("low", "node"), "near-repeated")
    labelled = placed.join(component.hint("merge"), "node", "left").select("id", "n_shingles", F.coalesce("component", "node").alias("component"))
    labelled = materialise(labelled, "near-labelled")
    least = materialise(labelled.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("least")), "near-least")
    out = labelled.join(least.hint("merge"), "component", "left").select("id", "n_shingles", F.coalesce("least", "id").alias("least"))
    if not several.isEmpty():  # a text without words goes with the others of its id
        of_id = out.join(several.select("id").hint("merge"), "id", "left_semi").groupBy("id").agg(F.min("least").alias("of_id"))
        out = out.join(materialise(of_id, "near-of-id").hint("merge"), "id", "left").select("id", "n_shingles", F.coalesce("of_id", "least").alias("least"))
    release(sketch, nodes, shared, buckets, wanted, sets)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"), F.col("id").eqNullSafe(F.col("least")).alias("kept"))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = filled(batch, "text")
        for a, b in passes(texts):
            sets = [s.tobytes() for s in shingle_sets(texts[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["set_key", "elements"])


def _short(elements: np.ndarray) -> np.ndarray:
    """Sorted distinct 32-bit fingerprints of a set."""
    return np.unique((elements >> np.uint64(32)).astype(np.uint32))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(1)]
        prints = [_short(s).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary())], ["id", "n_shingles", "prints"])


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """docs without those that near_duplicates() doesn't keep.

    Of each component the smallest id stays, with all rows repeated under it, whatever their texts; rows with a null id,
    and texts that are null, empty or without words, stay. Long texts are compared whole. All columns stay, whatever their
    names; an empty table gives an empty result."""
    dropped = near_duplicates(docs, id_col, text_col, percent).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(dropped.hint("merge"), F.col(id_col) == F.col("dropped_id"), "left_anti")
