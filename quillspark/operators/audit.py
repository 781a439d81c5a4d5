"""Hashes, duplicate groups, components of sources and hashes, checksums and leakage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .split import shuffle_key


def with_hash(rows: DataFrame, content: str, name: str = "content_hash") -> DataFrame:
    return rows.withColumn(name, F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary")), 256))


def duplicate_groups(hashed: DataFrame, name: str = "content_hash", split: str | None = None) -> DataFrame:
    """hash, n, and with a split column whether the group lies in more than one split, for hashes of two rows or more."""
    crosses = [(F.count_distinct(split) > 1).alias("crosses")] if split else []
    return hashed.groupBy(name).agg(F.count(F.lit(1)).alias("n"), *crosses).where("n > 1")


def leakage(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys in more than one split, with the rows and splits of each."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(split).alias("splits")).where("splits > 1")


def components(rows: DataFrame, left: str, right: str) -> DataFrame:
    """left, component: left keys that share right keys, directly or through others; component is the least left key.

    Each round takes the least label over a right key and over a left key, and follows the label's own label, so paths
    halve. Rounds are tables in the shared folder, written once each, and read by the next one's joins as they are, so
    that a hot key's rows can be split.
    """
    edges = rows.select(F.col(left).alias("l"), F.col(right).alias("r")).where("l IS NOT NULL AND r IS NOT NULL").distinct()
    edges = written(edges, "component-edges")
    labels = written(edges.select("l", F.col("l").alias("c")).distinct(), "component-labels")
    while True:
        over = written(edges.join(labels, "l").groupBy("r").agg(F.min("c").alias("c")), "component-over")
        least = written(edges.join(over, "r").groupBy("l").agg(F.min("c").alias("c")), "component-least")
        jump = least.join(labels.select(F.col("l").alias("c"), F.col("c").alias("up")), "c", "left")
        new = written(jump.select("l", F.least("c", F.coalesce("up", "c")).alias("c")), "component-labels")
        moved = new.join(labels.withColumnRenamed("c", "old"), "l").where("c <> old").limit(1).count()
        labels = new
        if not moved:
            return labels.select(F.col("l").alias(left), F.col("c").alias("component"))


def component_split(labels: DataFrame, component: str = "component", seed: int = 42, train: float = 0.8, dev: float = 0.1) -> DataFrame:
    """labels with ``split``: whole components go to train, validation or test by a hash, in about these parts, without
    ordering them. Sources or hashes that are linked never meet across splits."""
    h = F.substring(shuffle_key(seed, component), 1, 4)
    edge = lambda share: F.lit(f"{round(share * 0x10000):04x}")
    return labels.withColumn("split", F.when(h < edge(train), "train").when(h < edge(train + dev), "validation").otherwise("test"))


#: Keys of a block of a checksum.
BLOCK_KEYS = 100_000


def checksum(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """SHA-256 of a list of keys, whatever their order, and their number.

    Keys are dealt into blocks by their own hash, each block's sorted keys are hashed, and the sorted hashes of the blocks
    again, so no list is longer than a block or than the number of blocks. Blocks follow from the largest list alone;
    a list of up to BLOCK_KEYS keys is one block, and its sum that of its sorted keys joined by newlines.
    """
    text = rows.select(*by, F.col(key).cast("string").alias("_key"))
    most = text.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    blocks = -(-most // BLOCK_KEYS) or 1
    sums = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), "\n").cast("binary"), 256)
    parts = text.groupBy(*by, F.pmod(F.xxhash64("_key"), F.lit(blocks)).alias("_block")).agg(sums("_key").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    whole = F.max("_sum") if blocks == 1 else sums("_sum")
    return parts.groupBy(*by).agg(whole.alias("checksum"), F.sum("_n").alias("n"))


#: Bytes of sorted keys in a row of a list that list_checksum() hashes.
PIECE_BYTES = 4_000_000


def list_checksum(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """SHA-256 of each list's sorted keys joined by newlines, however long it is, and the number of its rows.

    Null keys are counted, but not listed; a list without any other has a null sum. Keys are sorted over all tasks and
    joined into pieces of about PIECE_BYTES. One hash has to go through a list from beginning to end: the pieces are handed
    to it in their order, and neither a task nor a row holds more than a few of them.
    """
    kinds = rows.select(*by).schema.fields
    names = [f"_by_{i}" for i in range(len(by))]
    given = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, kinds, strict=True)) + ("," if by else "")
    text = rows.select(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), F.col(key).cast("string").alias("_key"))
    ordered = text.repartitionByRange(*names, "_key").sortWithinPartitions(*names, "_key")
    ordered = ordered.select(*names, F.spark_partition_id().alias("_part"), "_key")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, at, part, number, held, size, n = None, None, 0, 0, [], 0, 0

        def piece() -> pa.RecordBatch:
            text = "\n".join(held) if held else None
            return pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(at, schema, strict=True)), pa.array([part], pa.int32()), pa.array([number]), pa.array([text], pa.string()), pa.array([n])], [*names, "_part", "_number", "_text", "_n"])

        for batch in batches:
            schema = [batch.column(i).type for i in range(len(names))]
            for *own, part_, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n and (own != at or size > PIECE_BYTES):
                    yield piece()
                    number, held, size, n = number + 1, [], 0, 0
                at, part, n = own, part_, n + 1
                if value is not None:
                    held.append(value)
                    size += len(value) + 1
        if n:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, at, digest, n = None, None, None, 0

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(at, schema, strict=True)), pa.array([digest and digest.hexdigest()], pa.string()), pa.array([n])], [*names, "checksum", "n"])

        for batch in batches:
            schema = [batch.column(i).type for i in range(len(names))]
            for i in range(batch.num_rows):
                own = [batch.column(k)[i].as_py() for k in range(len(names))]
                if n and own != at:
                    yield whole()
                    digest, n = None, 0
                at, n = own, n + batch.column("_n")[i].as_py()
                text = batch.column("_text")[i].as_py()
                if text is not None:
                    if digest is None:
                        digest = hashlib.sha256()
                    else:
                        digest.update(b"\n")
                    digest.update(text.encode())
        if n:
            yield whole()

    pieces = ordered.mapInArrow(joined, f"{given} _part int, _number long, _text string, _n long")
    dealt = pieces.repartition(*names) if by else pieces.coalesce(1)
    sums = dealt.sortWithinPartitions(*names, "_part", "_number").mapInArrow(hashed, f"{given} checksum string, n long")
    return sums.select(*(F.col(n).alias(c) for n, c in zip(names, by, strict=True)), "checksum", "n")


def ngram_counts(rows: DataFrame, words: Column, n: int = 5) -> DataFrame:
    """n-grams of words and their counts, for a language model of order n."""
    w = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))
    return rows.select(F.explode(w).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))
