"""Exact deduplication by content sort, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, text_or_empty

#: Sampled keys for each bucket, and buckets for each shuffle partition.
SAMPLES_A_BUCKET, BUCKETS_A_PARTITION = 24, 4
#: Characters of the text that lead the sort key.
HEAD_CHARS = 24


def _bucket(key: Column, splitters: list[str]) -> Column:
    """Number of splitters at or below the key, by a coarse and then a fine part of the sorted list."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    fine = F.split(F.lit(",".join(splitters)), ",")
    coarse = F.split(F.lit(",".join(splitters[step - 1 :: step])), ",")
    skipped = F.size(F.filter(coarse, lambda s: s <= key)) * step
    return skipped + F.size(F.filter(F.slice(fine, skipped + 1, F.lit(step)), lambda s: s <= key))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise=None, buckets: int | None = None
) -> DataFrame:
    """Group identical texts and mark the row of each group that stays.

    Rows are dealt to buckets by sampled splitters over (head of the normalised bytes, digest, id) and sorted in each
    bucket by head, digest, whole text and id, so equal texts are adjacent; each row is compared in full with the one
    before. As ids take part in the splitters, a group of any size is spread over several buckets. The runs at the two
    ends of each bucket (two rows a bucket) are joined by digest and length, and no group is ever gathered in a task.

    keep: "min" or "max" id. normalise: a Column function applied to the text first (default: no change).
    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input row, extra columns left out.

    Null text counts as empty; all empty texts are one group. Null ids sort lowest. Of rows repeated with the same id
    and text exactly one has kept = true. An empty table gives an empty result.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    spark = docs.sparkSession
    body = text_or_empty(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("id"), (normalise(body) if normalise else body).alias("body"))
    keyed = base.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256))
    head = F.hex(F.substring("body", 1, HEAD_CHARS).cast("binary"))
    key = F.concat(head, F.lit("."), F.col("digest"), F.lpad(F.hex(F.coalesce(F.col("id"), F.lit(0))), 16, "0"))

    n = docs.count()
    wanted = buckets or BUCKETS_A_PARTITION * shuffle_partitions(spark)
    fraction = min(1.0, SAMPLES_A_BUCKET * wanted / max(n, 1))
    sample = keyed.sample(fraction, seed=7) if fraction < 1 else keyed
    found = sorted(r.key for r in sample.select(key.alias("key")).collect())
    splitters = sorted({found[len(found) * k // wanted] for k in range(1, wanted)}) if len(found) > 1 else []

    dealt = keyed.withColumn("bucket", _bucket(key, splitters)).withColumn("head", head)
    order = Window.partitionBy("bucket").orderBy("head", "digest", "body", "id")
    marked = dealt.select(
        "bucket", "id", "digest", F.length("body").alias("size"), F.row_number().over(order).alias("place"),
        (~F.lag("body").over(order).eqNullSafe(F.col("body"))).cast("long").alias("opens"),
    )
    runs = marked.withColumn("run", F.sum("opens").over(Window.partitionBy("bucket").orderBy("place")))
    one = Window.partitionBy("bucket", "run")
    best = F.max if keep == "max" else F.min
    pick = F.struct(F.col("id").alias("id"), F.col("bucket").alias("bucket"), F.col("place").alias("place"))
    runs = runs.select(
        "bucket", "id", "digest", "size", "place", "run", F.count(F.lit(1)).over(one).alias("n"), best(pick).over(one).alias("pick"),
        F.max("run").over(Window.partitionBy("bucket")).alias("last"),
    )
    runs = materialise(runs.withColumn("edge", (F.col("run") == 1) | (F.col("run") == F.col("last"))), "content-runs")

    ends = runs.filter("edge").groupBy("bucket", "run").agg(F.first("digest").alias("digest"), F.first("size").alias("size"), F.first("n").alias("n"), F.first("pick").alias("pick"))
    spans = ends.groupBy("digest", "size").agg(F.sum("n").alias("all_n"), best("pick").alias("all_pick"), F.lit(True).alias("edge"))
    # Two rows a bucket at most, and the number of buckets is set above: a proven bound.
    out = runs.join(F.broadcast(spans), ["digest", "size", "edge"], "left")
    chosen = F.coalesce("all_pick", "pick")
    return out.select(
        F.col("id").alias("doc_id"), chosen["id"].alias("keep_id"), F.coalesce("all_n", "n").alias("group_size"),
        pick.eqNullSafe(chosen).alias("kept"), F.col("digest").alias("text_sha256"),
    )
