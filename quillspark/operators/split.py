"""Splits without leakage, samples, shards and generated rows. All randomness is a hash of a seed and a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(seed: int, *key: str | Column) -> Column:
    """A pseudo-random but fixed order of keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key)).cast("binary"))


#: Hexadecimal digits of a shuffle key by which spread_rank() cuts a group into blocks.
RANK_DIGITS = 3
#: Steps of a remainder by which apportioned() cuts the strata into blocks; a step of equal remainders is cut further.
REST_STEPS = 4096


def block_rank(rows: DataFrame, by: list[str], name: str, block: Column, order: list[Column]) -> DataFrame:
    """rows with ``name``: their place from 1 within the groups ``by``, by ``block`` and then ``order``.

    Places are counted within a block and added to the sizes of the blocks before it, so that no group, however large, is
    ordered in one task. A smaller block must never hold a row that ``order`` puts after one of a larger block.
    """
    marked = rows.withColumn("_block", block)
    sizes = marked.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*(F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    inside = marked.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_block").orderBy(*order)))
    same = [F.col("_block") == F.col("_b"), *(F.col(c).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(by))]
    out = inside.join(before, reduce(lambda a, b: a & b, same)).withColumn(name, F.col("_before") + F.col("_place"))
    return out.drop("_block", "_b", "_before", "_place", *(f"_by_{i}" for i in range(len(by))))


def spread_rank(rows: DataFrame, by: list[str], name: str, seed: int, *key: str) -> DataFrame:
    """rows with ``name``: their place from 1 within the groups ``by`` in the order of shuffle_key(seed, *key), then key."""
    hashed = rows.withColumn("_h", shuffle_key(seed, *key))
    return block_rank(hashed, by, name, F.substring("_h", 1, RANK_DIGITS), [F.col("_h"), *(F.col(k) for k in key)]).drop("_h")


def majority(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """group, value: the most frequent value of each group, of equals the one seen first in ``order``."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(group).agg(F.min_by(value, F.struct(-F.col("n"), F.col("first"))).alias(value))


def apportioned(strata: DataFrame, stratum: str, size: str, total: int, seats: int, name: str, seed: int = 42) -> DataFrame:
    """strata with ``name``: ``seats`` places dealt in proportion to ``size`` (``total`` in all) by largest remainders.

    Each stratum has the whole part of its share; places left go to the largest remainders, of equals to the first by hash.
    So the places add up exactly, and no stratum gets more than its share rounded up. Whole numbers only; the one figure
    that reaches the driver is the sum of the whole parts.
    """
    if not total or not seats:
        return strata.withColumn(name, F.lit(0).cast("long"))
    share = strata.withColumns({"_whole": F.expr(f"{size} * {seats}L div {total}L"), "_rest": F.col(size) * seats % total, "_tie": shuffle_key(seed, stratum)})
    left = seats - share.agg(F.sum("_whole")).first()[0]
    share = share.withColumn("_step", F.lit(REST_STEPS) - F.expr(f"_rest * {REST_STEPS} div {total}L"))
    even = share.groupBy("_step").agg((F.min("_rest") == F.max("_rest")).alias("_even"))  # a row a step
    block = F.format_string("%04d%s", "_step", F.when(F.col("_even"), F.substring("_tie", 1, RANK_DIGITS)).otherwise(""))
    ranked = block_rank(share.join(F.broadcast(even), "_step").withColumn("_all", F.lit(0)), ["_all"], "_rank", block, [F.desc("_rest"), F.col("_tie"), F.col(stratum)])
    return ranked.withColumn(name, F.col("_whole") + F.when(F.col("_rank") <= left, 1).otherwise(0)).drop("_whole", "_rest", "_tie", "_all", "_rank", "_step", "_even")


def _part(n: int, part: float, of: float = 1.0) -> int:
    """ceil(n * part / of) for parts given to a millionth."""
    return -(-n * round(part * 1_000_000) // round(of * 1_000_000))


def group_split(rows: DataFrame, group: str, stratum: str, order: str, seed: int = 42, train: float = 0.8, dev: float = 0.1) -> DataFrame:
    """group, stratum, split: whole groups go to train, validation or test, with exact totals over all strata.

    Of n groups ceil(n * (1 - train)) are held out, and of these the test part, rounded up, is tested on; a single one is
    for validation. Held-out places are apportioned to strata by largest remainders, and then the test's among them, so
    that strata too small for a place of their own take turns. With fewer than ten groups or a single stratum, groups are
    split without strata; with fewer than three groups all are train. A group's stratum is its most frequent one. Only
    groups and strata are ordered, not rows, and neither in one task.
    """
    groups = majority(rows, group, stratum, order)
    size = groups.agg(F.count(F.lit(1)).alias("g"), F.count_distinct(stratum).alias("s")).first()
    if size.g < 3:
        return groups.withColumn("split", F.lit("train"))
    held = _part(size.g, 1 - train)
    tested = _part(held, 1 - train - dev, 1 - train) if held > 1 else 0
    whole = F.lit(0) if size.g < 10 or size.s < 2 else F.col(stratum)
    groups = groups.withColumn("_stratum", whole)
    strata = groups.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_size"))
    strata = apportioned(strata, "_stratum", "_size", size.g, held, "_held", seed)
    strata = apportioned(strata, "_stratum", "_held", held, tested, "_tested", seed).withColumnRenamed("_stratum", "_own")
    ranked = spread_rank(groups, ["_stratum"], "_rank", seed, group)
    split = F.when(F.col("_rank") <= F.col("_tested"), "test").when(F.col("_rank") <= F.col("_held"), "validation").otherwise("train")
    return ranked.join(strata, F.col("_stratum").eqNullSafe(F.col("_own"))).withColumn("split", split).drop("_stratum", "_own", "_rank", "_size", "_held", "_tested")


def pinned(path: Column, split_pin: Column, augmented: Column) -> Column:
    """Rows that may only be trained on: pinned, flagged as augmented, or known by their path."""
    return F.coalesce(split_pin == "train", F.lit(False)) | F.coalesce(augmented, F.lit(False)) | F.coalesce(F.lower(path).rlike("augment|synthetic"), F.lit(False))


def leakage_guard(pinned_rows: DataFrame, splits: DataFrame, group: str) -> DataFrame:
    """Pinned rows whose group is in neither validation nor test."""
    held = splits.where("split <> 'train'").select(group).distinct()
    return pinned_rows.join(held, group, "left_anti")


def split_statistics(rows: DataFrame, split: str = "split") -> DataFrame:
    """Clips, hours, code-switched clips, sources by split, and their total as split 'total'."""
    sums = rows.rollup(split).agg(
        F.count(F.lit(1)).alias("clips"), F.round(F.sum("duration_sec") / 3600, 4).alias("hours"), F.count_if(F.coalesce("is_code_switched", F.lit(False))).alias("cs_clips"), F.count_distinct("source_id").alias("sources"),
    )
    return sums.withColumn(split, F.coalesce(split, F.lit("total")))


def simple_sample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return rows.orderBy(shuffle_key(seed, key), key).limit(n)


def stratified_sample(rows: DataFrame, n: int, stratum: str, flag: str, key: str, seed: int = 42) -> DataFrame:
    """n rows: from each stratum its equal part, half of it flagged if there are so many; then others up to n."""
    strata = rows.groupBy(stratum).agg(F.count_if(F.col(flag)).alias("_flagged"))
    per = n // max(1, strata.count())
    flagged = F.least(F.lit(per // 2), F.col("_flagged"))
    quota = F.when(F.col(flag), F.lit(per // 2)).otherwise(per - flagged)
    ranked = spread_rank(rows, [stratum, flag], "_rank", seed, key)
    ranked = ranked.join(strata.withColumnRenamed(stratum, "_stratum"), F.col(stratum).eqNullSafe(F.col("_stratum"))).withColumn("_first", F.col("_rank") <= quota)
    order = [F.desc("_first"), shuffle_key(seed + 1, key), F.col(key)]
    return ranked.orderBy(*order).limit(n).drop("_stratum", "_flagged", "_first", "_rank")


#: Parts of a group whose first rows are found before the group's rows meet.
GROUP_PARTS = 64


def k_per_group(rows: DataFrame, k: int, group: str, flag: str, key: str, used: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """k rows of each group that aren't used yet: one flagged if there is one, the others unflagged first.

    A group's parts are ranked each by itself, and of each its first k, so that no group is ordered whole in one task.
    """
    left = rows if used is None else rows.join(used.select(key).distinct(), key, "left_anti")
    left = left.withColumn("_h", shuffle_key(seed, key))
    first = left.where(F.col(flag)).groupBy(F.col(group).alias("_group")).agg(F.min(F.struct("_h", key)).alias("_first"))
    left = left.join(first, F.col(group).eqNullSafe(F.col("_group")), "left")
    chosen = F.col(flag) & (F.struct("_h", key) == F.col("_first"))
    left = left.withColumn("_wish", F.when(chosen, 0).when(~F.col(flag), 1).otherwise(2)).withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(GROUP_PARTS)))
    order = ["_wish", "_h", key]
    ranked = left.withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))).where(F.col("_rank") <= k)
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rank") <= k)
    return ranked.drop("_h", "_group", "_first", "_wish", "_part", "_rank")


def shards(rows: DataFrame, group: str, n: int) -> DataFrame:
    """group, rows, shard: whole groups, largest first, each to the shard that has least so far.

    Sequential by nature, over one row for each group: a fold over their sorted list, then one row per group again.
    """
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    listed = counts.agg(F.sort_array(F.collect_list(F.struct((-F.col("rows")).alias("minus"), F.col(group).alias("name")))).alias("groups"))
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), n).alias("load"), F.array().cast(f"array<struct<name:{dict(rows.dtypes)[group]},rows:bigint,shard:int>>").alias("out"))

    def place(state: Column, g: Column) -> Column:
        load = state["load"]
        at = F.array_position(load, F.array_min(load)).cast("int")
        new = F.transform(load, lambda x, i: F.when(i == at - 1, x - g["minus"]).otherwise(x))
        return F.struct(new.alias("load"), F.concat(state["out"], F.array(F.struct(g["name"].alias("name"), (-g["minus"]).alias("rows"), (at - 1).alias("shard")))).alias("out"))

    return listed.select(F.explode(F.aggregate("groups", start, place, lambda s: s["out"])).alias("x")).select(F.col("x.name").alias(group), "x.rows", "x.shard")


def equal_parts(rows: DataFrame, longest: float = 15.0, shortest: float = 5.0) -> DataFrame:
    """Segments of ``shortest`` seconds or more; longer ones than ``longest`` in equal parts. start_ms, end_ms, part."""
    length = F.col("end_ms") - F.col("start_ms")
    parts = F.ceil(length / (longest * 1000)).cast("int")
    cut = rows.where(length >= shortest * 1000).withColumn("parts", F.greatest(parts, F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    at = lambda k: (F.col("start_ms") + F.floor(k * length / F.col("parts"))).cast("long")
    return cut.withColumns({"start_ms": at(F.col("part")), "end_ms": at(F.col("part") + 1)}).drop("parts")


def speech_segments(frames: DataFrame, group: str, frame: str, speech: str, padding: int = 10) -> DataFrame:
    """group, first, last: runs of speech frames. A run begins ``padding`` frames early and is closed by so many silent
    ones, ``padding`` frames after the first of these; neither end lies outside of the group's frames. Frames that aren't
    there are silent; streaming/segments.py does the same on a stream."""
    ends = frames.groupBy(group).agg(F.max(frame).alias("_end"))
    voiced = frames.where(F.col(speech))
    w = Window.partitionBy(group).orderBy(frame)
    opens = F.coalesce(F.col(frame) - F.lag(frame).over(w) > padding, F.lit(True)).cast("int")
    runs = voiced.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(w))
    found = runs.groupBy(group, "_run").agg(F.greatest(F.min(frame) - padding, F.lit(0)).alias("first"), (F.max(frame) + padding + 1).alias("last"))
    found = found.join(ends.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")))
    return found.select(group, "first", F.least("last", "_end").alias("last"))


def augmentation_candidates(clips: DataFrame, everything: bool = False, rare_below: int = 0) -> DataFrame:
    """Original clips that are code-switched or of a dialect with fewer than ``rare_below`` originals."""
    own = clips.where(~F.coalesce(F.col("augmented"), F.lit(False)))
    n = own.groupBy("dialect").agg(F.count(F.lit(1)).alias("_n"))
    return own.join(n, "dialect").where(F.lit(everything) | F.col("is_code_switched") | (F.col("_n") < rare_below)).drop("_n")


# Kinds of augmentation and their parameters.
AUGMENTATIONS = (("speed", 0.9), ("speed", 1.1), ("noise", 20.0), ("pitch", 2.0), ("pitch", -2.0))


def augmented_rows(clips: DataFrame, k: int, seed: int = 42, low: float = 1.0, high: float = 20.0) -> DataFrame:
    """k derived rows for each clip, by the hash order of the kinds; pinned to train, of 1 to 20 seconds."""
    kinds = F.array(*(F.struct(F.lit(a).alias("aug_type"), F.lit(p).alias("aug_param")) for a, p in AUGMENTATIONS))
    rows = clips.withColumn("_kind", F.explode(kinds)).withColumns({"aug_type": F.col("_kind.aug_type"), "aug_param": F.col("_kind.aug_param")}).drop("_kind")
    order = shuffle_key(seed, "clip_id", "aug_type", "aug_param")
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("clip_id").orderBy(order))).where(F.col("_rank") <= k).drop("_rank")
    length = F.when(F.col("aug_type") == "speed", F.col("duration_sec") / F.col("aug_param")).otherwise(F.col("duration_sec"))
    named = F.concat_ws("_", "clip_id", "aug_type", F.replace(F.col("aug_param").cast("string"), F.lit("."), F.lit("p")))
    from .ingest import source_id

    rows = rows.withColumn("source_id", source_id(F.col("source_id"), F.col("clip_id")))
    return rows.withColumns({"duration_sec": F.round(length, 3), "clip_id": named, "augmented": F.lit(True), "split_pin": F.lit("train")}).where(F.col("duration_sec").between(low, high))


def query_catalogue(profiles: DataFrame, domains: DataFrame, templates: DataFrame) -> DataFrame:
    """bucket, dialect, domain, queries: each profile crossed with each domain's templates, placeholders filled.

    profiles: dialect, place; domains: domain; templates: domain, position, template. All are short lists of parameters.
    """
    filled = templates.join(domains, "domain").crossJoin(profiles).withColumn("query", F.replace(F.replace("template", F.lit("{place}"), F.col("place")), F.lit("{dialect}"), F.col("dialect")))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("position", "query"))), lambda x: x["query"])
    return filled.groupBy("dialect", "domain").agg(listed.alias("queries")).withColumn("bucket", F.concat_ws("__", "dialect", "domain"))


def fill_templates(count: int, templates: DataFrame, banks: DataFrame, seed: int = 42) -> DataFrame:
    """attempt, text: up to ``count`` different texts from up to ten times as many attempts.

    templates: array column ``templates`` in one row; banks: one row with a map ``banks`` of placeholder to words. Each
    placeholder of a template gets one word, at all its places.
    """
    tries = templates.sparkSession.range(10 * count).withColumnRenamed("id", "attempt")
    pick = lambda n, salt: (F.pmod(F.conv(F.substring(shuffle_key(seed, "attempt", F.lit(salt)), 1, 8), 16, 10).cast("long"), n) + 1).cast("int")
    names = sorted(banks.first()["banks"])
    rows = tries.crossJoin(F.broadcast(templates)).crossJoin(F.broadcast(banks))  # one row each
    text = F.element_at("templates", pick(F.size("templates"), "template"))
    for name in names:
        words = F.element_at("banks", F.lit(name))
        text = F.replace(text, F.lit("{" + name + "}"), F.element_at(words, pick(F.size(words), name)))
    made = rows.select("attempt", text.alias("text")).groupBy("text").agg(F.min("attempt").alias("attempt"))
    return made.orderBy("attempt").limit(count).select("attempt", "text")


def groups_of(rows: DataFrame, group: str) -> list:
    """The different groups, such as dialects or sources of a study, in order; they are few."""
    return [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]


def leave_one_out(rows: DataFrame, group: str, held_out) -> DataFrame:
    """rows with ``role``: 'test' in the held-out group, 'train' in the others. One pass, nothing is copied; the caller
    goes through groups_of()."""
    return rows.withColumn("role", F.when(F.col(group).eqNullSafe(F.lit(held_out)), "test").otherwise("train"))
