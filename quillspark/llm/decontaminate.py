"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

A window is a run of an item's words and a set of shingles, each at its own place. Shingles are ordered by how rare they
are in the documents. A text that contains a window must contain one of its rarest shingles (the prefix), and where that
lies says where the window would begin; only there the words are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, text_or_empty

#: Words of a window, and of a shingle.
WINDOW, WIDTH = 10, 3
#: Words once A-Z are lower-case: ASCII digits and letters, and all beyond ASCII. (A class of what is left out takes four
#: times as long.)
WORD = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
#: Windows that share a prefix shingle and travel in one row, at most.
TOGETHER = 64
#: Distinct windows whose prefix may be broadcast, about 300 bytes each; beyond it all joins are shuffled.
BROADCAST_WINDOWS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; lower() does that where all characters are ASCII, and is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def _shingle(word: Column, words: Column, at: Column, width: int) -> Column:
    """Hash of the words at ``at`` and after it; words beyond the end don't take part, so a match is no proof."""
    return F.xxhash64(word, *(F.get(words, at + k) for k in range(1, width)), F.lit(width))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, width: int) -> tuple[DataFrame, DataFrame]:
    """wid, words of the different windows, and wid, item of their items."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(text_or_empty(text_col)).alias("w")).where("size(w) > 0")
    cut = words.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))), lambda i: F.slice("w", i + 1, F.lit(window)))).alias("words")).distinct()
    cut = materialise(cut, "leak-items")
    windows = materialise(cut.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "leak-windows")
    owners = materialise(cut.join(windows.hint("merge"), "words").select("wid", "item"), "leak-owners")
    release(cut)
    return windows, owners


def _window_shingles(windows: DataFrame, width: int) -> DataFrame:
    """wid, words, width, at, hash: each shingle of a window; a window shorter than a shingle is one."""
    own = windows.withColumn("width", F.least(F.size("words"), F.lit(width)))
    own = own.select("wid", "words", "width", F.posexplode("words").alias("at", "word")).where("at <= size(words) - width")
    by_width = lambda k: F.when(F.col("width") == k, _shingle(F.col("word"), F.col("words"), F.col("at"), k))
    return own.withColumn("hash", F.coalesce(*(by_width(k) for k in range(1, width + 1))))


def prefixes(windows: DataFrame, docs: DataFrame, width: int, containment: float, small: bool) -> DataFrame:
    """hash, width, windows (wid, at, words): the shingles of which any text that contains a window has at least one.

    Of n shingles a text may lack m = n - ceil(containment * n), so the m + 1 rarest are enough.
    """
    shingles = materialise(_window_shingles(windows, width), "leak-shingles")
    seen = shingles.groupBy("hash", "width").agg(F.lit(0).alias("_"))
    counts = [_times(docs, seen.where(F.col("width") == k), k, small).withColumn("width", F.lit(k)) for k in _widths(shingles)]
    times = None
    for one in counts:
        times = one if times is None else times.unionByName(one)
    times = None if times is None else materialise(times, "leak-times")
    ranked = shingles if times is None else shingles.join(times.hint("merge"), ["hash", "width"], "left")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("wid").orderBy(F.coalesce("times", F.lit(0)) if times is not None else F.lit(0), "hash", "at")))
    n = F.size("words") - F.col("width") + 1
    needed = ranked.where(F.col("rank") <= n - F.ceil(F.lit(containment) * n) + 1)
    needed = needed.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("hash", "width").orderBy("wid", "at")) - 1) / TOGETHER))
    out = materialise(needed.groupBy("hash", "width", "chunk").agg(F.collect_list(F.struct("wid", "at", "words")).alias("windows")).drop("chunk"), "leak-prefixes")
    release(shingles, times)
    return out


def _widths(rows: DataFrame) -> list[int]:
    """Widths that occur: at most as many as a shingle has words."""
    return sorted(r.width for r in rows.select("width").distinct().collect())


def _matches(docs: DataFrame, side: DataFrame, width: int, small: bool, window: int) -> DataFrame:
    """Places of documents whose shingle is in ``side``, with its columns: doc, text_key, start and near (the words that a
    window around the place may have), at (the place in near)."""
    # outer: else the texts are cut into words twice more, for filters of empty lists
    placed = docs.select("doc", "text_key", "w", F.posexplode_outer("w").alias("place", "word"))
    hashed = placed.withColumn("hash", _shingle(F.col("word"), F.col("w"), F.col("place"), width))
    if small:
        found = hashed.join(F.broadcast(side.drop("width")), "hash")
    else:
        found = hashed.drop("w", "word").join(side.drop("width").hint("merge"), "hash")
        texts = docs.select(F.col("doc").alias("doc_"), F.col("text_key").alias("key_"), "w").dropDuplicates(["doc_", "key_"])
        found = found.join(texts.hint("merge"), F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("text_key") == F.col("key_"))).drop("doc_", "key_")
    start = F.greatest(F.col("place") - (window - 1), F.lit(0))
    # a row never carries the words of its whole text
    return found.select("doc", "text_key", start.alias("start"), F.slice("w", start + 1, F.lit(2 * window - 1)).alias("near"), (F.col("place") - start).alias("at"), *(c for c in side.columns if c not in ("hash", "width")))


def _times(docs: DataFrame, side: DataFrame, width: int, small: bool) -> DataFrame:
    """hash, times: how often shingles of ``side`` occur in all documents."""
    hashed = docs.select("w", F.posexplode_outer("w").alias("place", "word")).select(_shingle(F.col("word"), F.col("w"), F.col("place"), width).alias("hash"))
    side = side.select("hash")
    if small:
        return hashed.join(F.broadcast(side), "hash").groupBy("hash").agg(F.count(F.lit(1)).alias("times"))
    return hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("times")).join(side.hint("merge"), "hash")


def _verified(found: DataFrame, containment: float, width: int) -> DataFrame:
    """doc, text_key, s: windows (wid, start, size) whose words are at their places, as many as containment asks for.

    The prefix shingle's place in the window fixes where the window begins; it must begin and end inside the text.
    """
    begins: Callable[[Column], Column] = lambda x: F.col("at") - x["at"]
    inside = lambda x: (begins(x) >= 0) & (begins(x) + F.size(x["words"]) <= F.size("near"))
    here = lambda x: F.slice("near", begins(x) + 1, F.size(x["words"]))

    def same(x: Column) -> Column:
        if containment >= 1:
            return here(x) == x["words"]
        own = F.least(F.size(x["words"]), F.lit(width))
        starts = F.sequence(F.lit(1), F.size(x["words"]) - own + 1)
        hits = F.filter(starts, lambda i: F.slice(here(x), i, own) == F.slice(x["words"], i, own))
        return F.size(hits) >= F.ceil(F.lit(containment) * F.size(starts))

    kept = F.filter("windows", lambda x: F.when(inside(x), same(x)).otherwise(F.lit(False)))
    spans = F.transform(kept, lambda x: F.struct(x["wid"].alias("wid"), (F.col("start") + begins(x)).alias("start"), F.size(x["words"]).alias("size")))
    # outer: a filter of empty lists would be pushed into the join, and break its generated code
    return found.select("doc", "text_key", F.explode_outer(spans).alias("s")).where("s IS NOT NULL")


def _covered(spans: Column) -> Column:
    """Words inside of any span; spans sorted by their start."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def add(state: Column, s: Column) -> Column:
        end = s["start"] + s["size"]
        return F.struct(F.greatest(state["upto"], end).alias("upto"), (state["n"] + F.greatest(F.lit(0), end - F.greatest(s["start"], state["upto"]))).alias("n"))

    return F.aggregate(spans, start, add, lambda s: s["n"])


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, width: int = WIDTH,
    containment: float = 1.0, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans for every row of docs.

    A window is ``window`` consecutive words of an item, or the whole of a shorter one. It occurs where its words lie in
    the document one after the other; with a containment below 1, where that part of its shingles of ``width`` words lies
    at their places. n_hit counts the words inside of any occurrence, n_items the items with one; items_sha256 is of their
    ids, sorted as strings and joined by commas; spans (start, size, in words, sorted) are the occurrences.

    Null and empty texts have no words, on either side. Rows repeated with one id and text get the same result each;
    different texts of one id are told apart. Null document ids stay null; a null item id counts as the empty one; rows of
    one item id are one item. Texts of any length are read whole. Extra columns are left out; an empty table of documents
    gives an empty result, an empty benchmark no hits. Shingles are 64-bit hashes that only propose places: the words
    themselves decide. Documents that have the same windows share one list of items, and windows of up to ``TOGETHER``
    items a row, so a passage that many documents have is not multiplied by its items.
    """
    if not 0 < containment <= 1 or window < 1 or width < 1:
        raise ValueError("containment must be above 0 and at most 1, window and width at least 1")
    text = text_or_empty(F.col(text_col).cast("string"))
    base = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))
    worded = base.select("doc", "text_key", words_of(F.col("text")).alias("w"))
    windows, owners = item_windows(items, item_col, item_text_col, window, width)
    small = windows.count() <= broadcast_windows
    side = prefixes(windows, worded, width, containment, small)
    found = None
    for k in _widths(side):
        one = _verified(_matches(worded, side.where(F.col("width") == k), k, small, window), containment, width)
        found = one if found is None else found.unionByName(one)
    count = F.regexp_count(F.col("text"), F.lit(WORD.replace("a-z", "A-Za-z"))).cast("long")
    counted = base.select("doc", "text_key", count.alias("n_words"))
    nothing = "CAST(NULL AS ARRAY<STRUCT<start: INT, size: INT>>)"
    if found is None:
        out = counted.select("doc", "n_words", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("string").alias("items_sha256"), F.expr(nothing).alias("spans"))
    else:
        spans = found.groupBy("doc", "text_key").agg(F.collect_set("s").alias("s"))
        wids = F.array_sort(F.array_distinct(F.transform("s", lambda x: x["wid"])))
        places = F.array_sort(F.array_distinct(F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size")))))
        hits = spans.select("doc", "text_key", places.alias("spans"), wids.alias("wids"))
        hits = materialise(hits.withColumn("n_hit", _covered(F.col("spans"))).withColumn("set_key", F.sha2(F.array_join("wids", ","), 256)), "leak-hits")
        lists = hits.groupBy("set_key").agg(F.first("wids").alias("wids")).select("set_key", F.explode("wids").alias("wid"))
        lists = lists.join(owners.hint("merge"), "wid").groupBy("set_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
        lists = materialise(lists.select("set_key", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "leak-lists")
        marked = hits.drop("wids").join(lists.hint("merge"), "set_key").select(F.col("doc").alias("doc_"), F.col("text_key").alias("key_"), "n_hit", "n_items", "items_sha256", "spans")
        marked = materialise(marked, "leak-marked")
        release(hits, lists)
        out = counted.join(marked.hint("merge"), F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("text_key") == F.col("key_")), "left")
    release(windows, owners, side)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        F.col("doc").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.coalesce("spans", F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, size: INT>>)")).alias("spans"),
    )
