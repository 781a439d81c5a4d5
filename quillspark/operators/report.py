"""Small tables as lines of text, CSV and LaTeX, and the tables behind plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def in_order(rows: DataFrame, names: list[str], column: str) -> DataFrame:
    """rows with ``place``, their place in a fixed list; others come last."""
    return rows.withColumn("place", F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col(column)), F.lit(0))).withColumn("place", F.when(F.col("place") == 0, len(names) + 1).otherwise(F.col("place")).cast("long"))


def comparison(metrics: DataFrame, label: str, measures: list[str]) -> DataFrame:
    """label, plain, csv, latex: one line for each row, shares as percentages with one place, a dash for null."""
    cells = [T.percent(F.col(m)) for m in measures]
    return metrics.select(
        label, F.concat_ws(" ", F.rpad(label, 24, " "), *(F.lpad(c, 8, " ") for c in cells)).alias("plain"), F.concat_ws(",", label, *cells).alias("csv"),
        F.concat(F.concat_ws(" & ", T.latex(label), *cells), F.lit(r" \\")).alias("latex"),
    )


def grid(rows: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Every row key with every column key, null where there is no value: the table of a heat map."""
    keys = rows.select(row).distinct().crossJoin(rows.select(column).distinct())  # models and dialects: few of each
    return keys.join(rows.select(row, column, value), [row, column], "left")


def long(metrics: DataFrame, by: str, measures: list[str]) -> DataFrame:
    """by, metric, value: the table of grouped bars."""
    return metrics.unpivot([by], measures, "metric", "value")


def by_dialect(clips: DataFrame, dialect: str = "dialect") -> DataFrame:
    """Clips, hours, code-switched clips and their share by dialect, most clips first."""
    cs = F.count_if(F.coalesce("is_code_switched", F.lit(False)))
    return clips.groupBy(dialect).agg(F.count(F.lit(1)).alias("clips"), F.round(F.sum("duration_sec") / 3600, 4).alias("hours"), cs.alias("cs_clips"), F.round(100 * cs / F.count(F.lit(1)), 1).alias("cs_pct")).orderBy(F.desc("clips"), dialect)


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def top_values(rows: DataFrame, values: str, n: int = 50, seen: str | None = None) -> DataFrame:
    """The n most frequent elements of an array column; of equals the one first ``seen`` (a position), else by name."""
    one = rows.select(F.explode(values).alias("value"), *([F.col(seen).alias("_at")] if seen else []))
    counts = one.groupBy("value").agg(F.count(F.lit(1)).alias("n"), (F.min("_at") if seen else F.lit(0)).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first", "value").limit(n).drop("_first")


def label_changes(rows: DataFrame, before: str, after: str) -> DataFrame:
    """label, before, after: how many rows carry each label on either side of a step."""
    sides = F.array(F.struct(F.col(before).alias("label"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(F.col(after).alias("label"), F.lit(0).alias("b"), F.lit(1).alias("a")))
    return rows.select(F.explode(sides).alias("x")).groupBy("x.label").agg(F.sum("x.b").alias("before"), F.sum("x.a").alias("after"))


def trial_report(rows: DataFrame, by: str, words: str, order: str, most: int = 6) -> DataFrame:
    """by, clips, cs, high, bn, and up to ``most`` different words in the order in which they appear first.

    rows: label, cs_confidence, an array of words and a position. Each word's first place is found before words meet, so
    a group is as long as its vocabulary at most."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("clips"), F.count_if(F.col("label") == "CS").alias("cs"), F.count_if(F.col("cs_confidence") == "HIGH").alias("high"), F.count_if(F.col("label") == "BN_ONLY").alias("bn"))
    first = rows.select(by, order, F.posexplode(words).alias("place", "word")).groupBy(by, "word").agg(F.min(F.struct(order, "place")).alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("at", "word"))).where(F.col("rank") <= most)
    listed = ranked.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("words"))
    return counts.join(listed, by, "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def ordered_distinct(values: Column) -> Column:
    """Elements in the order in which they come first, each once."""
    return F.array_distinct(values)


def ranked_last(rows: DataFrame, *order: str) -> DataFrame:
    """rows in ascending order of columns, nulls after all values."""
    return rows.orderBy(*(F.col(c).asc_nulls_last() for c in order))


def character_vocabulary(rows: DataFrame, text: str, specials: tuple[str, ...] = ("<pad>", "<unk>", "|")) -> DataFrame:
    """symbol, id: the special symbols, then every other character in code point order. Characters are few."""
    seen = rows.select(F.explode(F.array_distinct(F.split(F.col(text), ""))).alias("symbol")).where("symbol NOT IN ('', ' ')").distinct()
    numbered = seen.select("symbol", (F.row_number().over(Window.orderBy("symbol")) - 1 + len(specials)).cast("long").alias("id"))
    fixed = rows.sparkSession.createDataFrame(list(zip(specials, range(len(specials)), strict=True)), "symbol string, id long")
    return fixed.unionByName(numbered)


def token_weights(vocabulary: DataFrame, weight: float = 3.0) -> DataFrame:
    """vocabulary with ``weight``: that of symbols with a Latin letter, 1 for others."""
    return vocabulary.withColumn("weight", F.when(F.col("symbol").rlike("[A-Za-z]"), weight).otherwise(1.0))
