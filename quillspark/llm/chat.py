"""Chat formatting by multi-party perspective rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

#: The markup of rendered turns.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"
#: Fixed value: what opens both marks; in a turn's own text it is written with a blank, so that no text forges a turn.
MARK, HARMLESS = "<|im_", "<| im_"
#: Turns of a block for offsets.
BLOCK_TURNS = 256


def _harmless(c: Column) -> Column:
    return F.replace(c, F.lit(MARK), F.lit(HARMLESS))


def _turn(speaker: Column, text: Column, mine: Column, narrator: Column) -> tuple[Column, Column]:
    """Header and body of a turn as one perspective sees it: itself as assistant, others as users with their names."""
    role = F.when(narrator, F.lit(SYSTEM)).when(mine, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.regexp_replace(_harmless(speaker), "[\\r\\n]+", " ")))
    return F.concat(F.lit(OPEN), role, F.lit("\n")), _harmless(text)


def rotate_perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, turn, place, segment, start, mask_start, mask_end, is_target: one row for each turn of each
    participant's rendering of the dialogue; segments joined in the order of place are the rendering.

    Every speaker but the system is a participant. In its rendering its own turns are the assistant's, those of others
    are of users with their names, system turns stay. start is the segment's offset in characters; the loss mask of a
    target covers [mask_start, mask_end): the text and the closing mark, without the header. Other turns have no mask.

    Marks inside a text or name are broken by a blank, and line breaks in names become blanks, so that neither can forge a
    turn. Segments are rows, so a conversation of any length is never gathered: offsets are sums within blocks of turns plus
    sums over the blocks before. Null text counts as empty, a null speaker as 'unknown'; rows with a null conversation
    form one; turns with equal numbers are ordered by speaker and text. Repeated rows stay, each as a turn. A
    conversation with only system turns has no perspective and no rows, and so has an empty table. Extra columns,
    whatever their names, are left out. Turns of one conversation with one number or none are one block of offsets.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"), text_or_empty(F.col(text).cast("string")).alias("text"),
        F.coalesce(F.floor(F.col(turn) / BLOCK_TURNS), F.lit(-1)).cast("long").alias("block"),
    )
    people = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    mine, narrator = F.col("speaker") == F.col("perspective"), F.col("speaker") == SYSTEM
    header, body = _turn(F.col("speaker"), F.col("text"), mine, narrator)
    seen = seen.select("conv_id", "perspective", "turn", "speaker", "block", "text", mine.alias("is_target"), F.length(header).alias("head"), F.concat(header, body, F.lit(CLOSE)).alias("segment"))
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn", "speaker", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = seen.select("*", F.row_number().over(inside).alias("at"), (F.sum(F.length("segment")).over(upto) - F.length("segment")).alias("within"))
    blocks = seen.groupBy("conv_id", "perspective", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("segment")).alias("chars"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b"))
    out = placed.join(blocks, same)
    start = (F.col("chars_before") + F.col("within")).cast("long")
    mask = lambda x: F.when(F.col("is_target"), x.cast("long"))
    return out.select(
        "conv_id", "perspective", "turn", (F.col("n_before") + F.col("at")).cast("long").alias("place"), "segment", start.alias("start"),
        mask(start + F.col("head")).alias("mask_start"), mask(start + F.length("segment")).alias("mask_end"), "is_target",
    )


def rendered(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, text, masks: whole renderings, for conversations known to fit a row."""
    parts = F.sort_array(F.collect_list(F.struct("place", "segment", "mask_start", "mask_end")))
    rows = segments.groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    masks = F.transform(F.filter("parts", lambda p: p["mask_start"].isNotNull()), lambda p: F.struct(p["mask_start"].alias("start"), p["mask_end"].alias("end")))
    return rows.select("conv_id", "perspective", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("text"), masks.alias("masks"))
