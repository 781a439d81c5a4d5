"""A trie of conversations by chained prefix digests.

A node is a distinct sequence of first turns. Its digest is SHA-256 of its parent's digest and its last turn's, so equal
digests are equal sequences, and nodes are found by grouping, without comparing texts. Texts are digested where they are
read; only digests and sizes are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, materialise, release, text_or_empty

#: Depths of a block: a node is exploded to its ancestors inside its block, and blocks' tops are a trie of their own.
BLOCK = 64
#: Ids of a block (as a power of two) that are joined to a text before the rows of a node meet.
ID_BITS = 8
#: Turns that a conversation may take from another, at most.
SHARED = 8
ROOT = hashlib.sha256(b"").digest()
SIZE = 32  # bytes of a digest


def marked_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, place (from 0), mark (digest of role and text), size (UTF-8 bytes of the text); turns by number, null first,
    those of one number by their digest."""
    role, text = text_or_empty(F.col(role_col).cast("string")), text_or_empty(F.col(text_col).cast("string"))
    mark = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), mark.alias("mark"), F.octet_length(text).cast("long").alias("size"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "mark")
    return turns.select("conv", (F.row_number().over(order) - 1).alias("place"), "mark", "size")


def rebuilt_turns(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """turns of every conversation c after its first h come from itself, the first h from conversation c - c % 5; h is
    crc32 of c's decimal text modulo SHARED + 1."""
    plan = convs.select(F.col("conv").alias("to"), (F.col("conv") - F.col("conv") % 5).alias("base"), crc_mod("conv", SHARED + 1).alias("h"))
    first = turns.where(F.col("place") < SHARED).join(plan.hint("merge"), F.col("conv") == F.col("base")).where("place < h").select(F.col("to").alias("conv"), "place", "mark", "size")
    return first.unionByName(turns.where(F.col("place") >= crc_mod("conv", SHARED + 1)))


def chained(rows: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """A row for every prefix of every conversation, the empty one too: conv, depth, digest, size (of the last turn), ends
    (whether the conversation goes no further), paths and ups.

    paths[j] holds the digests of a prefix whose depth is a multiple of block ** j and of its ancestors in its block of
    level j, one after the other from the top; ups[j] is the digest of the ancestor block ** j above it. Turns come sorted
    by conversation and are read one after the other, so that a conversation of any length needs no more memory than a
    block's digests a level.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "depth", "digest", "size", "ends", "paths", "ups"]
        held, digest, depth, stacks = None, b"", 0, []
        for batch in batches:
            out = []
            for conv, mark, size in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if held is not None:
                    out.append((*held[:4], mark is None, *held[4:]))
                if mark is None:  # the row that opens a conversation
                    digest, depth, stacks = ROOT, 0, []
                else:
                    digest, depth = hashlib.sha256(digest + mark).digest(), depth + 1
                paths, ups, j, k = [], [], 0, depth
                while True:
                    if j == len(stacks):
                        stacks.append([])
                    ups.append(stacks[j][-1] if stacks[j] else None)
                    if k % block == 0:
                        stacks[j] = []
                    stacks[j].append(digest)
                    paths.append(b"".join(stacks[j]))
                    if k % block or not k:
                        break
                    j, k = j + 1, k // block
                    if j == len(stacks):  # the first top of a level above: the root is the one before it
                        stacks.append([ROOT])
                held = conv, depth, digest, size, paths, ups
            yield _batch(out, names)
        if held is not None:
            yield _batch([(*held[:4], True, *held[4:])], names)

    opening = convs.select("conv", F.lit(-1).alias("place"), F.lit(None).cast("binary").alias("mark"), F.lit(0).cast("long").alias("size"))
    ordered = rows.unionByName(opening).repartition("conv").sortWithinPartitions("conv", "place")
    return ordered.mapInArrow(run, "conv long, depth long, digest binary, size long, ends boolean, paths array<binary>, ups array<binary>")


_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.list_(pa.binary()), pa.list_(pa.binary()))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names)


def _path(level: int) -> Column:
    """Digests from the top of a node's block of that level to itself; the root is the same at all levels."""
    return F.when(F.col("depth") == 0, F.get("paths", F.lit(0))).otherwise(F.get("paths", F.lit(level)))


def _ancestors(nodes: DataFrame, level: int, *columns: str) -> DataFrame:
    """Each node once for every ancestor in its block, itself included, as ``above``."""
    path = _path(level)
    steps = F.explode(F.sequence(F.lit(0), (F.octet_length(path) / SIZE).cast("int") - 1)).alias("step")
    rows = nodes.select(path.alias("path"), steps, *columns)
    return rows.select(F.substring("path", F.col("step") * SIZE + 1, F.lit(SIZE)).alias("above"), *columns)


def subtree_sums(nodes: DataFrame, values: list[str], block: int, level: int = 0) -> DataFrame:
    """digest and the sums of ``values`` over each node's subtree; nodes: digest, depth, paths, ups, values.

    Nodes are exploded to their ancestors. Where the trie is deeper than a block, its blocks' tops are summed first, as a
    trie of their own whose nodes have their blocks' sums, and what is below a block comes in through the parents of the
    tops under it; so a node makes at most ``block`` rows at each level, and levels grow with the logarithm of the depth.
    """
    step = block**level
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is not None and deepest >= step * block:
        top = F.substring(_path(level), 1, SIZE)
        of_block = nodes.groupBy(top.alias("digest")).agg(*(F.sum(v).alias(v) for v in values))
        tops = nodes.where(F.col("depth") % (step * block) == 0).drop(*values).join(of_block.hint("merge"), "digest")
        tops = materialise(tops, "trie-tops")
        totals = materialise(subtree_sums(tops, values, block, level + 1), "trie-totals")
        below = tops.where("depth > 0").select("digest", F.col("ups")[level].alias("up")).join(totals.hint("merge"), "digest").groupBy("up").agg(*(F.sum(v).alias(f"more_{v}") for v in values))
        nodes = nodes.join(below.hint("merge"), F.col("digest") == F.col("up"), "left").withColumns({v: F.col(v) + F.coalesce(f"more_{v}", F.lit(0)) for v in values})
        nodes = materialise(nodes.drop("up", *(f"more_{v}" for v in values)), "trie-added")
        release(tops, totals)
    rows = _ancestors(nodes, level, *values)
    return rows.groupBy(F.col("above").alias("digest")).agg(*(F.sum(v).alias(v) for v in values))


def _ends(prefixes: DataFrame) -> DataFrame:
    """digest, ends_sha256 of the nodes where conversations end: of their decimal ids in order, joined by commas.

    Ids are first joined in blocks of 2 ** ID_BITS neighbouring ones, anywhere; then a node's blocks are read in order by
    one task, which keeps no more than the state of the hash.
    """
    ids = prefixes.where("ends").select("digest", "conv", F.shiftright("conv", ID_BITS).alias("block"))
    blocks = ids.groupBy("digest", "block").agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = None, None
        for batch in batches:
            out = []
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if digest != of:
                    if state is not None:
                        out.append((of, state.hexdigest()))
                    of, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], ["digest", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([of], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["digest", "ends_sha256"])

    return blocks.repartition("digest").sortWithinPartitions("digest", "block").mapInArrow(run, "digest binary, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rebuild: bool = False, block: int = BLOCK
) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, digest, parent_digest: one
    row for every distinct sequence of first turns (role, text), the empty one included.

    conv_id is the smallest member, a member being any conversation that begins so; n_convs counts members, n_children the
    sequences one turn longer, n_leaves the childless ones at or below; saved_tokens sums, at and below, the bytes of the
    last turn's text times the members beyond the first: what a cache of prefixes needn't read again; ends_sha256 is of the
    decimal ids of the members that end here, in order, joined by commas (none: of the empty string). With ``rebuild``
    conversations are first rebuilt by rebuilt_turns().

    Turns are ordered by number, null first; turns of one number, repeated ones too, all count, in the order of a digest of
    role and text. A null role or text counts as empty. Rows without a conversation id belong to no conversation. Texts of
    any length are digested whole; conversations of any length are read turn by turn, one task each, since each digest needs
    the one before. Extra columns are left out. An empty table has no conversations and no nodes, not even the root.
    """
    turns = materialise(marked_turns(conversations, conv_col, turn_col, role_col, text_col), "trie-turns")
    convs = turns.select("conv").distinct()
    rows = rebuilt_turns(turns, convs) if rebuild else turns
    prefixes = materialise(chained(rows, convs, block), "trie-prefixes")
    grouped = prefixes.groupBy("depth", "digest").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.count_if("ends").alias("n_ends"), F.first("size").alias("size"), F.first("paths").alias("paths"), F.first("ups").alias("ups"),
    )
    # members that all end here have no turn in common after it: the node is a leaf
    childless, saved = (F.col("n_ends") == F.col("n_convs")).cast("long"), (F.col("n_convs") - 1) * F.col("size")
    nodes = materialise(grouped.withColumns({"n_leaves": childless, "saved_tokens": saved, "up": F.col("ups")[0]}), "trie-nodes")
    sums = subtree_sums(nodes.select("digest", "depth", "paths", "ups", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"], block)
    children = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.select("digest", "depth", "conv", "n_convs", "up").join(sums.hint("merge"), "digest").join(children.hint("merge"), "digest", "left").join(_ends(prefixes).hint("merge"), "digest", "left")
    known = materialise(known, "trie-known")
    parents = nodes.select(F.col("digest").alias("up"), F.col("conv").alias("parent_conv_id"))
    out = known.join(parents.hint("merge"), "up", "left")  # written before: a parent of very many is split
    result = materialise(
        out.select(
            F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.lower(F.hex("digest")).alias("digest"), F.lower(F.hex("up")).alias("parent_digest"),
        ),
        "trie",
    )
    release(turns, prefixes, nodes, known)
    return result
