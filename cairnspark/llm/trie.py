"""Conversation prefix trie: node counts, shared prefixes and what sharing them saves.

1. Conversations are read in order once, each turn extending a 128-bit digest of all turns before it; a step is one
   (conversation, depth). Nodes are the distinct digests, counted with partial aggregates.
2. A node that one conversation alone goes through has its counts by definition (one leaf below it, nothing saved), so
   only shared nodes need sums over subtrees.
3. Shared nodes are dealt into shards that hold whole subtrees. In a shard, digests get slots by a minimal perfect hash,
   each verified against the stored digest; counts are scattered into flat arrays by slot and added up through the array
   of parent slots, deepest level first.
4. Nodes above more than SHARD steps (the crown: the root, hot first turns, hot conversations) belong to no shard. Their
   sums come from the shards' tops and from each other by doubling: in round k a node adds what stands 2**k levels below,
   so that even a long chain of hot nodes takes a logarithm of its depth in rounds, and no task holds the crown.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import kernels as K
from cairnspark.llm.shared import made, small_batches, sweep, table, written

#: Steps in one shard, on average; a node with more at and below it belongs to the crown.
SHARD = 8192
#: Conversations that share a host (the first turns of the smallest id of their block come from it).
BLOCK = 100
#: Turns that come from the host: crc32 of the id modulo this.
BORROW = 6
ROOT = (0, 0)

_STEP = pa.schema(
    [("conv", pa.int64()), ("depth", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("up_hi", pa.int64()), ("up_lo", pa.int64()),
     ("chars", pa.int64()), ("last", pa.bool_())]
)
STEP_SCHEMA = "conv long, depth long, hi long, lo long, up_hi long, up_lo long, chars long, last boolean"


def extend(before: tuple[int, int], role: str, text: str) -> tuple[int, int]:
    """The digest of a prefix with one more turn."""
    role_, text_ = role.encode(), text.encode()
    head = before[0].to_bytes(8, "little", signed=True) + before[1].to_bytes(8, "little", signed=True) + len(role_).to_bytes(8, "little")
    digest = hashlib.blake2b(head + role_ + text_, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps of conversations whose rows come in order: (block, conv, borrow, role, text), a block's host first."""
    out: list[tuple] = []
    block = conv = pending = None
    host: list[tuple[str, str]] = []  # the first turns of the block's host, BORROW - 1 at most
    place, at = 0, ROOT

    def emit(depth: int, node: tuple[int, int], up: tuple[int, int], chars: int) -> None:
        nonlocal pending
        if pending:
            out.append((*pending, False))
        pending = (conv, depth, *node, *up, chars)

    def close() -> None:
        nonlocal pending
        if pending:
            out.append((*pending, True))
        pending = None

    def flush() -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _STEP, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=_STEP)

    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(5)]
        for block_, conv_, borrow, role, text in zip(*cols, strict=True):
            if block_ != block:
                block, host = block_, []
            if conv_ != conv:
                close()
                conv, place, at, depth = conv_, 0, ROOT, 0
                emit(0, ROOT, ROOT, 0)
                if conv != block:
                    for r, t in host[:borrow]:
                        up, at, depth = at, extend(at, r, t), depth + 1
                        emit(depth, at, up, len(t))
            if conv == block and len(host) < BORROW - 1:
                host.append((role, text))
            place += 1
            if conv == block or place > borrow:
                up, at, depth = at, extend(at, role, text), depth + 1
                emit(depth, at, up, len(text))
        if len(out) >= 8192:
            yield flush()
    close()
    if out:
        yield flush()


def rebuilt_steps(rows: DataFrame) -> DataFrame:
    """One row per prefix of every rebuilt conversation, the empty one included: conv, depth, digest, parent's digest, chars, last.

    A block of BLOCK ids lies in one partition, its host first, so that its first turns are known when the others come.
    Only running digests are held.
    """
    small_batches(rows.sparkSession)
    conv = F.col("conv_id").cast("long")
    named = rows.where("conv_id is not null").select(
        (conv - conv % BLOCK).alias("block"), conv.alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        (F.crc32(conv.cast("string").cast("binary")) % BORROW).cast("int").alias("borrow"),
    )
    host_first = F.when(F.col("block") == F.col("conv"), 0).otherwise(1)
    in_order = named.repartition("block").sortWithinPartitions("block", host_first, "conv", F.col("turn").asc_nulls_first(), "role", "text")
    return in_order.select("block", "conv", "borrow", "role", "text").mapInArrow(K.tidy(_walk), STEP_SCHEMA)


# --- slots: a minimal perfect hash over the digests of a shard ------------------------------------------------------------


class Slots:
    """A minimal perfect hash of distinct 128-bit digests: bit arrays, one per level; keys that collide go one level down.

    `of` gives each digest's slot, or -1 for digests that are none of the keys: the digest stored at a slot is compared.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = np.arange(len(hi)), 0
        self.at = np.empty(len(hi), np.int64)
        while len(left):
            size = 2 * len(left) + 1
            cell = self._cell(hi[left], lo[left], len(self.levels), size)
            taken = np.bincount(cell, minlength=size) == 1
            rank = base + np.cumsum(taken) - taken
            own = taken[cell]
            self.at[left[own]] = rank[cell[own]]
            self.levels.append((taken, rank))
            base += int(taken.sum())
            left = left[~own]
        self.hi, self.lo = np.empty_like(hi), np.empty_like(lo)
        self.hi[self.at], self.lo[self.at] = hi, lo

    @staticmethod
    def _cell(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = K.mix(hi.view(np.uint64) + K.mix(lo.view(np.uint64) + np.uint64(level)))
        return (mixed % np.uint64(size)).astype(np.int64)

    def of(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out, left = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for level, (taken, rank) in enumerate(self.levels):
            cell = self._cell(hi[left], lo[left], level, len(taken))
            own = taken[cell]
            out[left[own]] = rank[cell[own]]
            left = left[~own]
        found = out >= 0
        found[found] = (self.hi[out[found]] == hi[found]) & (self.lo[out[found]] == lo[found])
        return np.where(found, out, -1)


def subtree_sums(nodes: pd.DataFrame) -> pd.DataFrame:
    """nodes (hi, lo, up_hi, up_lo, depth, leaves, saved) of whole subtrees, with leaves and saved summed over each subtree."""
    hi, lo = nodes["hi"].to_numpy(), nodes["lo"].to_numpy()
    slots = Slots(hi, lo)
    parent, depth, leaves, saved = (np.empty(len(nodes), np.int64) for _ in range(4))
    parent[slots.at] = slots.of(nodes["up_hi"].to_numpy(), nodes["up_lo"].to_numpy())  # -1: the parent is in the crown
    depth[slots.at], leaves[slots.at], saved[slots.at] = nodes["depth"], nodes["leaves"], nodes["saved"]
    parent[depth == 0] = -1  # the root is nobody's child
    order = np.argsort(-depth, kind="stable")
    bounds = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, bounds):
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    out = nodes[["hi", "lo", "up_hi", "up_lo"]].copy()
    out["leaves"], out["saved"], out["top"] = leaves[slots.at], saved[slots.at], parent[slots.at] < 0
    return out


def _crown_sums(crown: DataFrame, levels: int) -> DataFrame:
    """(hi, lo, leaves, saved) of crown nodes (hi, lo, up_hi, up_lo, leaves, saved), summed over the crown nodes below each.

    Each round a node's sums reach twice as far down: it adds what the nodes just beyond its reach have, and reaches up
    to its reach's own ancestor. The root has no parent.
    """
    own = ["hi", "lo"]
    state = crown.select(*own, F.when(F.expr(f"hi = {ROOT[0]} and lo = {ROOT[1]}"), None).otherwise(F.struct("up_hi", "up_lo")).alias("up"), "leaves", "saved")
    mark = made()
    for _ in range(max(1, math.ceil(math.log2(levels + 1)))):
        more = state.where("up is not null").groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        beyond = state.select(F.struct(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo")).alias("up"), F.col("up").alias("beyond"))
        state = (
            state.join(more.withColumnsRenamed({"up": "self"}), F.col("self") == F.struct(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo")), "left")
            .join(beyond, "up", "left")
            .select(*own, F.col("beyond").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                    (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        )
        state = written(state, "crown")
        sweep(crown.sparkSession, mark, state)
    return state.select(*own, "leaves", "saved")


def _ends(steps: DataFrame, shared: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of shared nodes at which conversations end: the digest of their ids in order, comma-joined.

    The digest is sequential by its definition: ids alone stream through, in constant memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, done = None, None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2])], ["hi", "lo", "ends_sha256"])

        for batch in batches:
            for hi, lo, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now != (hi, lo):
                    if now:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (hi, lo), hashlib.sha256(str(conv).encode())
                else:
                    sha.update(f",{conv}".encode())
            if len(done) >= 4096:
                yield flush()
        if now:
            done.append((*now, sha.hexdigest()))
        if done:
            yield flush()

    ends = steps.where("last").select("hi", "lo", "conv").join(shared.where("ends > 0").select("hi", "lo"), ["hi", "lo"], "left_semi")
    return ends.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "conv").mapInArrow(K.tidy(run), "hi long, lo long, ends_sha256 string")


def prefix_trie(steps: DataFrame, shard: int = SHARD) -> DataFrame:
    """Per node of the trie of `steps` (see rebuilt_steps): its counts, and its parent's.

    conv_id is the smallest conversation through the node; n_convs, n_children, n_leaves, saved_tokens and ends_sha256
    are as op12_trie has them. No steps give no nodes.
    """
    spark = steps.sparkSession
    mark = made()
    steps = written(steps, "trie-steps")
    length = steps.where("last").select("conv", F.col("depth").alias("length"))
    node = ["hi", "lo"]
    nodes = written(
        steps.join(length, "conv")
        .groupBy(*node)
        .agg(
            F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if("last").alias("ends"), F.min("depth").alias("depth"),
            F.min("up_hi").alias("up_hi"), F.min("up_lo").alias("up_lo"), F.min("chars").alias("chars"),
            F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
        ),
        "trie-nodes",
    )
    below = (
        nodes.where("depth > 0")
        .groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo"))
        .agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("lone"))
    )
    shared = written(
        nodes.where("n_convs > 1").join(below, node, "left").select(
            *node, "up_hi", "up_lo", "conv_id", "depth", "n_convs", "ends", "weight", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            # each child of one conversation has one leaf below it; a node without children is a leaf itself
            F.when(F.col("n_children").isNull(), 1).otherwise(F.col("lone")).cast("long").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        ),
        "trie-shared",
    )
    crown, rest = shared.where(F.col("weight") > shard), shared.where(F.col("weight") <= shard)
    size = rest.count()
    # A conversation leaves the crown at `cut`: the node there is the top of the subtree that its deeper nodes lie in.
    cuts = steps.join(crown.select(*node), node, "left_semi").groupBy("conv").agg((F.max("depth") + 1).alias("cut"))
    tops = steps.join(rest.select(F.col("conv_id").alias("conv")).distinct(), "conv", "left_semi").join(cuts, "conv", "left")
    tops = tops.where(F.col("depth") == F.coalesce("cut", F.lit(0))).select(F.col("conv").alias("conv_id"), F.xxhash64("hi", "lo").alias("top"))
    shards = max(1, math.ceil(size / shard))
    dealt = rest.join(tops, "conv_id").select(F.pmod("top", F.lit(shards)).alias("shard"), *node, "up_hi", "up_lo", "depth", "leaves", "saved")
    sums = written(
        dealt.groupBy("shard").applyInPandas(subtree_sums, "hi long, lo long, up_hi long, up_lo long, leaves long, saved long, top boolean"), "trie-sums"
    )
    total = sums.select(*node, "leaves", "saved")
    levels = crown.agg(F.max("depth")).first()[0]
    if levels is not None:
        hanging = sums.where("top").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        loaded = crown.join(hanging, node, "left").select(
            *node, "up_hi", "up_lo", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")
        )
        total = total.unionByName(_crown_sums(loaded, levels))
    nothing = F.sha2(F.lit(""), 256)
    counts = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    upper = shared.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("upper"))
    ends = _ends(steps, shared)
    many = (
        shared.join(total.withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"}), node)
        .join(ends, node, "left").join(upper, ["up_hi", "up_lo"], "left")
        .select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("upper")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    )
    # Through these goes one conversation; where its parent is not shared either, that is the same one.
    one = nodes.where("n_convs = 1").join(upper, ["up_hi", "up_lo"], "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("upper", "conv_id")).alias("parent_conv_id"), "n_convs",
        (1 - F.col("ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("ends") > 0, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"),
    )
    out = written(many.unionByName(one).select(counts), "trie")
    sweep(spark, mark, out)
    return out


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations.

    Turns are taken by turn, nulls first, ties by role, then text; null roles and texts are empty. Rows of a null conv_id
    belong to no conversation and take no part. Repeated rows are turns of their own. An empty table has no nodes. Blocks
    of negative ids follow SQL's remainder. Further columns are left out, whatever their names.
    """
    return prefix_trie(rebuilt_steps(table(spark, sf_dir, "conversations")))
