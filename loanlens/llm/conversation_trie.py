"""Prefix trie of conversations by vertical bitmaps.

A conversation is a sequence of turns; every distinct sequence of first d turns
is a node. Conversations are dealt to shards of `shard_convs` neighbouring ids,
so a shard is small however common a prefix is, and cut into segments of
`segment` turns, so a very long conversation is many groups. Inside a group
(shard, segment) each (position, turn) is indexed to the bitset of the
conversations that have it there. A depth-first walk intersects a node's bitset
with the postings of the next position: the result is a child, its popcount the
members, its lowest bit the smallest conversation, and what is left of the
bitset when no conversation goes on is the list of those that end here.

Nodes of different shards meet by their key: the exclusive or of a 128-bit hash
of (position, role, text) over their turns, which is also how a segment knows
the nodes it starts from. So a prefix that a third of all conversations share
reaches the shuffle as one row per shard. Two different prefixes share a key
with odds of about n^2 / 2^129.

Sums over subtrees need no walk over the whole trie: a node is owned by its
smallest conversation, and its subtree's nodes are owned by members. A second
walk over the same bitsets adds up, bottom-up, the leaves and savings that each
shard's conversations own; conversations of several segments bring what their
later segments own as one number. The list of ids that end at one node is hashed
as a stream of shard chunks in order, never held whole.

Defined results: rows with a null conv_id take no part; null role and text are
empty; turns are ordered by turn (null first), ties by role, then text; repeated
rows are turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import staged
from loanlens.operators.ordering import position_in, with_position

SHARED = 9  # a rebuilt conversation takes fewer turns than this from its first neighbour
GROUP = 5

LOCAL = "depth long, key1 long, key2 long, parent1 long, parent2 long, n long, conv long, shard long, bytes long, ends array<long>"
SUMS = "depth long, key1 long, key2 long, leaves long, saved long"
ENDS = "depth long, key1 long, key2 long, sha string"
_LOCAL = pa.schema([(c, pa.int64()) for c in "depth key1 key2 parent1 parent2 n conv shard bytes".split()] + [("ends", pa.list_(pa.int64()))])
_SUMS = pa.schema([(c, pa.int64()) for c in "depth key1 key2 leaves saved".split()])
_ENDS = pa.schema([("depth", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("sha", pa.string())])
NO_ENDS = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "key1", "key2"]


class Walk:
    """Depth-first walk over one group. Nodes are numbered in walk order:
    parents before children; `above` is -1 for the group's topmost nodes."""

    def __init__(self, part: pa.Table, segment: int):
        order = np.argsort(part.column("conv").to_numpy(), kind="stable")
        part = part.take(pa.array(order))
        self.convs = part.column("conv").to_numpy().tolist()
        depths = part.column("total").to_numpy().tolist()
        start1, start2 = part.column("start1").to_numpy().tolist(), part.column("start2").to_numpy().tolist()
        seg = part.column("seg")[0].as_py() if len(part) else 0
        first = seg * segment
        turns = part.column("turns").combine_chunks()
        if isinstance(turns, pa.ChunkedArray):
            turns = pa.concat_arrays(turns.chunks)
        offsets, flat = turns.offsets.to_numpy().tolist(), turns.values
        z1, z2 = flat.field("z1").to_numpy(zero_copy_only=False).tolist(), flat.field("z2").to_numpy(zero_copy_only=False).tolist()
        size = flat.field("bytes").to_numpy(zero_copy_only=False).tolist()
        postings: list[dict[tuple[int, int], int]] = []
        going: list[int] = []  # conversations that have a turn at this position
        tops: dict[tuple[int, int], int] = {}
        for i, at in enumerate(offsets[:-1]):
            bit = 1 << i
            for j in range(offsets[i + 1] - at):
                if j == len(postings):
                    postings.append({})
                    going.append(0)
                turn = (z1[at + j], z2[at + j])
                postings[j][turn] = postings[j].get(turn, 0) | bit
                going[j] |= bit
            top = (start1[i], start2[i])
            tops[top] = tops.get(top, 0) | bit
        self.nodes: list[tuple[int, int, int, int, int, int, int, int]] = []  # depth, key1, key2, parent1, parent2, bitset, above, bytes
        todo = []
        for (k1, k2), members in tops.items():
            if seg == 0:  # the root, of all conversations
                self.nodes.append((0, k1, k2, 0, 0, members, -1, 0))
                todo.append((0, members, k1, k2, 0))
            else:  # a node of the segment before
                todo.append((0, members, k1, k2, -1))
        while todo:
            j, members, k1, k2, above = todo.pop()
            left = members & going[j] if j < len(postings) else 0
            while left:
                i = (left & -left).bit_length() - 1
                at = offsets[i] + j
                child = left & postings[j][(z1[at], z2[at])]
                left ^= child
                c1, c2 = k1 ^ z1[at], k2 ^ z2[at]
                todo.append((j + 1, child, c1, c2, len(self.nodes)))
                self.nodes.append((first + j + 1, c1, c2, k1, k2, child, above, size[at]))
        ended: dict[int, int] = {}
        for i, d in enumerate(depths):
            ended[d] = ended.get(d, 0) | 1 << i
        self.ended = ended

    def members(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.convs[low.bit_length() - 1])
            bits ^= low
        return out


def _nodes(segment: int):
    def run(part: pa.Table) -> pa.Table:
        walk, shard = Walk(part, segment), part.column("shard")[0].as_py() if len(part) else 0
        cols: list[list] = [[] for _ in _LOCAL.names]
        for depth, k1, k2, p1, p2, bits, _, size in walk.nodes:
            here = bits & walk.ended.get(depth, 0)
            row = (depth, k1, k2, p1, p2, bits.bit_count(), walk.convs[(bits & -bits).bit_length() - 1], shard, size,
                   walk.members(here) if here else None)
            for col, v in zip(cols, row):
                col.append(v)
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _LOCAL)], schema=_LOCAL)

    return run


def _subtree_sums(segment: int):
    """Per node of the group: leaves and savings that its members own at it and
    below, later segments included."""

    def run(part: pa.Table, owned: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in _SUMS.names]
        if len(part):
            walk = Walk(part, segment)
            own: dict[tuple[int, int], tuple[int, int]] = {}
            tails: dict[int, tuple[int, int]] = {}
            for conv, depth, leaf, weight in zip(*(owned.column(c).to_pylist() for c in ("owner", "at", "leaf", "weight"))):
                if depth is None:
                    tails[conv] = (leaf, weight)
                else:
                    own[(conv, depth)] = (leaf, weight)
            leaves, saved = [0] * len(walk.nodes), [0] * len(walk.nodes)
            last = (part.column("seg")[0].as_py() + 1) * segment
            for at in range(len(walk.nodes) - 1, -1, -1):
                depth, k1, k2, _, _, bits, above, _ = walk.nodes[at]
                leaf, weight = own.get((walk.convs[(bits & -bits).bit_length() - 1], depth), (0, 0))
                leaves[at] += leaf
                saved[at] += weight
                if depth == last and tails:
                    for conv in walk.members(bits):
                        leaf, weight = tails.get(conv, (0, 0))
                        leaves[at] += leaf
                        saved[at] += weight
                if above >= 0:
                    leaves[above] += leaves[at]
                    saved[above] += saved[at]
                for col, v in zip(cols, (depth, k1, k2, leaves[at], saved[at])):
                    col.append(v)
        return pa.Table.from_arrays([pa.array(c, type=pa.int64()) for c in cols], schema=_SUMS)

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per node from its chunks, which arrive together and in order."""
    now, digest = None, None

    def close():
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((*now, digest.hexdigest()), _ENDS)], schema=_ENDS)

    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        ids = batch.column(4)
        for at, key in enumerate(keys):
            text = ",".join(map(str, ids[at].as_py())).encode()
            if key == now:
                digest.update(b"," + text)
                continue
            if now is not None:
                yield close()
            now, digest = key, hashlib.sha256(text)
    if now is not None:
        yield close()


def rebuilt_turns(conversations: DataFrame, shard_convs: int) -> tuple[DataFrame, DataFrame]:
    """(conversations with their shard and depth, their rebuilt turns)."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = position_in(rows, ["conv"], [F.col("turn").asc_nulls_first(), "role", "text"], "place")
    turns = staged(placed.select(
        "conv", "place", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), "text", "role").alias("b"),
        F.octet_length("text").cast("long").alias("bytes")))
    counts = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    counts = counts.select(
        "conv", "own", (F.col("conv") - F.col("conv") % GROUP).alias("base"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED).alias("h"))
    bases = counts.select(F.col("conv").alias("b_conv"), F.col("own").alias("b_own"))
    counts = counts.join(bases, F.col("base") == F.col("b_conv"), "left").withColumn("taken", F.least("h", F.coalesce("b_own", F.lit(0))))
    convs = staged(with_position(
        counts.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")),
        ["conv"], "_place").withColumn("shard", F.floor(F.col("_place") / shard_convs)).drop("_place"))
    opening = turns.where((F.col("place") < SHARED) & (F.col("conv") % GROUP == 0)).withColumnRenamed("conv", "from")
    shared = convs.join(opening, (F.col("from") == F.col("base")) & (F.col("place") < F.col("h"))).select(
        "shard", "conv", "total", F.col("place").alias("pos"), "a", "b", "bytes")
    own = turns.join(convs, "conv").where("place >= h").select(
        "shard", "conv", "total", (F.col("place") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "bytes")
    return convs, shared.unionByName(own)


def prefix_trie(conversations: DataFrame, shard_convs: int = 1024, segment: int = 256) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 per node of the trie of rebuilt conversations."""
    if shard_convs < 1 or segment < 1:
        raise ValueError("shard_convs and segment must be positive")
    convs, turns = rebuilt_turns(conversations, shard_convs)
    turn = F.struct("pos", F.xxhash64("pos", "a", "b").alias("z1"), F.xxhash64("b", "pos", "a").alias("z2"), "bytes")
    # every conversation has its first segment, with or without turns
    held = convs.select("shard", "conv", "total", F.lit(0).cast("long").alias("seg"), F.lit(None).alias("turn")).unionByName(
        turns.select("shard", "conv", "total", F.floor(F.col("pos") / segment).alias("seg"), turn.alias("turn")))
    packed = held.groupBy("shard", "conv", "total", "seg").agg(
        F.sort_array(F.collect_list("turn")).alias("turns"),  # at most `segment` turns; nulls are left out
        F.coalesce(F.bit_xor("turn.z1"), F.lit(0)).alias("x1"), F.coalesce(F.bit_xor("turn.z2"), F.lit(0)).alias("x2"))
    before = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(packed.select(
        "shard", "conv", "total", "seg", F.transform("turns", lambda t: F.struct(t.z1, t.z2, t.bytes)).alias("turns"),
        F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("start1"), F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("start2")))

    local = staged(parts.groupBy("shard", "seg").applyInArrow(_nodes(segment), LOCAL))
    nodes = local.groupBy(*KEY).agg(
        F.sum("n").alias("n"), F.min("conv").alias("conv"), F.min("shard").alias("shard"),  # shards are in the order of ids
        F.max("parent1").alias("parent1"), F.max("parent2").alias("parent2"), F.max("bytes").alias("bytes"))
    nodes = staged(nodes)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent1").alias("key1"), F.col("parent2").alias("key2")).agg(
        F.count(F.lit(1)).alias("children"))
    nodes = staged(nodes.join(children, KEY, "left"))

    owned = nodes.select(
        "shard", F.floor((F.greatest("depth", F.lit(1)) - 1) / segment).alias("seg"), F.col("conv").alias("owner"), F.col("depth").alias("at"),
        F.col("children").isNull().cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("bytes")).alias("weight"),
    ).where("leaf > 0 or weight > 0")
    # what a conversation of several segments owns in the later ones, for each segment but the last
    long = parts.where(F.col("total") > segment).select("shard", "conv", "seg")
    per_part = owned.groupBy(F.col("owner").alias("conv"), "seg").agg(F.sum("leaf").alias("leaf"), F.sum("weight").alias("weight"))
    later = Window.partitionBy("conv").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    tails = long.join(per_part, ["conv", "seg"], "left").select(
        "shard", "seg", F.col("conv").alias("owner"), F.lit(None).cast("long").alias("at"),
        F.coalesce(F.sum("leaf").over(later), F.lit(0)).alias("leaf"), F.coalesce(F.sum("weight").over(later), F.lit(0)).alias("weight"),
    ).where("leaf > 0 or weight > 0")
    everything = owned.unionByName(tails).select(F.col("shard").alias("of"), F.col("seg").alias("part"), "owner", "at", "leaf", "weight")
    sums = parts.groupBy("shard", "seg").cogroup(everything.groupBy("of", "part")).applyInArrow(_subtree_sums(segment), SUMS)
    sums = sums.groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    chunks = local.where("ends is not null").select(*KEY, "shard", "ends")
    ends = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "shard").mapInArrow(_hash_ends, ENDS)

    above = nodes.select(
        (F.col("depth") + 1).alias("u_depth"), F.col("key1").alias("u1"), F.col("key2").alias("u2"), F.col("conv").alias("parent_conv_id"))
    found = nodes.join(sums, KEY).join(ends, KEY, "left")
    found = found.join(above, (F.col("depth") == F.col("u_depth")) & (F.col("parent1") == F.col("u1")) & (F.col("parent2") == F.col("u2")), "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
        F.coalesce("children", F.lit(0)).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"))
