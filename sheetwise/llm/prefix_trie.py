"""Trie of conversation prefixes, its subtree totals found by time-forward processing.

A node stands for a distinct sequence of first turns (role, text). A prefix's key is a digest of its length and of four sums of 32-bit hashes of (place, role, text) over its turns: sums
can be taken over parts of a conversation, so turns are dealt by range and a conversation of any length is spread over tasks. Equal keys are taken as equal sequences (128 bits of hash).

Totals travel from nodes to their parents. Nodes are sorted by Spark in reverse level order (deepest first, then by member); a task goes through its nodes once, takes from a priority queue the messages that were
sent to a node, and sends the node's totals to its parent. The queue is ordered like the nodes, and beyond ``QUEUE`` messages it writes sorted runs to an unnamed file of the task, which it merges on reading.
The trie is cut into shards before: a node whose members have more than ``limit`` turns from it on is heavy. Light subtrees are whole within a task; as a heavy node has heavy ancestors only, what
the tops of light subtrees send is summed by Spark for each heavy node. Heavy nodes are cut into bands of ``BAND`` levels below one ancestor each; bands are worked on by themselves, then the totals of their roots are passed between
the roots alone (a row for each band), and last the bands again with what their roots' children have sent. So neither a hot prefix, nor a group of copies, nor one endless conversation is one task's work.

``ends_sha256`` is a hash over one sequence of ids, which cannot be split: the ids are sorted and spelled out in many tasks, and one streams a node's pieces of text into the hash.

Edge cases: null roles and texts count as empty, rows without conv_id are left out. Turns are ordered by turn (null first), ties by a digest of role and text; repeated rows are turns of their own. An empty
table gives no rows. Very long texts are digested where they are read; only digests and lengths are shuffled. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import whole_text
from sheetwise.operators.nearest import small
from sheetwise.runtime import cut, scratch, ship

#: Levels of a band of heavy nodes, and messages that a queue holds in memory.
BAND, QUEUE = 100_000, 1 << 18
#: A heavy node has more than this share of a task's part of all turns.
SHARE = 4
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
LANES = ("k0", "k1", "k2", "k3")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, size`` (code points) of each turn."""
    role, text = (F.coalesce(whole_text(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    return turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("size"))


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, part, at, digest, size``: digested turns dealt by range, with their place from 1 among the turns of their conversation in their part.

    Parts ascend with the turns, and only neighbouring parts share a conversation.
    """
    # The last key splits rows that are equal in all others; which of them comes first makes no difference.
    rows = turns.withColumn("_row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(partitions(turns), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("_row")).withColumn("part", F.spark_partition_id())
    order = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return dealt.select("conv_id", "part", F.row_number().over(order).cast("long").alias("at"), "digest", "size")


def spread(parts: DataFrame, *sums: str) -> DataFrame:
    """Of ``(conv_id, part, sums)``, the conversations with several parts, and what the earlier parts have (``before_<sum>``): at most a row for each part, as a part can begin within one conversation only."""
    order = Window.partitionBy("conv_id").orderBy("part")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumns({"_first": F.min("part").over(Window.partitionBy("conv_id")), **{f"before_{s}": F.coalesce(F.sum(s).over(earlier), F.lit(0).cast("long")) for s in sums}})
    return rows.where("part > _first").select("conv_id", "part", *[f"before_{s}" for s in sums])


def rebuilt_turns(turns: DataFrame, base: Column, shared: Column, most_shared: int) -> DataFrame:
    """``conv_id, length, d, part, digest, size``: turns of rebuilt conversations, and a row with d = 0 for each conversation.

    The first ``shared`` (at most ``most_shared``) turns are those of conversation ``base``, the others its own beyond its first ``shared``.
    """
    spark = turns.sparkSession
    own = cut(spark, numbered(turns))
    parts = own.groupBy("conv_id", "part").agg(F.max("at").alias("n"))
    before = F.broadcast(spread(parts, "n"))
    placed = own.join(before, ["conv_id", "part"], "left").withColumn("pos", F.col("at") + F.coalesce("before_n", F.lit(0))).drop("at", "before_n")
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("n"), F.min("part").alias("first")).withColumns({"base": base, "h": shared})
    given = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    have = F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))
    convs = convs.join(given, "base", "left").withColumn("have", have).withColumn("length", F.col("have") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).select("conv_id", "base", "h", "have", "length", "first")
    convs = cut(spark, convs)
    top = convs.select("conv_id", "length", F.lit(0).cast("long").alias("d"), F.col("first").alias("part"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("size"))
    heads = placed.where(F.col("pos") <= most_shared).select(F.col("conv_id").alias("base"), "pos", "digest", "size")
    head = convs.join(heads, "base").where("pos <= h").select("conv_id", "length", F.col("pos").alias("d"), F.col("first").alias("part"), "digest", "size")
    tail = placed.join(convs, "conv_id").where("pos > h").select("conv_id", "length", (F.col("pos") - F.col("h") + F.col("have")).alias("d"), "part", "digest", "size")
    return top.unionByName(head).unionByName(tail)


def keyed_turns(rebuilt: DataFrame) -> DataFrame:
    """``conv_id, length, d, size, key, up``: each rebuilt turn with the keys of its prefix and of the prefix before it."""
    spark = rebuilt.sparkSession
    a, b = (F.xxhash64(F.lit(salt), "d", "digest") for salt in (1, 2))
    lanes = {"k0": F.shiftrightunsigned(a, 32), "k1": a.bitwiseAND(0xFFFFFFFF), "k2": F.shiftrightunsigned(b, 32), "k3": b.bitwiseAND(0xFFFFFFFF)}
    hashed = rebuilt.withColumns({k: F.when(F.col("d") == 0, F.lit(0).cast("long")).otherwise(v) for k, v in lanes.items()})
    order = Window.partitionBy("conv_id", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.select("conv_id", "length", "d", "part", "size", *LANES, *[F.sum(k).over(order).alias(f"s{k}") for k in LANES])
    summed = cut(spark, summed)
    parts = summed.groupBy("conv_id", "part").agg(*[F.sum(k).alias(k) for k in LANES])
    rows = summed.join(F.broadcast(spread(parts, *LANES)), ["conv_id", "part"], "left")
    at = {k: F.col(f"s{k}") + F.coalesce(f"before_{k}", F.lit(0).cast("long")) for k in LANES}
    key = lambda d, values: F.unhex(F.md5(F.concat_ws(",", d.cast("string"), *[v.cast("string") for v in values])))
    before = key(F.col("d") - 1, [at[k] - F.col(k) for k in LANES])
    return rows.select("conv_id", "length", "d", "size", key(F.col("d"), list(at.values())).alias("key"), F.when(F.col("d") > 0, before).alias("up"))


def _runs(keys: list) -> Iterator[tuple[int, int]]:
    """Bounds of runs of equal keys."""
    cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
    return zip(cuts, cuts[1:])


def ends_hashes(slots: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of nodes at which conversations end: their ids, ascending.

    Ids are dealt by range, so those of a hot node are sorted and spelled out by many tasks; one task then streams the node's pieces of text, in their order, into the hash.
    """
    ship(slots.sparkSession)
    many = partitions(slots)
    ends = slots.where("d = length").select("key", "conv_id").repartitionByRange(many, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id())

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, b in enumerate(batches):
            keys, ids, parts = (c.to_pylist() for c in b.columns)
            runs = list(_runs(keys)) if keys else []
            texts = [",".join(map(str, ids[s:e])) for s, e in runs]
            yield pa.record_batch(
                [pa.array([keys[s] for s, _ in runs], pa.binary()), pa.array([parts[s] for s, _ in runs], pa.int32()), pa.array([n] * len(runs), pa.int64()), pa.array(texts, pa.string())], names=["key", "part", "n", "text"]
            )

    pieces = ends.mapInArrow(spell, "key binary, part int, n long, text string").repartition(many, "key").sortWithinPartitions("key", "part", "n").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for b in batches:
            done = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key == now:
                    state.update(b"," + text.encode())
                    continue
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(text.encode())
            yield pa.record_batch([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["key", "ends_sha256"])
        if now is not None:
            yield pa.record_batch([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    return pieces.mapInArrow(run, "key binary, ends_sha256 string")


class MessageQueue:
    """Messages (level, member, leaves, saved, children), least (level, member) first; beyond ``most`` they go to sorted runs in an unnamed file."""

    ROW = struct.Struct("<qqqqq")
    READ = 4096

    def __init__(self, most: int = QUEUE):
        self.most, self.heap, self.file, self.runs, self.spills = most, [], None, [], 0

    def push(self, message: tuple[int, int, int, int, int]) -> None:
        if len(self.heap) >= self.most:
            self._spill()
        heapq.heappush(self.heap, message)

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # a task's own, like Spark's spill files: gone with it
        self.heap.sort()
        begin = self.file.seek(0, os.SEEK_END)
        self.file.write(b"".join(self.ROW.pack(*m) for m in self.heap))
        self.heap = []
        run = self._run(begin, self.file.tell())
        heapq.heappush(self.runs, (next(run), self.spills, run))
        self.spills += 1

    def _run(self, at: int, end: int) -> Iterator[tuple]:
        step = self.READ * self.ROW.size
        while at < end:
            self.file.seek(at)
            raw = self.file.read(min(step, end - at))
            at += len(raw)
            yield from self.ROW.iter_unpack(raw)

    def take(self, level: int, member: int) -> tuple[int, int, int]:
        """Sums of leaves, saved and children of the messages to a node; messages to earlier nodes are dropped."""
        leaves = saved = children = 0
        node = (level, member)
        while True:
            in_heap = bool(self.heap) and (not self.runs or self.heap[0] <= self.runs[0][0])
            head = self.heap[0] if in_heap else self.runs[0][0] if self.runs else None
            if head is None or head[:2] > node:
                return leaves, saved, children
            if head[:2] == node:
                leaves, saved, children = leaves + head[2], saved + head[3], children + head[4]
            if in_heap:
                heapq.heappop(self.heap)
            else:
                _, i, run = heapq.heappop(self.runs)
                following = next(run, None)
                if following is not None:
                    heapq.heappush(self.runs, (following, i, run))


NODE = "depth long, conv_id long, parent_conv_id long, shard binary, top boolean, leaves long, saved long, children long"


def pass_up(nodes: DataFrame, by: str | None = "shard", most: int = QUEUE) -> DataFrame:
    """Totals of each node's subtree within its shard.

    ``nodes``: depth, conv_id, parent_conv_id, shard, top (of its shard), and what a node has by itself or from outside: leaves, saved, children. A node without children is a leaf. Returns the same columns with totals;
    a shard's top sends nothing, as its parent is in another one. ``by`` None puts all nodes into one shard.
    """
    ship(nodes.sparkSession)
    columns = [c.split()[0] for c in NODE.split(", ")]
    dealt = nodes.select(columns)
    dealt = (dealt.repartition(partitions(nodes), by) if by else dealt.repartition(1)).sortWithinPartitions(F.col("depth").desc(), "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = MessageQueue(most)
        for b in batches:
            out = ([], [], [])
            for depth, conv, up, top, leaves, saved, children in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6, 7))):
                more = queue.take(-depth, conv)
                children += more[2]
                leaves = leaves + more[0] if children else 1
                saved += more[1]
                for column, v in zip(out, (leaves, saved, children)):
                    column.append(v)
                if not top and up is not None:
                    queue.push((1 - depth, up, leaves, saved, 1))
            yield pa.record_batch([*b.columns[:5], *[pa.array(c, pa.int64()) for c in out]], names=columns)

    return dealt.mapInArrow(run, NODE)


def prefix_nodes(slots: DataFrame) -> DataFrame:
    """A row for each node: key, up, depth, conv_id, n_convs, own saved tokens, and the turns of its members from it on."""
    return slots.groupBy("key").agg(
        F.min("up").alias("up"), F.min("d").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size"), F.sum(F.col("length") - F.col("d") + 1).alias("weight")
    )


def _sent(tops: DataFrame) -> DataFrame:
    """Messages of shards' tops, summed for each node that they are sent to."""
    parent = (F.col("depth") - 1).alias("depth")
    return tops.where("parent_conv_id is not null").groupBy(parent, F.col("parent_conv_id").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count(F.lit(1)).alias("more_children"))


def _with(nodes: DataFrame, sent: DataFrame) -> DataFrame:
    more = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved", "children")}
    return nodes.join(sent, ["depth", "conv_id"], "left").withColumns(more).drop(*[f"more_{c}" for c in more])


def subtree_totals(nodes: DataFrame, slots: DataFrame, limit: int | None = None, band: int = BAND, most: int = QUEUE) -> DataFrame:
    """``depth, conv_id, parent_conv_id, n_children, n_leaves, saved_tokens`` for the :func:`prefix_nodes` of :func:`keyed_turns`."""
    spark = nodes.sparkSession
    if limit is None:
        total = nodes.agg(F.sum("n_convs")).first()[0] or 0
        limit = max(64, total // (SHARE * partitions(nodes)))
    zero = F.lit(0).cast("long")
    with scratch(spark) as own:
        heavy = own(nodes.where(F.col("weight") > limit).select("key"))
        # How deep the heavy part of each conversation's path goes; the node below it is the top of a light subtree.
        deep = slots.join(small(heavy), "key").groupBy("conv_id").agg(F.max("d").alias("deep"))
        paths = slots.select("conv_id", "d", "key").join(deep, "conv_id", "left").withColumn("deep", F.coalesce("deep", F.lit(-1).cast("long")))
        tops = paths.where("d = deep + 1").select("conv_id", "deep", F.col("key").alias("light"))
        bands = paths.where(f"d <= deep and d % {band} = 0").select("conv_id", F.expr(f"d div {band}").alias("band"), F.col("key").alias("shard"))
        parents = nodes.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
        saved = ((F.col("n_convs") - 1) * F.col("size")).alias("saved")
        rows = nodes.join(parents, "up", "left").select("depth", "conv_id", "parent_conv_id", zero.alias("leaves"), saved, zero.alias("children")).join(tops, "conv_id", "left")
        rows = own(rows.withColumn("is_light", F.coalesce(F.col("depth") > F.col("deep"), F.lit(False))))
        light = own(pass_up(rows.where("is_light").withColumns({"shard": F.col("light"), "top": F.expr("depth = deep + 1")}), most=most))
        upper = rows.where("not is_light").withColumns({"band": F.expr(f"depth div {band}"), "top": F.expr(f"depth % {band} = 0")}).join(bands, ["conv_id", "band"])
        upper = own(_with(upper, _sent(light.where("top"))))
        # Bands by themselves, where a node knows how many children it has in the next band, but not their totals.
        below = _sent(upper.where("top")).withColumns({"more_leaves": zero, "more_saved": zero})
        roots = own(pass_up(_with(upper, below), most=most).where("top").withColumn("band", F.expr(f"depth div {band}")))
        # The roots, each below the root of the band that holds its parent.
        above = upper.select((F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("shard").alias("over"))
        names = roots.select(F.col("shard").alias("over"), F.col("conv_id").alias("over_conv_id"))
        linked = roots.join(above, ["depth", "parent_conv_id"], "left").join(names, "over", "left")
        linked = linked.select(F.col("band").alias("depth"), "conv_id", F.col("over_conv_id").alias("parent_conv_id"), "shard", F.lit(False).alias("top"), "leaves", "saved", F.lit(1).cast("long").alias("children"))
        between = pass_up(linked, None, most).select(F.col("depth").alias("band"), "conv_id", "leaves", "saved")
        whole = roots.drop("leaves", "saved").join(between, ["band", "conv_id"])
        # The bands again, with all that their nodes' children have.
        ended = pass_up(_with(upper, _sent(whole)), most=most)
        every = light.unionByName(ended)
        return cut(spark, every.select("depth", "conv_id", "parent_conv_id", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")))


def shared_prefix(conv_id: Column) -> tuple[Column, Column]:
    """(base, shared): a conversation begins with the first crc32(conv_id as text) % 6 turns of the first one of its hundred."""
    return conv_id - conv_id % 100, F.crc32(conv_id.cast("string")) % 6


def prefix_trie(turns: DataFrame, limit: int | None = None, band: int = BAND, most: int = QUEUE) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    slots = cut(spark, keyed_turns(rebuilt_turns(digests(turns), *shared_prefix(F.col("conv_id")), 5)))
    nodes = cut(spark, prefix_nodes(slots))
    totals = subtree_totals(nodes, slots, limit, band, most)
    named = nodes.join(ends_hashes(slots), "key", "left").select("depth", "conv_id", "n_convs", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
    return named.join(totals, ["depth", "conv_id"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
