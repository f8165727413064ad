"""Prefix trie of conversations; subtree totals by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.shared import text_or_empty, written
from ledgerloom.scale import small_side

#: Turns that one sort or running sum covers at most (turn numbers, for a sort by turn).
CHUNK = 4096
#: The ids that one string joins differ in these last bits only.
ID_BITS = 16
#: Shards of light subtrees are meant to be so many for each partition.
SHARDS_PER_PARTITION = 4
#: Messages that a queue holds in memory.
QUEUE_ROWS = 200_000
_SUMS = ("w0", "w1", "w2", "w3")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, role, text..)`` with ``pos`` from 1: by turn (null first), then role, then the text's digest.

    ``turns`` holds ``(conv_id, turn, role, digest, size)``.  Turns are ranked within CHUNK turn numbers, so a
    conversation of very many turns is not sorted by one task.
    """
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62)).cast("bigint"))
    rows = turns.withColumn("_null", F.col("turn").isNotNull()).withColumn("_chunk", chunk)
    before = W.partitionBy("conv_id").orderBy("_null", "_chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "_null", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("conv_id", "_null", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy("conv_id", "_null", "_chunk").orderBy("turn", "role", "digest"))
    ranked = rows.withColumn("_rank", rank)
    return ranked.join(offsets, ["conv_id", "_null", "_chunk"]).select(
        "conv_id", (F.col("_before") + F.col("_rank")).alias("pos"), "role", "digest", "size"
    )


def rebuilt(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``(conv_id, d, role, digest, size)``: every conversation c with the first h turns of conversation c - c % 100.

    ``conversations`` holds ``(conv_id, h, base)``; after the borrowed turns come its own after its first h.  A
    base lends to at most a hundred conversations, and never more than five turns.
    """
    lent = turns.where("pos <= 5").withColumnRenamed("conv_id", "base")
    borrowed = conversations.join(lent, "base").where(F.col("pos") <= F.col("h"))
    count = turns.where("pos <= 5").groupBy(F.col("conv_id").alias("base")).agg(F.max("pos").alias("_there"))
    own = conversations.join(count, "base", "left").select(
        "conv_id", "h", F.least(F.col("h"), F.coalesce("_there", F.lit(0))).alias("_lent")
    )
    kept = turns.join(own, "conv_id").where(F.col("pos") > F.col("h"))
    place = F.col("_lent") + F.col("pos") - F.col("h")
    columns = ["role", "digest", "size"]
    return borrowed.select("conv_id", F.col("pos").cast("bigint").alias("d"), *columns).unionByName(
        kept.select("conv_id", place.cast("bigint").alias("d"), *columns)
    )


def _words(column: Column) -> list[Column]:
    """The four 32-bit words of a 128-bit digest in hex."""
    return [F.conv(F.substring(column, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(name) for i, name in enumerate(_SUMS)]


def memberships(turns: DataFrame) -> DataFrame:
    """``(conv_id, d, node, parent, size)``: the nodes that each conversation goes through, below the root.

    A node is named by a digest of its depth and the sum of the digests of ``(depth, role, text)`` along its
    path.  Sums may be taken in chunks and put together, so a very long conversation needs no single task.
    """
    each = turns.select(
        "conv_id", "d", "size", F.floor((F.col("d") - 1) / CHUNK).alias("_chunk"),
        *_words(F.md5(F.concat_ws("|", F.col("d").cast("string"), F.md5(F.encode("role", "utf-8")), "digest").cast("binary"))),
    )
    whole = each.groupBy("conv_id", "_chunk").agg(*[F.sum(x).alias(f"_{x}") for x in _SUMS])
    earlier = W.partitionBy("conv_id").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    before = whole.select(
        "conv_id", "_chunk", *[F.coalesce(F.sum(f"_{x}").over(earlier), F.lit(0)).alias(f"_{x}") for x in _SUMS]
    ).where(F.col("_chunk") > 0)
    upto = W.partitionBy("conv_id", "_chunk").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    running = each.select("conv_id", "d", "size", "_chunk", *_SUMS, *[F.sum(x).over(upto).alias(f"s{x}") for x in _SUMS])
    total = running.join(before, ["conv_id", "_chunk"], "left").select(
        "conv_id", "d", "size", *_SUMS, *[(F.col(f"s{x}") + F.coalesce(f"_{x}", F.lit(0))).alias(f"s{x}") for x in _SUMS]
    )
    name = lambda d, sums: F.md5(F.concat_ws(",", d.cast("string"), *sums).cast("binary"))
    node = name(F.col("d"), [F.col(f"s{x}") for x in _SUMS])
    parent = name(F.col("d") - 1, [F.col(f"s{x}") - F.col(x) for x in _SUMS])
    return total.select("conv_id", "d", node.alias("node"), parent.alias("parent"), "size")


#: Name of the root: depth 0 and sums of nothing.
ROOT = hashlib.md5(b"0,0,0,0,0").hexdigest()


class _Queue:
    """Messages ``(depth, node, leaves, saved)``, deepest first; beyond ``most`` they go to sorted runs on disk.

    The runs are unnamed scratch of one task attempt, as the files of a spilling sort are.
    """

    def __init__(self, most: int):
        self.most, self.heap, self.runs, self.made = most, [], [], 0

    def push(self, depth: int, node: str, leaves: int, saved: int) -> None:
        heapq.heappush(self.heap, (-depth, node, leaves, saved))
        if len(self.heap) >= self.most:
            file = tempfile.TemporaryFile()
            for first in range(0, len(rows := sorted(self.heap)), 1000):
                pickle.dump(rows[first : first + 1000], file)
            file.seek(0)
            self.heap = []
            run = self._read(file)
            self.made += 1
            heapq.heappush(self.runs, (next(run), self.made, run))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def pull(self, depth: int, node: str) -> tuple[int, int, int]:
        """Messages, leaves and saved tokens sent to ``node``, which no deeper message may precede."""
        n, leaves, saved = 0, 0, 0
        while True:
            head = self.heap[0] if self.heap else None
            far = self.runs[0][0] if self.runs else None
            best = min((x for x in (head, far) if x is not None), default=None)
            if best is None or best[:2] != (-depth, node):
                assert best is None or best[:2] > (-depth, node), "a message for a node that is not here"
                return n, leaves, saved
            if best is head:
                heapq.heappop(self.heap)
            else:
                _, place, run = self.runs[0]
                after = next(run, None)
                if after is None:
                    heapq.heappop(self.runs)
                else:
                    heapq.heapreplace(self.runs, (after, place, run))
            n, leaves, saved = n + 1, leaves + best[2], saved + best[3]


_TOTALS = "node string, n_children long, n_leaves long, saved_tokens long"


def forward_totals(nodes: DataFrame, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """``(node, n_children, n_leaves, saved_tokens)`` of all nodes of each partition's forest.

    ``nodes`` holds ``(node, parent, d, n_convs, size, sent, leaves, saved)`` in reverse level order within a
    partition (deepest first, then by name), with every descendant of a node in its partition or already
    summed up in ``sent`` (children), ``leaves`` and ``saved``.  Each node takes its messages from the queue
    and passes its totals on; messages to parents elsewhere are left out (``top`` marks such nodes).
    """

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = _Queue(queue_rows)
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            out = []
            for node, parent, d, n_convs, size, sent, leaves, saved, top in zip(*columns, strict=True):
                n, more_leaves, more_saved = queue.pull(d, node)
                children = sent + n
                leaves = leaves + more_leaves if children else 1
                saved += more_saved + (n_convs - 1) * size
                if not top:
                    queue.push(d - 1, parent, leaves, saved)
                out.append((node, children, leaves, saved))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64())],
                ["node", "n_children", "n_leaves", "saved_tokens"],
            )

    names = ["node", "parent", "d", "n_convs", "size", "sent", "leaves", "saved", "top"]
    return nodes.select(*names).mapInArrow(forward, _TOTALS)


def subtree_totals(nodes: DataFrame, members: DataFrame, n_conversations: int) -> DataFrame:
    """:func:`forward_totals` of the whole trie: within shards first, then across the shards' roots.

    ``nodes (node, parent, d, conv_id, n_convs, size)`` has the root; ``members (conv_id, d, node)``.  A subtree
    in one conversation has one leaf and saves nothing, so only shared nodes are processed.  A node of more
    than some conversations is heavy; there are few, as each has so many memberships.  What hangs below the
    heavy nodes are the shards' trees, dealt out whole; their roots' totals, summed by parent, go to the last
    forest, the heavy nodes.
    """
    spark = nodes.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heavy_from = max(1, n_conversations // (SHARDS_PER_PARTITION * partitions))
    heavy = (F.col("n_convs") > heavy_from) | (F.col("d") == 0)
    single = nodes.where("n_convs = 1 AND d > 0")
    shared = nodes.where("n_convs > 1 OR d = 0").withColumn("_heavy", heavy)
    # Every child in one conversation is a leaf's path.
    lone = single.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("sent"))
    # The first node below the heavy ones, on the way of each node's smallest conversation.
    crowns = small_side(shared.where("_heavy").select("node"))
    deepest = members.join(crowns, "node", "left_semi").groupBy("conv_id").agg((F.max("d") + 1).alias("_cut"))
    light = shared.where("NOT _heavy")
    smallest = light.select("conv_id").distinct().join(deepest, "conv_id", "left").select("conv_id", F.coalesce("_cut", F.lit(1)).alias("_cut"))
    shard = members.join(smallest, "conv_id").where(F.col("d") == F.col("_cut")).select("conv_id", "_cut", F.col("node").alias("_shard"))
    light = light.join(lone, "node", "left").join(shard, "conv_id").select(
        "node", "parent", "d", "n_convs", "size", "_shard", F.coalesce("sent", F.lit(0)).alias("sent"),
        F.coalesce("sent", F.lit(0)).alias("leaves"), F.lit(0).cast("bigint").alias("saved"), (F.col("d") == F.col("_cut")).alias("top"),
    )
    dealt = light.repartition(partitions, "_shard").sortWithinPartitions(F.desc("d"), "node")
    below = written(forward_totals(dealt))
    roots = below.join(light.where("top").select("node", "parent"), "node")
    messages = roots.groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("sent"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    lone = lone.select("node", "sent", F.col("sent").alias("leaves"), F.lit(0).cast("bigint").alias("saved"))
    sums = [F.sum(x).alias(x) for x in ("sent", "leaves", "saved")]
    crown = shared.where("_heavy")
    messages = messages.unionByName(lone).join(small_side(crown.select("node")), "node", "left_semi").groupBy("node").agg(*sums)
    crown = crown.join(messages, "node", "left").select(
        "node", "parent", "d", "n_convs", "size", *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in ("sent", "leaves", "saved")],
        (F.col("d") == 0).alias("top"),
    )
    above = forward_totals(crown.repartition(1).sortWithinPartitions(F.desc("d"), "node"))
    return below.unionByName(above)


def end_digests(ends: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` over ``ends (conv_id, node)``: of the ids in ascending order, joined by commas.

    Ids are joined in blocks of a bounded number of conversations; the strings of a node with more than one
    block then pass one digest as a stream, in order.
    """
    blocks = ends.groupBy("node", F.shiftright("conv_id", ID_BITS).alias("_block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )
    first = F.when(F.row_number().over(W.partitionBy("node").orderBy("_block")) > 1, F.lit(",")).otherwise(F.lit(""))
    joined = blocks.select("node", "_block", F.concat(first, "ids").alias("ids"), F.count(F.lit(1)).over(W.partitionBy("node")).alias("_n"))
    one = joined.where("_n = 1").select("node", F.sha2(F.encode("ids", "utf-8"), 256).alias("ends_sha256"))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        done: list[tuple[str, str]] = []
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = name, hashlib.sha256()
                digest.update(ids.encode())
        if node is not None:
            done.append((node, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], ["node", "ends_sha256"])

    many = joined.where("_n > 1").repartition("node").sortWithinPartitions("node", "_block").select("node", "ids")
    return one.unionByName(many.mapInArrow(streamed, "node string, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations of ``conversations (conv_id, turn, role, text)``, one row per node.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: a node is a
    distinct sequence of first turns and named by its smallest conversation; n_leaves and saved_tokens sum over
    its subtree, itself included.  Turns go by number, null first; equal numbers by role, then by the text's
    md5, so repeated rows are turns of their own.  Null role or text is empty; rows with a null conv_id belong
    to no conversation and are left out; other columns are never read.  Texts may be of any length: only their
    digest and number of code points travel.  An empty table still has its root: conv_id null, no conversations,
    one leaf.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        text_or_empty("role").alias("role"), F.md5(F.encode(text_or_empty(), "utf-8")).alias("digest"),
        F.length(text_or_empty()).cast("bigint").alias("size"),
    )
    turns = written(numbered_turns(rows))
    ids = turns.select("conv_id").distinct().select(
        "conv_id", (F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % 6).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % 100).alias("base"),
    )
    ids = written(ids)
    members = written(memberships(rebuilt(turns, ids)))
    n, least = ids.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    below = members.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("d").alias("d"), F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"),
    )
    root = members.sparkSession.createDataFrame(
        [(ROOT, None, 0, least, n, 0)], "node string, parent string, d long, conv_id long, n_convs long, size long"
    )
    nodes = written(below.unionByName(root))
    totals = subtree_totals(nodes, members, n)
    last = members.groupBy("conv_id").agg(F.max_by("node", "d").alias("node"))
    ends = end_digests(ids.select("conv_id").join(last, "conv_id", "left").select("conv_id", F.coalesce("node", F.lit(ROOT)).alias("node")))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(totals, "node", "left").join(ends, "node", "left").join(parents, "parent", "left")
    # A subtree in one conversation: a path to its end.
    alone = (F.col("n_convs") == 1) & (F.col("d") > 0)
    end_of = hashlib.sha256(b"").hexdigest()
    return whole.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs",
        F.when(alone, F.when(F.col("ends_sha256").isNull(), F.lit(1)).otherwise(F.lit(0))).otherwise(F.col("n_children")).cast("bigint").alias("n_children"),
        F.when(alone, F.lit(1)).otherwise(F.col("n_leaves")).cast("bigint").alias("n_leaves"),
        F.when(alone, F.lit(0)).otherwise(F.col("saved_tokens")).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(end_of)).alias("ends_sha256"),
    )
