"""Conversation prefix trie: what conversations share, and what sharing saves, by time-forward processing.

A turn's hash of 128 bits depends on its role, text and place; the exclusive or of the first d of them names a
prefix, so prefixes are windows over (conversation, block of turns) with what earlier
blocks add, however long a conversation is. Nodes are counted by their names.

A node and its children share a smallest member once at each level, so the trie falls into paths: all nodes with
one smallest member, from a top down to that member's end. Subtree totals go up time-forward over
the tree of paths: paths are sorted by descending level of their tops (children first), each takes what has
been sent to it from a priority queue, adds its own and sends the total on to the path that it hangs on. Light paths
(at most `light` members) go in shards of whole subtrees below a heavy path; each shard is one queue, which
spills runs when it is full. What shard roots have is summed by the heavy path above and
a last queue takes the heavy ones: with light = max(LIGHT, prefixes / MAX_HEAVY) they are MAX_HEAVY at most, as each one
has more than `light` members with a turn of their own at its level. Inside a path totals are sums from its end
upwards, again windows over blocks.

Ids of a node's ends are joined in chunks of CHUNK ids before a task streams them through SHA-256, which can't be split.

Null roles and texts are empty. A null turn comes first; rows of one turn are ordered by role, then by a hash of the
text. Rows without conv_id belong to no conversation and are left out. Repeated rows are turns
of their own. Texts may be empty or very long. An empty table has no root. Only the named columns
are read, so further columns may have any names.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import jobs

#: A rebuilt conversation begins with up to SHARED - 1 turns of the first of its FAMILY.
FAMILY, SHARED = 100, 6
BLOCK, CHUNK = 1024, 256
LIGHT, MAX_HEAVY = 256, 1_000_000
QUEUED = 1 << 18

NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


class SpillingQueue:
    """A priority queue of (level, path, leaves, saved), highest level first, then least path; full, it spills a sorted run.

    Runs lie in an unnamed file of the task that goes with it; nobody else reads it and a lost task begins anew.
    """

    RECORD = struct.Struct("<4q")

    def __init__(self, most: int = QUEUED):
        self.most, self.heap, self.runs = most, [], []

    def push(self, level: int, path: int, leaves: int, saved: int) -> None:
        if len(self.heap) >= self.most:
            run = tempfile.TemporaryFile()
            for item in sorted(self.heap):
                run.write(self.RECORD.pack(*item))
            run.seek(0)
            self.heap = []
            self._open(run)
        heapq.heappush(self.heap, (-level, path, leaves, saved))

    def _open(self, run) -> None:
        if head := run.read(self.RECORD.size):
            heapq.heappush(self.runs, (self.RECORD.unpack(head), id(run), run))
        else:
            run.close()

    def take(self, level: int, path: int) -> tuple[int, int]:
        """Sums of all that was sent to a path; all before it in the order has been taken."""
        leaves = saved = 0
        while True:
            of_run = bool(self.runs) and (not self.heap or self.runs[0][0] < self.heap[0])
            if not (self.heap or of_run) or (self.runs[0][0] if of_run else self.heap[0])[:2] != (-level, path):
                return leaves, saved
            if of_run:
                item, _, run = heapq.heappop(self.runs)
                self._open(run)
            else:
                item = heapq.heappop(self.heap)
            leaves, saved = leaves + item[2], saved + item[3]


def forward(paths: Iterator[tuple], most: int = QUEUED) -> Iterator[tuple]:
    """(path, leaves, saved) with all totals from (shard, path, top, parent, parent_top, leaves, saved) by shard, descending top, path.

    parent_top is None where the parent isn't in the shard.
    """
    for _, shard in itertools.groupby(paths, lambda row: row[0]):
        queue = SpillingQueue(most)
        for _, path, top, parent, parent_top, leaves, saved in shard:
            more, further = queue.take(top, path)
            leaves, saved = leaves + more, saved + further
            if parent_top is not None:
                queue.push(parent_top, parent, leaves, saved)
            yield path, leaves, saved


def _totals(paths: DataFrame, most: int) -> DataFrame:
    """forward() over partitions that hold whole shards in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = forward(rows, most)
        while out := list(itertools.islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["conv_id", "leaves", "saved"])

    sent = paths.select("shard", "conv_id", "top", "parent", "parent_top", "leaves", "saved").sortWithinPartitions("shard", F.desc("top"), "conv_id")
    return sent.mapInArrow(run, "conv_id long, leaves long, saved long")


def prefixes(conversations: DataFrame, block: int = BLOCK, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(the prefixes of all rebuilt conversations: conv_id, d, name (p1, p2), name of the one before (q1, q2), chars, last; all conversations: conv_id, turns)."""
    c = lambda name: F.col(f"`{name}`")
    rows = conversations.filter(c(conv_col).isNotNull()).select(c(conv_col).cast("long").alias("conv_id"), c(turn_col).alias("turn"), F.coalesce(c(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(c(text_col), F.lit("")).alias("text"))
    number = F.coalesce(F.floor(F.col("turn") / block).cast("long"), F.lit(-(1 << 62)))
    rows = jobs.materialize(rows.select("conv_id", "turn", "role", number.alias("block"), F.xxhash64("role", "text").alias("e1"), F.xxhash64(F.lit(1), "text", "role").alias("e2"), F.length("text").cast("long").alias("chars")), "turns")

    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")).select("conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"), F.sum("n").over(whole).alias("turns"), F.min("block").over(whole).alias("first_block"))
    blocks = jobs.materialize(blocks, "blocks")
    convs = blocks.filter("block = first_block").select("conv_id", "turns", "first_block", (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % SHARED).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    bases = convs.filter("conv_id = base").select("base", F.col("turns").alias("base_turns"))
    convs = convs.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_turns", F.lit(0)))).withColumn("length", F.col("lent") + F.greatest(F.col("turns") - F.col("h"), F.lit(0)))
    convs = jobs.materialize(convs.select("conv_id", "base", "h", "lent", "length", "first_block"), "conversations")

    known = blocks.select("conv_id", "block", "ahead").join(convs.select("conv_id", "h", "lent", "length"), "conv_id")
    in_block = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "e1", "e2")
    own = rows.join(known, ["conv_id", "block"]).withColumn("at", F.col("ahead") + F.row_number().over(in_block))
    own = jobs.materialize(own.select("conv_id", "block", "at", "h", "lent", "length", "e1", "e2", "chars"), "own-turns")
    heads = own.filter((F.col("at") < SHARED) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "at", "e1", "e2", "chars")
    lent = convs.filter("lent > 0").join(heads, "base").filter("at <= lent").select("conv_id", F.col("first_block").alias("block"), F.col("at").alias("d"), "length", "e1", "e2", "chars")
    kept = own.filter("at > h").select("conv_id", "block", (F.col("at") - F.col("h") + F.col("lent")).alias("d"), "length", "e1", "e2", "chars")
    made = lent.unionByName(kept).select("conv_id", "block", "d", "length", "chars", F.xxhash64("e1", "d").alias("x1"), F.xxhash64("d", "e2").alias("x2"))

    long = blocks.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id")
    if not long.isEmpty():
        made = jobs.materialize(made, "rebuilt")
        sums = made.join(long, "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
        before = sums.select("conv_id", "block", *[F.expr(f"bit_xor({y}) OVER (PARTITION BY conv_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias(y) for y in ("y1", "y2")])
        made = made.join(before, ["conv_id", "block"], "left")
    else:
        made = made.withColumns({"y1": F.lit(0).cast("long"), "y2": F.lit(0).cast("long")})
    upto = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    name = lambda k: F.bit_xor(f"x{k}").over(upto).bitwiseXOR(F.coalesce(f"y{k}", F.lit(0).cast("long")))
    made = made.withColumns({"p1": name(1), "p2": name(2)})
    made = made.select("conv_id", "d", "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "chars", (F.col("d") == F.col("length")).alias("last"))
    return jobs.materialize(made, "prefixes"), convs.select("conv_id", F.col("length").alias("turns"))


def _ends(ends: DataFrame) -> DataFrame:
    """p1, p2, ends_sha256 of (p1, p2, conv_id): chunks of ids first, then one stream a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out = []
        for (p1, p2), chunks in itertools.groupby(rows, lambda row: row[:2]):
            state = hashlib.sha256(next(chunks)[2].encode())
            for chunk in chunks:
                state.update(b",")
                state.update(chunk[2].encode())
            out.append((p1, p2, state.hexdigest()))
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["p1", "p2", "ends_sha256"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["p1", "p2", "ends_sha256"])

    chunks = ends.groupBy("p1", "p2", F.expr(f"conv_id div {CHUNK}").alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    chunks = chunks.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "chunk")
    return chunks.select("p1", "p2", "ids").mapInArrow(run, "p1 long, p2 long, ends_sha256 string")


def trie(conversations: DataFrame, block: int = BLOCK, light: int = LIGHT, queued: int = QUEUED, **names: str) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations: NODE."""
    found, convs = prefixes(conversations, block, **names)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(zero.alias("p1"), zero.alias("p2"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("chars"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"))
    nodes = found.groupBy("p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.first("d").alias("depth"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"), F.first("q1").alias("q1"), F.first("q2").alias("q2"))
    nodes = jobs.materialize(nodes.withColumn("depth", F.col("depth").cast("long")).unionByName(root), "nodes")
    ends = found.filter("last").select("p1", "p2", "conv_id").unionByName(convs.filter("turns = 0").select(zero.alias("p1"), zero.alias("p2"), "conv_id"))
    children = nodes.filter("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    none = hashlib.sha256(b"").hexdigest()
    nodes = nodes.join(children, ["p1", "p2"], "left").join(_ends(ends), ["p1", "p2"], "left").withColumns({"n_children": F.coalesce("n_children", zero), "ends_sha256": F.coalesce("ends_sha256", F.lit(none))})
    # The root's children, which may be very many, need no join: their parent is known. The others' may be split by AQE.
    top = nodes.filter("depth = 0").select(F.col("conv_id").alias("root_conv_id"))  # one row
    above = nodes.filter("depth > 0 AND n_children > 0").select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.filter("depth > 1").join(above, ["q1", "q2"], "left").unionByName(
        nodes.filter("depth <= 1").crossJoin(F.broadcast(top)).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("root_conv_id"))).drop("root_conv_id"))
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "own": (F.col("n_convs") - 1) * F.col("chars")})
    nodes = jobs.materialize(nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "leaf", "own", "ends_sha256"), "known-nodes")

    paths = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("n_convs").alias("members"), F.min_by("parent_conv_id", "depth").alias("parent"), F.sum("leaf").alias("leaves"), F.sum("own").alias("saved"), F.max("depth").alias("bottom"), F.count("*").alias("n"))
    paths = jobs.materialize(paths, "paths")
    sizes = paths.agg(F.sum("n").alias("n"), F.max("bottom").alias("deepest")).first()
    totals = _path_totals(paths, max(light, (found.count() if sizes["n"] else 0) // MAX_HEAVY), queued)

    sent = totals.join(paths.select("conv_id", "parent", "top"), "conv_id").filter("top > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    nodes = nodes.join(sent, ["conv_id", "depth"], "left").withColumns({"block": F.expr(f"depth div {block}"), "leaves": F.col("leaf") + F.coalesce("leaves", zero), "saved": F.col("own") + F.coalesce("saved", zero)})
    if (sizes["deepest"] or 0) >= block:
        nodes = jobs.materialize(nodes, "summed-nodes")
        later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        below = nodes.groupBy("conv_id", "block").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).select("conv_id", "block", F.sum("leaves").over(later).alias("more"), F.sum("saved").over(later).alias("further"))
        nodes = nodes.join(below, ["conv_id", "block"])
    else:
        nodes = nodes.withColumns({"more": zero, "further": zero})
    rest = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.withColumns({"n_leaves": F.sum("leaves").over(rest) + F.coalesce("more", zero), "saved_tokens": F.sum("saved").over(rest) + F.coalesce("further", zero)})
    return nodes.select(*NODE)


def _path_totals(paths: DataFrame, light: int, queued: int) -> DataFrame:
    """conv_id, leaves, saved of whole subtrees, by path: light ones in shards, then the heavy ones."""
    heavy = jobs.materialize(paths.filter((F.col("members") > light) | (F.col("top") == 0)), "heavy-paths")  # MAX_HEAVY rows at most
    small = paths.filter((F.col("members") <= light) & (F.col("top") > 0)).join(F.broadcast(heavy.select(F.col("conv_id").alias("parent"), F.lit(True).alias("root"))), "parent", "left")
    small = jobs.materialize(small.select("conv_id", "top", "parent", "leaves", "saved", F.coalesce("root", F.lit(False)).alias("root")), "light-paths")
    # Shards: the light path below a heavy one, found by pointer jumping; no path has more than `light` branches here.
    above = small.select(F.col("conv_id").alias("parent"), F.col("top").alias("parent_top"))
    shards = jobs.materialize(small.join(above, "parent", "left").withColumn("parent_top", F.when(~F.col("root"), F.col("parent_top"))).withColumn("shard", F.when(F.col("root"), F.col("conv_id")).otherwise(F.col("parent"))), "shards")
    while not shards.filter(~F.col("root")).isEmpty():
        ahead = shards.select(F.col("conv_id").alias("shard"), F.col("shard").alias("next"), F.col("root").alias("there"))
        shards = jobs.materialize(shards.join(ahead, "shard").withColumns({"shard": F.col("next"), "root": F.col("there")}).drop("next", "there"), "shards")
    done = jobs.materialize(_totals(shards.repartition("shard"), queued), "light-totals")

    sent = done.join(paths.select("conv_id", F.col("parent").alias("up")), "conv_id").join(F.broadcast(heavy.select(F.col("conv_id").alias("up"))), "up", "left_semi").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("further"))
    own = heavy.join(sent, "conv_id", "left").join(heavy.select(F.col("conv_id").alias("parent"), F.col("top").alias("parent_top")), "parent", "left")
    zero = F.lit(0).cast("long")
    own = own.withColumns({"shard": zero, "leaves": F.col("leaves") + F.coalesce("more", zero), "saved": F.col("saved") + F.coalesce("further", zero)})
    return done.unionByName(_totals(own.coalesce(1), queued))
