"""Prefix trie of conversations by Van Emde Boas recursion: sequences are cut at half depth until one turn is left.

A block is a range of depths below one prefix. Cut at its half, its distinct first halves make the upper trie, and what
follows each of them is a lower trie of its own; both are cut again, and all blocks of one size are worked on at once. So
there are as many rounds as the logarithm of the longest sequence, and none depends on how many turns one has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from loamgraph.operators.fold import ordered_fold

#: A conversation takes the first turns, up to MOST_SHARED of them, of the one that begins its run of RUN ids.
RUN, MOST_SHARED = 5, 8
#: Ids that are joined to one piece before a node's ids are hashed.
PIECE = 4096
NO_ENDS = hashlib.sha256().hexdigest()


def _shared(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)


def _numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, n_bytes): turns in their order, from one. Rows are dealt by range and counted where they
    lie, so a conversation of any length is spread; what its earlier parts hold is added: one row a part at most."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    both = F.concat(F.octet_length(empty("role")).cast("string"), F.lit(":"), empty("role"), empty("text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(F.sha2(both.cast("binary"), 256), 1, 32)).alias("digest"), F.octet_length(empty("text")).cast("long").alias("n_bytes")
    ).where("conv_id is not null")
    dealt = rows.repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            ids = batch["conv_id"].to_numpy()
            if not len(ids):
                continue
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            at = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)])) + 1
            if ids[0] == last:
                at[: starts[1] if len(starts) > 1 else len(ids)] += seen
            last, seen = ids[-1], at[-1]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array(at), batch["digest"], batch["n_bytes"], batch["part"]], ["conv_id", "at", "digest", "n_bytes", "part"])

    counted = dealt.select("conv_id", "digest", "n_bytes", F.spark_partition_id().alias("part"))
    local = cut(counted.mapInArrow(count, "conv_id long, at long, digest binary, n_bytes long, part int"))
    parts = local.groupBy("conv_id", "part").agg(F.max("at").alias("n"))
    # only the first conversation of a part can have begun in an earlier one
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.sum("n").over(earlier)).where("offset > 0").drop("n")
    return local.join(F.broadcast(offsets), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("offset", F.lit(0))).alias("pos"), "digest", "n_bytes")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, h1, h2, n_bytes) and sequences (conv_id, n) of the rebuilt conversations. h1 and h2 stand for a
    role and text at their place, so what they give by exclusive or stands for a whole prefix."""
    turns = cut(_numbered(conversations))
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    begun = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    plan = sizes.withColumns({"base": F.col("conv_id") - F.col("conv_id") % RUN, "h": _shared(F.col("conv_id"))}).join(begun, "base", "left")
    plan = cut(plan.select("conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"), "own"))
    own = turns.where(F.col("pos") > _shared(F.col("conv_id"))).join(plan.select("conv_id", "h", "taken"), "conv_id")
    heads = turns.where((F.col("pos") <= MOST_SHARED) & (F.col("conv_id") % RUN == 0)).withColumnRenamed("conv_id", "base")
    taken = plan.select("conv_id", "base", "taken").where("taken > 0").join(heads, "base").where("pos <= taken")
    rows = own.withColumn("pos", F.col("pos") - F.col("h") + F.col("taken")).select("conv_id", "pos", "digest", "n_bytes").unionByName(taken.select("conv_id", "pos", "digest", "n_bytes"))
    hashed = {"h1": F.xxhash64("digest", "pos"), "h2": F.xxhash64("pos", "digest")}
    lengths = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    return cut(rows.withColumns(hashed).drop("digest")), cut(lengths)


def _halves(turns: DataFrame, level: int) -> DataFrame:
    """(conv_id, block, s1, s2) of the first half of each block of 2 ** level depths; turns combine before the shuffle."""
    depth = F.col("pos") - 1
    first = turns.where(F.shiftright(depth, level - 1).bitwiseAND(F.lit(1)) == 0)
    return first.groupBy("conv_id", F.shiftright(depth, level).alias("block")).agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))


def _split(rows: DataFrame, turns: DataFrame, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (conv_id, n, block, r1, r2, members, l1, l2) of blocks of 2 ** level depths, cut at the half: those of the halves,
    the cut ones, and the distinct cuts.

    A row is a sequence in a block below prefix r. Either it ends in the block (l is null), or it goes through to prefix l
    and stands for so many members. Sequences that go through the first half alike become one row of the upper trie.
    """
    middle = F.col("block") * (1 << level) + (1 << (level - 1))
    through = F.col("l1").isNotNull() | (F.col("n") >= middle)
    halved = rows.where(through).join(_halves(turns, level), ["conv_id", "block"])
    halved = cut(halved.withColumns({"c1": F.col("r1").bitwiseXOR(F.col("s1")), "c2": F.col("r2").bitwiseXOR(F.col("s2"))}).drop("s1", "s2"))
    cuts = cut(halved.groupBy("block", "r1", "r2", "c1", "c2").agg(F.min("conv_id").alias("conv_id"), F.sum("members").alias("members")))
    none = F.lit(None).cast("long")
    upper = cuts.select("conv_id", none.alias("n"), (F.col("block") * 2).alias("block"), "r1", "r2", "members", F.col("c1").alias("l1"), F.col("c2").alias("l2"))
    ended = rows.where(~through).withColumn("block", F.col("block") * 2)
    lower = halved.select("conv_id", "n", (F.col("block") * 2 + 1).alias("block"), F.col("c1").alias("r1"), F.col("c2").alias("r2"), "members", "l1", "l2")
    return upper.unionByName(ended).unionByName(lower), halved, cuts


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _forests(below: DataFrame, cuts: DataFrame) -> DataFrame:
    """Totals (block, r1, r2, leaves, saved) of whole blocks, from those of their halves: the upper one's own, and those of
    the lower ones that hang at its cuts."""
    upper = below.where("block % 2 = 0").withColumn("block", F.shiftright("block", 1))
    lower = below.where("block % 2 = 1").select(F.shiftright("block", 1).alias("block"), F.col("r1").alias("c1"), F.col("r2").alias("c2"), "leaves", "saved")
    hung = lower.join(cuts.select("block", "r1", "r2", "c1", "c2"), ["block", "c1", "c2"]).select(below.columns)
    return _summed(upper.unionByName(hung), "block", "r1", "r2")


def _grafted(above: DataFrame | None, below: DataFrame, halved: DataFrame) -> DataFrame:
    """What is added to prefixes (block, l1, l2) at the ends of half-size blocks and to all above them in their block: the
    totals of the lower tries that hang there, and what is added at the ends of whole blocks (``above``), which goes to
    the end of the lower half and, through the cut, to the end of the upper one."""
    added = below.where("block % 2 = 1").select((F.col("block") - 1).alias("block"), F.col("r1").alias("l1"), F.col("r2").alias("l2"), "leaves", "saved")
    if above is None:
        return added
    ways = halved.where("l1 is not null").select("block", "l1", "l2", "c1", "c2")
    upper = above.join(ways, ["block", "l1", "l2"]).select((F.col("block") * 2).alias("block"), F.col("c1").alias("l1"), F.col("c2").alias("l2"), "leaves", "saved")
    lower = above.withColumn("block", F.col("block") * 2 + 1)
    return _summed(added.unionByName(upper).unionByName(lower), "block", "l1", "l2")


class Hashing:
    """SHA-256 of a node's pieces of ids, in order."""

    def __init__(self):
        self.node, self.hash = None, hashlib.sha256()

    def add(self, row: dict) -> list[dict]:
        if self.node is not None:
            self.hash.update(b",")
        self.node = row
        self.hash.update(row["piece"].encode())
        return []

    def end(self) -> list[dict]:
        return [{"depth": self.node["depth"], "l1": self.node["l1"], "l2": self.node["l2"], "ends_sha256": self.hash.hexdigest()}]


def _ends(ended: DataFrame) -> DataFrame:
    """(depth, l1, l2, ends_sha256) from ``ended`` (depth, l1, l2, conv_id). Ids are joined to pieces where a range of them
    lies; the hash, which can only be taken in order, goes over pieces."""
    names = ["depth", "l1", "l2"]

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.stack([batch[n].to_numpy() for n in names])
            if not node.shape[1]:
                continue
            starts = np.flatnonzero(np.r_[True, (node[:, 1:] != node[:, :-1]).any(axis=0)])
            bounds = np.r_[starts, node.shape[1]]
            spans = [(i, min(i + PIECE, stop)) for start, stop in zip(bounds[:-1], bounds[1:], strict=True) for i in range(start, stop, PIECE)]
            ids = batch["conv_id"].to_pylist()
            first = np.array([i for i, _ in spans])
            pieces = pa.array([",".join(map(str, ids[i:j])) for i, j in spans], pa.string())
            yield pa.RecordBatch.from_arrays([*(pa.array(x[first]) for x in node), batch["conv_id"].take(pa.array(first)), pieces], [*names, "first", "piece"])

    dealt = ended.repartitionByRange(*names, "conv_id").sortWithinPartitions(*names, "conv_id")
    pieces = dealt.select(*names, "conv_id").mapInArrow(joined, "depth long, l1 long, l2 long, first long, piece string")
    return ordered_fold(pieces, names, ["first"], Hashing, "depth long, l1 long, l2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt ``conversations`` (conv_id, turn, role, text): a row per node, that is per distinct sequence of first
    turns, the textless root included.

    conv_id is the smallest member (a conversation that begins so), depth the number of turns, parent_conv_id the
    parent's conv_id, n_convs the members, n_children the nodes one turn longer, n_leaves the childless nodes in the
    subtree, saved_tokens the sum over the subtree of each node's (n_convs - 1) times UTF-8 bytes of its last text, and
    ends_sha256 the hash of the ids of members that end there, ascending and joined by commas.

    Turns are in the order of ``turn``, nulls first, ties by a digest of role and text, so repeated rows are turns of
    their own. Null roles and texts are empty. Rows without a conv_id belong to none and are passed over; no rows give
    no root. Other columns are ignored.
    """
    turns, sequences = rebuilt(conversations)
    total = sequences.agg(F.count("*").alias("n"), F.max("n").alias("longest"), F.min("conv_id").alias("first")).first()
    levels = int(total.longest or 0).bit_length()
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    rows = sequences.select("conv_id", "n", zero.alias("block"), zero.alias("r1"), zero.alias("r2"), F.lit(1).cast("long").alias("members"), none.alias("l1"), none.alias("l2"))
    halves = {}
    for level in range(levels, 0, -1):
        rows, halved, cuts = _split(rows, turns, level)
        halves[level] = halved, cuts

    last = turns.select("conv_id", (F.col("pos") - 1).alias("block"), "n_bytes")
    nodes = rows.where("l1 is not null").drop("n").join(last, ["conv_id", "block"]).withColumn("depth", F.col("block") + 1)
    children = nodes.groupBy(F.col("block").alias("depth"), F.col("r1").alias("l1"), F.col("r2").alias("l2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["depth", "l1", "l2"], "left").na.fill(0, ["n_children"])
    nodes = cut(nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("members") - 1) * F.col("n_bytes")}))

    forests = {0: _summed(nodes, "block", "r1", "r2")}
    for level in range(1, levels + 1):
        forests[level] = cut(_forests(forests[level - 1], halves[level][1]))
    added = None
    for level in range(levels, 0, -1):
        added = cut(_grafted(added, forests[level - 1], halves[level][0]))
    if added is not None:
        more = added.select(F.col("block").alias("block"), "l1", "l2", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
        nodes = nodes.join(more, ["block", "l1", "l2"], "left").na.fill(0, ["more_leaves", "more_saved"])
        nodes = nodes.withColumns({"leaves": F.col("leaves") + F.col("more_leaves"), "saved": F.col("saved") + F.col("more_saved")})

    root = _summed(forests[levels]).select(
        F.lit(total.first).cast("long").alias("conv_id"), zero.alias("depth"), zero.alias("l1"), zero.alias("l2"), none.alias("r1"), none.alias("r2"),
        F.lit(total.n).alias("members"), F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"),
    ).where(F.lit(total.n > 0))
    root = root.join(children.where("depth = 0").select("depth", "n_children"), "depth", "left").na.fill(0, ["n_children"])
    columns = ["conv_id", "depth", "l1", "l2", "r1", "r2", "members", "n_children", "leaves", "saved"]
    every = nodes.select(columns).unionByName(root.select(columns))

    named = nodes.select((F.col("depth") + 1).alias("depth"), F.col("l1").alias("r1"), F.col("l2").alias("r2"), F.col("conv_id").alias("above"))
    every = every.join(named, ["depth", "r1", "r2"], "left").join(_ends(rows.where("l1 is null").select(F.col("block").alias("depth"), F.col("r1").alias("l1"), F.col("r2").alias("l2"), "conv_id")), ["depth", "l1", "l2"], "left")
    parent = F.when(F.col("depth") == 1, F.lit(total.first)).otherwise(F.col("above")).cast("long")
    return every.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), F.col("members").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
