"""Conversation prefix trie in tables of nodes under minimal perfect hashes.

A node is a distinct sequence of first turns. The digest of a prefix is the exclusive or of the
digests of its turns at their places (128 bits), so prefixes are summed in any pieces: a
conversation is cut into segments of ``SEGMENT`` turns, each with the digest of what stands
before it. Segments are dealt to shards of bounded size, whatever they share, so hot first
turns, copies and very long conversations are spread like others.

In a shard the distinct prefix digests get the slots of a minimal perfect hash, and each lookup
compares the digest stored in its slot. Counts are scattered into flat arrays, parents are an
array of slots. Spark sums the shards' tables by digest; then each node's value goes to the one
shard that holds its smallest member, is scattered into its slot, and sums run through the
parent slots from the deepest level up. Each shard gives its share of every prefix that it
holds, and Spark adds the shares. What a segment's later turns sum to arrives as one number.

Rows with a null conversation are left out. Turns stand in the order of ``turn`` (null first),
equal ones in that of their hashes; repeated rows are turns of their own. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage_cut import cut
from ..functions.ordered import running

#: turns of a segment, rows of a shard, and ids of a piece of a list
SEGMENT, SHARD, PIECE = 4096, 100_000, 256

_ODD = np.uint64(0x9E3779B97F4A7C15)


class Slots:
    """Minimal perfect hash of distinct pairs of longs: pairs alone in a cell of a level take it, the others go on to the next level."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, taken = np.arange(len(a)), 0
        slot = np.empty(len(a), np.int64)
        while len(left):
            size = max(8, 2 * len(left))
            at = self._cells(a[left], b[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = taken - 1 + np.cumsum(alone)
            self.levels.append((alone, rank))
            hit = alone[at]
            slot[left[hit]] = rank[at[hit]]
            taken += int(alone.sum())
            left = left[~hit]
        self.a, self.b = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
        self.a[slot], self.b[slot] = a, b

    @staticmethod
    def _cells(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (a.view(np.uint64) + np.uint64((2 * level + 1) * int(_ODD) % 2 ** 64)) ^ (b.view(np.uint64) >> np.uint64(level % 32))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) + b.view(np.uint64) * _ODD
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.a)

    def slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 for a pair that has none."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._cells(a[left], b[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        own = (out >= 0) & (self.a[out] == a) & (self.b[out] == b) if len(self) else np.zeros(len(a), bool)
        return np.where(own, out, -1)


class Shard:
    """The trie of a shard's segments as flat arrays by slot."""

    def __init__(self, rows: pa.Table):
        conv, i, d1, d2, size, end, mine = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)
                                            for c in ("conv", "i", "d1", "d2", "size", "end", "mine"))
        part = rows.column("part").combine_chunks().to_numpy()
        order = np.lexsort((i, part, conv))
        self.conv, self.part, i, d1, d2, size, self.end, mine = (x[order] for x in (conv, part, i, d1, d2, size, end, mine))
        first = np.ones(len(i), bool)
        first[1:] = (self.conv[1:] != self.conv[:-1]) | (self.part[1:] != self.part[:-1])
        starts = np.flatnonzero(first)
        unit = np.cumsum(first) - 1

        def prefix(d):
            upto = np.bitwise_xor.accumulate(d) if len(d) else d
            before = np.where(starts > 0, upto[starts - 1], 0)
            return upto ^ before[unit]

        self.a, self.b = prefix(d1), prefix(d2)
        by = np.lexsort((self.b, self.a))
        a, b = self.a[by], self.b[by]
        new = np.ones(len(by), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.table = Slots(a[new], b[new])
        self.slots = self.table.slot(self.a, self.b)
        self.last = np.append(starts[1:], len(i)) - 1
        n = len(self.table)
        self.parent, self.depth, self.size = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.above_a, self.above_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.members, self.least, self.owned = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, bool)
        after = np.flatnonzero(~first)
        self.above_a[self.slots[after]], self.above_b[self.slots[after]] = self.a[after - 1], self.b[after - 1]
        joined = after[mine[after - 1]]  # what follows the head of a segment hands nothing up here
        self.parent[self.slots[joined]] = self.slots[joined - 1]
        counted = self.slots[mine]
        self.depth[counted], self.size[counted] = i[mine], size[mine]
        np.add.at(self.members, counted, 1)
        np.minimum.at(self.least, counted, self.conv[mine])
        self.owned[counted] = True

    def summed(self, *values: np.ndarray) -> list[np.ndarray]:
        """Sums of values over subtrees, level by level from the deepest one up."""
        by = np.argsort(-self.depth, kind="stable")
        for level in np.split(by, np.flatnonzero(np.diff(self.depth[by])) + 1):
            level = level[self.parent[level] >= 0]
            for v in values:
                np.add.at(v, self.parent[level], v[level])
        return list(values)


PARTS = "kind int, d1 long, d2 long, p1 long, p2 long, depth long, n long, conv long, size long"
SHARES = "d1 long, d2 long, saved long, leaves long"


def _tables(rows: pa.Table) -> pa.Table:
    """The nodes of a shard (kind 0), and the conversations that end in a node (kind 1)."""
    s = Shard(rows)
    own = np.flatnonzero(s.owned)
    nodes = {"kind": np.zeros(len(own), np.int32), "d1": s.table.a[own], "d2": s.table.b[own], "p1": s.above_a[own],
             "p2": s.above_b[own], "depth": s.depth[own], "n": s.members[own], "conv": s.least[own], "size": s.size[own]}
    ends = np.flatnonzero(s.end)
    zero = np.zeros(len(ends), np.int64)
    last = {"kind": np.ones(len(ends), np.int32), "d1": s.a[ends], "d2": s.b[ends], "p1": zero, "p2": zero, "depth": zero, "n": zero, "conv": s.conv[ends], "size": zero}
    return pa.concat_tables([pa.table(nodes), pa.table(last)])


def _shares(rows: pa.Table, values: pa.Table) -> pa.Table:
    """A shard's share of each subtree's sums; a value without a digest belongs to the last turn of its segment."""
    s = Shard(rows)
    saved, leaves = np.zeros(len(s.table), np.int64), np.zeros(len(s.table), np.int64)
    conv, part, a, b, v, leaf, later = (values.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("conv", "part", "d1", "d2", "v", "leaf", "later"))
    at = s.table.slot(a[~later], b[~later])
    if (at < 0).any():
        raise ValueError("a node is missing in the shard of its smallest member")
    np.add.at(saved, at, v[~later])
    np.add.at(leaves, at, leaf[~later])
    ends = {(c, p): s.slots[k] for c, p, k in zip(s.conv[s.last], s.part[s.last], s.last)} if later.any() else {}
    for c, p, x, y in zip(conv[later], part[later], v[later], leaf[later]):
        saved[ends[c, p]] += x
        leaves[ends[c, p]] += y
    s.summed(saved, leaves)
    some = np.flatnonzero((saved != 0) | (leaves != 0))
    some = some[s.owned[some]]
    return pa.table({"d1": s.table.a[some], "d2": s.table.b[some], "saved": saved[some], "leaves": leaves[some]})


def rebuilt(turns: DataFrame, *, borrow: int = 5, every: int = 100) -> DataFrame:
    """(conv, i, h1, h2, size, end): turns of rebuilt conversations from 1 on, and one row of place 0 a conversation.

    A conversation c begins with the first h turns of the conversation c - c % ``every`` and goes
    on with its own after the first h; h is crc32 of the id as text, modulo ``borrow`` + 1.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"),
                                                     F.length(text).cast("long").alias("size"), F.lit(1).cast("long").alias("one"))
    placed = cut(running(rows, ["conv_id"], ["turn", "h1", "h2"], index="j", sums={"one": "upto"}, totals=True, span=SEGMENT).select(
        F.col("conv_id").alias("conv"), F.col("j"), "h1", "h2", "size", F.col("upto_all").alias("length")))
    first = F.col("conv") - F.col("conv") % every
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (borrow + 1)
    heads = placed.where((F.col("conv") % every == 0) & (F.col("j") <= borrow))
    lengths = heads.where("j = 1").select(F.col("conv").alias("base"), F.col("length").alias("_have"))
    taken = F.least("h", F.coalesce("_have", F.lit(0)))
    own = placed.withColumns({"base": first, "h": h}).join(lengths, "base", "left").withColumn("k", taken)
    own = own.withColumn("total", F.col("k") + F.greatest(F.col("length") - F.col("h"), F.lit(0)))
    ids = own.where("j = 1").select("conv", "base", "h", "total")
    given = ids.join(heads.select(F.col("conv").alias("base"), "j", "h1", "h2", "size"), "base").where("j <= h")
    zero = F.lit(0).cast("long")
    out = own.where("j > h").select("conv", (F.col("k") + F.col("j") - F.col("h")).alias("i"), "h1", "h2", "size", "total")
    out = out.union(given.select("conv", "j", "h1", "h2", "size", "total")).union(ids.select("conv", zero, zero, zero, zero, "total"))
    return out.select("conv", F.col("i").cast("long").alias("i"), "h1", "h2", "size", (F.col("i") == F.col("total")).alias("end"))


def _dealt(turns: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Rows with their segment and shard, the segments, and the shard of columns ``conv`` and ``part``."""
    part = F.floor(F.col("i") / SEGMENT).cast("long").alias("part")
    zero = F.lit(0).cast("long")
    at = lambda c, salt: F.when(F.col("i") == 0, zero).otherwise(F.xxhash64(F.lit(salt), "i", c))
    rows = cut(turns.select("conv", part, "i", at("h1", 2).alias("d1"), at("h2", 3).alias("d2"), "size", "end", F.lit(True).alias("mine")))
    n = rows.count()
    pieces = cut(rows.groupBy("conv", "part").agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2")))
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = pieces.select("conv", "part", F.bit_xor("d1").over(before).alias("d1"), F.bit_xor("d2").over(before).alias("d2")).where("part > 0")
    # what stands before a segment is its first row, and no member of its node
    heads = carried.select("conv", "part", (F.col("part") * SEGMENT - 1).alias("i"), "d1", "d2", zero.alias("size"), F.lit(False).alias("end"), F.lit(False).alias("mine"))
    shards = max(-(-n // SHARD), 2 * int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shard = F.pmod(F.xxhash64("conv", "part"), F.lit(shards))
    return cut(rows.union(heads).withColumn("shard", shard)), pieces, shard


def _ends(ends: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) over the ascending ids of each node; lists are joined in pieces by range and hashed as a stream."""
    sorted_rows = ends.repartitionByRange("d1", "d2", "conv").sortWithinPartitions("d1", "d2", "conv")

    def pieces(batches):
        for batch in batches:
            a, b, conv = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.ones(len(a), bool)
            cuts[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            group = np.maximum.accumulate(np.where(cuts, np.arange(len(a)), 0))
            starts = np.flatnonzero(cuts | ((np.arange(len(a)) - group) % PIECE == 0))
            stops = np.append(starts[1:], len(a))
            text = [",".join(map(str, conv[s:e].tolist())) for s, e in zip(starts, stops)]
            yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(conv[starts]), pa.array(text, pa.string())], names=["d1", "d2", "least", "ids"])

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "ids"))):
                if (a, b) == key:
                    state.update(b",")
                else:
                    out += [(*key, state.hexdigest())] if state else []
                    key, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            yield made(out)
        yield made([(*key, state.hexdigest())] if state else [])

    def made(rows):
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["d1", "d2", "ends_sha256"])

    joined = sorted_rows.mapInArrow(pieces, "d1 long, d2 long, least long, ids string")
    return joined.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "least").mapInArrow(hashed, "d1 long, d2 long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie over conversations (conv, i, h1, h2, size, end): see :func:`rebuilt`.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rows, pieces, shard = _dealt(turns)
    made = cut(rows.groupBy("shard").applyInArrow(_tables, PARTS))
    nodes = made.where("kind = 0").groupBy("d1", "d2").agg(*[F.first(c).alias(c) for c in ("p1", "p2", "depth", "size")], F.sum("n").alias("n"), F.min("conv").alias("conv"))
    nodes = cut(nodes)
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("children"))
    nodes = cut(nodes.join(children, ["d1", "d2"], "left").withColumn("children", F.coalesce("children", F.lit(0)).cast("long")))
    value, leaf = (F.col("n") - 1) * F.col("size"), (F.col("children") == 0).cast("long")
    values = nodes.select("conv", F.floor(F.col("depth") / SEGMENT).cast("long").alias("part"), "d1", "d2", value.alias("v"), leaf.alias("leaf"), F.lit(False).alias("later"))
    sums = values.groupBy("conv", "part").agg(F.sum("v").alias("v"), F.sum("leaf").alias("leaf"))
    # what a conversation's later segments sum to, also for segments in which it is no node's smallest member
    after = W.partitionBy("conv").orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    later = pieces.select("conv", "part").join(sums, ["conv", "part"], "left").select(
        "conv", "part", F.sum("v").over(after).alias("v"), F.sum("leaf").over(after).alias("leaf")).where("v <> 0 OR leaf <> 0")
    later = later.select("conv", "part", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    none = F.lit(0).cast("long")
    values = values.union(later.select("conv", "part", none, none, "v", "leaf", F.lit(True))).withColumn("shard", shard)
    shares = rows.groupBy("shard").cogroup(values.groupBy("shard")).applyInArrow(_shares, SHARES)
    totals = shares.groupBy("d1", "d2").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    above = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv").alias("parent"))
    out = nodes.join(totals, ["d1", "d2"], "left").join(_ends(made.where("kind = 1").select("d1", "d2", "conv")), ["d1", "d2"], "left").join(
        above, ["p1", "p2"], "left")
    long = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return out.select(F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"), long("n", "n_convs"),
                      long("children", "n_children"), long("leaves", "n_leaves"), long("saved", "saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
