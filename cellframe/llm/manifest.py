"""Merkle manifest of a dataset by time-forward processing.

The leaves of each group (a source), in the order of their keys, are the lowest level of a
tree in which every ``FANOUT`` consecutive nodes, fewer at the end, become the hash of their
digests; what remains is the group's subroot. Subroots in the order of their groups make the
root in the same way.

Nodes are labelled by level and place, so that a parent's label follows its children's. A node
sends its digest to its parent through a priority queue ordered by the receiver's label and
takes its own messages from there when its label is due; the reversed sweep sends each node
the part of the proof above it, which the node hands on with the siblings of each child. The
queue is external: Spark's sort delivers messages between blocks of ``BLOCK`` nodes, each
sorted ahead of the nodes that take it, and a task keeps a heap for the one block that it
sweeps. So a task holds one block, a hot group is many blocks, and each round of sweeps
shrinks the table by ``BLOCK``. Every round is a written table.

Groups and keys may be null and come first. Rows of equal key stand in the order of their
leaves; repeated rows are leaves of their own. An empty table has no rows in the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage_cut import cut
from ..functions.ordered import ranged

#: children of a node, and nodes that a task sweeps together
FANOUT = 16
BLOCK = FANOUT ** 3

NODES = "g string, n long, pos long, hash string"
MESSAGES = "g string, pos long, suffix array<string>, subroot string, root string"


def leaf_hash(*columns: Column) -> Column:
    """Digest of a row: each value as its UTF-8 length, a colon and its text, or a dash where it is null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def upward(hashes: list[str], height: int) -> list[list[str]]:
    """Levels of the tree over ``hashes``, each node's digest delivered to its parent in label order."""
    levels: list[list[str]] = [hashes] + [[] for _ in range(height)]
    queue = [(1, i // FANOUT, i, h) for i, h in enumerate(hashes)]  # in label order, so already a heap
    while queue[0][0] <= height:
        level, node = queue[0][:2]
        run = []
        while queue and queue[0][:2] == (level, node):
            run.append(heappop(queue)[3])
        levels[level].append(digest("".join(run)))
        heappush(queue, (level + 1, node // FANOUT, node, levels[level][-1]))
    return levels


def downward(levels: list[list[str]], suffix: tuple[str, ...]) -> Iterator[tuple[int, tuple[str, ...]]]:
    """(place, proof) of the lowest nodes; a proof has the siblings to the left and to the right of each level, lowest first."""
    queue: list[tuple[int, int, tuple[str, ...]]] = [(1 - len(levels), 0, suffix)]
    while queue:
        level, node, proof = heappop(queue)
        if not level:
            yield node, proof
            continue
        run = levels[-level - 1][node * FANOUT: (node + 1) * FANOUT]
        for j in range(len(run)):
            heappush(queue, (level + 1, node * FANOUT + j, ("".join(run[:j]), "".join(run[j + 1:]), *proof)))


def folded(leaf: str, proof: tuple[str, ...]) -> str:
    """The root that follows from a leaf and its proof."""
    for left, right in zip(proof[::2], proof[1::2]):
        leaf = digest(left + leaf + right)
    return leaf


def _height(n: int) -> int:
    """Levels above the lowest one of a block, in a group of ``n`` nodes."""
    height = 0
    while FANOUT ** height < min(n, BLOCK):
        height += 1
    return height


def _blocks(batches) -> Iterator[list[dict]]:
    """The rows of one block after the other."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["g"], row["block"]) != key:
                if rows:
                    yield rows
                key, rows = (row["g"], row["block"]), []
            rows.append(row)
    if rows:
        yield rows


def _swept(rows: DataFrame, sweep: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Apply ``sweep`` to the sorted rows of each block."""
    dealt = rows.repartition("g", "block").sortWithinPartitions("g", "block", "pos")
    names = [c.split()[0] for c in schema.split(", ")]
    lists = [c.split()[1] == "array<string>" for c in schema.split(", ")]
    kinds = [pa.list_(pa.string()) if many else pa.int64() if c.split()[1] == "long" else pa.string() for c, many in zip(schema.split(", "), lists)]

    def run(batches):
        out: list[tuple] = []
        for block in _blocks(batches):
            out += sweep(block)
            if len(out) >= BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return dealt.mapInArrow(run, schema)


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))


def _up(block: list[dict]) -> list[tuple]:
    n = block[0]["n"]
    return [(block[0]["g"], -(-n // BLOCK), block[0]["block"], upward([r["hash"] for r in block], _height(n))[-1][0])]


def _opened(block: list[dict]) -> Iterator[tuple[dict, dict, tuple[str, ...]]]:
    """(message, node, proof) of a block whose message stands ahead of its nodes."""
    message, *nodes = block
    levels = upward([r["hash"] for r in nodes], _height(nodes[0]["n"]))
    for place, proof in downward(levels, tuple(message["suffix"])):
        yield message, nodes[place], proof


def _down(block: list[dict]) -> list[tuple]:
    return [(m["g"], r["pos"], list(proof), m["subroot"], m["root"]) for m, r, proof in _opened(block)]


def _proved(block: list[dict]) -> list[tuple]:
    return [(r["g"], r["pos"], m["subroot"], m["root"], digest("".join(proof)), folded(r["claim"] or r["hash"], proof)) for m, r, proof in _opened(block)]


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their place ``pos`` in their group ``g`` and the group's number of rows ``n``; hot groups are spread over range partitions."""
    placed = ranged(rows, "g", *order)
    per = placed.groupBy("g", "_part").agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy("g")
    per = per.select("g", "_part", F.sum("_n").over(group).alias("n"),
                     F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("g", "_part").orderBy(*order)) - 1
    return placed.join(per, ["g", "_part"]).select(*rows.columns, "n", (F.col("_before") + inside).cast("long").alias("pos"))


def climb(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of nodes at every ``BLOCK``-th level, and (g, level, hash) of the subroots; ``level`` is the last table that has the group."""
    tables, done = [leaves.select("g", "n", "pos", "hash")], []
    while True:
        level = cut(_swept(_in_blocks(tables[-1]), _up, NODES))
        done.append(level.where("n = 1").select("g", F.lit(len(tables) - 1).alias("level"), "hash"))
        if level.where("n > 1").isEmpty():
            break
        tables.append(level.where("n > 1"))
    roots = done[0]
    for more in done[1:]:
        roots = roots.union(more)
    return tables, roots


def _met(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Nodes in blocks, with the message of each block ahead of them."""
    ahead = messages.select("g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "suffix", "subroot", "root")
    return _in_blocks(nodes).unionByName(ahead, allowMissingColumns=True)


def descend(tables: list[DataFrame], roots: DataFrame) -> DataFrame:
    """Messages for the blocks of the lowest table; ``roots`` has (g, level, suffix, subroot, root) of each group."""
    messages = None
    for level in range(len(tables) - 1, -1, -1):
        own = roots.where(F.col("level") == level).select("g", F.lit(0).cast("long").alias("pos"), "suffix", "subroot", "root")
        messages = own if messages is None else own.union(cut(_swept(_met(tables[level + 1], messages), _down, MESSAGES)))
    return messages


def prove(rows: DataFrame, *, group: str = "source", key: str = "doc_id", leaf: str = "leaf", claim: str = "claim") -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of all rows.

    ``claim`` is the digest that a row is verified with, its leaf where it is null. The proof's
    hash is over the siblings' digests from the lowest level to the root, left to right.
    """
    named = rows.select(F.col(key).alias("key"), F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("-")).alias("g"), F.col(leaf).alias("hash"),
                        F.col(claim).alias("claim"))
    leaves = cut(ranked(named, "key", "hash"))
    tables, subroots = climb(leaves)
    subroots = cut(subroots)
    tops = cut(ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("part"), "level", "hash"), "part"))
    above, root = climb(tops)
    whole = root.select("g", "level", F.array().cast("array<string>").alias("suffix"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    sent = cut(_swept(_met(above[0], descend(above, whole)), _down, MESSAGES))
    opened = tops.join(sent.select("pos", "suffix", "root"), "pos").select(F.col("part").alias("g"), "level", "suffix", F.col("hash").alias("subroot"), "root")
    proofs = _swept(_met(leaves.select("g", "n", "pos", "hash", "claim"), descend(tables, cut(opened))), _proved,
                    "g string, pos long, subroot string, root string, proof_sha256 string, folded_root string")
    out = leaves.select("g", "pos", F.col("key").alias(key), "hash").join(proofs, ["g", "pos"])
    return out.select(key, F.col("hash").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
