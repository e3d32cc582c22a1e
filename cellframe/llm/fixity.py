"""Fixity audit of web archives by Merkle trees over records and their offset ranges.

Pages become records of archive files: a header, the page and a blank line, one after the other
in the order of their ids. A leaf is the hash of a record's place, its offset range and its
bytes; a node is the hash of its ``FANOUT`` children in order, down to one root a file. Two
replicas are compared root by root, and only below nodes that differ are children compared, so
an audit of sound replicas reads one hash a file. What is left at the leaves locates the damage.

Every level is a written table of fixed-width rows; a step is one aggregation by node. Null
pages and urls are empty ones. Rows are ordered by id, url and content hash, so repeated rows
are records of their own; ids that are null make one file by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage_cut import cut

#: children of a node, and ids of an archive file
FANOUT, FILE = 16, 512


def record(url: Column, page: Column) -> Column:
    """The text of an archive record."""
    line = "\r\n"
    return F.concat(F.lit(f"WARC/1.0{line}WARC-Type: resource{line}WARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"{line}Content-Length: "),
                    F.octet_length(F.coalesce(page, F.lit(""))).cast("string"), F.lit(f"{line}{line}"), F.coalesce(page, F.lit("")), F.lit(f"{line}{line}"))


def manifest(pages: DataFrame, *, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """(file, place, id, start, stop, sha256) of the records; offsets count bytes, ``stop`` is exclusive."""
    body = record(F.col(url), F.col(text))
    rows = pages.select(F.coalesce(F.floor(F.col(key) / FILE), F.lit(-1)).cast("long").alias("file"), F.col(key).alias("id"), F.col(url).alias("url"),
                        F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("sha256"))
    order = W.partitionBy("file").orderBy("id", "url", "sha256")
    rows = rows.withColumn("place", (F.row_number().over(order) - 1).cast("long")).withColumn("stop", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.select("file", "place", "id", (F.col("stop") - F.col("size")).alias("start"), "stop", "sha256")


def tree(records: DataFrame, height: int) -> list[DataFrame]:
    """Levels of (file, node, start, stop, hash), leaves first, roots last."""
    leaf = F.sha2(F.concat_ws(":", "place", "start", "stop", "sha256"), 256)
    levels = [cut(records.select("file", F.col("place").alias("node"), "start", "stop", leaf.alias("hash")))]
    for _ in range(height):
        below = levels[-1].withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long"))
        children = F.array_sort(F.collect_list(F.struct("node", "start", "stop", "hash")))
        nodes = below.groupBy("file", "parent").agg(children.alias("c"))
        hashed = F.sha2(F.concat_ws(",", F.transform("c", lambda x: F.concat_ws(":", x["node"], x["start"], x["stop"], x["hash"]))), 256)
        levels.append(cut(nodes.select("file", F.col("parent").alias("node"), F.col("c")[0]["start"].alias("start"),
                                       F.element_at("c", -1)["stop"].alias("stop"), hashed.alias("hash"))))
    return levels


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, node) whose hashes differ, or that only one replica has."""
    both = a.select("file", "node", F.col("hash").alias("a"), F.lit(None).cast("string").alias("b")).union(
        b.select("file", "node", F.lit(None).cast("string"), "hash"))
    return both.groupBy("file", "node").agg(F.max("a").alias("a"), F.max("b").alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node")


def audit(own: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that differ between two manifests: file, place, offsets in either, hashes, and ``state``.

    ``state`` is "changed", "missing" (from the replica) or "extra" (in the replica only).
    """
    own, replica = cut(own), cut(replica)
    last = own.union(replica).agg(F.max("place").alias("m")).first().m or 0
    height = 1
    while FANOUT ** height <= last:
        height += 1
    left, right = tree(own, height), tree(replica, height)
    bad = cut(differing(left[-1], right[-1]))
    for a, b in zip(left[-2::-1], right[-2::-1]):
        above = bad.select("file", F.col("node").alias("parent"))
        below = lambda t: t.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long")).join(above, ["file", "parent"], "left_semi")
        bad = cut(differing(below(a), below(b)))
    bad = bad.withColumnRenamed("node", "place")
    found = bad.join(own, ["file", "place"], "left").join(
        replica.withColumnsRenamed({c: f"replica_{c}" for c in ("id", "start", "stop", "sha256")}), ["file", "place"], "left")
    state = F.when(F.col("replica_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "extra").otherwise("changed")
    return found.withColumn("state", state)
