"""Near duplicates: MinHash signatures, a multi-index Hamming join, and links confirmed on full shingle sets.

A document's set holds the hashes of its runs of ``n`` words (A to Z in lower case; with fewer
words, the whole sequence; without words, nothing, and then it has no link). Two documents are
linked if 100 * intersection >= percent * union.

1. **Signature.** The low 16 bits of ``4 * chunks`` minimum hashes. Documents of equal sets
   become one *node*.
2. **Multi-index Hamming join.** A signature is split into chunks of four components. Two
   signatures that differ in at most ``2 * chunks - 1`` components have, by the pigeonhole
   principle, a chunk with at most one difference, so they share one of the keys made from a
   chunk with one component left out: all pairs under that distance meet. ``chunks_for``
   takes enough chunks that a linked pair lies beyond it with probability under 1e-5.
3. **Stars first.** Every group of a key compares its members with one member, which each key
   draws anew. That joins large groups of copies without listing their pairs.
4. **The rest.** Only groups whose members still lie in several components go on, and only
   pairs across components count. A small group lists such pairs under the distance; a large
   one is dealt to pairs of blocks, and each task confirms its pairs itself and returns the
   links that join something new. No pair is lost and no group meets in one task.

Every text is read whole. Rows with null ids take part; ``component_id`` is the smallest
non-null id of the component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage_cut import cut
from .components import components
from .words import Words, mix, window_hash, words

#: components of a chunk
WIDE = 4
#: members up to which a group lists its pairs
SMALL = 64
#: members and shingles of a block of a large group, on average
BLOCK, BLOCK_SHINGLES = 2000, 2_000_000
#: probability that a pair at the very threshold lies beyond the signature distance
MISS = 1e-5


def chunks_for(percent: int) -> int:
    """Fewest chunks for which a pair of similarity ``percent``/100 differs in 2 * chunks - 1 components at most, but for MISS."""
    p = 1 - percent / 100
    for m in range(4, 40):
        k = WIDE * m
        if sum(math.comb(k, i) * p ** i * (1 - p) ** (k - i) for i in range(2 * m, k + 1)) <= MISS:
            return m
    raise ValueError("the similarity is too low for this join")


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, distinct sorted shingle hashes row by row) of one slice."""
    rows = len(w.ptr) - 1
    h, at = w.ngrams(n)
    row = w.row_of_word()[at] if len(at) else np.zeros(0, np.int64)
    count = np.diff(w.ptr)
    short = np.flatnonzero((count > 0) & (count < n))
    parts_h, parts_r = [h], [row]
    for size in np.unique(count[short]):
        r = short[count[short] == size]
        parts_h.append(mix(window_hash(w.hash, w.ptr[r], int(size)) + np.uint64(size)))
        parts_r.append(r)
    h, row = np.concatenate(parts_h), np.concatenate(parts_r)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.searchsorted(row[first], np.arange(rows + 1)), h[first]


def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return seeds[:k], seeds[k:] | np.uint64(1)


def signature_rows(column: pa.Array, n: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, set sizes, two set hashes, signatures) of slices of a text column."""
    turn, times = _multipliers(k)
    for w in words(column):
        edges, s = shingles(w, n)
        size = np.diff(edges)
        has = size > 0
        starts = edges[:-1][has]
        out = np.zeros((len(size), k), np.uint16)
        k1, k2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
        if has.any():
            for i in range(k):
                out[has, i] = mix(np.minimum.reduceat((s ^ turn[i]) * times[i], starts)) & np.uint64(0xFFFF)
            k1[has] = np.bitwise_xor.reduceat(mix(s), starts)
            k2[has] = np.add.reduceat(mix(s + np.uint64(99)), starts)
        yield w.first, size, k1, k2, out


def _signed(docs: DataFrame, key: str, text: str, n: int, k: int) -> DataFrame:
    """One row per document: id, row hashes, set size, set hashes, signature (two bytes a component)."""
    named = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(key), F.col(text)).alias("h1"), F.hash(F.col(text)).alias("h2"), F.col(text).alias("text"))
    schema = T.StructType([named.schema["doc"], *(T.StructField(c, t) for c, t in (
        ("h1", T.LongType()), ("h2", T.IntegerType()), ("size", T.LongType()), ("k1", T.LongType()), ("k2", T.LongType()), ("sig", T.BinaryType())))])

    def run(batches):
        for batch in batches:
            for first, size, k1, k2, sig in signature_rows(batch.column("text"), n, k):
                m = len(size)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * k), m, [None, pa.py_buffer(sig.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, m) for c in ("doc", "h1", "h2")), pa.array(size, pa.int64()),
                     pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), raw.cast(pa.binary())],
                    names=["doc", "h1", "h2", "size", "k1", "k2", "sig"])

    return named.mapInArrow(run, schema)


def _unpacked(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, k)


def _chunk_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of each signature: each chunk with each component left out, and the number of both."""
    wide, cols = sig.astype(np.uint64), []
    for c in range(sig.shape[1] // WIDE):
        for left_out in range(WIDE):
            a, b, d = (WIDE * c + j for j in range(WIDE) if j != left_out)
            cols.append(wide[:, a] | wide[:, b] << np.uint64(16) | wide[:, d] << np.uint64(32) | np.uint64(WIDE * c + left_out) << np.uint64(48))
    return np.stack(cols, axis=1)


def _keys(nodes: DataFrame, k: int) -> DataFrame:
    """(key, node): a node under each of its keys."""
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                keys = _chunk_keys(_unpacked(batch.column("sig"), k))
                node = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    short, long = (x, y) if len(x) < len(y) else (y, x)
    both = int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(column: pa.Array, n: int) -> list[np.ndarray]:
    out = []
    for w in words(column):
        edges, s = shingles(w, n)
        out += [s[edges[i]: edges[i + 1]] for i in range(len(edges) - 1)]
    return out


def _confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar enough."""
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                x, y = _sets(batch.column("text_a"), n), _sets(batch.column("text_b"), n)
                yield batch.select(["a", "b"]).filter(pa.array([_linked(p, q, percent) for p, q in zip(x, y)], pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _close(pairs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The pairs whose signatures differ in fewer than half of the components (2 * chunks - 1 at most)."""
    s = nodes.select("node", "sig")
    both = pairs.join(s.toDF("a", "sig_a"), "a").join(s.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")

    def run(batches):
        for batch in batches:
            apart = (_unpacked(batch.column("sig_a"), k) != _unpacked(batch.column("sig_b"), k)).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(2 * apart < k))

    return both.mapInArrow(run, "a long, b long")


def _first_shared(same: np.ndarray) -> np.ndarray:
    """Number of the first key that two signatures share, from their equal components; a large number if none."""
    k = same.shape[-1]
    chunks = same.reshape(*same.shape[:-1], k // WIDE, WIDE)
    total = chunks.sum(axis=-1)
    shared = np.stack([total - chunks[..., j] == WIDE - 1 for j in range(WIDE)], axis=-1).reshape(*same.shape[:-1], k)
    return np.where(shared.any(axis=-1), shared.argmax(axis=-1), 1 << 30)


def _cross_pairs(sig: np.ndarray, component: np.ndarray, key: int, left: np.ndarray, right: np.ndarray, step: int = 256):
    """Places (i, j) of pairs across components, near in signature, that meet under this key first."""
    number = (key >> 48) & 0xFFFF
    for at in range(0, len(left), step):
        i = left[at: at + step]
        for to in range(0, len(right), step):
            j = right[to: to + step]
            same = sig[i][:, None, :] == sig[j][None, :, :]
            good = (2 * (~same).sum(axis=2) < sig.shape[1]) & (component[i][:, None] != component[j][None, :])
            p, q = np.nonzero(good)
            if len(p):
                first = _first_shared(same[p, q]) == number
                yield from zip(i[p[first]].tolist(), j[q[first]].tolist())


def _small_pairs(members: DataFrame, k: int) -> DataFrame:
    """Pairs across components in groups of at most SMALL members, each once."""
    groups = members.groupBy("key").agg(F.collect_list(F.struct("node", "component", "sig")).alias("m"))

    def run(batches):
        for batch in batches:
            a, b = [], []
            for key, m in zip(batch.column("key").to_pylist(), batch.column("m").to_pylist()):
                node, part = np.array([x["node"] for x in m]), np.array([x["component"] for x in m])
                sig = np.frombuffer(b"".join(x["sig"] for x in m), np.uint16).reshape(-1, k)
                places = np.arange(len(m))
                for i, j in _cross_pairs(sig, part, key, places, places):
                    if node[i] < node[j]:
                        a.append(node[i])
                        b.append(node[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def _block_links(rows: pd.DataFrame, n: int, k: int, percent: int) -> pd.DataFrame:
    """Confirmed links of one pair of blocks that join something new; ``block`` is the row's own block."""
    sets = _sets(pa.array(rows["text"]), n)
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, k)
    part, names = np.unique(rows["component"].to_numpy(), return_inverse=True)
    parent = list(range(len(part)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    block, node = rows["block"].to_numpy(), rows["node"].to_numpy()
    low, high = int(rows["b1"].iloc[0]), int(rows["b2"].iloc[0])
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    out = []
    for i, j in _cross_pairs(sig, names, int(rows["key"].iloc[0]), left, right):
        if (low != high or i < j) and (p := root(int(names[i]))) != (q := root(int(names[j]))) and _linked(sets[i], sets[j], percent):
            parent[max(p, q)] = min(p, q)
            out.append((node[i], node[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _large_links(members: DataFrame, texts: DataFrame, n: int, k: int, percent: int) -> DataFrame:
    """Links across components in larger groups, dealt to pairs of blocks."""
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "node", "component", "sig", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    full = dealt.join(texts, "node")
    return full.groupBy("key", "b1", "b2").applyInPandas(lambda g: _block_links(g, n, k, percent), "a long, b long")


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``h1``, ``h2`` (hashes that name the row), ``n_shingles``, ``component``, ``component_id``.

    ``component`` is null for a document without words; ``component_id`` is then its own id.
    """
    m = chunks_for(percent)
    k = WIDE * m
    signed = cut(_signed(docs, key, text, n, k))
    nodes = signed.where("size > 0").groupBy("k1", "k2").agg(F.min(F.struct("doc", "h1", "h2")).alias("row"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", F.col("row.h1").alias("h1"), F.col("row.h2").alias("h2"), "size", "sig"))

    # one member drawn by each key: the smallest node after a turn that belongs to the key
    keyed = _keys(nodes, k)
    turned = F.col("node").bitwiseXOR(F.shiftrightunsigned(F.xxhash64("key"), 1))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min(turned).alias("drawn")).where("members > 1")
    groups = cut(keyed.join(shared, "key").select("key", "node", "members", F.col("drawn").bitwiseXOR(F.shiftrightunsigned(F.xxhash64("key"), 1)).alias("pivot")))

    # texts of all nodes that share a key, one row each
    wanted = nodes.join(groups.select("node").distinct(), "node", "left_semi").select("node", "h1", "h2")
    held = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("h1"), F.hash(F.col(text)).alias("h2"), F.col(text).alias("text"))
    texts = cut(held.join(wanted, ["h1", "h2"]).groupBy("h1", "h2", "node").agg(F.first("text").alias("text")).select("node", "text"))

    stars = groups.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = cut(_confirm(_close(stars, nodes, k), texts, n, percent))

    named = components(links)
    placed = groups.join(named, "node", "left").select("key", "node", "members", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    live = placed.join(mixed, "key").join(nodes.select("node", "sig", "size"), "node")
    live = cut(live.select("key", "node", "members", "component", "sig", "size"))
    total = live.groupBy("key").agg(F.sum("size").alias("shingles"))
    small = _confirm(_small_pairs(live.where(F.col("members") <= SMALL), k), texts, n, percent)
    large = _large_links(live.where(F.col("members") > SMALL).join(total, "key"), texts, n, k, percent)
    more = cut(small.union(large))
    if more.isEmpty():
        final = named
    else:
        final = components(links.union(more))
    final = nodes.select("node", "k1", "k2").join(final, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component"))
    rows = signed.select("doc", "h1", "h2", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("k1")).alias("k1"), "k2").join(final, ["k1", "k2"], "left")
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc").alias("least"))
    return rows.join(least, "component", "left").select(
        F.col("doc").alias("doc_id"), "h1", "h2", "n_shingles", "component", F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("least")).alias("component_id"))
