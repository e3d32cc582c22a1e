"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes.

Words are compared with A to Z in lower case. A *seed* is a run of ``least`` words that a
document and a benchmark item share.

1. The items' seeds set bits of a bitmap of fixed size, which is broadcast. A task
   reads whole texts, keeps the runs of words whose seeds hit the bitmap, and forgets the rest.
2. Seeds of documents and items are joined by hash. A pair goes on if its shared seeds could
   cover ``share`` of the item's words.
3. Each pair is tiled: longest common runs of unmarked words first, by Karp-Rabin hashes of a
   search length that grows to the longest match and then falls to ``least``; a marked word
   belongs to one tile. Tiles may lie in any order, so moved passages count.

A pair is contaminated if tiles cover ``share`` of the item's words. Null and empty texts and
items of fewer than ``least`` words share no seed. Equal item rows count once; rows of
documents keep to themselves, equal ones too (their result is one row).
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitmap import hits, of_hashes
from .shipping import ship, unpack
from .words import window_hash, words

#: words of the shortest tile, and the share of an item's words that tiles must cover
LEAST, SHARE = 5, 0.5


def _windows(tokens: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and hashes of the windows of ``size`` tokens that are free throughout."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    taken = np.append(0, np.cumsum(~free))
    at = np.flatnonzero(taken[size:] == taken[:n])
    return at, window_hash(tokens, at, size)


def _matches(p: np.ndarray, t: np.ndarray, p_free: np.ndarray, t_free: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Longest free matches of at least ``size`` tokens: (-length, place in t, place in p)."""
    at_p, hash_p = _windows(p, p_free, size)
    at_t, hash_t = _windows(t, t_free, size)
    hit = np.isin(hash_t, hash_p)
    at_t, hash_t = at_t[hit], hash_t[hit]
    where: dict[int, list[int]] = {}
    for i, h in zip(at_p.tolist(), hash_p.tolist()):
        where.setdefault(h, []).append(i)
    out = []
    for j, h in zip(at_t.tolist(), hash_t.tolist()):
        for i in where[h]:
            if j and i and t_free[j - 1] and p_free[i - 1] and t[j - 1] == p[i - 1]:
                continue  # inside a match that began earlier
            k = 0
            while i + k < len(p) and j + k < len(t) and p_free[i + k] and t_free[j + k] and p[i + k] == t[j + k]:
                k += 1
            if k >= size:  # else two windows only share a hash
                out.append((-k, j, i))
    return out


def tile(p: np.ndarray, t: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of item ``p`` with text ``t``: (length, place in t, place in p) of the tiles.

    Longest first, then the earliest in t, then the earliest in p.
    """
    p_free, t_free = np.ones(len(p), bool), np.ones(len(t), bool)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(p), 20))
    while size >= least:
        found = _matches(p, t, p_free, t_free, size)
        longest = -min(found)[0] if found else 0
        if longest > 2 * size:
            size = longest
            continue
        heapq.heapify(found)
        while found:
            length, j, i = heapq.heappop(found)
            length = -length
            free = p_free[i: i + length] & t_free[j: j + length]
            if free.all():
                p_free[i: i + length] = False
                t_free[j: j + length] = False
                tiles.append((length, j, i))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b - a >= size:  # what is left of a match that lost words to a longer one
                    heapq.heappush(found, (a - b, j + a, i + a))
        size = -1 if size == least else max(least, size // 2)
    return tiles


_ITEM = "item long, item_id {}, item_words array<long>, seeds array<long>"


def _item_rows(items: DataFrame, key: str, text: str, least: int) -> DataFrame:
    named = items.select(F.xxhash64(F.col(key), F.col(text)).alias("item"), F.col(key).alias("item_id"), F.col(text).alias("text")).distinct()

    def run(batches):
        for batch in batches:
            for w in words(batch.column("text")):
                rows = len(w.ptr) - 1
                seeds, at = w.ngrams(least)
                edges = np.searchsorted(at, w.ptr)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").slice(w.first, rows), batch.column("item_id").slice(w.first, rows),
                     pa.ListArray.from_arrays(pa.array(w.ptr, pa.int32()), pa.array(w.hash.view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(seeds.view(np.int64)))],
                    names=["item", "item_id", "item_words", "seeds"])

    return named.mapInArrow(run, _ITEM.format(named.schema["item_id"].dataType.simpleString()))


def _doc_rows(docs: DataFrame, bitmap: np.ndarray, key: str, text: str, least: int) -> DataFrame:
    """Documents with a seed in the bitmap: their words in hit runs, the words' places, and the seeds hit."""
    named = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(key), F.col(text)).alias("h1"), F.hash(F.col(text)).alias("h2"), F.col(text).alias("text"))
    made = ship(docs.sparkSession, bitmap)
    schema = T.StructType([named.schema["doc"], *(T.StructField(c, t) for c, t in (
        ("h1", T.LongType()), ("h2", T.IntegerType()), ("places", T.ArrayType(T.IntegerType())), ("doc_words", T.ArrayType(T.LongType())), ("seeds", T.ArrayType(T.LongType()))))])

    def run(batches):
        bits = unpack(made)
        for batch in batches:
            for w in words(batch.column("text")):
                seeds, at = w.ngrams(least)
                hit = hits(bits, seeds)
                seeds, at = seeds[hit], at[hit]
                if not len(at):
                    continue
                covered = np.zeros(len(w.hash) + 1, np.int32)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + least, -1)
                word = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
                row_at, row_word = np.searchsorted(at, w.ptr), np.searchsorted(word, w.ptr)
                rows = np.flatnonzero(np.diff(row_at))
                ends = lambda e: pa.array(np.append(e[rows], e[rows[-1] + 1]), pa.int32())  # noqa: E731  rows without a hit add nothing between
                taken = pa.array(w.first + rows)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(taken) for c in ("doc", "h1", "h2")),
                     pa.ListArray.from_arrays(ends(row_word), pa.array(word - np.repeat(w.ptr[:-1], np.diff(row_word)), pa.int32())),
                     pa.ListArray.from_arrays(ends(row_word), pa.array(w.hash[word].view(np.int64))),
                     pa.ListArray.from_arrays(ends(row_at), pa.array(seeds.view(np.int64)))],
                    names=["doc", "h1", "h2", "places", "doc_words", "seeds"])

    return named.mapInArrow(run, schema)


def contaminated(docs: DataFrame, items: DataFrame, *, least: int = LEAST, share: float = SHARE, key: str = "doc_id",
                 item_key: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item whose tiles cover ``share`` of the item.

    Columns: ``doc_id``, ``h1``, ``h2`` (hashes that name the row), ``item_id``, ``n_words`` of
    the item, ``n_covered``, ``coverage``, and ``tiles``, an array of (word in the text, word
    in the item, words).
    """
    known = _item_rows(items, item_key, item_text, least)
    seeds = known.select("item", F.size("item_words").alias("n_words"), F.explode("seeds").alias("seed"))
    found = _doc_rows(docs, of_hashes(seeds, "seed"), key, text, least)
    shared = found.select("h1", "h2", F.explode(F.array_distinct("seeds")).alias("seed")).join(
        seeds.groupBy("item", "seed").agg(F.count("*").alias("times"), F.first("n_words").alias("n_words")), "seed")
    pairs = shared.groupBy("h1", "h2", "item").agg(F.sum("times").alias("times"), F.first("n_words").alias("n_words"))
    pairs = pairs.where(F.col("times") * least >= F.col("n_words") * share).select("h1", "h2", "item")
    full = found.drop("seeds").join(pairs, ["h1", "h2"]).join(known.drop("seeds"), "item")
    out = T.StructType([T.StructField("doc_id", found.schema["doc"].dataType), T.StructField("h1", T.LongType()), T.StructField("h2", T.IntegerType()),
                        T.StructField("item_id", known.schema["item_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_covered", T.LongType()),
                        T.StructField("coverage", T.DoubleType()),
                        T.StructField("tiles", T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("doc_word", "item_word", "words")])))])

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                places, p = np.array(r["places"]), np.array(r["item_words"], np.int64).view(np.uint64)
                gaps = np.flatnonzero(np.diff(places) != 1) + 1
                t = np.insert(np.array(r["doc_words"], np.int64).view(np.uint64), gaps, 0)  # no word has the hash 0, so no tile spans a gap
                at = np.insert(places, gaps, -1)
                tiles = tile(p, t, least)
                covered = sum(x[0] for x in tiles)
                if covered >= share * len(p):
                    rows.append({"doc_id": r["doc"], "h1": r["h1"], "h2": r["h2"], "item_id": r["item_id"], "n_words": len(p), "n_covered": covered, "coverage": covered / len(p),
                                 "tiles": sorted(({"doc_word": int(at[j]), "item_word": i, "words": n} for n, j, i in tiles), key=lambda x: x["doc_word"])})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(out)
    return full.select("doc", "h1", "h2", "item_id", "item_words", "places", "doc_words").mapInArrow(run, out)
