"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves whole pre-tokens that are
tokens themselves. Tier two: the others are merged on a linked list of byte pieces with a
heap of candidate merges, lowest rank first, leftmost first among equal ranks. The whole
vocabulary (of a fixed size) is broadcast; rows stay where they are, so there is no shuffle.

A null text counts as empty: no ids, and an empty byte string. Extra columns pass through.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shipping import ship, unpack

#: distinct pre-tokens that a task remembers before it starts anew
MEMO = 600_000
#: keys in a bucket of the perfect hash, on average
BUCKET = 4
#: numbers that spread a displacement and a hash
STEP, SPREAD, MASK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (one base64 token and its rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _key_hashes(keys: list[bytes]) -> np.ndarray:
    """64-bit hash of each key; its two halves choose the bucket and the slot."""
    import xxhash
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


class PerfectHash:
    """Minimal perfect hash of fixed keys: n keys, n slots, one probe, one comparison.

    Buckets take displacements from the largest on until all of their keys fall on free
    slots, and a bucket of one key names its slot. A slot keeps its key, so a stranger is recognised.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = max(n, 1), max(1, n // BUCKET)
        hashes = _key_hashes(keys)
        if len(np.unique(hashes)) < n:
            raise ValueError("keys are repeated, or two keys share a 64-bit hash")
        bucket = ((hashes >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_key: list[bytes | None] = [None] * self.n
        free = np.ones(self.n, bool)
        for b in np.argsort(-np.diff(edges), kind="stable"):
            members = order[edges[b]: edges[b + 1]]
            if not len(members):
                break
            if len(members) == 1:  # the slot itself, as a negative number
                slots = [spare := int(np.argmax(free))]
                self.shift[b] = -1 - spare
            else:
                self.shift[b], slots = self._fit(hashes[members], free)
            free[slots] = False
            for m, s in zip(members, slots):
                self.slot_key[s] = keys[m]
        self.shift = self.shift.tolist()

    def _fit(self, hashes: np.ndarray, free: np.ndarray) -> tuple[int, np.ndarray]:
        block, first = 64, 0
        while first < 1 << 26:
            shifts = np.arange(first, first + block, dtype=np.uint64) * np.uint64(STEP)
            slots = (((hashes[None, :] ^ shifts[:, None]) * np.uint64(SPREAD) >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)
            good = free[slots].all(axis=1)
            ordered = np.sort(slots, axis=1)
            good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                return first + k, slots[k]
            first, block = first + block, min(block * 2, 4096)
        raise ValueError("no displacement found")

    def slot(self, key: bytes) -> int:
        """Slot of a key, -1 for a stranger."""
        import xxhash
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[(h >> 32) % self.buckets]
        s = -1 - d if d < 0 else (((h ^ (d * STEP & MASK)) * SPREAD & MASK) >> 32) % self.n
        return s if self.slot_key[s] == key else -1


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of the token that two tokens make side by side, by ``left << 32 | right``."""
    return {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


def merge(piece: list[int], pairs: dict[int, int]) -> list[int]:
    """Ids of one pre-token, given as the ids of its bytes: lowest rank first on a linked list, by a heap."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = pairs.get
    heap = [r << 32 | i for i in range(n - 1) if (r := get(piece[i] << 32 | piece[i + 1])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        first = pop(heap)
        i, rank = first & 0xFFFFFFFF, first >> 32
        left, j = piece[i], after[i]
        if left < 0 or j >= n or get(left << 32 | piece[j]) != rank:
            continue  # one of the two has been merged meanwhile
        piece[i], piece[j] = rank, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get(rank << 32 | piece[k])) is not None:
                push(heap, r << 32 | i)
        if (h := before[i]) >= 0 and (r := get(piece[h] << 32 | rank)) is not None:
            push(heap, r << 32 | h)
    return [p for p in piece if p >= 0]


class Memo(dict):
    """Ids by pre-token; what is missing is made by ``make``."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, token):
        self[token] = made = self.make(token)
        return made


class Codec:
    """Vocabulary, its perfect hash and the splitting pattern; sent to tasks as one broadcast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.pattern = pattern
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.pairs = pair_ranks(ranks)
        self.hash = PerfectHash(list(ranks))
        self.slot_id = [ranks[k] for k in self.hash.slot_key]
        self.find = self.memo = None
        top = max(ranks.values()) + 1
        by_id: list[bytes] = [b""] * top
        for token, i in ranks.items():
            by_id[i] = token
        self.bytes_of = np.frombuffer(b"".join(by_id), np.uint8)
        self.len_of = np.fromiter(map(len, by_id), np.int64, top)
        self.at_of = np.cumsum(self.len_of) - self.len_of

    def __getstate__(self):
        return {**self.__dict__, "find": None, "memo": None}

    def _ids(self, token: str) -> bytes:
        raw = token.encode()
        s = self.hash.slot(raw)
        ids = [self.slot_id[s]] if s >= 0 else merge([self.byte_id[b] for b in raw], self.pairs)
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if self.find is None:
            import regex
            self.find, self.memo = regex.compile(self.pattern).findall, Memo(self._ids)
        if len(self.memo) > MEMO:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, self.find(text)))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of many ids, one after the other."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.len_of) or (self.len_of[ids] == 0).any()):
            raise ValueError("an id is not in the vocabulary")
        size = self.len_of[ids]
        end = np.cumsum(size)
        place = np.arange(end[-1] if len(end) else 0) + np.repeat(self.at_of[ids] - (end - size), size)
        return self.bytes_of[place]


def _decoded(codec: Codec, ids: np.ndarray, edges: np.ndarray, step: int = 1 << 18) -> pa.Array:
    """Byte strings of the rows ``ids[edges[i]:edges[i+1]]``."""
    parts = [codec.decode(ids[i: i + step]) for i in range(0, len(ids), step)]
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    reach = np.append(0, np.cumsum(codec.len_of[ids]))[edges]
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1,
                                 [None, pa.py_buffer(reach.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with at most about ``limit`` bytes in a column, one row at least."""
    at, rows, size = 0, 0, 0
    for n in pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist():
        if rows and size + n > limit:
            yield batch.slice(at, rows)
            at, rows, size = at + rows, 0, 0
        rows, size = rows + 1, size + n
    if rows:
        yield batch.slice(at, rows)


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in {g.name for g in fields}] + list(fields))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text: str = "text", ids: str = "ids",
           decoded: str | None = None) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int), and ``decoded`` (binary) if a name is given.

    ``decoded`` is made from the ids alone, so it shows that they round-trip. Columns of
    these names are replaced.
    """
    made = ship(docs.sparkSession, Codec(ranks, pattern))
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    fields += [T.StructField(decoded, T.BinaryType(), False)] if decoded else []
    schema = _with(docs.schema, *fields)
    kept = [f.name for f in schema.fields if f.name not in {ids, decoded}]

    def run(batches):
        codec = unpack(made)
        for whole in batches:
            for batch in _pieces(whole, text):
                rows = [codec.encode(t) if t else b"" for t in batch.column(text).to_pylist()]
                numbers = np.frombuffer(b"".join(rows), np.int32)
                edges = np.append(0, np.cumsum([len(r) // 4 for r in rows])).astype(np.int32)
                made_ids = pa.ListArray.from_arrays(pa.array(edges), pa.array(numbers))
                columns = [batch.column(k) for k in kept] + [made_ids]
                if decoded:
                    columns.append(_decoded(codec, numbers, edges))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *(f.name for f in fields)])

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, ranks: dict[bytes, int], *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``coded`` with the bytes of its ids; null ids give null bytes, an unknown id is an error."""
    made = ship(coded.sparkSession, Codec(ranks, ""))
    schema = _with(coded.schema, T.StructField(decoded, T.BinaryType(), True))
    kept = [f.name for f in schema.fields if f.name != decoded]

    def run(batches):
        codec = unpack(made)
        for batch in batches:
            rows = batch.column(ids).to_pylist()
            out = [None if r is None else codec.decode(np.array(r, np.int64)).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(out, pa.binary())], names=[*kept, decoded])

    return coded.mapInArrow(run, schema)
