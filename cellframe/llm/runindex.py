"""Substring dedup over bytes by run-length indexes.

A byte goes if a string of ``least`` bytes that covers it also starts in a document of smaller
id. Strings are judged on the input, and never reach across documents.

Copies of whole texts go by their hashes; of each text, the row of smallest id is read. Every
window of ``least`` bytes is named by the smallest hash of the ``GRAM`` byte strings in it, so
equal windows have equal names wherever they stand. Neighbouring windows of one name make a
piece of a text. Names are counted over all texts first: each task sorts its names and sends
those of a bucket (a range of names) in one parcel. A bitmap of the repeated ones, two bits each and some
``EACH`` in all, keeps the second reading small (beyond ``2 ** MOST`` bits it lets more pass), and whatever it lets pass is
decided exactly. Pieces are dealt by name to buckets of some ``BUCKET`` bytes, at most ``BUCKETS``, in parcels
with the places where they stand, so the number of parcels of a task does not follow the size of the table.
A bucket joins its equal pieces and goes through them by shards of some ``TARGET`` bytes. A shard sorts its suffixes, keeps the
Burrows-Wheeler transform as runs with the suffixes at both ends of each run, and streams the
pieces backwards through it: matching statistics, all pieces abreast. A window whose match is
``least`` long lies in one range of suffixes, whose smallest id is known; it is marked for every
document of larger id. (A name of a single piece needs no index: its windows have the piece's
smallest id.) Pieces of frequent names are grouped by their bytes before they are dealt; if those
that differ hold over ``TARGET`` bytes, the name is too hot for a task, and its windows are
grouped by their bytes instead, which gives the same marks.

Offsets count UTF-8 bytes. A null or empty text has no window. A null id is neither smaller nor
larger than another: such rows lose nothing and take nothing. Rows of equal id do not take from
each other. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage_cut import cut, fresh_path
from .bitmap import hits, of_hashes
from .shipping import ship, unpack

#: bytes of a window, of the strings that name it, of a shard's pieces; windows of a piece, and of a stretch of text read at once
LEAST, GRAM, TARGET, PIECE, STRETCH = 50, 24, 1 << 19, 64, 1 << 16
#: pieces that a task deals at once, bytes of pieces in a bucket, and most buckets
PACK, BUCKET, BUCKETS = 1 << 18, 1 << 22, 1 << 12
#: texts handled at once
ROWS = 1 << 10
#: bits of the bitmap for each repeated name, and most bits as a power of two: 128 MB
EACH, MOST = 6, 30


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def names(data: np.ndarray, least: int, gram: int) -> np.ndarray:
    """The name of the window at each place: the smallest hash of its ``gram`` byte strings."""
    h, k, factor = _mixed(data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1, 0xBF58476D1CE4E5B9
    while k < gram:
        step = min(k, gram - k)
        h = h[:-step] * np.uint64(factor) + h[step:]
        h ^= h >> np.uint64(31)
        k, factor = k + step, factor * 0x5851F42D4C957F2D % 2 ** 64 | 1
    h, k = _mixed(h), 1
    while k < least - gram + 1:
        step = min(k, least - gram + 1 - k)
        h = np.minimum(h[:-step], h[step:])
        k += step
    return h


def pieces(data: np.ndarray, offsets: np.ndarray, least: int, gram: int):
    """(name, first window, windows) of the pieces of texts that stand one after the other, a stretch at a time."""
    for low in range(int(offsets[0]), int(offsets[-1]) - least + 1, STRETCH):
        high = min(low + STRETCH, int(offsets[-1]) - least + 1)
        name = names(data[low: high + least - 1], least, gram)
        whole = np.ones(high - low, bool)
        for end in offsets[np.searchsorted(offsets, low): np.searchsorted(offsets, high + least)]:
            whole[max(int(end) - least + 1 - low, 0): max(int(end) - low, 0)] = False
        edge = np.ones(high - low, bool)
        edge[1:] = (name[1:] != name[:-1]) | (whole[1:] != whole[:-1])
        start = np.flatnonzero(edge)
        count = np.diff(np.append(start, high - low))
        kept = whole[start]
        start, count = start[kept], count[kept]
        parts = -(-count // PIECE)
        which = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        count = np.minimum(np.repeat(count, parts) - which * PIECE, PIECE)
        start = np.repeat(start, parts) + which * PIECE
        yield _mixed(name[start]).view(np.int64), start + low, count


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column, and where each text starts and the last one ends."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _counted(docs: DataFrame, least: int, gram: int, copies: np.ndarray | None, top: int) -> DataFrame:
    """(bucket, names, counts): the sorted names of some texts by their first ``top`` bits, in 8 bytes each, with how often they occur and, in the last bit,
    whether in several texts, in 4; texts in the bitmap of copies are left out."""
    shipped = ship(docs.sparkSession, copies)

    def parcels(name, row):
        order = np.argsort(name)
        name, row = name[order], row[order]
        start, name = _ranges(name)
        counts = np.diff(start).astype(np.uint32) << np.uint32(1)
        counts |= np.minimum.reduceat(row, start[:-1]) != np.maximum.reduceat(row, start[:-1])
        start, bucket = _ranges(name >> np.uint64(64 - top))
        return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), _chunks(name, start), _chunks(counts, start)], names=["bucket", "names", "counts"])

    def run(batches):
        held, n, texts = [], 0, 0
        for batch in _slices(batches, unpack(shipped)):
            data, offsets = _texts(batch.column("text"))
            for name, start, _ in pieces(data, offsets, least, gram):
                held.append((name.view(np.uint64), np.searchsorted(offsets, start, "right") + texts))
                n += len(name)
            texts += len(offsets)
            if n >= PACK:
                yield parcels(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield parcels(*map(np.concatenate, zip(*held)))

    return docs.select("own", "text").mapInArrow(run, "bucket int, names binary, counts binary")


def _ranges(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers start, with the end, and the numbers."""
    at = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)
    return np.append(at, len(sorted_)), sorted_[at]


def _chunks(values: np.ndarray, start: np.ndarray) -> pa.Array:
    """Bytes of the values from each start to the next."""
    return pa.Array.from_buffers(pa.binary(), len(start) - 1, [None, pa.py_buffer((start * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _repeated(parcels: DataFrame, limit: int) -> DataFrame:
    """(bucket, names, n, pieces, often): names that occur in several texts, how many they are, how often they occur, and those that occur more than ``limit`` times."""
    def run(table: pa.Table) -> pa.Table:
        name = np.frombuffer(b"".join(table.column("names").to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
        order = np.argsort(name)
        counts = counts[order]
        start, name = _ranges(name[order])
        n = np.add.reduceat(counts >> np.uint32(1), start[:-1], dtype=np.int64)
        kept = (np.diff(start) > 1) | (counts[start[:-1]] & np.uint32(1)).astype(bool)
        name, n = name[kept], n[kept]
        return pa.table({"bucket": table.column("bucket")[:1], "names": pa.array([name.tobytes()], pa.binary()), "n": pa.array([len(name)]), "pieces": pa.array([int(n.sum())]),
                         "often": pa.array([name[n > limit].tobytes()], pa.binary())})

    return parcels.groupBy("bucket").applyInArrow(run, "bucket int, names binary, n long, pieces long, often binary")


def filter_bits(n: int, top: int) -> int:
    """Bits, as a power of two, of the bitmap of ``n`` names whose first ``top`` bits name a bucket."""
    return max(min((max(n, 1) * EACH - 1).bit_length(), MOST), top + 10)


def places(name: np.ndarray, bits: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each name, in the part of the bitmap that is its bucket's."""
    name, rest = name.view(np.uint64), np.uint64(bits - top)
    return name >> np.uint64(64 - bits), (name >> np.uint64(64 - top) << rest) | (name & ((np.uint64(1) << rest) - np.uint64(1)))


def among(bitmap: np.ndarray, name: np.ndarray, bits: int, top: int) -> np.ndarray:
    """Whether each name may be among those of the bitmap."""
    one, two = ((bitmap[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 for p in places(name, bits, top))
    return (one & two).astype(bool)


def part_of_bitmap(name: np.ndarray, bits: int, top: int) -> np.ndarray:
    """A bucket's part of the bitmap."""
    part = np.zeros(1 << bits - top, bool)
    for p in places(name, bits, top):
        part[p & np.uint64(len(part) - 1)] = True
    return np.packbits(part, bitorder="little")


def _bitmap(repeated: DataFrame, bits: int, top: int) -> np.ndarray:
    """Bitmap of the repeated names; the driver gets its parts, of ``2 ** MOST`` bits in all at most."""
    def run(batches):
        for batch in batches:
            parts = [part_of_bitmap(np.frombuffer(x, np.uint64), bits, top).tobytes() for x in batch.column("names").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(parts, pa.binary())], names=["bucket", "part"])

    out = np.zeros(1 << bits - 3, np.uint8)
    size = len(out) >> top
    for batch in repeated.where("n > 0").select("bucket", "names").mapInArrow(run, "bucket int, part binary").toArrow().to_batches():
        for bucket, part in zip(*batch.columns):
            out[bucket.as_py() * size: (bucket.as_py() + 1) * size] = np.frombuffer(part.as_buffer(), np.uint8)
    return out


def _slices(batches, copies: np.ndarray | None):
    """Some ``ROWS`` rows at a time, without those in the bitmap of copies."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            rows = batch.slice(low, ROWS)
            yield rows if copies is None else rows.filter(pa.array(~hits(copies, rows.column("own").to_numpy())))


def _emitted(docs: DataFrame, least: int, gram: int, copies: np.ndarray | None, bitmap: Broadcast, bits: int, top: int, often: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, rows) of the pieces whose name is in the bitmap of repeated ones, in parcels; without a bucket, (name, piece, doc, hash, at) of those of frequent names."""
    shipped = ship(docs.sparkSession, (copies, often))
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("rows", T.BinaryType()), T.StructField("name", T.LongType()),
                           T.StructField("piece", T.BinaryType()), T.StructField("doc", docs.schema["doc"].dataType), T.StructField("hash", T.LongType()),
                           T.StructField("at", T.LongType())])

    def dealt(held, often):
        table = pa.Table.from_batches(held).combine_chunks()
        name = table.column("name").to_numpy().view(np.uint64)
        hot = np.isin(name, often)
        if hot.any():
            for batch in table.filter(pa.array(hot)).to_batches():
                yield pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.binary()), *batch.columns], names=schema.names)
        cold = np.flatnonzero(~hot)
        order = cold[np.argsort(name[cold])]
        table = table.take(pa.array(order))
        start, bucket = _ranges((name[order] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32))
        out = []
        for a, b in zip(start[:-1], start[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table.slice(a, b - a))
            out.append(sink.getvalue().to_pybytes())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(out, pa.binary()), *(pa.nulls(len(out), f.type) for f in table.schema)], names=schema.names)

    def run(batches):
        (skipped, frequent), known = unpack(shipped), np.frombuffer(bitmap.value, np.uint8)
        held, n = [], 0
        for batch in _slices(batches, skipped):
            data, offsets = _texts(batch.column("text"))
            for name, start, count in pieces(data, offsets, least, gram):
                hit = np.flatnonzero(among(known, name, bits, top))
                if not len(hit):
                    continue
                name, start, size = name[hit], start[hit], count[hit] + least - 1
                ends = np.append(0, np.cumsum(size))
                raw = data[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
                piece = pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
                row = np.searchsorted(offsets, start, "right") - 1
                rows = pa.array(row)
                held.append(pa.RecordBatch.from_arrays([pa.array(name), piece, batch.column("doc").take(rows), batch.column("hash").take(rows), pa.array(start - offsets[row])],
                                                       names=schema.names[2:]))
                n += len(hit)
                if n >= PACK:
                    yield from dealt(held, frequent)
                    held, n = [], 0
        if n:
            yield from dealt(held, frequent)

    return docs.mapInArrow(run, schema)


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of strings of bytes below 255, with the suffixes at the ends of each run.

    ``cap`` bounds the match lengths that are told apart.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, cap: int):
        self.cap = cap
        sizes = np.diff(offsets)
        ends = np.cumsum(sizes + 1) - 1  # each string is followed by a code that is smaller than any byte's
        self.text = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
        inside = np.ones(len(self.text), bool)
        inside[ends] = False
        own = data[offsets[0]: offsets[-1]]
        used = np.flatnonzero(np.bincount(own, minlength=1))
        self.code = np.full(256, -1)
        self.code[used] = np.arange(len(used)) + 1
        self.text[inside] = self.code[own]
        self.rest = np.repeat(ends, sizes + 1) - np.arange(len(self.text))
        self.bits = max(len(used).bit_length(), 1)
        self.width = 62 // self.bits
        self.ones = 1 << (self.bits * np.arange(self.width))
        padded = np.append(self.text, np.zeros(self.width, np.uint8)).astype(np.int64)
        self.word = np.zeros(len(self.text), np.int64)
        for j in range(self.width):
            self.word |= np.where(self.rest >= j, padded[j: j + len(self.text)], 0) << (self.bits * (self.width - 1 - j))
        suffixes, k, rank = self._sorted(int(sizes.max(initial=0)) + 1)
        # ranges of suffixes that share their first cap bytes
        a, b = suffixes[:-1], suffixes[1:]
        if 0 < k <= cap:
            equal = (self.rest[a] >= cap) & (self.rest[b] >= cap)
            for off in [*range(0, cap - k, k), cap - k]:
                later = np.append(rank[off:], np.zeros(off, np.int64))
                equal &= later[a] == later[b]
        else:
            equal = self.common(a, b, np.full(len(a), cap)) >= cap
        edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
        self.low, self.high = edges[::2], edges[1::2] + 1
        self.members = suffixes
        before = self.text[suffixes - 1]
        head = np.ones(len(before), bool)
        head[1:] = before[1:] != before[:-1]
        self.start = np.flatnonzero(head)
        self.char = before[self.start].astype(np.int64)
        length = np.diff(np.append(self.start, len(before)))
        self.first, self.last = suffixes[self.start], suffixes[self.start + length - 1]
        self.end = self.start + length - 1
        self.run = np.repeat(np.arange(len(self.start), dtype=np.int32), length)
        self.order = np.argsort(self.char, kind="stable")
        self.key = self.char[self.order] * len(self.start) + self.order
        self.step = np.empty(len(self.start), np.int64)
        self.step[self.order] = np.cumsum(length[self.order]) - length[self.order]

    def _sorted(self, longest: int) -> tuple[np.ndarray, int, np.ndarray]:
        """Suffixes in order, equal ones in the order of their strings; and their ranks by a prefix of at most ``cap`` bytes, with its length."""
        def ranks(key):
            order = np.argsort(key)
            new = np.zeros(len(key), np.int64)
            new[1:] = np.diff(key[order]) != 0
            out = np.empty(len(key), np.int64)
            out[order] = np.cumsum(new)
            return out, int(new.sum()) + 1

        k, key, bits = self.width, self.word, (len(self.text) + 1).bit_length()
        held = 0, self.word
        while True:
            if k >= longest:
                return np.argsort(key, kind="stable"), *held
            rank, distinct = ranks(key)
            if k <= self.cap:
                held = k, rank
            if distinct == len(key):
                return np.argsort(rank), *held
            key = rank + 1  # as many ranks of following places as a word holds
            for j in range(1, 63 // bits):
                after = np.zeros(len(rank), np.int64)
                if j * k < len(rank):
                    after[:-j * k] = np.where(self.rest[:-j * k] >= j * k, rank[j * k:] + 1, 0)
                key = key << bits | after
            k *= max(63 // bits, 1)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of two suffixes each, at most ``most``."""
        most = np.minimum(most, np.minimum(self.rest[a], self.rest[b]))
        out, left = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(left):
            at = out[left]
            left, at = left[at < most[left]], at[at < most[left]]
            differ = self.word[a[left] + at] ^ self.word[b[left] + at]
            out[left] += self.width - np.searchsorted(self.ones, differ, "right")
            left = left[differ == 0]
        return np.minimum(out, most)

    def match(self, data: np.ndarray, offsets: np.ndarray):
        """Matching statistics of patterns, read backwards and abreast: yields (pattern, place, length, row) of one more byte each.

        ``length`` is that of the longest prefix of the pattern's rest that occurs in the strings, at
        most ``cap``; ``row`` is the place in order of a suffix that starts with it.
        """
        sizes = np.diff(offsets)
        by = np.argsort(-sizes, kind="stable")
        rising = -sizes[by]
        row, at, length = np.zeros(len(by), np.int64), np.full(len(by), self.members[0] if len(self.members) else 0), np.zeros(len(by), np.int64)
        for t in range(1, int(sizes.max(initial=0)) + 1):
            n = int(np.searchsorted(rising, -t, "right"))
            who = by[:n]
            char = self.code[data[offsets[who + 1] - t]]
            run = self.run[row[:n]]
            off = np.flatnonzero(self.char[run] != char)
            lost = off[:0]
            if len(off):
                place = np.searchsorted(self.key, char[off] * len(self.start) + run[off])
                best, to = np.full(len(off), -1), np.zeros(len(off), np.int64)
                for side, sample, edge in ((place - 1, self.last, self.end), (place, self.first, self.start)):
                    near = self.order[np.clip(side, 0, len(self.order) - 1)]
                    x = np.flatnonzero((side >= 0) & (side < len(self.order)) & (self.char[near] == char[off]))
                    reach = self.common(at[off[x]], sample[near[x]], length[off[x]])
                    better = reach > best[x]
                    x, reach = x[better], reach[better]
                    best[x], to[x] = reach, sample[near[x]]
                    run[off[x]], row[off[x]] = near[x], edge[near[x]]
                found = best >= 0
                at[off[found]], length[off[found]] = to[found], best[found]
                lost = off[~found]
            row[:n] = self.step[run] + row[:n] - self.start[run]
            at[:n] -= 1
            length[:n] = np.minimum(length[:n] + 1, self.cap)
            row[lost], at[lost], length[lost] = 0, self.members[0], 0
            yield who, sizes[who] - t, length[:n], row[:n]


def _ranked(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The place of each value in the order of those that occur, and these."""
    column = pa.chunked_array(column.chunks, column.type).combine_chunks().dictionary_encode()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    order = pc.sort_indices(column.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[column.indices.to_numpy()], column.dictionary.take(pa.array(order))


def _marked(name: np.ndarray, piece: pa.Array, low: np.ndarray, high: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(piece, first, last, smallest): windows of pieces that differ, of smallest and largest id, with the smallest id that has them, where that is below the piece's largest."""
    _, group, number = np.unique(name, return_inverse=True, return_counts=True)
    small, large = np.full(len(number), np.iinfo(np.int64).max), np.full(len(number), -1)
    np.minimum.at(small, group, low)
    np.maximum.at(large, group, high)
    # names of one id take nothing; those of several pieces go through the index, and first
    kept = np.flatnonzero(small[group] < large[group])
    kept = kept[np.argsort(number[group[kept]] == 1, kind="stable")]
    several = int((number[group[kept]] > 1).sum())
    low, high = low[kept], high[kept]
    column = piece.take(pa.array(kept)).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    windows = np.diff(offsets) - least + 1
    base = np.append(0, np.cumsum(windows))
    best = np.repeat(low, windows)
    if several:
        index = RunIndex(data, offsets[:several + 1], least)
        owner = np.repeat(low[:several], np.diff(offsets[:several + 1]) + 1)[index.members]
        smallest = np.minimum.reduceat(np.append(owner, 0), np.stack([index.low, index.high], 1).ravel())[::2] if len(index.low) else index.low
        for who, place, length, row in index.match(data, offsets[:several + 1]) if len(index.low) else ():
            long = np.flatnonzero(length >= least)
            who, place, row = who[long], place[long], row[long]
            at = np.searchsorted(index.low, row, "right") - 1
            inside = (at >= 0) & (row < index.high[at])
            to = base[who[inside]] + place[inside]
            best[to] = np.minimum(best[to], smallest[at[inside]])
    owner = np.repeat(np.arange(len(kept)), windows)
    edge = np.ones(len(best), bool)
    edge[1:] = (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(edge)
    stop = np.append(start[1:], len(best)) - 1
    marked = best[start] < high[owner[start]]
    start, stop = start[marked], stop[marked]
    who = owner[start]
    return kept[who], start - base[who], stop - base[who], best[start]


def _covered(rows: pa.Table, least: int, target: int) -> pa.Table:
    """(doc, hash, start, end): spans of a bucket's pieces (name, piece, doc, hash, at) that start in a smaller id too."""
    doc, _ = _ranked(rows.column("doc"))
    name = rows.column("name").to_numpy()
    order = np.argsort(name)
    start, _ = _ranges(name[order])
    small, large = (f.reduceat(doc[order], start[:-1]) if len(order) else order for f in (np.minimum, np.maximum))
    order = order[np.repeat(small < large, np.diff(start))]
    rows, name, doc = rows.combine_chunks().take(pa.array(order)), name[order], doc[order]
    # equal pieces as one, in the order of their names
    pieces_ = pa.chunked_array(rows.column("piece").chunks, pa.binary()).combine_chunks().dictionary_encode()
    which, strings = pieces_.indices.to_numpy(), pieces_.dictionary
    low, high, called = np.full(len(strings), np.iinfo(np.int64).max), np.full(len(strings), -1), np.zeros(len(strings), np.int64)
    np.minimum.at(low, which, doc)
    np.maximum.at(high, which, doc)
    called[which] = name
    first, _ = _ranges(called)
    ends = np.append(0, np.cumsum(pc.binary_length(strings).to_numpy()))
    shards, _ = _ranges(ends[first[:-1]] // target)
    found = [(np.zeros(0, np.int64),) * 4]
    for a, b in zip(first[shards[:-1]], first[shards[1:]]):
        who, *rest = _marked(called[a:b], strings.slice(a, b - a), low[a:b], high[a:b], least)
        found.append((who + a, *rest))
    who, begin, last, smallest = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(who, kind="stable")
    n = np.bincount(who, minlength=len(strings))
    skip, n = (np.cumsum(n) - n)[which], n[which]
    row = np.repeat(np.arange(len(which)), n)
    mark = order[np.arange(len(row)) + np.repeat(skip - (np.cumsum(n) - n), n)]
    larger = smallest[mark] < doc[row]
    row, mark = row[larger], mark[larger]
    at, taken = rows.column("at").to_numpy()[row], pa.array(row)
    return pa.table({"doc": rows.column("doc").take(taken), "hash": rows.column("hash").take(taken), "start": pa.array(at + begin[mark]), "end": pa.array(at + last[mark] + least)})


def _marks(rows: pa.Table, least: int) -> pa.Table:
    """(name, key, first, last, least): what :func:`_marked` finds in pieces (name, key, piece, lo, hi)."""
    rows = rows.combine_chunks()
    rank, ids = _ranked(pa.chunked_array([*rows.column("lo").chunks, *rows.column("hi").chunks]))
    piece = pa.chunked_array(rows.column("piece").chunks, pa.binary()).combine_chunks()
    who, first, last, smallest = _marked(rows.column("name").to_numpy(), piece, rank[:len(rows)], rank[len(rows):], least)
    taken = pa.array(who)
    return pa.table({"name": rows.column("name").take(taken), "key": rows.column("key").take(taken), "first": pa.array(first), "last": pa.array(last), "least": ids.take(pa.array(smallest))})


def _by_windows(strings: DataFrame, least: int) -> DataFrame:
    """What :func:`_marks` returns, by grouping windows by their bytes."""
    windows = strings.select("name", "key", "lo", "hi", "piece", F.explode(F.sequence(F.lit(0), F.length("piece") - least)).alias("first"))
    windows = windows.withColumn("window", F.expr(f"substring(piece, first + 1, {least})")).drop("piece")
    smallest = windows.groupBy("window").agg(F.min("lo").alias("least"))
    place = F.col("first").cast("long")
    return windows.join(smallest, "window").where("least < hi").select("name", "key", place.alias("first"), place.alias("last"), "least")


def _by_parcels(emitted: DataFrame, *, least: int, target: int) -> DataFrame:
    """(doc, hash, start, end) of the pieces in parcels."""
    def run(parcels: pa.Table) -> pa.Table:
        tables = [pa.ipc.open_stream(x).read_all() for x in parcels.column("rows").to_pylist()]
        return _covered(pa.concat_tables(tables), least, target)

    schema = T.StructType([emitted.schema["doc"], emitted.schema["hash"], T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return emitted.where("bucket is not null").select("bucket", "rows").groupBy("bucket").applyInArrow(run, schema)


def _by_marks(emitted: DataFrame, *, least: int, target: int, shards: int) -> DataFrame:
    """(doc, hash, start, end) of the pieces of frequent names."""
    emitted = emitted.where("bucket is null").select("name", F.xxhash64("piece").alias("key"), "piece", "doc", "hash", "at")
    kind = emitted.schema["doc"].dataType
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("name", "key", "first", "last")] + [T.StructField("least", kind)])
    often = cut(emitted.groupBy("name", "key", "piece").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")))
    hot = cut(often.groupBy("name").agg(F.sum(F.length("piece")).alias("bytes")).where(F.col("bytes") > target).select("name"))
    few = often.join(hot, "name", "left_anti").withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)))
    marks = few.groupBy("shard").applyInArrow(lambda rows: _marks(rows, least), schema)
    marks = marks.union(_by_windows(often.join(hot, "name", "left_semi").select("name", "key", "piece", "lo", "hi"), least))
    return emitted.select("name", "key", "doc", "hash", "at").join(marks, ["name", "key"]).where("least < doc").select(
        "doc", "hash", (F.col("at") + F.col("first")).alias("start"), (F.col("at") + F.col("last") + least).alias("end"))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["end"]))
        else:
            out.append((s["start"], s["end"]))
    return out


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, target: int = TARGET,
                removed: str = "removed", kept: str = "kept") -> DataFrame:
    """``docs`` with ``removed``, an array of (start, end) in bytes, and ``kept``, the bytes that are left.

    Columns of these names are replaced; all others stay, whatever their names.
    """
    rows = docs.drop(removed, kept)
    spark = docs.sparkSession
    words = F.col(text)
    narrow = rows.select(F.col(key).alias("doc"), F.xxhash64(words).alias("hash"), F.xxhash64(F.lit(1), words).alias("twin"),
                         F.octet_length(words).cast("long").alias("size"), words.alias("text")).where(F.col("doc").isNotNull() & (F.col("size") >= least))
    narrow = narrow.withColumn("own", F.xxhash64("doc", "hash"))
    named = narrow.drop("text")
    first = named.groupBy("hash", "twin").agg(F.min("doc").alias("first"))
    copies = cut(named.join(first, ["hash", "twin"]).where("doc > first").select("doc", "hash", "own", "size").distinct())
    skip = of_hashes(copies, "own")
    # rows that the bitmap takes for copies, and that are none
    spared = cut(_maybe(narrow.select("doc", "hash", "own", "text"), skip).join(copies, ["doc", "hash"], "left_anti"))
    narrow = narrow.select("doc", "hash", "own", "text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = max(min(8 * partitions, BUCKETS).bit_length() - 1, 1)
    repeated = cut(_repeated(_counted(narrow, least, gram, skip, top).union(_counted(spared, least, gram, None, top)), target // (PIECE + least - 1)))
    n, total = repeated.agg(F.sum("n"), F.sum("pieces")).first()
    bits = filter_bits(n or 0, top)
    bitmap = spark.sparkContext.broadcast(_bitmap(repeated, bits, top).tobytes())
    often = np.frombuffer(b"".join(bytes(r[0]) for r in repeated.select("often").where("length(often) > 0").collect()), np.uint64)
    buckets = min(max((total or 0) * least * 5 // 4 // BUCKET, min(2 * partitions, (total or 0) // 1000)) + 1, BUCKETS)
    path = fresh_path(spark, "step")
    emitted = _emitted(narrow, least, gram, skip, bitmap, bits, top, often, buckets).union(_emitted(spared, least, gram, None, bitmap, bits, top, often, buckets))
    emitted.write.option("compression", "zstd").parquet(path)  # neighbouring pieces overlap
    emitted = spark.read.schema(emitted.schema).parquet(path)
    covered = _by_parcels(emitted, least=least, target=target)
    if len(often):
        covered = covered.union(_by_marks(emitted, least=least, target=target, shards=min(len(often), max(2 * partitions, len(often) // 4))))
    covered = covered.union(copies.select("doc", "hash", F.lit(0).cast("long"), "size"))
    spans = covered.groupBy("doc", "hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    spans = cut(spans)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)  # the spans have all that is needed of the pieces
    return _cut_out(rows, spans, key, text, removed, kept)


def _maybe(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows that are in the bitmap."""
    shipped = ship(docs.sparkSession, bits)

    def run(batches):
        known = unpack(shipped)
        for batch in batches:
            yield batch.filter(pa.array(hits(known, batch.column("own").to_numpy()))) if batch.num_rows else batch

    return docs.mapInArrow(run, docs.schema)


def _cut_out(rows: DataFrame, spans: DataFrame, key: str, text: str, removed: str, kept: str) -> DataFrame:
    """``rows`` with what is removed and what is left; texts travel compressed to their spans."""
    others = rows.select(F.struct(*[F.col(c) for c in rows.columns if c != text]).alias("row"), F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("hash"),
                         F.col(text).alias("text"))
    closed = T.StructType([*others.schema.fields[:3], T.StructField("size", T.LongType()), T.StructField("packed", T.BinaryType())])
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def pack(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            raw = [t.as_buffer() if t.is_valid else None for t in batch.column("text")]
            packed = [None if r is None else codec.compress(r, asbytes=True) for r in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([None if r is None else r.size for r in raw], pa.int64()), pa.array(packed, pa.binary())], names=closed.names)

    def unpack_(batches):
        codec = pa.Codec("zstd")
        for batch in _slices(batches, None):
            texts, out, left = [], [], []
            for size, packed, spans_ in zip(*(batch.column(c).to_pylist() for c in ("size", "packed", "spans"))):
                raw = None if packed is None else codec.decompress(packed, size, asbytes=True) if size else b""
                gone = _merged(spans_ or [])
                ends = [0, *(b for _, b in gone)]
                texts.append(raw)
                out.append([{"start": a, "end": b} for a, b in gone])
                left.append(None if raw is None else b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in gone), size])))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(out, arrow), pa.array(left, pa.binary())],
                                             names=["row", "text", "removed", "kept"])

    joined = others.mapInArrow(pack, closed).join(spans, ["doc", "hash"], "left").select("row", "size", "packed", "spans")
    opened = joined.mapInArrow(unpack_, T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("removed", span), T.StructField("kept", T.BinaryType())]))
    columns = [F.col("text").alias(text) if c == text else F.col("row")[c].alias(c) for c in rows.columns]
    return opened.select(*columns, F.col("removed").alias(removed), F.col("kept").alias(kept))
