"""Substring dedup by hashing lines and sentences.

A text is cut into pieces that tile it: a piece ends after a line break or after full stops,
calls and question marks with the blanks behind them. A piece of fewer than ``least`` words
belongs to the piece that follows it in its line, so that a repeated passage falls into the same
units wherever it stands, from its first longer sentence on. Units are normalised (A to Z in lower
case, blanks collapsed) and hashed to 128 bits. Of all units of equal digest, over all
documents, the one of smallest rank (document id, row hashes, offset) stays and the others are
removed; what stays keeps its offsets in the original text. Units of fewer than ``least``
words (the short end of a line) are never removed.

Digests are counted first; only those that occur again matter. They set bits of a bitmap of
fixed size that is broadcast, so the second reading of the texts emits little more than the
units that really repeat, and the exact join decides. Hot digests are counted in the tasks
before they are shuffled, and the join's hot partitions can be split.

Offsets count code points. A null or empty text has no unit. Rows with equal id and text share
their rank, so each of them keeps what the first keeps.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage_cut import cut
from .bitmap import hits, of_hashes
from .shipping import ship, unpack

#: words of the shortest unit that can be removed
LEAST = 5
#: pieces of a text
UNIT = r"[^\n.!?]*(?:[.!?]+[ \t]*\n?|\n)|[^\n.!?]+"


def digests(text: str, least: int) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the units with at least ``least`` words."""
    import xxhash
    out, start, unit = [], 0, []
    for m in re.finditer(UNIT, text):
        words = m[0].encode().lower().split()
        unit += words
        if len(words) >= least or m[0][-1] == "\n" or m.end() == len(text):
            if len(unit) >= least:
                out.append((start, m.end(), xxhash.xxh3_128_digest(b" ".join(unit))))
            start, unit = m.end(), []
    return out


def _halves(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _counted(docs: DataFrame, text: str, least: int) -> DataFrame:
    """(d1, d2, n): digests with their number in one batch of rows."""
    def run(batches):
        for batch in batches:
            seen: dict[bytes, int] = {}
            for t in batch.column(0).to_pylist():
                for _, _, d in digests(t, least) if t else ():
                    seen[d] = seen.get(d, 0) + 1
            d1, d2 = _halves(list(seen))
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array(list(seen.values()), pa.int64())], names=["d1", "d2", "n"])

    return docs.select(text).mapInArrow(run, "d1 long, d2 long, n long")


def _repeats(docs: DataFrame, bitmap: np.ndarray, key: str, text: str, least: int) -> DataFrame:
    """(d1, d2, doc, h1, h2, start, end) of units whose digest is in the bitmap."""
    named = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(key), F.col(text)).alias("h1"), F.hash(F.col(text)).alias("h2"), F.col(text).alias("text"))
    made = ship(docs.sparkSession, bitmap)
    schema = T.StructType([T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), named.schema["doc"], T.StructField("h1", T.LongType()),
                           T.StructField("h2", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def run(batches):
        bits = unpack(made)
        for batch in batches:
            row, start, end, raw = [], [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                for a, b, d in digests(t, least) if t else ():
                    row.append(i)
                    start.append(a)
                    end.append(b)
                    raw.append(d)
            d1, d2 = _halves(raw)
            hit = np.flatnonzero(hits(bits, d1))
            rows = pa.array(np.array(row, np.int64)[hit])
            yield pa.RecordBatch.from_arrays(
                [pa.array(d1[hit]), pa.array(d2[hit]), *(batch.column(c).take(rows) for c in ("doc", "h1", "h2")),
                 pa.array(np.array(start, np.int32)[hit]), pa.array(np.array(end, np.int32)[hit])], names=schema.names)

    return named.mapInArrow(run, schema)


def _cut_out(text: str, removed: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """What is left of a text, and where it was."""
    kept, at = [], 0
    for a, b in [*removed, (len(text), len(text))]:
        if a > at:
            kept.append((at, a))
        at = b
    return "".join(text[a:b] for a, b in kept), kept


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, removed: str = "removed", kept: str = "kept") -> DataFrame:
    """``docs`` without units that occur earlier, with ``removed`` and ``kept``: arrays of (start, end) in the original text.

    Columns of these names are replaced.
    """
    rows = docs.drop(removed, kept)
    names = rows.columns
    counts = _counted(rows, text, least).groupBy("d1", "d2").agg(F.sum("n").alias("n"))
    repeated = cut(counts.where("n > 1").select("d1", "d2"))
    units = cut(_repeats(rows, of_hashes(repeated, "d1"), key, text, least).join(repeated, ["d1", "d2"], "left_semi"))
    rank = F.struct("doc", "h1", "h2", "start")
    first = units.groupBy("d1", "d2").agg(F.min(rank).alias("first"))
    later = units.join(first, ["d1", "d2"]).where(~rank.eqNullSafe(F.col("first"))).select("h1", "h2", "start", "end").distinct()
    spans = later.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(removed))
    free = "_" * (1 + max(map(len, rows.columns)))  # longer than any column's name
    h1, h2 = f"h1{free}", f"h2{free}"
    named = rows.withColumns({h1: F.xxhash64(F.col(key), F.col(text)), h2: F.hash(F.col(text))})
    joined = named.join(spans.withColumnsRenamed({"h1": h1, "h2": h2}), [h1, h2], "left").select(*rows.columns, removed)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]), False)
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            columns = {c: batch.column(c) for c in names}
            out = [[(s["start"], s["end"]) for s in r or ()] for r in batch.column(removed).to_pylist()]
            texts = columns[text].to_pylist()
            left = [_cut_out(t, r) if t else (t, []) for t, r in zip(texts, out)]
            columns[text] = pa.array([t for t, _ in left], columns[text].type)
            pairs = lambda spans: pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], arrow)
            yield pa.RecordBatch.from_arrays([*columns.values(), pairs(out), pairs([k for _, k in left])], names=[*columns, removed, kept])

    return joined.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(removed, span), T.StructField(kept, span)]))
