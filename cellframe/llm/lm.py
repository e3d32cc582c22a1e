"""Language-model scores of whole documents: a gated recurrent network and the corpus's word counts.

Tokens are words (A to Z in lower case) and one end for each document. Words are told apart by
64-bit hashes.

1. Every training text is counted whole, in its task first; counts and their number of words
   grow with the corpus and stay a distributed table.
2. The ``OWN`` most frequent words have ids of their own, in classes of about equal counts. The
   others fall into ``FORMS`` classes by their first and last letters; in such a class a word
   has the probability that its count gives, unknown words sharing a tenth of a count.
3. Training texts are dealt to ``ROUNDS`` rounds of shards by row hashes; the number of shards
   follows the number of tokens, about ``SHARD`` each. A copy of the network is trained on all tokens of
   a shard's texts, by backpropagation in consecutive windows with the state carried from one to
   the next through each whole text; the copies of a round and their sums of squared gradients are
   averaged in Spark by their tokens and start the next round. Each training token is learned once.
4. Scoring carries the state across windows through each whole text. Counts of the ``HEAD`` most
   frequent words are broadcast; the other words of a document are joined with the counts by
   hash, where no word can be hot.

Texts are split into words twice, for the counts and for the ids; training and scoring read the ids.

A null or empty text is one end. Rows with a null id are training rows; every row is scored.
"""

from __future__ import annotations

from copy import deepcopy
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage_cut import cut
from . import gru
from .shipping import ship, unpack
from .words import Words, _lower_table, mix, words

OWN, FORMS, HEAD = 2048, 61, 1 << 16
CLASSES, HIDDEN = 32, 16
#: rounds of training, and tokens of one copy in a round
ROUNDS, SHARD = 4, 1 << 20
#: hash of the end token, and what a count is raised by
END, ALPHA = 0x7E57ED0F7E57ED0F, 0.1
#: numbers of a block of parameters
BLOCK = 1 << 13


def _forms(w: Words) -> np.ndarray:
    """Class of each word by its first and last letters."""
    low = _lower_table()
    ends = low[w.data[w.start]].astype(np.uint64) << np.uint64(8) | low[w.data[w.end - 1]]
    return (mix(ends) % np.uint64(FORMS)).astype(np.int32)


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row edges, hashes, forms) with an end after each row's words; an end's form is 0."""
    rows = len(w.ptr) - 1
    edges = w.ptr + np.arange(rows + 1)
    h, form = np.full(edges[-1], END, np.uint64), np.zeros(edges[-1], np.int32)
    place = np.arange(len(w.hash)) + w.row_of_word()
    h[place] = w.hash
    if len(w.hash):
        form[place] = _forms(w)
    return edges, h, form


def _counted(docs: DataFrame) -> DataFrame:
    """Counts of words in one batch of rows (h, form, n)."""
    def run(batches):
        for batch in batches:
            parts = []
            for w in words(batch.column("text")):
                _, h, form = _tokens(w)
                of, values = pd.factorize(h)
                kind = np.zeros(len(values), np.int32)
                kind[of] = form
                parts.append((values, kind, np.bincount(of, minlength=len(values))))
            if not parts:
                continue
            values, at, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([p[2] for p in parts])).astype(np.int64)
            form = np.concatenate([p[1] for p in parts])[at]
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(form, pa.int32()), pa.array(n)], names=["h", "form", "n"])

    return docs.select("text").mapInArrow(run, "h long, form int, n long")


class Head:
    """Ids and counts of frequent words, by hash: a jump table over sorted hashes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, own: int):
        order = np.argsort(hashes)
        self.hash, self.count = np.append(hashes[order], np.uint64(2 ** 64 - 1)), np.append(counts[order], 0)
        rank = np.arange(len(hashes))[order]
        self.id, self.own = np.append(np.where(rank < own, rank, -1), -1), min(own, len(hashes))
        self.jump = np.searchsorted(self.hash[:-1] >> np.uint64(48), np.arange(1 << 16))
        self.longest = int(np.bincount((hashes >> np.uint64(48)).astype(np.int64), minlength=1).max()) if len(hashes) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places in the table; the last place for strangers."""
        at = self.jump[(h >> np.uint64(48)).astype(np.int64)]
        out = np.full(len(h), len(self.hash) - 1)
        for k in range(self.longest):
            place = np.minimum(at + k, len(self.hash) - 1)
            np.copyto(out, place, where=self.hash[place] == h)
        return out

    def ids(self, place: np.ndarray, form: np.ndarray) -> np.ndarray:
        own = self.id[place]
        return np.where(own >= 0, own, self.own + form)


def _start(head: Head) -> int:
    """Id of the end token, which stands before each text."""
    return int(head.ids(head.find(np.array([END], np.uint64)), np.zeros(1, np.int64))[0])


def _encoded(docs: DataFrame, head: Head, parts: int, total: float, distinct: float, form_mass: np.ndarray) -> DataFrame:
    """Each text once: ids of its tokens as 16-bit numbers, what the head's counts say, and the words that are not in the head with their number.

    ``part``, ``h1`` and ``h2`` deal the texts to parts by row hashes.
    """
    made = ship(docs.sparkSession, head)
    named = docs.select("doc_id", "held_out", F.xxhash64("doc_id", "text").alias("h1"), F.hash("text").alias("h2"), "text")
    dealt = named.select("doc_id", "held_out", F.pmod("h1", F.lit(parts)).cast("int").alias("part"), "h1", "h2", "text")
    schema = T.StructType([*(dealt.schema[c] for c in ("doc_id", "held_out", "part", "h1", "h2")), *(T.StructField(c, t) for c, t in (
        ("row", T.LongType()), ("ids", T.BinaryType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("extra", T.DoubleType()),
        ("rare", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.IntegerType()))))])

    def run(batches):
        from pyspark import TaskContext
        table = unpack(made)
        row = TaskContext.get().partitionId() << 33
        below = np.log10(total + ALPHA * (distinct + 1))
        known_log = np.log10(table.count + ALPHA)
        for batch in batches:
            ids, columns = [], []
            for w in words(batch.column("text")):
                edges, h, form = _tokens(w)
                of, values = pd.factorize(h)
                place = table.find(values)[of]
                inside = place < len(table.hash) - 1
                ident = table.ids(place, form)
                short = ident.astype(np.int16)
                ids += [short[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                known = np.where(inside, known_log[place], 0.0)
                # a word without an id of its own: its share of its form's counts
                extra = np.where(ident < table.own, 0.0, known - form_mass[form])
                owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
                rare = np.flatnonzero(~inside)
                order = rare[np.lexsort((h[rare], owner[rare]))]
                new = np.append(True, (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])) if len(order) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(order)))
                cuts = np.searchsorted(owner[order][first], np.arange(len(edges)))
                sums = lambda x: np.add.reduceat(x, edges[:-1])  # noqa: E731  every row has an end, so none is empty
                columns.append((np.diff(edges), sums(inside.astype(np.int64)), sums(known - below), sums(extra),
                                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(h[order][first].view(np.int64))),
                                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(times, pa.int32()))))
            if not ids:
                continue
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "held_out", "part", "h1", "h2")), pa.array(np.arange(row, row + n)), pa.array(ids, pa.binary()),
                 *(pa.array(np.concatenate([c[k] for c in columns])) for k in range(4)), *(pa.concat_arrays([c[k] for c in columns]) for k in (4, 5))],
                names=schema.names)
            row += n

    return dealt.mapInArrow(run, schema)


def _trained(encoded: DataFrame, shards: int, head: Head, net: gru.Network, past: list[np.ndarray]) -> None:
    """One round: a copy is trained on each shard's whole texts; copies are weighted by their tokens and averaged in Spark.

    Shards and the order of their texts follow from row hashes, so they do not depend on partitions.
    """
    made = ship(encoded.sparkSession, (net, past, _start(head)))
    across = int(np.ceil(np.sqrt(shards)))
    dealt = encoded.repartition(2 * shards, "part").sortWithinPartitions("part", "h1", "h2").select("part", "ids")

    def rows(batches):
        for batch in batches:
            yield from zip(batch.column("part").to_pylist(), batch.column("ids").to_pylist())

    def run(batches):
        model, squares, start = unpack(made)
        for part, texts in groupby(rows(batches), key=lambda row: row[0]):
            copy, sums = deepcopy(model), deepcopy(squares)
            tokens = gru.train(copy, sums, (np.frombuffer(ids, np.int16) for _, ids in texts), start)
            vector = np.concatenate([copy.vector(), *(s.ravel() for s in sums)]).astype(np.float64) * tokens
            blocks = [vector[i: i + BLOCK] for i in range(0, len(vector), BLOCK)]
            k = len(blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(k), pa.int32()), pa.array([part // ROUNDS % across] * k, pa.int32()), pa.array([part] * k, pa.int32()), pa.array([float(tokens)] * k),
                 pa.array(blocks, pa.list_(pa.float64()))], names=["block", "bucket", "part", "weight", "sums"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bucket", "part"])
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "bucket": [rows["bucket"].iloc[0]], "part": [0], "weight": [rows["weight"].sum()],
                             "sums": [np.sum(np.stack(rows["sums"].tolist()), axis=0)]})

    shape = "block int, bucket int, part int, weight double, sums array<double>"
    copies = dealt.mapInArrow(run, shape).groupBy("block", "bucket").applyInPandas(added, shape).groupBy("block").applyInPandas(added, shape)
    got = copies.toPandas().sort_values("block")
    if len(got):
        vector = np.concatenate([np.array(s) / w for s, w in zip(got["sums"], got["weight"])]).astype(np.float32)
        half = len(vector) // 2
        net.load(vector[:half])
        for s, piece in zip(past, np.split(vector[half:], np.cumsum([s.size for s in past])[:-1])):
            s[...] = piece.reshape(s.shape)


def _scored(encoded: DataFrame, head: Head, net: gru.Network) -> DataFrame:
    """Per row: what the head's counts and the network say."""
    made = ship(encoded.sparkSession, (net, _start(head)))
    kept = encoded.select("doc_id", "held_out", "row", "n_tokens", "n_known", "base", F.col("extra").alias("model"), "ids")
    schema = T.StructType(kept.schema.fields[:-1])

    def run(batches):
        model, start = unpack(made)
        for batch in batches:
            logs = gru.score(model, [np.frombuffer(ids, np.int16) for ids in batch.column("ids").to_pylist()], start) / np.log(10)
            columns = {c: batch.column(c) for c in schema.names}
            columns["model"] = pa.array(logs + columns["model"].to_numpy())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=schema.names)

    return kept.mapInArrow(run, schema)


def log_likelihood(docs: DataFrame, held_out: Column, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row.

    ``base_score`` is the unigram log10 probability from the counts of rows that are not held out, ``score`` the model's.
    """
    named = docs.select(F.col(key).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    learned = named.where(~F.col("held_out"))
    counts = cut(_counted(learned).groupBy("h").agg(F.sum("n").alias("c"), F.max("form").alias("form")))
    top = counts.orderBy(F.desc("c"), "h").limit(HEAD).toArrow()
    hashes, count, form = (top.column(c).to_numpy() for c in ("h", "c", "form"))
    order = np.lexsort((hashes, -count))
    hashes, count, form = hashes[order].view(np.uint64), count[order].astype(np.float64), form[order]
    mass, kinds = np.zeros(FORMS), np.zeros(FORMS)
    for r in counts.groupBy("form").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        mass[r.form], kinds[r.form] = r.c, r.v
    total, distinct = mass.sum(), kinds.sum()
    np.subtract.at(mass, form[:OWN], count[:OWN])
    np.subtract.at(kinds, form[:OWN], 1)

    head = Head(hashes, count, OWN)
    net = gru.build(count[:OWN], mass, CLASSES, HIDDEN)
    past = [np.full_like(p, gru.PAST) for p in net.parameters()]
    shards = max(1, -(-int(total) // (ROUNDS * SHARD)))
    encoded = cut(_encoded(named, head, ROUNDS * shards, total, distinct, np.log10(mass + ALPHA * (kinds + 1))))
    texts = encoded.where(~F.col("held_out")).select("part", "h1", "h2", "ids")
    for k in range(ROUNDS):
        _trained(texts.where(F.col("part") % ROUNDS == k), shards, head, net, past)
    scored = cut(_scored(encoded, head, net))
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("h"), F.col("w.times").alias("times"))
    joined = rare.join(counts.select("h", "c"), "h", "left")
    found = joined.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + ALPHA)).alias("logs"),
                                      F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known"))
    both = scored.join(found, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
                       (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"))
