"""Quality classifier: a linear support vector machine over naive-Bayes-scaled n-gram indicators.

Features are indicators of word n-grams (1, 2) and of word-shape n-grams (1 to 3), hashed to
``DIM`` places. A shape says which kinds of characters a word has, which come first and last,
and whether the word repeats the one before, so junk of unseen words is still recognised. A
row of indicators has length one and is scaled by the classes' log-count ratios; the hinge
loss is then minimised by dual coordinate descent. Margins of held-out folds give the
logistic curve that turns a margin into a score from 0 to 1.

Labels are learned from a bounded sample (``SAMPLE`` labelled rows, those of smallest id
hash). Every text is scored whole, in the task that reads it. An empty or null text has no
feature and gets the score of the bias alone. Labels that are null or whose document is
missing are not used; a document with several labels counts once for each, and of rows that share an id
the one of smallest text is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shipping import ship, unpack
from .words import Words, mix, words

#: places of hashed features
DIM = 1 << 18
#: most labelled rows that the classifier is fitted on
SAMPLE = 6000
#: score from which a document counts as good
THRESHOLD = 0.7


def _kinds() -> np.ndarray:
    """Kind of each byte as one bit: capital, small, digit, stop, call, bar, other sign, part of a longer character."""
    kind = np.full(256, 64, np.uint8)
    kind[128:] = 128
    kind[65:91], kind[97:123], kind[48:58] = 1, 2, 4
    kind[[*b".,;:'\"-()"]] = 8
    kind[[*b"!?"]] = 16
    kind[[*b"|"]] = 32
    kind[[0x20, *range(0x09, 0x0E)]] = 0
    return kind


def _shapes(w: Words) -> np.ndarray:
    kinds = _kinds()[w.data]
    whole = np.bitwise_or.reduceat(kinds[w.start[0]:], w.start - w.start[0]).astype(np.uint64)
    shape = whole | kinds[w.start].astype(np.uint64) << np.uint64(8) | kinds[w.end - 1].astype(np.uint64) << np.uint64(16)
    row = w.row_of_word()
    again = np.zeros(len(row), np.uint64)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
    return mix(shape | again << np.uint64(24) | np.uint64(1 << 40))


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row edges, distinct feature places row by row) of slices of a text column."""
    for w in words(column):
        rows = len(w.ptr) - 1
        parts = []
        if len(w.start):
            row, shape = w.row_of_word(), _shapes(w)
            for kind, n, hashes in ((1, 1, w.hash), (2, 2, w.hash), (3, 1, shape), (4, 2, shape), (5, 3, shape)):
                h, at = w.ngrams(n, hashes)
                h = mix(h + np.uint64(kind))
                parts.append(row[at].astype(np.int64) << 18 | (h % np.uint64(DIM)).astype(np.int64))
        keys = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        yield w.first, np.searchsorted(keys, np.arange(rows + 1) << 18), keys & (DIM - 1)


@dataclass
class Model:
    weight: np.ndarray  # of an indicator, ratio and vector in one
    bias: float
    slope: float
    offset: float

    def margins(self, edges: np.ndarray, places: np.ndarray) -> np.ndarray:
        n = np.diff(edges)
        total = np.append(0.0, np.cumsum(self.weight[places]))[edges]
        return np.diff(total) / np.sqrt(np.maximum(n, 1)) + self.bias

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * margins + self.offset)))


def _ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float) -> np.ndarray:
    good, bad = np.full(DIM, smooth), np.full(DIM, smooth)
    for places, label in zip(rows, y):
        (good if label > 0 else bad)[places] += 1
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def _descend(rows: list[np.ndarray], y: np.ndarray, smooth: float, cost: float, passes: int) -> tuple[np.ndarray, float]:
    """Weights and bias: dual coordinate descent on the hinge loss, each class with the same total cost."""
    ratio = _ratios(rows, y, smooth)
    values = [ratio[p] / np.sqrt(max(len(p), 1)) for p in rows]
    square = np.array([v @ v + 1 for v in values])
    most = np.where(y > 0, cost * len(y) / max(2 * (y > 0).sum(), 1), cost * len(y) / max(2 * (y < 0).sum(), 1))
    alpha, w, bias = np.zeros(len(y)), np.zeros(DIM), 0.0
    rng = np.random.default_rng(7)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(y)):
            p, v = rows[i], values[i]
            gradient = y[i] * (w[p] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            if (step := (new - alpha[i]) * y[i]) != 0:
                alpha[i] = new
                w[p] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w * ratio, bias


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over margins, by Newton steps with a little shrinkage."""
    good, bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.column_stack([margins, np.ones(len(y))])
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def train(rows: list[np.ndarray], labels: np.ndarray, *, smooth: float = 1.0, cost: float = 1.0, passes: int = 20, folds: int = 3) -> Model:
    """Fit on feature rows and labels (0 or 1). With one class or none, the score is that class's share."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    if len(set(y)) < 2:
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return Model(np.zeros(DIM), 0.0, 1.0, float(np.log(share / (1 - share))))
    fold, margins = np.zeros(len(y), int), np.zeros(len(y))
    for label in (1, -1):
        fold[y == label] = np.arange((y == label).sum()) % folds
    for k in range(folds):
        inside = np.flatnonzero(fold != k)
        if len(set(y[inside])) == 2:
            m = Model(*_descend([rows[i] for i in inside], y[inside], smooth, cost, passes), 1.0, 0.0)
            out = np.flatnonzero(fold == k)
            edges = np.append(0, np.cumsum([len(rows[i]) for i in out])).astype(int)
            margins[out] = m.margins(edges, np.concatenate([rows[i] for i in out]) if len(out) else np.zeros(0, int))
    return Model(*_descend(rows, y, smooth, cost, passes), *_curve(margins, y))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", learn: Column | None = None, sample: int = SAMPLE,
        key: str = "doc_id", text: str = "text") -> Model:
    """Model of the labelled documents for which ``learn`` (over ``key``) holds, at most ``sample`` labelled rows.

    The sample's ids are the only rows broadcast, so that the texts are not shuffled.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (F.lit(True) if learn is None else learn))
    chosen = chosen.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key", "_label").limit(sample)
    joined = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_key")
    # rows that share an id count as one, so the sample's bound holds whatever repeats
    joined = joined.groupBy("_key", "_label").agg(F.min("_text").alias("_text"))

    def run(batches):
        for batch in batches:
            for first, edges, places in features(batch.column("_text")):
                made = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(places, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("_key").slice(first, len(made)), batch.column("_label").slice(first, len(made)), made],
                                                 names=["_key", "_label", "places"])

    kept = joined.select("_key", "_label", "_text").mapInArrow(run, T.StructType([
        T.StructField("_key", joined.schema["_key"].dataType), T.StructField("_label", T.IntegerType()), T.StructField("places", T.ArrayType(T.IntegerType()))]))
    table = kept.toArrow()
    order = np.lexsort((table.column("_label").to_numpy(), table.column("_key").to_numpy()))
    lists = table.column("places").combine_chunks()
    edges, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return train([flat[edges[i]: edges[i + 1]] for i in order], table.column("_label").to_numpy()[order])


def classify(docs: DataFrame, model: Model, *, text: str = "text", score: str = "score", predicted: str = "predicted",
             threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1) and ``predicted`` (1 from ``threshold`` on); columns of these names are replaced."""
    made = ship(docs.sparkSession, model)
    kept = [f.name for f in docs.schema.fields if f.name not in (score, predicted)]
    schema = T.StructType([docs.schema[k] for k in kept] + [T.StructField(score, T.DoubleType(), False)])

    def run(batches):
        fitted = unpack(made)
        for batch in batches:
            out = [fitted.score(fitted.margins(edges, places)) for _, edges, places in features(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(np.concatenate(out) if out else [], pa.float64())],
                                             names=[*kept, score])

    return docs.mapInArrow(run, schema).withColumn(predicted, (F.col(score) >= threshold).cast("int"))
