"""Segmentation of image tables and scores of predicted masks.

Steps inside one image run where the image row is; steps on labelled pixels group
by region, which the image bounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.expr import safe_div

IMAGE = ["fov", "peak", "t"]
REGION = [*IMAGE, "label"]
EPSILON = 1e-7  # fixed value: keeps the score ratios finite
PIECE = 1 << 20  # pixels of the label images a task hands back at once


def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of image rows of at most ``PIECE`` pixels, or one image: results of a whole batch are never held together."""
    for b in batches:
        if len(b):
            step = max(PIECE // max(int((b["height"] * b["width"]).max()), 1), 1)
            yield from (b.iloc[i:i + step] for i in range(0, len(b), step))


def otsu(pixels: DataFrame, *, bins: int | None = None, scale: float = 1.0, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Threshold of each image that maximises the between-class variance: ``keys, threshold``.

    Whole-number images use one bin per value; ``bins`` sets equal bins over the image's range.
    """
    keys = list(keys)
    if bins is None:
        hist = pixels.groupBy(*keys, F.col("v").cast("double").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    else:
        ends = pixels.groupBy(*keys).agg(F.min("v").alias("a"), F.max("v").alias("b"))
        w = (F.col("b") - F.col("a")) / bins
        i = F.least(F.floor(F.coalesce(safe_div(F.col("v") - F.col("a"), w), F.lit(0))), F.lit(bins - 1))
        hist = pixels.join(ends, keys).groupBy(*keys, (F.col("a") + (i + 0.5) * w).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("c")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    mass = F.col("n") * F.col("c")
    w1, s1 = F.sum("n").over(upto), F.sum(mass).over(upto)
    w2, s2 = F.sum("n").over(whole) - w1, F.sum(mass).over(whole) - s1
    between = F.when(w2 > 0, w1 * w2 * F.pow(s1 / w1 - s2 / w2, F.lit(2)))
    best = hist.select(*keys, "c", F.round(between, 6).alias("_b")).groupBy(*keys).agg(
        F.max(F.struct(F.coalesce("_b", F.lit(-1.0)).alias("b"), (-F.col("c")).alias("c")))["c"].alias("c"))
    return best.select(*keys, (-F.col("c") * scale).alias("threshold"))


def binarise(prob: DataFrame, *, threshold: float | None = 0.6, col: str = "p") -> DataFrame:
    """Class mask of a probability column; without a threshold the probability in percent."""
    p = F.col(col)
    value = F.rint(p * 100).cast("int") if threshold is None else (p >= threshold).cast("int")
    return prob.withColumn("mask", value)


def label_components(masks: DataFrame) -> DataFrame:
    """4-neighbour components of image rows ``keys, height, width, px`` (non-zero is foreground).

    Labels run in row order of the first pixel: ``fov, peak, t, y, x, label``.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            yield b[["fov", "peak", "t", "width"]].assign(lab=[
                k.components(np.reshape(p, (h, w)) != 0).ravel().astype(np.int32) for p, h, w in zip(b["px"], b["height"], b["width"])])

    lab = masks.select(*IMAGE, "height", "width", "px").mapInPandas(run, "fov int, peak int, t int, width int, lab array<int>")
    return _flat(lab)


def _flat(lab: DataFrame) -> DataFrame:
    flat = lab.select(*IMAGE, "width", F.posexplode("lab").alias("_i", "label")).where("label > 0")
    return flat.select(*IMAGE, F.floor(F.col("_i") / F.col("width")).cast("int").alias("y"),
                       (F.col("_i") % F.col("width")).alias("x"), "label")


def drop_small(labels: DataFrame, *, min_size: int = 25) -> DataFrame:
    """Regions with at least ``min_size`` pixels."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*REGION))
    return labels.withColumn("_n", n).where(F.col("_n") >= min_size).drop("_n")


def clear_border(labels: DataFrame, *, height: int, width: int) -> DataFrame:
    """Regions that do not touch the image border."""
    edge = F.col("y").isin(0, height - 1) | F.col("x").isin(0, width - 1)
    touches = F.max(edge).over(Window.partitionBy(*REGION))
    return labels.withColumn("_t", touches).where(~F.col("_t")).drop("_t")


def holes(masks: DataFrame, *, height: int, width: int, max_size: int | None = None) -> DataFrame:
    """Background pixels enclosed by foreground: ``fov, peak, t, y, x, label`` (one label per hole)."""
    inverse = masks.withColumn("px", F.transform("px", lambda v: F.when(v == 0, 1).otherwise(0)))
    inner = clear_border(label_components(inverse), height=height, width=width)
    if max_size is None:
        return inner
    n = F.count(F.lit(1)).over(Window.partitionBy(*REGION))
    return inner.withColumn("_n", n).where(F.col("_n") < max_size).drop("_n")


def segment(stacks: DataFrame, thresholds: DataFrame, *, open1: float = 2, distance: float = 2, open2: float = 1,
            min_size: int = 25) -> DataFrame:
    """Segment images above their threshold (:func:`otsu`): ``fov, peak, t, y, x, label``.

    Border objects are cleared, the mask is opened, cores away from the background become
    markers, small markers go, and each marker grows over the thresholded pixels it reaches.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            out = []
            for px, h, w, level in zip(b["px"], b["height"], b["width"], b["threshold"]):
                mask = k.without_border(np.reshape(px, (h, w)) > level)
                core = k.far_from_background(k.opened(mask, open1), distance)
                core = k.without_border(k.opened(core, open2))
                markers = k.components(k.at_least(k.components(core), min_size) > 0)
                out.append(k.spread(markers, mask).ravel().astype(np.int32))
            yield b[["fov", "peak", "t", "width"]].assign(lab=out)

    rows = stacks.join(thresholds, IMAGE).select(*IMAGE, "height", "width", "px", "threshold")
    return _flat(rows.mapInPandas(run, "fov int, peak int, t int, width int, lab array<int>"))


def dice(a: DataFrame, b: DataFrame, *, smooth: float = 0.0, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Overlap of two masks given as pixel rows: ``keys, dice``."""
    keys = list(keys)
    side = lambda df, n: df.select(*keys, "y", "x", F.lit(1 if n == "a" else 0).alias("a"), F.lit(1 if n == "b" else 0).alias("b"))
    both = side(a, "a").unionByName(side(b, "b")).groupBy(*keys, "y", "x").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = both.groupBy(*keys).agg(F.sum(F.col("a") * F.col("b")).alias("i"), F.sum(F.col("a") + F.col("b")).alias("n"))
    return n.select(*keys, safe_div(2 * F.col("i") + smooth, F.col("n") + smooth).alias("dice"))


def mask_scores(df: DataFrame, *, keys: Sequence[str] = IMAGE, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Precision, recall, F1, F2, F0.5 and mean absolute difference of predicted against true masks."""
    hit = lambda c: F.sum(F.rint(F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))))
    t, p = F.col(true).cast("double"), F.col(pred).cast("double")
    s = df.groupBy(*keys).agg(hit(t * p).alias("tp"), hit(t).alias("pos"), hit(p).alias("guess"),
                              (F.abs(F.sum(p) - F.sum(t)) / F.count(t)).alias("abs_diff"))
    s = s.withColumns({"precision": F.col("tp") / (F.col("guess") + EPSILON), "recall": F.col("tp") / (F.col("pos") + EPSILON)})

    def f(beta: float) -> Column:
        pr, rc = F.col("precision"), F.col("recall")
        return (1 + beta * beta) * pr * rc / (rc + beta * beta * pr + EPSILON)

    return s.select(*keys, "precision", "recall", f(1).alias("f1"), f(2).alias("f2"), f(0.5).alias("f05"), "abs_diff")


def tversky(df: DataFrame, *, alpha: float = 0.5, beta: float = 0.5, keys: Sequence[str] = IMAGE, true: str = "y_true",
            pred: str = "y_pred") -> DataFrame:
    """Tversky index: hits over hits plus weighted false positives and false negatives."""
    t, p = F.col(true).cast("double"), F.col(pred).cast("double")
    tp = F.sum(t * p)
    return df.groupBy(*keys).agg(
        safe_div(tp, tp + alpha * F.sum(p * (1 - t)) + beta * F.sum((1 - p) * t)).alias("tversky"))
