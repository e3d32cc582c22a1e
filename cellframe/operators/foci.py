"""Fluorescent foci: detection, assignment to cells, linking and tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import safe_div, volume
from ..functions.kernels import best_product, laplace_peaks, soft_masks
from ..functions.lineage_cut import cut
from .cells import order_daughters
from .lineage import resolve
from .regions import IMAGE, REGION, make_id


def focus_displacement(foci: DataFrame, regions: DataFrame) -> DataFrame:
    """Distance of each focus (region keys, ``fy, fx``) from the cell centre along and across the cell."""
    c = regions.select(*REGION, F.col("y").alias("cy"), F.col("x").alias("cx"), "orientation")
    o = F.when(F.col("orientation") < 0, F.col("orientation") + math.pi).otherwise(F.col("orientation"))
    dy, dx = F.col("fy") - F.col("cy"), F.col("fx") - F.col("cx")
    return foci.join(c, REGION).withColumns({"disp_l": dy * F.sin(o) - dx * F.cos(o), "disp_w": dy * F.cos(o) + dx * F.sin(o)}) \
        .drop("cy", "cx", "orientation")


def focus_filter(foci: DataFrame, regions: DataFrame, medians: DataFrame, *, ratio: float = 1.5, height: str = "height") -> DataFrame:
    """Foci inside their cell's box whose height is at least ``ratio`` times the cell's median intensity."""
    box = regions.select(*REGION, "min_y", "min_x", "max_y", "max_x").join(medians.select(*REGION, "median"), REGION)
    y, x = F.col("fy"), F.col("fx")
    inside = (y > F.col("min_y")) & (y < F.col("max_y")) & (x > F.col("min_x")) & (x < F.col("max_x"))
    kept = foci.join(box, REGION).where(inside & (safe_div(F.col(height), F.col("median")) >= ratio))
    return kept.select(foci.columns)


def moments(patches: DataFrame, keys: list[str]) -> DataFrame:
    """Gaussian parameters of pixel patches by moments: ``keys, height, cy, cx, width``.

    The width comes from the single column through the centroid, with the distances
    counted from the column centroid.
    """
    v = F.col("v").cast("double")
    mean = patches.groupBy(*keys).agg(F.max("v").alias("height"), safe_div(F.sum(F.col("y") * v), F.sum(v)).alias("cy"),
                                      safe_div(F.sum(F.col("x") * v), F.sum(v)).alias("cx"))
    gap = F.col("y") - F.col("cx")
    through = patches.join(mean, keys).where(F.col("x") == F.floor("cx")).groupBy(*keys).agg(
        F.sqrt(safe_div(F.sum(F.abs(gap * gap * v)), F.sum(v))).alias("width"))
    return mean.join(through, keys, "left")


def detect_foci(stacks: DataFrame, labels: DataFrame, *, min_sigma: int = 2, max_sigma: int = 3, threshold: float = 0.001) -> DataFrame:
    """Bright spots of every cell-frame: region keys, ``fy, fx, sigma, height, width, total``.

    ``labels`` holds label images (``lab``) beside the intensity images (``px``). Spots are
    maxima of the scale-normalised Laplacian; their centre and width come from moments.
    """
    sigmas = list(range(min_sigma, max_sigma + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                img, lab = np.reshape(r.px, (r.height, r.width)).astype(float), np.reshape(r.lab, (r.height, r.width))
                for one in np.unique(lab[lab > 0]):
                    masked = np.where(lab == one, img, 0)
                    if masked.max() <= 0:
                        continue
                    for y, x, s in laplace_peaks(masked, sigmas, threshold):
                        reach = int(np.ceil(np.sqrt(2) * s))
                        y0, x0 = max(y - reach, 0), max(x - reach, 0)
                        spot = img[y0:y + reach, x0:x + reach]
                        if spot.sum() <= 0:
                            continue
                        # image coordinates: sums of whole numbers and one division
                        iy, ix = np.indices(spot.shape) + np.array([y0, x0])[:, None, None]
                        cy, cx = (iy * spot).sum() / spot.sum(), (ix * spot).sum() / spot.sum()
                        wide = np.sqrt((((iy - cy) ** 2 + (ix - cx) ** 2) * spot).sum() / spot.sum() / 2)
                        near = img[max(y - max_sigma, 0):y + max_sigma, max(x - max_sigma, 0):x + max_sigma]
                        rows.append((r.fov, r.peak, r.t, int(one), cy, cx, s, spot.max(), wide, near.sum()))
            yield pd.DataFrame(rows, columns=["fov", "peak", "t", "label", "fy", "fx", "sigma", "height", "width", "total"])

    both = stacks.select(*IMAGE, "height", "width", "px").join(labels.select(*IMAGE, "lab"), IMAGE)
    return both.mapInPandas(run, "fov int, peak int, t int, label int, fy double, fx double, sigma double, height double, "
                                 "width double, total double")


def assign_foci(focus_px: DataFrame, cell_px: DataFrame, *, overlap: float = 0.5) -> DataFrame:
    """Cells that hold at least a share of a focus region's pixels: image keys, ``focus_label, label, share``."""
    f = focus_px.select(*IMAGE, "y", "x", F.col("label").alias("focus_label"))
    area = f.groupBy(*IMAGE, "focus_label").agg(F.count(F.lit(1)).alias("_area"))
    both = f.join(cell_px.select(*IMAGE, "y", "x", "label"), [*IMAGE, "y", "x"]).groupBy(*IMAGE, "focus_label", "label").agg(
        F.count(F.lit(1)).alias("_n"))
    return both.join(area, [*IMAGE, "focus_label"]).withColumn("share", F.col("_n") / F.col("_area")).where(
        F.col("share") >= overlap).drop("_n", "_area")


def focus_scores(label_images: DataFrame, *, sigma: float = 1.0) -> DataFrame:
    """Largest product of the blurred masks of every focus and every focus of the previous frame that it meets.

    ``label_images(fov, peak, t, height, width, lab)``. Returns region keys, ``prev_label,
    score`` and ``n_prev``, the largest label of the previous frame; foci that do not meet have
    no row (their score is zero). The label images of two neighbouring frames meet in one row.
    """
    now = label_images.select(*IMAGE, "height", "width", "lab")
    before = label_images.select("fov", "peak", (F.col("t") + 1).alias("t"), F.col("lab").alias("prev"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                shape = (r.height, r.width)
                old, new = (soft_masks(np.reshape(img, shape), sigma) for img in (r.prev, r.lab))
                n = int(np.max(r.prev))
                rows += [(r.fov, r.peak, r.t, k, p, score, n) for k, c in new.items() for p, a in old.items() if (score := best_product(a, c)) > 0]
            yield pd.DataFrame(rows, columns=["fov", "peak", "t", "label", "prev_label", "score", "n_prev"])

    return now.join(before, IMAGE).mapInPandas(run, "fov int, peak int, t int, label int, prev_label int, score double, n_prev int")


def link_foci(label_images: DataFrame | None, valid: DataFrame, *, sigma: float = 1.0, prefix: str = "", scores: DataFrame | None = None) -> DataFrame:
    """Focus ids of the valid focus regions (``fov, peak, t, label``): ``focus_id, steps`` added.

    A focus continues the previous focus with the best score, unless all scores are
    equal; otherwise it starts a new focus. ``scores`` are those of :func:`focus_scores`, where
    they are known already.
    """
    s = focus_scores(label_images, sigma=sigma) if scores is None else scores
    best = s.groupBy(*REGION).agg(
        F.min(F.struct(F.round(-F.col("score"), 9).alias("s"), "prev_label"))["prev_label"].alias("prev_label"),
        # a previous focus that is not met has the score zero
        (F.max("score") - F.when(F.count("*") < F.max("n_prev"), 0.0).otherwise(F.min("score"))).alias("spread")).where("spread > 1e-9")
    nodes = cut(make_id(valid.select(*REGION).distinct(), prefix=prefix, name="id"))
    back = nodes.select("fov", "peak", (F.col("t") + 1).alias("t"), F.col("label").alias("prev_label"), F.col("id").alias("to"))
    edges = nodes.join(best, REGION).join(back, [*IMAGE, "prev_label"]).select("id", "to")
    chain = resolve(nodes.select(F.col("id").alias("cell_id")), edges)
    return nodes.join(chain, nodes["id"] == chain["cell_id"]).select(*REGION, F.col("end").alias("focus_id"), "steps")


def focus_merges(scores: DataFrame, linked: DataFrame) -> DataFrame:
    """Foci that end by meeting another one: one row per focus with its merge attributes.

    ``scores`` are those of :func:`focus_scores`, ``linked(fov, peak, t, label, focus_id)`` those of
    :func:`link_foci`. A region that meets regions of several foci of the frame before joins them.
    A focus whose last regions are among those, and which does not go on, is ``ended_by_merge``:
    ``merge_partner`` is the focus of the joining region of best score (ties by label), and
    ``merge_time`` that region's frame. Merges make a graph, in which every focus has at most one
    way out and a partner always ends later: ``final_id`` is the focus in which a chain of
    ``n_merges`` merges ends, and ``n_merged_in`` the number of foci that end in this one directly.
    """
    foci = linked.select(*REGION, "focus_id")
    life = cut(foci.groupBy("focus_id").agg(F.min("t").alias("appear_time"), F.max("t").alias("last_time")))
    before = foci.select("fov", "peak", (F.col("t") + 1).alias("t"), F.col("label").alias("prev_label"), F.col("focus_id").alias("from_id"))
    met = cut(scores.where("score > 0").select(*REGION, "prev_label", "score").join(foci, REGION).join(before, [*IMAGE, "prev_label"]))
    # several foci of the frame before in one region
    joining = met.groupBy(*REGION).agg(F.min("from_id").alias("_a"), F.max("from_id").alias("_b")).where("_a <> _b").select(*REGION)
    ended = met.join(joining, REGION, "left_semi").join(life.select(F.col("focus_id").alias("from_id"), (F.col("last_time") + 1).alias("t")), ["from_id", "t"], "left_semi")
    rank = F.struct(F.round(-F.col("score"), 9), "prev_label", "label")
    merges = cut(ended.groupBy(F.col("from_id").alias("focus_id"), F.col("t").alias("merge_time")).agg(F.min_by("focus_id", rank).alias("merge_partner")))
    into = merges.groupBy(F.col("merge_partner").alias("focus_id")).agg(F.count(F.lit(1)).alias("n_merged_in"))
    chain = resolve(life.select(F.col("focus_id").alias("cell_id")), merges.select(F.col("focus_id").alias("id"), F.col("merge_partner").alias("to")))
    ends = chain.select(F.col("cell_id").alias("focus_id"), F.col("end").alias("final_id"), F.col("steps").alias("n_merges"))
    out = life.join(merges, "focus_id", "left").join(into, "focus_id", "left").join(ends, "focus_id")
    return out.select("focus_id", "appear_time", "last_time", "merge_partner", "merge_time", F.col("merge_partner").isNotNull().alias("ended_by_merge"),
                      "final_id", "n_merges", F.coalesce("n_merged_in", F.lit(0)).alias("n_merged_in"))


def focus_long_table(focus_obs: DataFrame, *, key: str = "cell_id") -> DataFrame:
    """One row per focus and time with its size, its fluorescence by area and volume, and its place in the cell.

    ``focus_obs``: key, t, length, width, area, seconds, total_fl, median_fl, sd_fl, disp_l, disp_w.
    """
    total, size = F.col("total_fl"), volume("length", "width")
    return focus_obs.select(
        F.col(key).alias("focus_id"), "t", "length", size.alias("volume"), "area", "seconds", safe_div(total, F.col("area")).alias("area_mean"),
        safe_div(total, size).alias("volume_mean"), total.alias("total"), F.col("median_fl").alias("median"), F.col("sd_fl").alias("sd"), "disp_l", "disp_w")


def focus_tables(foci: DataFrame, focus_obs: DataFrame) -> DataFrame:
    """Wide table: one row per focus with its first appearance, split and children in order of y.

    ``foci(cell_id, parent_id)`` names each focus by ``cell_id``; ``focus_obs`` has ``cell_id, t, label, y``.
    """
    seen = focus_obs.groupBy("cell_id").agg(F.min("t").alias("appear_time"), F.min_by("label", "t").alias("appear_label"),
                                            F.max("t").alias("last_time"))
    kids = order_daughters(foci, focus_obs).withColumnRenamed("parent_id", "cell_id")
    split = foci.where("parent_id IS NOT NULL").select("cell_id", "parent_id").join(seen.select("cell_id", "appear_time"), "cell_id") \
        .groupBy(F.col("parent_id").alias("cell_id")).agg(F.min("appear_time").alias("split_time"))
    wide = foci.select("cell_id", "parent_id").join(seen, "cell_id").join(kids, "cell_id", "left").join(split, "cell_id", "left")
    wide = wide.withColumn("disappear", F.when(F.col("split_time").isNull(), F.col("last_time")))
    return wide.withColumnRenamed("cell_id", "focus_id")
