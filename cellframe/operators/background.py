"""Background subtraction and region intensities.

Image rows (``stacks``: keys, height, width, ``px``) carry one whole image each, so
work inside an image needs no shuffle. ``pixels`` is the exploded form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import safe_div
from ..functions.kernels import best_match, blurred, moved, thinned
from .filters import analysed

IMAGE = ["fov", "peak", "t"]
REGION = [*IMAGE, "label"]


def explode_pixels(stacks: DataFrame) -> DataFrame:
    """One row per pixel of every image: ``fov, peak, t, y, x, v``."""
    flat = stacks.select(*IMAGE, "width", F.posexplode("px").alias("_i", "v"))
    return flat.select(*IMAGE, F.floor(F.col("_i") / F.col("width")).cast("int").alias("y"),
                       (F.col("_i") % F.col("width")).alias("x"), "v")


def average_empties(pixels: DataFrame, specs: DataFrame) -> DataFrame:
    """Mean of the channels marked empty, truncated to whole numbers: ``fov, t, y, x, empty``."""
    return analysed(pixels, specs, spec=0).groupBy("fov", "t", "y", "x").agg(F.floor(F.avg("v")).cast("int").alias("empty"))


def average_empties_aligned(stacks: DataFrame, specs: DataFrame, *, pad: int = 10) -> DataFrame:
    """Like :func:`average_empties`, with every empty first moved onto the first one of its frame."""
    empties = analysed(stacks, specs, spec=0)
    first = empties.groupBy("fov", "t").agg(F.min_by("px", "peak").alias("ref"))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ref, px, h, w in zip(b["ref"], b["px"], b["height"], b["width"]):
                img = np.reshape(px, (h, w))
                _, dy, dx = best_match(np.reshape(ref, (h, w)), img, pad)
                out.append(moved(img, dy, dx).ravel())
            yield b[["fov", "peak", "t", "height", "width"]].assign(px=out)

    cols = ["fov", "peak", "t", "height", "width", "px", "ref"]
    aligned = empties.join(first, ["fov", "t"]).select(*cols).mapInPandas(
        align, "fov int, peak int, t int, height int, width int, px array<int>")
    return explode_pixels(aligned).groupBy("fov", "t", "y", "x").agg(F.floor(F.avg("v")).cast("int").alias("empty"))


def borrow_empties(empties: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add the empties of other fields of view: ``mapping(from_fov, to_fov)``; own empties stay as they are."""
    own = empties.select("fov").distinct()
    wanted = mapping.join(own, mapping["to_fov"] == own["fov"], "left_anti")
    lent = empties.join(wanted, F.col("fov") == F.col("from_fov")).drop("fov", "from_fov").withColumnRenamed("to_fov", "fov")
    return empties.unionByName(lent.select(*empties.columns))


def subtract_fluor(pixels: DataFrame, empties: DataFrame, *, size: tuple[int, int], empty_size: tuple[int, int]) -> DataFrame:
    """Channel minus empty, not below zero; a smaller empty is centred with repeated edges, a larger one cropped.

    The value is null in frames that have no empty.
    """
    def place(axis: str, i: int) -> Column:
        before = max(size[i] - empty_size[i], 0) // 2
        return F.least(F.greatest(F.col(axis) - before, F.lit(0)), F.lit(empty_size[i] - 1))

    placed = pixels.withColumns({"_y": place("y", 0), "_x": place("x", 1)})
    lent = empties.select("fov", "t", F.col("y").alias("_y"), F.col("x").alias("_x"), "empty")
    left = F.col("v") - F.col("empty")
    return placed.join(lent, ["fov", "t", "_y", "_x"], "left").select(
        *IMAGE, "y", "x", F.when(left.isNotNull(), F.greatest(left, F.lit(0))).alias("v"))


def empty_images(empties: DataFrame) -> DataFrame:
    """Pack the averaged empties into image rows ``fov, t, empty_px`` (row order)."""
    packed = empties.groupBy("fov", "t").agg(F.sort_array(F.collect_list(F.struct("y", "x", "empty"))).alias("p"))
    return packed.select("fov", "t", F.transform("p", lambda p: p["empty"]).alias("empty_px"))


def subtract_phase(stacks: DataFrame, empties: DataFrame, *, pad: int = 10) -> DataFrame:
    """Align the frame's empty to each channel image and take empty minus channel, not below zero."""
    def subtract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for px, empty, h, w in zip(b["px"], b["empty_px"], b["height"], b["width"]):
                img, e = np.reshape(px, (h, w)).astype(int), np.reshape(empty, (h, w)).astype(int)
                _, dy, dx = best_match(img, e, pad)
                out.append(np.maximum(moved(e, dy, dx) - img, 0).ravel())
            yield b[["fov", "peak", "t", "height", "width"]].assign(px=out)

    return stacks.join(empty_images(empties), ["fov", "t"]).select(*IMAGE, "height", "width", "px", "empty_px").mapInPandas(
        subtract, "fov int, peak int, t int, height int, width int, px array<int>")


def median_cross(stacks: DataFrame) -> DataFrame:
    """Median of every pixel and its four neighbours; the border repeats its own pixels."""
    w, n = F.col("width"), F.col("height") * F.col("width")
    px = F.col("px")

    def middle(v: Column, i: Column) -> Column:
        up = F.when(i < w, i).otherwise(i - w)
        down = F.when(i >= n - w, i).otherwise(i + w)
        left = F.when(i % w == 0, i).otherwise(i - 1)
        right = F.when(i % w == w - 1, i).otherwise(i + 1)
        return F.get(F.sort_array(F.array(v, *[F.get(px, j) for j in (up, down, left, right)])), F.lit(2))

    return stacks.withColumn("px", F.transform(px, middle))


def normalise(stacks: DataFrame) -> DataFrame:
    """Divide by the channel's largest median-filtered value and clip at one."""
    top = median_cross(stacks).groupBy("fov", "peak").agg(F.max(F.array_max("px")).alias("_top"))
    return stacks.join(top, ["fov", "peak"]).withColumn(
        "px", F.transform("px", lambda v: F.least(v / F.col("_top"), F.lit(1.0)))).drop("_top")


def background_correct(stacks: DataFrame, *, sigma: float = 10) -> DataFrame:
    """Median-filtered image minus its Gaussian blur."""
    def correct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            imgs = [np.reshape(p, (h, w)).astype(float) for p, h, w in zip(b["px"], b["height"], b["width"])]
            yield b.assign(px=[(i - blurred(i, sigma)).ravel() for i in imgs])

    return median_cross(stacks).select(*IMAGE, "height", "width", "px").mapInPandas(
        correct, "fov int, peak int, t int, height int, width int, px array<double>")


def region_pixels(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """Pixels of labelled regions: ``fov, peak, t, y, x, label, v``.

    Tables of whole images (``px``) and label images (``lab``) are joined image by image and
    spread afterwards, so no pixel is shuffled; tables of pixels are joined pixel by pixel.
    """
    if "lab" not in labels.columns:
        return pixels.join(labels, [*IMAGE, "y", "x"])
    both = pixels.select(*IMAGE, "width", "px").join(labels.select(*IMAGE, "lab"), IMAGE)
    flat = both.select(*IMAGE, "width", F.posexplode(F.arrays_zip("px", "lab")).alias("_i", "_e")).where("_e.lab > 0")
    return flat.select(*IMAGE, F.floor(F.col("_i") / F.col("width")).cast("int").alias("y"), (F.col("_i") % F.col("width")).alias("x"),
                       F.col("_e.lab").alias("label"), F.col("_e.px").alias("v"))


def region_intensity(pixels: DataFrame, labels: DataFrame, obs: DataFrame) -> DataFrame:
    """Total intensity of each observed region, also per area and per volume (``obs``: region keys, area, volume)."""
    total = region_pixels(pixels, labels).groupBy(*REGION).agg(F.sum("v").alias("total"))
    return obs.select(*REGION, "area", "volume").join(total, REGION, "left").withColumn(
        "total", F.coalesce("total", F.lit(0))).select(
        *REGION, "total", safe_div(F.col("total"), F.col("area")).alias("per_area"),
        safe_div(F.col("total"), F.col("volume")).alias("per_volume"))


def region_intensity_spread(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """Median and population deviation of each region; a region is bounded by its image."""
    return region_pixels(pixels, labels).groupBy(*REGION).agg(
        F.percentile("v", F.lit(0.5)).alias("median"), F.stddev_pop("v").alias("std"))


def fl_per_volume(obs: DataFrame, *, fl: str = "fl_total", volume: str = "volume") -> DataFrame:
    return obs.withColumn("fl_per_volume", safe_div(F.col(fl), F.col(volume)))


def axis_distance() -> tuple[Column, Column]:
    """Position along and across the region's long axis, from its centroid (columns cy, cx, orientation)."""
    dy, dx = F.col("y") - F.col("cy"), F.col("x") - F.col("cx")
    co, si = F.cos("orientation"), F.sin("orientation")
    return dx * co - dy * si, dx * si + dy * co


def midline_intensity(pixels: DataFrame, labels: DataFrame, regions: DataFrame) -> DataFrame:
    """Mean intensity of the region's pixels within half a pixel of its long axis; zero if there is none."""
    axes = regions.select(*REGION, F.col("y").alias("cy"), F.col("x").alias("cx"), "orientation")
    _, across = axis_distance()
    # rounding decides the same way for pixels exactly half a pixel away
    near = F.round(F.abs(across), 9) <= 0.5
    got = region_pixels(pixels, labels).join(axes, REGION).groupBy(*REGION).agg(F.avg(F.when(near, F.col("v"))).alias("m"))
    return regions.select(*REGION).join(got, REGION, "left").select(*REGION, F.coalesce("m", F.lit(0.0)).alias("midline"))


def medial_axis_intensity(stacks: DataFrame, label_images: DataFrame) -> DataFrame:
    """Mean intensity of every region on its own midline, which follows bent cells: region keys, ``midline``; zero if nothing of the region is left.

    ``stacks(fov, peak, t, height, width, px)``, ``label_images(fov, peak, t, lab)``. Midlines come
    from thinning the label image (:func:`cellframe.functions.kernels.thinned`), one image at a time.
    """
    both = stacks.select(*IMAGE, "height", "width", "px").join(label_images.select(*IMAGE, "lab"), IMAGE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                lab = np.reshape(r.lab, (r.height, r.width))
                n = int(lab.max(initial=0)) + 1
                line, px = thinned(lab).ravel(), np.asarray(r.px, float)
                left, total = np.bincount(line, minlength=n), np.bincount(line, weights=px, minlength=n)
                rows += [(r.fov, r.peak, r.t, int(i), total[i] / left[i] if left[i] else 0.0) for i in np.unique(lab[lab > 0])]
            yield pd.DataFrame(rows, columns=["fov", "peak", "t", "label", "midline"])

    return both.mapInPandas(run, "fov int, peak int, t int, label int, midline double")
