"""Channel geometry: projections, channel ends and masks, drift, orientation, cropping and picking.

``pixels`` holds one row per image pixel with the image keys (``fov, peak, t`` by
default), ``y``, ``x`` and ``v``. Windows in this module run inside one image or over
the columns of one image, which the image size bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div
from ..functions.kernels import best_match
from ..functions.lineage_cut import cut
from ..functions.ordered import one_row, running
from ..sources.catalog import sample_frames

IMAGE = ("fov", "peak", "t")


def projections(pixels: DataFrame, *, axis: str, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Intensity summed over the rows (``axis="x"``) or columns (``axis="y"``): ``keys, axis, s``."""
    return pixels.groupBy(*keys, axis).agg(F.sum("v").alias("s"))


def _first_max(value: Column, at: Column) -> Column:
    """Position of the maximum; the smallest position wins ties."""
    return F.max(F.struct(value.alias("v"), (-at).alias("p")))["p"] * -1


def _ends(proj: DataFrame, keys: Sequence[str], height: int) -> DataFrame:
    """Closed and open end of a row projection from its first derivative."""
    step = proj.withColumn("d", F.lead("s").over(Window.partitionBy(*keys).orderBy("y")) - F.col("s")).where("d IS NOT NULL")
    top, low = height // 3, 2 * height // 3
    y, d = F.col("y"), F.col("d")
    return step.groupBy(*keys).agg(_first_max(F.when(y < top, d), F.when(y < top, y)).alias("closed"),
                                   _first_max(F.when(y >= low, -d), F.when(y >= low, y)).alias("open"))


def channel_ends(pixels: DataFrame, channels: DataFrame, *, height: int, half_width: int, tol: int = 15, border: int = 15,
                 keys: Sequence[str] = IMAGE) -> DataFrame:
    """Closed and open end of every channel: ``keys, x, closed, open``.

    ``channels`` gives channel centres ``keys, x``. The ends found in a channel's own
    columns count only if they agree with those of the whole image and keep off its border.
    """
    keys = list(keys)
    rows = projections(pixels, axis="y", keys=keys)
    whole = _ends(rows, keys, height).withColumnsRenamed({"closed": "_c", "open": "_o"})
    # every channel names its few columns, so pixels meet them by equality
    cols = channels.select(*keys, F.col("x").alias("_x"), F.explode(
        F.sequence(F.col("x") - half_width, F.col("x") + (half_width - 1))).alias("x"))
    own = pixels.join(cols, [*keys, "x"]).groupBy(*keys, "_x", "y").agg(F.sum("v").alias("s"))
    own = _ends(own, [*keys, "_x"], height)
    both = channels.select(*keys, F.col("x").alias("_x")).join(whole, keys).join(own, [*keys, "_x"], "left")
    length, default = F.col("open") - F.col("closed"), F.col("_o") - F.col("_c")
    good = ((F.abs(length - default) <= tol) & (F.col("closed") >= border) & (F.col("open") <= height - border))
    good = F.coalesce(good, F.lit(False))
    return both.select(*keys, F.col("_x").alias("x"), F.when(good, F.col("closed")).otherwise(F.col("_c")).alias("closed"),
                       F.when(good, F.col("open")).otherwise(F.col("_o")).alias("open"))


def channel_peaks(proj: DataFrame, *, width: int, separation: float, image_width: int,
                  keys: Sequence[str] = IMAGE) -> DataFrame:
    """Channel centres: local maxima of the column projection, not too near the image border: ``keys, x``."""
    w = Window.partitionBy(*keys).orderBy("x")
    before = F.max("s").over(w.rangeBetween(-width, -1))
    after = F.max("s").over(w.rangeBetween(1, width))
    top = proj.withColumns({"_b": before, "_a": after}).where(
        (F.col("_b").isNull() | (F.col("s") > F.col("_b"))) & (F.col("_a").isNull() | (F.col("s") >= F.col("_a"))))
    return top.where((F.col("x") >= separation / 2) & (image_width - F.col("x") >= separation / 2)).select(*keys, "x", "s")


def _responses(values: Column, width: int) -> Column:
    """Response of an array to a Mexican hat of the given width at every place; outside the array it is zero."""
    reach = 4 * width
    hat = F.array(*[F.lit((1 - (k / width) ** 2) * math.exp(-0.5 * (k / width) ** 2) / math.sqrt(width)) for k in range(-reach, reach + 1)])
    at = lambda i: F.aggregate(F.sequence(F.lit(-reach), F.lit(reach)), F.lit(0.0),
                               lambda total, k: total + F.coalesce(F.get(values, i + k), F.lit(0.0)) * F.get(hat, k + reach))
    # rounding decides ties the same way everywhere
    return F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.round(at(i), 6))


def _maxima(response: Column) -> Column:
    """Places of the positive local maxima, the first of equal neighbours."""
    low = F.lit(float("-inf"))
    top = lambda i, r: (r > 0) & (r > F.coalesce(F.get(response, i - 1), low)) & (r >= F.coalesce(F.get(response, i + 1), low))
    return F.filter(F.sequence(F.lit(0), F.size(response) - 1), lambda i: top(i, F.get(response, i)))


def _ridge(pos: Column, length: Column, best: Column, on: bool) -> Column:
    return F.struct(pos.alias("pos"), length.cast("int").alias("length"), best.alias("best"), F.lit(on).alias("on"))


def ridge_peaks(proj: DataFrame, *, widths: Sequence[int], separation: float, image_width: int, snr: float = 1.0, min_length: int | None = None,
                keys: Sequence[str] = IMAGE) -> DataFrame:
    """Channel centres of any of the ``widths``: ``keys, x, length, best``, from a column projection (``keys, x, s``).

    The projection, less its mean, is compared with Mexican hats of each width. From the widest to the
    narrowest, local maxima are linked to the nearest ones of the next width within half that width
    (the smaller place of equals); a maximum that nothing reaches begins a ridge, and a ridge without
    a next maximum ends. A ridge of at least ``min_length`` widths (by default a quarter of
    them) counts if its ``best`` response is at least ``snr`` times the tenth percentile of the
    narrowest width's absolute responses. Peaks nearer to the border than half a separation go.
    """
    order = sorted(set(widths), reverse=True)
    least = min_length or max(1, -(-len(order) // 4))
    rows = proj.groupBy(*keys).agg(F.avg("s").alias("_mean"), F.sort_array(F.collect_list(F.struct("x", F.col("s").cast("double").alias("s")))).alias("_p"))
    # written step by step, so that no array is computed again for each of its elements
    rows = cut(rows.select(*keys, F.col("_p.x").alias("_x"), F.transform("_p", lambda p: p["s"] - F.col("_mean")).alias("_c")))
    rows = cut(rows.select(*keys, "_x", *[_responses(F.col("_c"), w).alias(f"_r{w}") for w in order]))
    rows = cut(rows.select(*rows.columns, *[_maxima(F.col(f"_r{w}")).alias(f"_m{w}") for w in order]))
    first = order[0]
    rows = rows.withColumn("_ridges", F.transform(f"_m{first}", lambda i: _ridge(i, F.lit(1), F.get(f"_r{first}", i), True)))
    for w in order[1:]:
        r, m, reach = F.col(f"_r{w}"), F.col(f"_m{w}"), max(1, w // 2)

        def nearest(ridge):
            found = F.filter(m, lambda i: F.abs(i - ridge["pos"]) <= reach)
            return F.when(ridge["on"], F.array_min(F.transform(found, lambda i: F.struct(F.abs(i - ridge["pos"]).alias("d"), i.alias("i"))))["i"])

        rows = cut(rows.withColumn("_linked", F.transform("_ridges", lambda x: F.struct(x.alias("ridge"), nearest(x).alias("next")))))
        kept = F.transform("_linked", lambda x: F.when(x["next"].isNull(), _ridge(x["ridge"]["pos"], x["ridge"]["length"], x["ridge"]["best"], False)).otherwise(
            _ridge(x["next"], x["ridge"]["length"] + 1, F.greatest(x["ridge"]["best"], F.get(r, x["next"])), True)))
        fresh = F.transform(F.filter(m, lambda i: ~F.coalesce(F.exists("_linked", lambda x: x["next"] == i), F.lit(False))),
                            lambda i: _ridge(i, F.lit(1), F.get(r, i), True))
        rows = rows.withColumn("_ridges", F.concat(kept, fresh)).drop("_linked", f"_m{w}")
    size = F.sort_array(F.transform(f"_r{order[-1]}", lambda v: F.abs(v)))
    noise = F.get(size, F.floor((F.size(size) - 1) / 10).cast("int"))
    found = rows.select(*keys, "_x", noise.alias("_noise"), F.explode("_ridges").alias("_ridge")).where(
        (F.col("_ridge.length") >= least) & (F.col("_ridge.best") >= snr * F.col("_noise")))
    # ridges that meet are one peak
    peaks = found.groupBy(*keys, F.get("_x", F.col("_ridge.pos")).alias("x")).agg(F.max("_ridge.length").alias("length"), F.max("_ridge.best").alias("best"))
    return peaks.where((F.col("x") >= separation / 2) & (image_width - F.col("x") >= separation / 2))


def consensus_masks(boxes: DataFrame, *, crop_pad: int, length_pad: int, shape: tuple[int, int]) -> DataFrame:
    """One mask per channel and field of view from the boxes of all frames: ``fov, peak, min_row..max_col`` (inclusive).

    Boxes are padded, clipped to the image and merged where their columns touch.
    """
    height, width = shape
    clip = boxes.select(
        "fov", F.greatest(F.col("min_col") - crop_pad, F.lit(0)).alias("x1"),
        F.least(F.col("max_col") + crop_pad, F.lit(width)).alias("x2"),
        F.greatest(F.col("min_row") - length_pad, F.lit(0)).alias("y1"),
        F.least(F.col("max_row") + length_pad, F.lit(height)).alias("y2"))
    # after this at most one row per image column of a field of view is left
    starts = clip.groupBy("fov", "x1").agg(F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.max("y2").alias("y2"))
    order = Window.partitionBy("fov").orderBy("x1")
    reach = F.max("x2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = starts.withColumn("_new", F.when(F.col("x1") > reach, 1).otherwise(0))
    island = flagged.withColumn("_k", F.sum("_new").over(order)).groupBy("fov", "_k").agg(
        F.min("y1").alias("min_row"), (F.max("y2") - 1).alias("max_row"), F.min("x1").alias("min_col"),
        (F.max("x2") - 1).alias("max_col"))
    return island.where((F.col("min_col") > 0) & (F.col("max_col") < width)).select(
        "fov", F.floor((F.col("min_col") + F.col("max_col")) / 2).cast("int").alias("peak"), "min_row", "max_row",
        "min_col", "max_col")


def equalise_masks(masks: DataFrame, *, n_cols: int) -> DataFrame:
    """Grow all masks to the largest length (at the open end) and width (about the middle, odd pixel right)."""
    top = one_row(masks, l=F.max(F.col("max_row") - F.col("min_row")), w=F.max(F.col("max_col") - F.col("min_col")))
    more = top["w"] - (F.col("max_col") - F.col("min_col"))
    left = F.floor(more / 2)
    return masks.select(
        "fov", "peak", "min_row", (F.col("min_row") + top["l"]).alias("max_row"),
        F.when(more == 0, F.col("min_col")).otherwise(F.greatest(F.col("min_col") - left, F.lit(0))).alias("min_col"),
        F.when(more == 0, F.col("max_col")).otherwise(
            F.least(F.col("max_col") + (more - left), F.lit(n_cols - 1))).alias("max_col"))


def frame_masks(boxes: DataFrame) -> DataFrame:
    """Masks per frame from (row, column, row, column) boxes: row pair first, then column pair."""
    return boxes.select("fov", "peak", "t", F.array("min_row", "max_row").alias("rows"), F.array("min_col", "max_col").alias("cols"))


def trap_boxes(regions: DataFrame, *, min_area: int = 2000, width: int = 27, height: int = 256,
               shape: tuple[int, int]) -> DataFrame:
    """Boxes of fixed size around large regions; boxes that leave the image are dropped."""
    r, c = F.rint("y").cast("int"), F.rint("x").cast("int")
    big = regions.where(F.col("area") >= min_area)
    out = big.select("fov", "peak", "t", "label", (r - height // 2).alias("min_row"), (c - width // 2).alias("min_col"),
                     (r + height // 2).alias("max_row"), (c + width // 2 + width % 2).alias("max_col"))
    inside = (F.least("min_row", "min_col") >= 0) & (F.col("max_row") <= shape[0]) & (F.col("max_col") <= shape[1])
    return out.where(inside)


def frame_shifts(regions: DataFrame, *, track: Sequence[str] = ("peak", "label")) -> DataFrame:
    """Mean movement of all channels since the first frame: ``fov, t, dy, dx``, rounded to whole pixels.

    Only tracks present in the first frame of the field of view count.
    """
    first = regions.groupBy("fov").agg(F.min("t").alias("t"))
    start = regions.join(first, ["fov", "t"]).select("fov", *track, F.col("y").alias("_y"), F.col("x").alias("_x"))
    moved = regions.join(start, ["fov", *track]).groupBy("fov", "t")
    return moved.agg(F.rint(F.avg(F.col("y") - F.col("_y"))).cast("int").alias("dy"),
                     F.rint(F.avg(F.col("x") - F.col("_x"))).cast("int").alias("dx"))


def shift_boxes(boxes: DataFrame, shifts: DataFrame, *, size: int) -> DataFrame:
    """Boxes in every frame; a channel is dropped whole if any frame after the first moves it out of the image."""
    corners = {"min_row": "dy", "min_col": "dx", "max_row": "dy", "max_col": "dx"}
    first = shifts.groupBy("fov").agg(F.min("t").alias("_t0"))
    at = boxes.select("fov", "peak", *corners).join(shifts, "fov").join(first, "fov")
    later = F.col("t") != F.col("_t0")
    at = at.select("fov", "peak", "t", later.alias("_later"),
                   *[(F.col(c) + F.when(later, F.col(d)).otherwise(0)).alias(c) for c, d in corners.items()])
    out = F.col("_later") & ((F.least(*corners) < 0) | (F.greatest(*corners) > size))
    gone = at.where(out).select("fov", "peak").distinct()
    return at.join(gone, ["fov", "peak"], "left_anti").drop("_later")


def full_area_tracks(regions: DataFrame, *, area: int, keys: Sequence[str] = ("fov", "label")) -> DataFrame:
    """Regions of the tracks whose summed area is exactly ``area`` (width · height · frames)."""
    whole = regions.groupBy(*keys).agg(F.sum("area").alias("_a")).where(F.col("_a") == area).select(*keys)
    return regions.join(whole, list(keys), "left_semi")


def fill_missing_frames(frames: DataFrame, detections: DataFrame, *, keys: Sequence[str] = ("fov", "peak")) -> DataFrame:
    """Give frames without detections those of the last earlier frame that has some; a first frame takes the next one's."""
    keys = list(keys)
    seen = detections.select(*keys, "t").distinct().withColumn("_seen", F.col("t"))
    every = frames.select(*keys, "t").distinct().join(seen, [*keys, "t"], "left")
    filled = running(every, keys, ["t"], tops={"_seen": "_from"}, index="_i")
    after = seen.select(*keys, (F.col("t") - 1).alias("t"), F.col("_seen").alias("_next"))
    filled = filled.join(after, [*keys, "t"], "left")
    source = F.coalesce("_from", F.when(F.col("_i") == 1, F.col("_next")))
    filled = filled.select(*keys, "t", source.alias("_from")).where("_from IS NOT NULL")
    return filled.join(detections.withColumnRenamed("t", "_from"), [*keys, "_from"]).withColumnRenamed("_from", "source_t")


def orientation(pixels: DataFrame, *, height: int, mode: str = "auto", keys: Sequence[str] = IMAGE) -> DataFrame:
    """Whether each image has to be flipped so that channels open downwards: ``keys, flip``."""
    if mode in ("up", "down"):
        return pixels.select(*keys).distinct().withColumn("flip", F.lit(mode == "up"))
    # the pixels of one image row are bounded by the image width
    row = F.avg("v") if mode == "auto" else F.percentile("v", F.lit(0.5))
    rows = pixels.groupBy(*keys, "y").agg(row.alias("s"))
    at = rows.groupBy(*keys).agg(_first_max(F.col("s"), F.col("y")).alias("y"))
    if mode == "auto":
        return at.select(*keys, (F.col("y") < height / 2).alias("flip"))
    if mode == "profile":
        return at.select(*keys, (F.col("y") <= height // 2).alias("flip"))
    raise ValueError(f"unknown mode {mode!r}")


def flip_rows(pixels: DataFrame, flips: DataFrame, *, height: int, keys: Sequence[str] = IMAGE) -> DataFrame:
    turned = F.when(F.col("flip"), (height - 1) - F.col("y")).otherwise(F.col("y"))
    return pixels.join(flips, list(keys)).withColumn("y", turned).drop("flip")


def phase_plane(pixels: DataFrame, *, keys: Sequence[str] = IMAGE) -> DataFrame:
    """The plane with the highest mean of every image: ``keys, plane``; the first name wins ties."""
    mean = pixels.groupBy(*keys, "plane").agg(F.avg("v").alias("m"))
    return mean.groupBy(*keys).agg(F.min(F.struct((-F.col("m")).alias("m"), "plane"))["plane"].alias("plane"))


def crop_channels(frames: DataFrame, masks: DataFrame) -> DataFrame:
    """Cut the channels out of full frames ``fov, t, height, width, px``: one image per row, ``fov, peak, t, height, width, left, px``.

    A frame meets the masks of its field of view and its rows are sliced, so no pixel is
    shuffled. A mask that passes the bottom repeats the last row; one that passes a side is cut
    there, and ``left`` is the channel column of its first pixel.
    """
    kept = masks.where("max_row > min_row AND max_col > min_col")
    both = frames.join(kept, "fov").withColumns({
        "_a": F.greatest(F.col("min_col"), F.lit(0)), "_w": F.least(F.col("max_col"), F.col("width")) - F.greatest(F.col("min_col"), F.lit(0))})
    line = lambda r: F.slice("px", F.greatest(F.least(r, F.col("height") - 1), F.lit(0)) * F.col("width") + F.col("_a") + 1, F.col("_w"))
    rows = F.transform(F.sequence("min_row", F.col("max_row") - 1), line)
    # the crop comes first: beside new columns named height and width, the old ones could not be told apart
    cropped = both.where("_w > 0").withColumn("_px", F.flatten(rows))
    return cropped.select("fov", "peak", "t", (F.col("max_row") - F.col("min_row")).alias("height"), F.col("_w").alias("width"),
                          (F.col("_a") - F.col("min_col")).alias("left"), F.col("_px").alias("px"))


def channel_xcorr(stacks: DataFrame, *, pad: int = 10, n: int = 20) -> DataFrame:
    """Best normalised cross-correlation of sampled frames with the channel's first frame: ``fov, peak, t, score``."""
    keys = ["fov", "peak"]
    some = sample_frames(stacks, n=n)
    first = some.groupBy(*keys).agg(F.min_by("px", "t").alias("first_px"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [best_match(np.reshape(f, (h, w)), np.reshape(p, (h, w)), pad)[0]
                   for f, p, h, w in zip(b["first_px"], b["px"], b["height"], b["width"])]
            yield b[["fov", "peak", "t"]].assign(score=got)

    return some.join(first, keys).select(*keys, "t", "height", "width", "px", "first_px").mapInPandas(
        score, "fov int, peak int, t int, score double")


def pick_channels(scores: DataFrame, *, method: str, threshold: float = 0.9, col: str = "score") -> DataFrame:
    """Mark channels to analyse (1) or to ignore (-1): ``fov, peak, spec``.

    ``correlation``: a filled channel changes, so its mean score is below the threshold.
    ``probability``: the mean class probability is above it. ``count``: any cell was found.
    """
    rule = {"correlation": F.avg(col) < threshold, "probability": F.avg(col) > threshold, "count": F.max(col) > 0}[method]
    return scores.groupBy("fov", "peak").agg(F.when(rule, 1).otherwise(-1).alias("spec"))


def channel_summary(specs: DataFrame) -> DataFrame:
    """Channels per field of view by their mark."""
    count = lambda s: F.count_if(F.col("spec") == s)
    return specs.groupBy("fov").agg(count(1).alias("analysed"), count(0).alias("empty"), count(-1).alias("ignored"))


def max_label(labels: DataFrame) -> DataFrame:
    return labels.groupBy(*IMAGE).agg(F.max("label").alias("n_cells"))


def intensity_range(pixels: DataFrame, *, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Display range of a movie: mean of the image minima, the smallest and the mean of the image maxima."""
    per = pixels.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return per.agg(F.avg("lo").alias("low"), F.min("hi").alias("high"), F.avg("hi").alias("mean_high"))
