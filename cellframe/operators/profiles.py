"""Intensity profiles along and across cells, and ensembles aligned by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div, volume
from ..functions.lineage_cut import cut
from ..functions.ordered import one_row, union_all
from .background import axis_distance, region_pixels
from .filters import fl_frames
from .regions import REGION


def _edge(limit: Column) -> Column:
    """A band limit, rounded like the positions, so that pixels on it fall the same way everywhere."""
    return F.round(limit, 9)


def _on_axes(pixels: DataFrame, labels: DataFrame, obs: DataFrame) -> DataFrame:
    """Region pixels with their position along (``u``, growing with y) and across (``w``) the region's long axis.

    ``obs``: region keys, y, x, orientation, length, width.
    """
    axes = obs.select(*REGION, F.col("y").alias("cy"), F.col("x").alias("cx"), "orientation", "length", "width")
    along, across = axis_distance()
    turn = F.when(F.col("orientation") > 0, -1).otherwise(1)
    return region_pixels(pixels, labels).join(axes, REGION).select(
        *REGION, "v", "length", "width", F.round(along * turn, 9).alias("u"), F.round(across * turn, 9).alias("w"))


def _dense(rows: DataFrame, ends: DataFrame, keys: list[str], half: Column) -> DataFrame:
    """Profile rows ``keys, pos, value`` from -half to half, zero where no pixel falls."""
    grid = ends.withColumn("_h", F.floor(_edge(half))).withColumn("_k", F.explode(F.sequence(-F.col("_h"), F.col("_h"))))
    return grid.join(rows, [*keys, "_k"], "left").select(
        *keys, (F.col("_k") + F.col("_h")).alias("pos"), F.coalesce("value", F.lit(0.0)).alias("value"))


def axis_profile(pixels: DataFrame, labels: DataFrame, obs: DataFrame, *, pad: float = 4, band: float = 1.25) -> DataFrame:
    """Mean intensity along the long axis in a band of 1.25 cell widths: region keys, ``pos, value``.

    Pixels go to the nearest whole position; both ends reach ``pad``/2 beyond the cell.
    """
    at = _on_axes(pixels, labels, obs)
    half = (F.col("length") + pad) / 2
    rows = at.where((F.abs("w") <= _edge(F.col("width") * band / 2)) & (F.abs("u") <= _edge(half))).groupBy(*REGION, F.rint("u").cast("long").alias("_k")) \
        .agg(F.avg("v").alias("value"))
    return _dense(rows, obs.select(*REGION, "length"), REGION, half)


def pack_profiles(profile: DataFrame, keys: list[str] = REGION) -> DataFrame:
    """Profiles as arrays; the length of a cell in its image bounds them."""
    return profile.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("p")).select(
        *keys, F.transform("p", lambda p: p["value"]).alias("profile"))


def ring(profile: DataFrame) -> DataFrame:
    """Position, height and width of a profile's peak and the median of its non-zero values.

    The position counts from the cell's end; the width is the deviation of what stands above the median.
    """
    top = profile.groupBy(*REGION).agg(
        F.max("value").alias("height"), F.max(F.struct("value", (-F.col("pos")).alias("p")))["p"].alias("_p"),
        F.percentile(F.when(F.col("value") != 0, F.col("value")), F.lit(0.5)).alias("median"))
    above = F.greatest(F.col("value") - F.col("median"), F.lit(0.0))
    both = profile.join(top, REGION).groupBy(*REGION).agg(
        F.first("height").alias("height"), F.first("median").alias("median"), (-F.first("_p") - 3).alias("location"),
        F.sum(above).alias("s"), F.sum(above * F.col("pos")).alias("sx"), F.sum(above * F.col("pos") * F.col("pos")).alias("sxx"))
    mean = safe_div(F.col("sx"), F.col("s"))
    spread = F.greatest(safe_div(F.col("sxx"), F.col("s")) - mean * mean, F.lit(0.0))
    return both.select(*REGION, "location", "height", "median", F.when(F.col("s") > 0, F.sqrt(spread)).alias("width"))


def cross_profiles(pixels: DataFrame, obs: DataFrame, *, band: float = 6, pad: float = 8) -> DataFrame:
    """Mean intensity across the cell at its middle and both quarters: region keys, ``place, pos, value``.

    The image is read unmasked, so that the margin shows what lies beside the cell; a line
    starts at its end of smaller x. ``quarter1`` lies towards the smaller y.
    """
    axes = obs.select(*REGION, F.col("y").alias("cy"), F.col("x").alias("cx"), "orientation", "length", "width")
    along, across = axis_distance()
    seen = pixels.join(axes, REGION[:3])
    if "px" in pixels.columns:  # whole images: spread after the join
        seen = pixels.withColumnRenamed("width", "_w").join(axes, REGION[:3]).select("*", F.posexplode("px").alias("_i", "v"))
        seen = seen.withColumns({"y": F.floor(F.col("_i") / F.col("_w")), "x": F.col("_i") % F.col("_w")})
    at = seen.select(
        *REGION, "v", "length", "width", F.round(along * F.when(F.col("orientation") > 0, -1).otherwise(1), 9).alias("u"),
        F.round(across * F.when(F.sin("orientation") < 0, -1).otherwise(1), 9).alias("w"))
    places = lambda: F.explode(F.array(*[F.struct(F.lit(n).alias("place"), (F.col("length") * s).alias("_u0"))
                                         for n, s in (("mid", 0.0), ("quarter1", -0.25), ("quarter2", 0.25))])).alias("_e")
    half = (F.col("width") + pad) / 2
    rows = at.select("*", places()).where((_edge(F.abs(F.col("u") - F.col("_e._u0"))) <= band / 2) & (F.abs("w") <= _edge(half)))
    rows = rows.groupBy(*REGION, F.col("_e.place").alias("place"), F.rint("w").cast("long").alias("_k")).agg(F.avg("v").alias("value"))
    ends = obs.select(*REGION, "length", "width").select("*", places()).select(*REGION, "width", F.col("_e.place").alias("place"))
    return _dense(rows, ends, [*REGION, "place"], half)


def constriction_time(pixels: DataFrame, labels: DataFrame, obs: DataFrame, *, margin: int = 3) -> DataFrame:
    """Time at which each cell last bends inwards at its middle, or its last time: ``cell_id, constriction_time``.

    The window reaches half the observation's width and ``margin`` from the centroid, both ways.

    The mid-cell intensity by position is fitted by a parabola; on the symmetric grid of
    positions its leading coefficient has the sign of the sum of s·(x² − mean x²).
    """
    at = _on_axes(pixels, labels, obs).withColumn("h", F.rint(_edge(F.col("width") / 2)) + margin)
    h = F.col("h")
    at = at.where((F.abs("u") <= h + 0.5) & (F.abs("w") <= h + 0.5))
    x = F.least(F.greatest(F.rint("u"), -h), h)
    # the mean of x² over the whole positions from -h to h
    bend = at.groupBy(*REGION).agg(F.round(F.sum(F.col("v") * (x * x - h * (h + 1) / 3)), 6).alias("bend"))
    seen = obs.select("cell_id", *REGION).join(bend, REGION, "left")
    return seen.groupBy("cell_id").agg(
        F.coalesce(F.max(F.when(F.col("bend") < 0, F.col("t"))), F.max("t")).alias("constriction_time"))


def model_lengths(cells: DataFrame, obs: DataFrame, *, time_int: float = 1.0) -> DataFrame:
    """Exponential model length of every observation: ``cell_id, t, model_length``."""
    start = obs.groupBy("cell_id").agg(F.min("t").alias("_t0"))
    c = cells.select("cell_id", "sb", "sd", "tau").join(start, "cell_id")
    grown = F.col("sb") * F.exp(F.log(F.col("sd") / F.col("sb")) / F.col("tau") * (F.col("t") - F.col("_t0")) * time_int)
    return obs.select("cell_id", "t").join(c, "cell_id").select("cell_id", "t", grown.alias("model_length"))


def _binned_profiles(cells, obs, profiles, *, px2um, time_int, fl_int, fl_start) -> DataFrame:
    """Trimmed profiles in 0.1 µm size bins: ``cell_id, t, size_bin, profile``."""
    at = fl_frames(model_lengths(cells, obs, time_int=time_int), start=fl_start, every=fl_int)
    at = at.withColumn("size_bin", F.rint(F.round(F.col("model_length") * 10, 9)).cast("int")).join(profiles, ["cell_id", "t"])
    keep = F.rint(F.col("size_bin") / 10 / px2um).cast("int")
    spare = F.greatest(F.size("profile") - keep, F.lit(0))
    return at.select("cell_id", "t", "size_bin", F.slice("profile", F.floor(spare / 2).cast("int") + 1, F.least(keep, F.size("profile"))).alias("profile"))


def ensemble_profiles(cells: DataFrame, obs: DataFrame, profiles: DataFrame, *, px2um: float = 1.0, time_int: float = 1.0, fl_int: int = 2,
                      fl_start: int = 1, cell_min: int = 50, binned: DataFrame | None = None) -> DataFrame:
    """Mean profile of every size bin with more than ``cell_min`` members: ``size_bin`` (tenths of a µm), ``pos, value, n``; pos is centred.

    ``binned`` are the trimmed profiles, where they are known already.
    """
    b = cut(_binned_profiles(cells, obs, profiles, px2um=px2um, time_int=time_int, fl_int=fl_int, fl_start=fl_start)) if binned is None else binned
    n = b.groupBy("size_bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_min)
    total = b.select("size_bin", F.size("profile").alias("_len"), F.posexplode("profile").alias("_i", "v")).groupBy("size_bin", "_i").agg(
        F.sum("v").alias("s"), F.max("_len").alias("_len"))
    return total.join(n, "size_bin").select("size_bin", (F.col("_i") - F.floor(F.col("_len") / 2)).alias("pos"),
                                            (F.col("s") / F.col("n")).alias("value"), "n")


def nucleoid_ensemble(cells: DataFrame, obs: DataFrame, profiles: DataFrame, **kwargs) -> DataFrame:
    """One row per size bin: volume, sum, maximum and sum of fourth powers of the mean profile."""
    mean = ensemble_profiles(cells, obs, profiles, **kwargs)
    v = F.col("value")
    out = mean.groupBy("size_bin").agg(F.first("n").alias("n"), F.sum(v).alias("fl_sum"), F.max(v).alias("fl_max"),
                                       F.sum(v * v * v * v).alias("fl_amp"))
    width = one_row(cells, w=F.avg("width"))["w"]
    return out.withColumn("volume", volume(F.col("size_bin") / 10, width))


def size_ensemble(cells: DataFrame, obs: DataFrame, profiles: DataFrame, focus_obs: DataFrame, **kwargs) -> DataFrame:
    """:func:`nucleoid_ensemble` with the mean number of foci per size bin and its change over every second bin."""
    opts = {k: v for k, v in kwargs.items() if k != "cell_min"}
    opts = {"px2um": 1.0, "time_int": 1.0, "fl_int": 2, "fl_start": 1, **opts}
    b = cut(_binned_profiles(cells, obs, profiles, **opts))
    base = nucleoid_ensemble(cells, obs, profiles, **kwargs, binned=b)
    b = b.select("cell_id", "t", "size_bin")
    foci = focus_obs.groupBy("cell_id", "t").agg(F.count(F.lit(1)).alias("_k"))
    count = b.join(foci, ["cell_id", "t"], "left").groupBy("size_bin").agg(F.sum(F.coalesce("_k", F.lit(0))).alias("foci"))
    out = base.join(count, "size_bin").withColumn("foci_avg", F.col("foci") / F.col("n"))
    # one row per tenth of a micrometre
    order = Window.partitionBy(F.lit(0)).orderBy("size_bin")
    out = out.withColumn("_i", F.row_number().over(order) - 1).withColumn("_next", F.lead("foci_avg", 2).over(order))
    return out.withColumn("foci_diff", F.when(F.col("_i") % 2 == 0, F.col("_next") - F.col("foci_avg"))).drop("_i", "_next", "foci")


def trace_points(cells: DataFrame, obs: DataFrame, profiles: DataFrame, focus: DataFrame, *, time_int: float = 1.0, px2um: float = 1.0,
                 y_adj: float = 3) -> DataFrame:
    """Points to draw along a trace: ``fov, peak, cell_id, part, hours, y, value, scaled``.

    ``profile`` points are scaled to the range of all profiles, ``focus`` points lie at
    their displacement plus half the cell length, ``concentration`` is total over volume.
    """
    place = cells.select("cell_id", "fov", "peak")
    hours = (F.col("t") * time_int / 60).alias("hours")
    none = F.lit(None).cast("double")
    # profiles travel whole and are unfolded where they have their place
    there = profiles.select("cell_id", "t", "profile").join(obs.select("cell_id", "t"), ["cell_id", "t"], "left_semi")
    lim = one_row(there, a=F.min(F.array_min("profile")), b=F.max(F.array_max("profile")))
    pts = there.join(place, "cell_id").select("cell_id", "t", "fov", "peak", F.posexplode("profile").alias("_i", "value"))
    prof = pts.select(
        "cell_id", F.lit("profile").alias("part"), hours, ((F.col("_i") - y_adj) * px2um).alias("y"), F.col("value").cast("double").alias("value"),
        safe_div(F.col("value") - lim["a"], lim["b"] - lim["a"]).alias("scaled"), "fov", "peak")
    # one row per cell serves the other parts; its frames from birth to division bound the array
    seen = obs.groupBy("cell_id").agg(F.collect_list(F.struct("t", "length", "fl_total", "width")).alias("_o")).join(place, "cell_id")
    spots = focus.select("cell_id", F.col("t").alias("_t"), "disp_l", "foci_h").join(seen, "cell_id")
    foc = spots.select("cell_id", "fov", "peak", "disp_l", "foci_h", F.inline(F.filter("_o", lambda o: o["t"] == F.col("_t")))).select(
        "cell_id", F.lit("focus").alias("part"), hours, ((F.col("disp_l") + F.col("length") / 2) * px2um).alias("y"),
        F.col("foci_h").cast("double").alias("value"), none.alias("scaled"), "fov", "peak")
    conc = seen.select("cell_id", "fov", "peak", F.inline("_o")).select(
        "cell_id", F.lit("concentration").alias("part"), hours, none.alias("y"),
        safe_div(F.col("fl_total"), volume("length", "width")).alias("value"), none.alias("scaled"), "fov", "peak")
    return union_all([prof, foc, conc])
