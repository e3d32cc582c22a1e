"""Regions of labelled images: properties, sizes, ids, frame pairs and context windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import population_axes

IMAGE = ["fov", "peak", "t"]
REGION = [*IMAGE, "label"]


def _moment(pixels: Column, a: str, b: str) -> Column:
    """Population covariance of two coordinates (variance, if the same), with running means in the order of ``pixels``."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("n"), zero.alias("a"), zero.alias("b"), zero.alias("s"))

    def add(m: Column, p: Column) -> Column:
        n, da = m["n"] + 1, p[a] - m["a"]
        mean_b = m["b"] + (p[b] - m["b"]) / n
        return F.struct(n.alias("n"), (m["a"] + da / n).alias("a"), mean_b.alias("b"), (m["s"] + da * (p[b] - mean_b)).alias("s"))

    seen = F.filter(pixels, lambda p: p[a].isNotNull() & p[b].isNotNull())
    return F.aggregate(seen, start, add, lambda m: F.try_divide(m["s"], m["n"]))


def region_props(labels: DataFrame) -> DataFrame:
    """Area, centroid, half-open box and second-moment axes of every labelled region.

    The orientation is the angle of the long axis to the column axis, counted
    counter-clockwise as displayed (rows run downwards). Moments are added up from pixel to pixel,
    row by row, so equal shapes have equal axes to the last bit, however the pixels were dealt.
    """
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    m = labels.where("label > 0").groupBy(*REGION).agg(
        F.count(F.lit(1)).alias("area"), F.avg(y).alias("cy"), F.avg(x).alias("cx"), F.min("y").alias("min_y"),
        F.min("x").alias("min_x"), (F.max("y") + 1).alias("max_y"), (F.max("x") + 1).alias("max_x"),
        F.sort_array(F.collect_list(F.struct(y.alias("y"), x.alias("x")))).alias("px"))
    m = m.withColumns({"vy": _moment(F.col("px"), "y", "y"), "vx": _moment(F.col("px"), "x", "x"), "c": _moment(F.col("px"), "x", "y")})
    major, minor = population_axes(F.col("vy"), F.col("vx"), F.col("c"))
    # rounding keeps an upright region from turning over by rounding noise
    angle = F.atan2(F.round(2 * F.col("c"), 9) + F.lit(0.0), F.round(F.col("vx") - F.col("vy"), 9) + F.lit(0.0)) / -2
    return m.select(*REGION, "area", F.col("cy").alias("y"), F.col("cx").alias("x"), "min_y", "min_x", "max_y", "max_x",
                    angle.alias("orientation"), major.alias("major"), minor.alias("minor"))


def perimeter(labels: DataFrame) -> DataFrame:
    """Region pixels with a 4-neighbour outside the region. A region is bounded by its image."""
    def alone(axis: str, other: str) -> Column:
        w = Window.partitionBy(*REGION, other).orderBy(axis)
        both = (F.lag(axis).over(w) == F.col(axis) - 1) & (F.lead(axis).over(w) == F.col(axis) + 1)
        return ~F.coalesce(both, F.lit(False))

    return labels.where("label > 0").withColumn("_edge", alone("y", "x") | alone("x", "y")).where("_edge").drop("_edge")


def _nearest(y: Column, x: Column, when: Column) -> Column:
    """The perimeter pixel nearest to a point, among those where ``when`` holds; row order wins ties."""
    d = (F.col("py") - y) * (F.col("py") - y) + (F.col("px") - x) * (F.col("px") - x)
    return F.min(F.when(when, F.struct(F.round(d, 9).alias("d"), "k", "py", "px")))


def _distance(a: str, b: str) -> Column:
    dy, dx = F.col(f"{a}.py") - F.col(f"{b}.py"), F.col(f"{a}.px") - F.col(f"{b}.px")
    return F.sqrt((dy * dy + dx * dx).cast("double"))


def feret(labels: DataFrame, regions: DataFrame) -> DataFrame:
    """Length and width along the region's axes, measured between perimeter pixels: ``keys, length, width``.

    Length: the pixels nearest to guide points at 0.6 of the long axis from the centre,
    one in the outer quarter and one in the rest. Width: the mean of two chords at a
    fifth of the length to both sides of the centre.
    """
    order = Window.partitionBy(*REGION).orderBy("y", "x")
    pts = perimeter(labels).select(*REGION, F.col("y").alias("py"), F.col("x").alias("px"),
                                   F.row_number().over(order).alias("k"),
                                   F.count(F.lit(1)).over(Window.partitionBy(*REGION)).alias("n"))
    axes = regions.select(*REGION, F.col("y").alias("y0"), F.col("x").alias("x0"), F.cos("orientation").alias("co"),
                          F.sin("orientation").alias("si"), "major", "minor", (F.col("orientation") > 0).alias("up"))
    pts = pts.join(axes, REGION)
    y0, x0, co, si = (F.col(c) for c in ("y0", "x0", "co", "si"))
    reach = F.col("major") * 0.6
    head = lambda share: (F.col("k") <= F.rint(F.col("n") / share)) == F.col("up")
    ends = pts.groupBy(*REGION).agg(
        _nearest(y0 - si * reach, x0 + co * reach, head(4)).alias("a"),
        _nearest(y0 + si * reach, x0 - co * reach, ~head(4)).alias("b"))
    ends = ends.select(*REGION, _distance("a", "b").alias("length")).where("length IS NOT NULL")
    pts = pts.join(ends, REGION)
    along, across = F.col("length") * 0.2, F.col("minor") * 0.6
    chords = pts.groupBy(*REGION).agg(*[
        _nearest(y0 - s * si * along + w * co * across, x0 + s * co * along + w * si * across,
                 head(2) if s > 0 else ~head(2)).alias(f"{n}{m}")
        for n, s in (("p", 1), ("q", -1)) for m, w in (("l", -1), ("r", 1))])
    width = (_distance("pl", "pr") + _distance("ql", "qr")) / 2
    return ends.join(chords.select(*REGION, width.alias("width")), REGION)


def make_id(df: DataFrame, *, prefix: str = "", name: str = "cell_id", t: str = "t", label: str = "label") -> DataFrame:
    """Add an id that spells out field of view, channel, time and label."""
    text = F.format_string("f%02dp%04dt%04dr%02d", F.col("fov"), F.col("peak"), F.col(t), F.col(label))
    return df.withColumn(name, F.concat(F.lit(prefix), text) if prefix else text)


def parse_id(df: DataFrame, *, col: str = "cell_id") -> DataFrame:
    part = lambda i: F.regexp_extract(col, r"f(\d+)p(\d+)t(\d+)r(\d+)$", i).cast("int")
    return df.withColumns({"fov": part(1), "peak": part(2), "t": part(3), "label": part(4)})


def frame_counts(regions: DataFrame) -> DataFrame:
    """Regions per frame and region pairs with the next frame: ``fov, peak, t, n, pairs``."""
    n = regions.groupBy(*IMAGE).agg(F.count(F.lit(1)).alias("n"))
    after = n.select("fov", "peak", (F.col("t") - 1).alias("t"), F.col("n").alias("_m"))
    return n.join(after, IMAGE, "left").select(*IMAGE, "n", (F.col("n") * F.coalesce("_m", F.lit(0))).alias("pairs"))


def region_pairs(regions: DataFrame) -> DataFrame:
    """Every region with every region of the next frame; a frame holds at most 255 labels.

    The pairs are the table the pair classifier scores, so all of them are kept.
    """
    cols = ["min_y", "max_y", "y", "area", "orientation"]
    a = regions.select(*REGION, *cols)
    b = regions.select("fov", "peak", (F.col("t") - 1).alias("t"), F.col("label").alias("next_label"),
                       *[F.col(c).alias(f"next_{c}") for c in cols])
    return a.join(b, IMAGE)


def first_regions(regions: DataFrame, *, n: int) -> DataFrame:
    """The ``n`` regions of each frame with the smallest labels, whatever their values are."""
    w = Window.partitionBy(*IMAGE).orderBy("label")
    return regions.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")


def context_window(regions: DataFrame, frames: DataFrame, *, top: int, radius: int = 2,
                   features: Sequence[str] = ("area", "y", "x", "min_y", "min_x", "max_y", "max_x", "orientation", "major")) -> DataFrame:
    """Features of the labels 1 to ``top`` in the frames around each frame, zero where there is none.

    A row of slots has a fixed length, which the caller names; larger labels have no slot.

    One row per frame, offset and label slot: ``fov, peak, t, offset, label, features``.
    """
    grid = frames.select(*IMAGE).distinct().withColumn("offset", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))) \
        .withColumn("label", F.explode(F.sequence(F.lit(1), F.lit(top))))
    grid = grid.withColumn("_t", F.col("t") + F.col("offset"))
    have = regions.where(F.col("label") <= top).select("fov", "peak", F.col("t").alias("_t"), "label", *features)
    return grid.join(have, ["fov", "peak", "_t", "label"], "left").select(
        *IMAGE, "offset", "label", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])


def classify_pairs(pairs: DataFrame, *, threshold: float = 0.95,
                   probs: Sequence[str] = ("p_migration", "p_child", "p_false_join", "p_none")) -> DataFrame:
    """The first class above the threshold names the interaction; pairs of the last class or of none are dropped."""
    first = F.coalesce(*[F.when(F.col(p) > threshold, F.lit(p.removeprefix("p_"))) for p in probs])
    named = pairs.withColumn("interaction", first)
    return named.where(F.col("interaction") != probs[-1].removeprefix("p_"))
