"""Per-cell summaries, fits and export tables built from cells and their observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div, volume
from ..functions.ordered import one_row

FLAT = 1e-9  # a series of ln(length) with a smaller spread is constant up to rounding

# fixed values: column lists of the exported frames
FRAME_COLUMNS = ("fov", "peak", "birth_label", "birth_time", "division_time", "sb", "sd", "width", "delta",
                 "tau", "elong_rate", "septum_position")
RESCALED = ("sb", "sd", "width", "delta", "tau", "elong_rate", "septum_position")
WIDE_COLUMNS = ("fov", "peak", "division_time", "birth_label", "birth_time", "sb", "sd", "delta", "tau",
                "elong_rate", "septum_position", "death", "disappear")


def first_obs(obs: DataFrame, cols: Sequence[str]) -> DataFrame:
    """First observation of every cell, one row per cell with the given columns and ``t``."""
    pick = F.min_by(F.struct("t", *[c for c in cols if c != "t"]), "t").alias("_f")
    return obs.groupBy("cell_id").agg(pick).select(
        "cell_id", "_f.t", *[F.col(f"_f.{c}") for c in cols if c != "t"])


def order_daughters(cells: DataFrame, obs: DataFrame, *, y: str = "y") -> DataFrame:
    """``parent_id, child1_id, child2_id``: the daughter nearer the closed end (smaller y) comes first."""
    born = first_obs(obs, [y]).select("cell_id", F.col(y).alias("_y"))
    kids = cells.where(F.col("parent_id").isNotNull()).select("cell_id", "parent_id").join(born, "cell_id")
    place = F.struct("_y", "cell_id")
    return kids.groupBy("parent_id").agg(
        F.min(place)["cell_id"].alias("child1_id"),
        F.when(F.count(F.lit(1)) > 1, F.max(place)["cell_id"]).alias("child2_id"))


def _with_daughters(cells: DataFrame, obs: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cells whose two daughters were both observed, with structs ``d1`` and ``d2`` of their first values."""
    first = first_obs(obs, cols)
    as_child = lambda key, name: first.select(
        F.col("cell_id").alias(key), F.struct("t", *[c for c in cols if c != "t"]).alias(name))
    return (cells.select("cell_id", "child1_id", "child2_id")
            .join(as_child("child1_id", "d1"), "child1_id").join(as_child("child2_id", "d2"), "child2_id"))


def division_summary(cells: DataFrame, obs: DataFrame, *, px2um: float = 1.0) -> DataFrame:
    """Size at birth and division, added size, generation time, septum position and mean width."""
    divided = _with_daughters(cells, obs, ["length", "width", "seconds"])
    own = obs.groupBy("cell_id").agg(
        F.min_by(F.struct("length", "seconds"), "t").alias("f"), F.sum("width").alias("w"),
        F.count("width").alias("n"))
    both = F.col("d1.length") + F.col("d2.length")
    sb, sd = F.col("f.length") * px2um, both * px2um
    return divided.join(own, "cell_id").select(
        "cell_id", sb.alias("sb"), sd.alias("sd"), (sd - sb).alias("delta"),
        ((F.col("d1.seconds") - F.col("f.seconds")) / 60).alias("tau"), F.col("d1.t").alias("division_time"),
        safe_div(F.col("d1.length"), both).alias("septum_position"),
        ((F.col("w") + (F.col("d1.width") + F.col("d2.width")) / 2) / (F.col("n") + 1) * px2um).alias("width"))


def obs_with_division(cells: DataFrame, obs: DataFrame, *, px2um: float = 1.0) -> DataFrame:
    """Observations in micrometres plus one division point per cell with two observed daughters."""
    scaled = obs.select("cell_id", "t", "seconds", (F.col("length") * px2um).alias("length"),
                        (F.col("width") * px2um).alias("width"), F.lit(False).alias("at_division"))
    # a division point belongs to a cell that was itself observed
    seen = obs.select("cell_id").distinct()
    point = _with_daughters(cells, obs, ["length", "width", "seconds"]).join(seen, "cell_id", "left_semi").select(
        "cell_id", F.col("d1.t").alias("t"), F.col("d1.seconds").alias("seconds"),
        ((F.col("d1.length") + F.col("d2.length")) * px2um).alias("length"),
        ((F.col("d1.width") + F.col("d2.width")) / 2 * px2um).alias("width"), F.lit(True).alias("at_division"))
    return scaled.unionByName(point).withColumn("volume", volume("length", "width"))


def elongation_rate(obs: DataFrame) -> DataFrame:
    """Slope of ln(length) per hour; null where it cannot be fitted."""
    return obs.groupBy("cell_id").agg(
        (F.regr_slope(F.log("length"), F.col("seconds") / 60.0) * 60).alias("elong_rate"))


def growth_rate(obs: DataFrame, *, mpf: float = 1.0) -> DataFrame:
    """Slope and intercept of ln(length) on minutes since the first frame; null below two points."""
    # shifting x by its first value leaves the slope and moves the intercept
    x, y = F.col("t") * float(mpf), F.log("length")
    fit = obs.groupBy("cell_id").agg(
        F.regr_slope(y, x).alias("growth_rate"), F.regr_intercept(y, x).alias("_b"), F.min(x).alias("_x0"))
    return fit.select("cell_id", "growth_rate",
                      (F.col("_b") + F.col("growth_rate") * F.col("_x0")).alias("growth_rate_intercept"))


def log_fit(obs: DataFrame) -> DataFrame:
    """Exponential growth fit: every observation with its fitted length and the fit's r²."""
    y = F.log("length")
    fit = obs.groupBy("cell_id").agg(F.regr_slope(y, F.col("t")).alias("_a"),
                                     F.regr_intercept(y, F.col("t")).alias("_b"),
                                     # a flat series has no correlation with time
                                     F.when(F.max(y) - F.min(y) < FLAT, 0.0).otherwise(F.regr_r2(y, F.col("t"))).alias("r2"))
    fit = fit.where(F.col("_a").isNotNull())
    return obs.join(fit, "cell_id").select(
        "cell_id", "t", "length", F.exp(F.col("_a") * F.col("t") + F.col("_b")).alias("length_fit"), "r2")


def r2(df: DataFrame, *, y: str, yfit: str, by: Sequence[str] = ()) -> DataFrame:
    """Coefficient of determination of a fitted column, per group."""
    miss = F.sum((F.col(y) - F.col(yfit)) * (F.col(y) - F.col(yfit)))
    return df.groupBy(*by).agg((1 - safe_div(miss, F.var_pop(y) * F.count(y))).alias("r2"))


def breakpoint_guess(obs: DataFrame) -> DataFrame:
    """First guess of a two-slope fit: the point farthest below the line from first to last point."""
    pts = obs.select("cell_id", F.col("t").cast("double").alias("x"), F.log("length").alias("y"))
    ends = pts.groupBy("cell_id").agg(F.min("x").alias("x0"), F.max("x").alias("xn"),
                                      F.min_by("y", "x").alias("y0"), F.max_by("y", "x").alias("yn"))
    ends = ends.where("xn > x0")
    # rounding keeps points on the line apart from rounding noise
    below = F.round((F.col("y") - F.col("y0")) - (F.col("yn") - F.col("y0")) / (F.col("xn") - F.col("x0"))
                    * (F.col("x") - F.col("x0")), 12)
    mid = pts.join(ends, "cell_id").groupBy("cell_id").agg(
        F.min(F.struct(below.alias("h"), "x", "y")).alias("m"),
        *[F.first(c).alias(c) for c in ("x0", "xn", "y0", "yn")])
    xm, ym = F.col("m.x"), F.col("m.y")
    return mid.select(
        "cell_id", (xm - F.col("x0")).alias("x_mid"), ym.alias("y_mid"),
        F.when(xm == F.col("x0"), 0.0).otherwise(safe_div(ym - F.col("y0"), xm - F.col("x0"))).alias("slope1"),
        F.when(xm == F.col("xn"), 0.0).otherwise(safe_div(F.col("yn") - ym, F.col("xn") - xm)).alias("slope2"))


def bilinear_fit(obs: DataFrame) -> DataFrame:
    """Best two-slope fit of ln(length): shift time, length there, both slopes and r².

    Every observation time is tried as the breakpoint. Running sums give the left and
    right moments of each candidate, so the search is linear in the observations. A cell's
    frames from birth to division bound its window: one shuffle by cell serves all sums.
    """
    cell = Window.partitionBy("cell_id")
    upto = cell.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    pts = obs.select("cell_id", "t", F.log("length").alias("y")).withColumns({
        "t0": F.min("t").over(cell), "vy": F.when(F.max("y").over(cell) - F.min("y").over(cell) >= FLAT, F.var_pop("y").over(cell))})
    pts = pts.withColumn("x", (F.col("t") - F.col("t0")).cast("double"))
    x, y = F.col("x"), F.col("y")
    terms = {"1": F.lit(1.0), "x": x, "xx": x * x, "y": y, "xy": x * y}
    m = pts.withColumns({**{f"l{n}": F.sum(e).over(upto) for n, e in terms.items()}, "n": F.sum(F.lit(1.0)).over(cell),
                         **{f"s{n}": F.sum(e).over(cell) for n, e in {**terms, "yy": y * y}.items() if n != "1"}})
    k, c = F.col("x"), F.col
    su, suu, suy = c("lx") - k * c("l1"), c("lxx") - 2 * k * c("lx") + k * k * c("l1"), c("lxy") - k * c("ly")
    r1, rx, rxx = c("n") - c("l1"), c("sx") - c("lx"), c("sxx") - c("lxx")
    sw, sww, swy = rx - k * r1, rxx - 2 * k * rx + k * k * r1, (c("sxy") - c("lxy")) - k * (c("sy") - c("ly"))
    m = m.select("cell_id", "t", "t0", "n", "sy", "syy", "vy", su.alias("su"), suu.alias("suu"), suy.alias("suy"),
                 sw.alias("sw"), sww.alias("sww"), swy.alias("swy"))
    part = lambda a, b: F.when(b > 0.5, a / b).otherwise(0.0)
    a = ((c("sy") - c("su") * part(c("suy"), c("suu")) - c("sw") * part(c("swy"), c("sww")))
         / (c("n") - c("su") * part(c("su"), c("suu")) - c("sw") * part(c("sw"), c("sww"))))
    m = m.where("n > 1").withColumn("a", a)
    m = (m.withColumn("b", part(c("suy") - c("a") * c("su"), c("suu")))
         .withColumn("c", part(c("swy") - c("a") * c("sw"), c("sww"))))
    m = m.withColumn("sse", F.round(c("syy") - c("a") * c("sy") - c("b") * c("suy") - c("c") * c("swy"), 9))
    best = m.groupBy("cell_id").agg(
        F.min(F.struct("sse", "t", "a", "b", "c", "vy", "n")).alias("m"))
    return best.select("cell_id", c("m.t").alias("t_shift"), F.exp("m.a").alias("length_at_shift"),
                       c("m.b").alias("slope1"), c("m.c").alias("slope2"),
                       (1 - safe_div(c("m.sse"), c("m.vy") * c("m.n"))).alias("r2"))


def wide_cells(cells: DataFrame) -> DataFrame:
    """One row per cell; absent relatives become empty ids, absent columns nulls."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    have = set(cells.columns)
    rest = [F.col(c) if c in have else F.lit(None).cast("int").alias(c) for c in WIDE_COLUMNS]
    return cells.select(F.col("cell_id").alias("id"), blank("parent_id"), blank("child1_id"), blank("child2_id"), *rest)


def long_cells(obs: DataFrame, fl: DataFrame | None = None, *, planes: Sequence[str] = ()) -> DataFrame:
    """One row per cell and time; ``fl(cell_id, t, plane, total)`` adds one column per plane."""
    if fl is None:
        return obs
    wide = fl.where(F.col("plane").isin(list(planes))).groupBy("cell_id", "t").agg(*[
        F.max(F.when(F.col("plane") == p, F.col("total"))).alias(f"fl_{p}") for p in planes])
    return obs.join(wide, ["cell_id", "t"], "left")


def rescale(df: DataFrame, *, cols: Sequence[str]) -> DataFrame:
    """Divide columns by their mean."""
    mean = one_row(df, **{c: F.avg(c) for c in cols})
    return df.withColumns({c: F.col(c) / mean[c] for c in cols})


def cells_frame(cells: DataFrame, *, rescale_means: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """The numeric analysis columns, optionally rescaled by their means."""
    out = cells.select(*keep, *FRAME_COLUMNS)
    return rescale(out, cols=RESCALED) if rescale_means else out


def cycle_frame(cells: DataFrame, *parts: DataFrame, add_volume: bool = True) -> DataFrame:
    """Cells with their cell-cycle tables (keyed by ``cell_id``) and the volumes at birth and division."""
    out = cells.select("cell_id", *FRAME_COLUMNS)
    for p in parts:
        out = out.join(p, "cell_id", "left")
    if add_volume:
        out = out.withColumns({"birth_volume": volume("sb", "width"), "division_volume": volume("sd", "width")})
    return out


def mid_time(cells: DataFrame) -> DataFrame:
    return cells.withColumn("mid_time", (F.col("birth_time") + F.col("division_time")) / 2)


def cell_foci(cells: DataFrame, focus_obs: DataFrame, *, focus: str = "focus_id") -> DataFrame:
    """Bridge table: the cells present with the foci seen in them, each pair once."""
    return focus_obs.select("cell_id", focus).distinct().join(cells.select("cell_id"), "cell_id", "left_semi")
