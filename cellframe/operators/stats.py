"""Population summaries: statistics tables, histograms, binned trends, correlations and traces."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div
from ..functions.lineage_cut import cut
from ..functions.ordered import one_row, positions, quantiles, union_all
from .cells import RESCALED, rescale
from .lineage import CHANNEL, connectors


def stats_table(df: DataFrame, *, cols: Sequence[str] = RESCALED) -> DataFrame:
    """Mean, sample deviation, coefficient of variation, median, minimum and maximum: one row per column."""
    df = cut(df.select(*cols))  # the input is read twice but evaluated once
    q = quantiles(df, cols, {"median": 0.5})
    row = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
                            F.max(c).cast("double").alias("max")).alias(c) for c in cols])
    rest = row.unpivot([], list(cols), "name", "_v").select("name", "_v.*")
    # a column of nulls only has no quantile
    return rest.join(q, "name", "left").withColumn("cv", safe_div(F.col("std"), F.col("mean")))


def group_stats(df: DataFrame, *, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Count, extremes, quartiles, mean and sample deviation per group: rows ``by, name``."""
    by = list(by)
    df = cut(df.select(*by, *[c for c in cols if c not in by]))  # the input is read twice but evaluated once
    q = quantiles(df, cols, {"q25": 0.25, "median": 0.5, "q75": 0.75}, by=by)
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_e"))
    rest = long.select(*by, "_e.*").groupBy(*by, "name").agg(
        F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"))
    group = F.struct(*by, "name")  # equal where both are null, too
    return rest.withColumn("_g", group).join(q.withColumn("_g", group).drop(*by, "name"), "_g", "left").drop("_g")


class Bins(NamedTuple):
    """Equal bins from ``lo``; the last one is closed on the right."""

    lo: float
    width: float
    n: int


def _numbers(df: DataFrame, *aggs: Column) -> tuple[float, ...]:
    """A few global aggregates as Python numbers: bin edges become literals of the plan."""
    row = df.agg(*[a.cast("double").alias(f"_{i}") for i, a in enumerate(aggs)]).first()
    if row[0] is None:
        raise ValueError("no data to choose bins from")
    return tuple(row)


def sturges_bins(df: DataFrame, *, col: str, rescaled: bool = False) -> Bins:
    """Bins over mean ± 3 sample deviations (or 0 to 2 for rescaled data), counted by Sturges' rule."""
    lo, hi = 0.0, 2.0
    if not rescaled:
        mean, std = _numbers(df, F.avg(col), F.coalesce(F.stddev_samp(col), F.lit(0.0)))
        lo, hi = mean - 3 * std, mean + 3 * std
    low, high, n = _numbers(df.where(F.col(col).between(lo, hi)), F.min(col), F.max(col), F.count(col))
    size = (high - low) / (math.log2(n) + 1)
    count = max(1, math.ceil((hi - lo) / size)) if size > 0 else 1
    return Bins(lo, (hi - lo) / count, count)


def even_bins(df: DataFrame, *, col: str, n: int) -> Bins:
    """``n`` equal bins from minimum to maximum."""
    lo, hi = _numbers(df, F.min(col), F.max(col))
    return Bins(lo, (hi - lo) / n, n)


def step_bins(df: DataFrame, *, col: str, width: float, pad: float = 0.0) -> Bins:
    """Edges from the minimum (less ``pad``) in steps of ``width``, ending before the maximum (plus ``pad``)."""
    lo, hi = _numbers(df, F.min(col) - pad, F.max(col) + pad)
    return Bins(lo, float(width), max(0, math.ceil((hi - lo) / width) - 1))


def interval_bins(df: DataFrame, *, col: str, interval: float) -> Bins:
    """Bins for times measured in whole intervals: edges half an interval past each multiple."""
    (hi,) = _numbers(df, F.max(col))
    return Bins(interval / 2, float(interval), max(0, math.ceil(hi / interval) - 1))


def bin_index(x: Column, bins: Bins) -> Column:
    """Zero-based bin of a value, null outside."""
    i = F.floor((x - bins.lo) / bins.width)
    last = F.lit(bins.lo + bins.width * bins.n)
    return F.when((i >= 0) & (i < bins.n), i).when(x == last, bins.n - 1).cast("int")


def bin_table(df: DataFrame, bins: Bins) -> DataFrame:
    """One row per bin: ``bin, left, right, center``."""
    rows = df.sparkSession.range(bins.n).select(F.col("id").cast("int").alias("bin"))
    left = F.lit(bins.lo) + F.col("bin") * bins.width
    return rows.select("bin", left.alias("left"), (left + bins.width).alias("right"), (left + bins.width / 2).alias("center"))


def _chosen_bins(df: DataFrame, col: str, bins, rescaled: bool = False) -> Bins:
    if isinstance(bins, str):
        if bins != "sturges":
            raise ValueError(f"unknown bins {bins!r}")
        return sturges_bins(df, col=col, rescaled=rescaled)
    return even_bins(df, col=col, n=bins) if isinstance(bins, int) else bins


def histogram(df: DataFrame, *, col: str, bins="sturges", kind: str = "line", rescale_mean: bool = False) -> DataFrame:
    """Density histogram: ``x, density`` for lines (closed by a zero at both ends) or ``left, right, density`` for steps."""
    data = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias(col))
    if rescale_mean:
        data = rescale(data, cols=[col])
    b = _chosen_bins(data, col, bins, rescale_mean)
    counts = data.select(bin_index(F.col(col), b).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))
    total = one_row(counts, n=F.sum("n"))["n"]
    rows = bin_table(df, b).join(counts, "bin", "left").withColumn(
        "density", F.coalesce("n", F.lit(0)) / (total * (F.col("right") - F.col("left"))))
    if kind == "step":
        return rows.select("left", "right", "density")
    ends = rows.agg(F.min("left").alias("a"), F.max("right").alias("b")).select(F.explode(F.array("a", "b")).alias("x"))
    return rows.select(F.col("center").alias("x"), "density").unionByName(ends.withColumn("density", F.lit(0.0)))


def binned_stat(df: DataFrame, *, x: str, y: str, stat: str = "mean", bins="sturges", binmin: int | None = None) -> DataFrame:
    """Mean or median of y in bins of x: ``center, value, error, n``.

    The error is the population deviation over √n, times 1.253 for medians. With
    ``binmin`` thinner bins are dropped; without it empty bins stay, with a null value.
    """
    data = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    b = _chosen_bins(data, "x", bins)
    data = data.withColumn("bin", bin_index(F.col("x"), b)).where("bin IS NOT NULL")
    got = data.groupBy("bin").agg(F.avg("y").alias("value"), F.count("y").alias("n"),
                                  (F.stddev_pop("y") / F.sqrt(F.count("y"))).alias("error"))
    if stat == "median":
        mid = quantiles(data, ["y"], {"m": 0.5}, by=["bin"]).select("bin", "m")
        got = got.join(mid, "bin").select("bin", F.col("m").alias("value"), "n", (F.col("error") * 1.253).alias("error"))
    elif stat != "mean":
        raise ValueError(f"unknown statistic {stat!r}")
    rows = bin_table(df, b).select("bin", "center")
    if binmin:
        return rows.join(got.where(F.col("n") >= binmin), "bin").select("center", "value", "error", "n")
    return rows.join(got, "bin", "left").select("center", "value", "error", F.coalesce("n", F.lit(0)).alias("n"))


def time_trend(df: DataFrame, *, y: str, x: str = "birth_time", t_int: float = 1.0, window: float = 10,
               binmin: int | None = 10, align: str | float = "birth") -> DataFrame:
    """Mean of y in windows of hours since the first birth (or a given offset in hours)."""
    if align == "birth":
        offset = one_row(df, t=F.min("birth_time"))["t"] * t_int / 60
    else:
        offset = F.lit(float(align))
    data = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        (F.col(x) * t_int / 60 - offset).alias("hours"), F.col(y).alias("value"))
    return binned_stat(data, x="hours", y="value", bins=step_bins(data, col="hours", width=window * t_int / 60),
                       binmin=binmin)


def trend_and_hist(df: DataFrame, *, y: str, **kwargs) -> DataFrame:
    """Time trend and distribution of a column in one table, told apart by ``part``."""
    trend = time_trend(df, y=y, **kwargs).select(F.lit("trend").alias("part"), F.col("center").alias("x"), "value")
    hist = histogram(df, col=y).select(F.lit("histogram").alias("part"), "x", F.col("density").alias("value"))
    return trend.unionByName(hist)


def trend_derivative(df: DataFrame, *, y: str, x: str = "birth_time", window: float = 10) -> DataFrame:
    """Difference of consecutive window means: ``center, diff`` (null next to an empty window)."""
    b = step_bins(df, col=x, width=window, pad=1)
    means = binned_stat(df, x=x, y=y, bins=b).withColumn("_k", F.floor((F.col("center") - b.lo) / b.width))
    after = means.select((F.col("_k") - 1).alias("_k"), F.col("value").alias("_next"))
    return means.join(after, "_k").select("center", (F.col("_next") - F.col("value")).alias("diff"))


def instant_rate(obs: DataFrame, *, n: int = 1, t_int: float = 1.0, t_shift: float | None = None) -> DataFrame:
    """Mean instantaneous elongation rate per hour by time, from every n-th observation of each cell."""
    pts = obs.select("cell_id", "t", "length")
    # a cell's frames from birth to division bound its window
    w = Window.partitionBy("cell_id").orderBy("t")
    if n > 1:
        pts = pts.withColumn("_i", F.row_number().over(w)).where(F.col("_i") % n == 1).drop("_i")
    prev = pts.withColumn("_l0", F.lag("length").over(w)).where("_l0 IS NOT NULL")
    rate = F.log(F.col("length") / F.col("_l0")) * 60 / n / t_int
    minutes = F.col("t") * t_int - (0.0 if t_shift is None else t_shift * t_int)
    return prev.select(minutes.alias("minutes"), rate.alias("rate")).groupBy("minutes").agg(
        F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("std"),
        (F.stddev_pop("rate") / F.sqrt(F.count("rate"))).alias("se"), F.count("rate").alias("n"))


def _line(x: Column, y: Column) -> Column:
    """Straight-line fit of y on x with its standard error, as one struct aggregate."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    slope, r, n = F.regr_slope(y, x), F.corr(x, y), F.count(x)
    err = F.sqrt(F.greatest(1 - r * r, F.lit(0.0)) * safe_div(F.var_pop(y), F.var_pop(x)) / (n - 2))
    mx, my, sx = F.avg(x), F.avg(y), F.stddev_samp(x)
    return F.struct(
        slope.alias("slope"), F.regr_intercept(y, x).alias("intercept"), r.alias("r"), err.alias("stderr"),
        (slope + 1.96 * err).alias("slope_high"), (my - (slope + 1.96 * err) * mx).alias("intercept_high"),
        (slope - 1.96 * err).alias("slope_low"), (my - (slope - 1.96 * err) * mx).alias("intercept_low"),
        (mx - 3 * sx).alias("x_low"), (mx + 3 * sx).alias("x_high"), n.alias("n"))


def pair_corr(df: DataFrame, *, x: str, y: str, rescale_mean: bool = False) -> DataFrame:
    """One row: regression line, correlation, and the 95 % wedge through the mean."""
    data = df.dropna(how="any", subset=[x, y]).select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    if rescale_mean:
        data = rescale(data, cols=[x, y])
    return data.agg(_line(F.col(x), F.col(y)).alias("_v")).select("_v.*")


def bin_regression(df: DataFrame, *, x: str, y: str, bins="sturges", binmin: int | None = None) -> DataFrame:
    """Regression line through the bin means."""
    return pair_corr(binned_stat(df, x=x, y=y, bins=bins, binmin=binmin), x="center", y="value")


def average_ranks(df: DataFrame, *, key: str, cols: Sequence[str]) -> DataFrame:
    """``key`` and the columns replaced by their ranks; ties share the average rank."""
    long = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_e"))
    long = long.select(key, "_e.*").where("v IS NOT NULL")
    counts = long.groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
    rank = positions(counts, ["name"], "v", "n").select(
        "name", "v", (F.col("_before") + (F.col("n") + 1) / 2).alias("rank"), (F.col("n") * 1000 > F.col("_total")).alias("hot"))
    # values that hold over a thousandth of a column's rows are fewer than a thousand for each
    # column: they are broadcast, so the shuffled join has no hot key
    hot = long.join(F.broadcast(rank.where("hot").drop("hot")), ["name", "v"], "left")
    cold = hot.where("rank IS NULL").drop("rank").join(rank.where("NOT hot").drop("hot"), ["name", "v"])
    return hot.where("rank IS NOT NULL").unionByName(cold).groupBy(key).agg(*[
        F.max(F.when(F.col("name") == c, F.col("rank"))).alias(c) for c in cols])


def corr_matrix(df: DataFrame, *, cols: Sequence[str], method: str = "pearson", key: str = "cell_id") -> DataFrame:
    """Correlation of every pair of columns, upper triangle with the diagonal: ``x, y, r, n``.

    Spearman ranks each column over its own non-null rows.
    """
    data = average_ranks(df, key=key, cols=cols) if method == "spearman" else df
    named = [(a, b) for i, a in enumerate(cols) for b in list(cols)[i:]]
    # pairs as rows: partial sums shrink them to one row per pair before the shuffle, and
    # the generated code stays small however many columns there are
    both = F.explode(F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
        for a, b in named])).alias("_e")
    return data.select(both).select("_e.*").groupBy("x", "y").agg(
        F.corr("a", "b").alias("r"), F.count(F.col("a") + F.col("b")).alias("n"))


def corr_list(df: DataFrame, *, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The regression of each pair of columns: one row per pair, all in one pass."""
    row = df.agg(*[_line(F.col(x), F.col(y)).alias(f"_{i}") for i, (x, y) in enumerate(pairs)])
    named = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"_{i}").alias("v"))
             for i, (x, y) in enumerate(pairs)]
    return row.select(F.explode(F.array(*named)).alias("_e")).select("_e.x", "_e.y", "_e.v.*")


def hexbin(df: DataFrame, *, x: str, y: str, extent: Sequence[float] | None = None, grid: tuple[int, int] = (20, 10),
           min_count: int = 3) -> DataFrame:
    """Counts on a hexagonal grid: ``hx, hy, n``; ``extent`` is (left, right, bottom, top)."""
    data = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if extent is None:
        e = one_row(data, a=F.min("x"), b=F.max("x"), c=F.min("y"), d=F.max("y"))
        left, right, bottom, top = e["a"], e["b"], e["c"], e["d"]
    else:
        left, right, bottom, top = (F.lit(float(v)) for v in extent)
    pad = (right - left) * 1e-9
    left, right = left - pad, right + pad
    nx, ny = grid
    sx, sy = (right - left) / nx, (top - bottom) / ny
    ix, iy = (F.col("x") - left) / sx, (F.col("y") - bottom) / sy
    # two interleaved rectangular lattices; a point goes to the nearer centre
    ax, ay, bx, by = F.rint(ix), F.rint(iy), F.floor(ix), F.floor(iy)
    da = (ix - ax) * (ix - ax) + 3 * (iy - ay) * (iy - ay)
    db = (ix - bx - 0.5) * (ix - bx - 0.5) + 3 * (iy - by - 0.5) * (iy - by - 0.5)
    on_a = (da < db) & (ax >= 0) & (ax <= nx) & (ay >= 0) & (ay <= ny)
    on_b = (da >= db) & (bx >= 0) & (bx < nx) & (by >= 0) & (by < ny)
    cell = F.when(on_a, F.struct(ax.alias("i"), ay.alias("j"))).when(on_b, F.struct((bx + 0.5).alias("i"), (by + 0.5).alias("j")))
    cells = data.select(cell.alias("c")).where("c IS NOT NULL").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return cells.where(F.col("n") >= min_count).select(
        (F.col("c.i") * sx + left).alias("hx"), (F.col("c.j") * sy + bottom).alias("hy"), "n")


def sample_traces(cells: DataFrame, obs: DataFrame, *, n: int = 1000, seed: int = 0, t_int: float = 1.0) -> DataFrame:
    """Hour and length series of ``n`` cells, drawn by a hash of cell id and seed."""
    order = F.md5(F.concat(F.col("cell_id").cast("string"), F.lit(f":{seed}")))
    drawn = cells.select("cell_id").orderBy(order, "cell_id").limit(n)
    return obs.join(drawn, "cell_id", "left_semi").select(
        "cell_id", (F.col("t") * t_int / 60).alias("hours"), "length")


def saw_tooth(cells: DataFrame, obs: DataFrame, *, t_int: float = 1.0) -> DataFrame:
    """Trace points and connecting segments of every channel, with the channel's largest division length."""
    top = cells.groupBy(*CHANNEL).agg(F.max("sd").alias("max_sd"))
    pts = obs.join(cells.select("cell_id", *CHANNEL), "cell_id").select(
        *CHANNEL, "cell_id", F.lit("trace").alias("part"), (F.col("t") * t_int / 60).alias("hours"), F.col("length").alias("y"))
    seg = connectors(cells).select(*CHANNEL, "cell_id", F.explode(F.array(
        F.struct(F.lit("from").alias("part"), F.col("y0").alias("y")),
        F.struct(F.lit("to").alias("part"), F.col("y1").alias("y")))).alias("_e"), (F.col("t") * t_int / 60).alias("hours"))
    seg = seg.select(*CHANNEL, "cell_id", "_e.part", "hours", "_e.y")
    return union_all([pts, seg]).join(top, CHANNEL)


def mean_se(df: DataFrame, *, by: Sequence[str], col: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"),
                               (F.stddev_pop(col) / F.sqrt(F.count(col))).alias("se"), F.count(col).alias("n"))
