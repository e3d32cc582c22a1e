"""Filters on cell, observation and focus tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import one_row, quantiles

# fixed values: the attributes a cell must have in range to pass filter_by_stat
STAT_COLUMNS = ("sb", "sd", "delta", "elong_rate", "tau", "septum_position")


def complete(cells: DataFrame) -> DataFrame:
    """Cells that have both a parent and daughters."""
    return cells.where(F.col("child1_id").isNotNull() & F.col("parent_id").isNotNull())


def mothers(cells: DataFrame) -> DataFrame:
    return by_birth_label(cells, labels=1)


def by_birth_label(cells: DataFrame, *, labels: int | Sequence[int] = 1) -> DataFrame:
    wanted = [labels] if isinstance(labels, int) else list(labels)
    return cells.where(F.col("birth_label").isin(wanted))


def by_fov(cells: DataFrame, *, fovs: int | Sequence[int]) -> DataFrame:
    wanted = [fovs] if isinstance(fovs, int) else list(fovs)
    return cells.where(F.col("fov").isin(wanted))


def by_fov_peak(cells: DataFrame, *, fov: int, peak: int) -> DataFrame:
    return cells.where((F.col("fov") == fov) & (F.col("peak") == peak))


def by_fov_peaks(cells: DataFrame, *, mapping: Mapping[int, Sequence[int] | None] | None) -> DataFrame:
    """Keep the channels listed per field of view; a field mapped to None is kept whole.

    The mapping is an argument of the call, so it becomes a pushed-down predicate.
    """
    if mapping is None:
        return cells
    keep = F.lit(False)
    for fov, peaks in mapping.items():
        here = F.col("fov") == fov
        keep = keep | (here if peaks is None else here & F.col("peak").isin(list(peaks)))
    return cells.where(keep)


def born_before(cells: DataFrame, *, t: int | None = None) -> DataFrame:
    return cells if t is None else cells.where(F.col("birth_time") <= t)


def born_after(cells: DataFrame, *, t: int | None = None) -> DataFrame:
    return cells if t is None else cells.where(F.col("birth_time") >= t)


def where_attr(df: DataFrame, *, attr: str, val, idx: int | None = None) -> DataFrame:
    """Rows whose attribute (or its zero-based list item) equals a value."""
    c = F.col(attr) if idx is None else F.get(F.col(attr), idx)
    return df.where(c == F.lit(val))


def where_contains(cells: DataFrame, obs: DataFrame, *, attr: str, val) -> DataFrame:
    """Cells whose list attribute, kept as observation rows, holds a value."""
    return cells.join(obs.where(F.col(attr) == F.lit(val)).select("cell_id"), "cell_id", "left_semi")


def foci_at(focus_obs: DataFrame, *, label: int, t: int, key: str = "focus_id") -> DataFrame:
    """All rows of the foci that carry ``label`` at time ``t``."""
    hit = focus_obs.where((F.col("label") == label) & (F.col("t") == t)).select(key)
    return focus_obs.join(hit, key, "left_semi")


def filter_by_stat(cells: DataFrame, *, center: str = "mean", k: float = 3,
                   cols: Sequence[str] = STAT_COLUMNS) -> DataFrame:
    """Cells with all six statistics strictly inside centre ± k sample standard deviations."""
    spread = {f"s_{c}": F.stddev_samp(c) for c in cols}
    if center == "mean":
        row = one_row(cells, **spread, **{c: F.avg(c) for c in cols})
        mid = row
    elif center == "50%":
        row = one_row(cells, **spread)
        q = quantiles(cells, cols, {"q": 0.5})
        mid = one_row(q, **{c: F.max(F.when(F.col("name") == c, F.col("q"))) for c in cols})
    else:
        raise ValueError(f"unknown center {center!r}")
    # one-sided form of both strict bounds, so that each statistic is looked up once
    keep = F.lit(True)
    for c in cols:
        keep = keep & (F.abs(F.col(c) - mid[c]) < k * row[f"s_{c}"])
    return cells.where(keep)


def cutoffs(df: DataFrame, *, col: str, method: str = "mean", plo: float = 1, phi: float = 1) -> DataFrame:
    """One row ``lo, hi`` with the bounds of an attribute; ``hi`` is null where there is none."""
    if method == "mean":
        mu, d = F.avg(col), F.stddev_pop(col)
        return df.agg((mu - plo * d).alias("lo"), (mu + phi * d).alias("hi"))
    if method == "logmean":
        x = F.when(F.col(col) > 0, F.log(col))
        mu, d = F.avg(x), F.stddev_pop(x)
        return df.agg(F.exp(mu - plo * d).alias("lo"), F.exp(mu + phi * d).alias("hi"))
    if method == "median":
        q = quantiles(df, [col], {"a": 0.25, "m": 0.5, "b": 0.75}).agg(*[F.max(c).alias(c) for c in "amb"])
        return q.select((F.col("m") - plo * (F.col("b") - F.col("a"))).alias("lo"),
                        (F.col("m") + phi * (F.col("b") - F.col("a"))).alias("hi"))
    if method == "median-min":
        mid = quantiles(df, [col], {"m": 0.5})
        m = one_row(mid, m=F.max("m"))["m"]
        spread = quantiles(df.select(F.abs(F.col(col) - m).alias("_dev")), ["_dev"], {"mad": 0.5}).agg(F.max("mad").alias("mad"))
        return spread.select((m + plo * F.col("mad")).alias("lo"), F.lit(None).cast("double").alias("hi"))
    raise ValueError(f"unknown method {method!r}")


def _bounds(df: DataFrame, asked: Mapping[str, Mapping]) -> dict[str, tuple[Column, Column]]:
    """Bounds of many attributes as :func:`cutoffs` gives them: one aggregation, and one or two quantile passes for all."""
    def of(*methods):
        return [c for c, p in asked.items() if p["method"] in methods]

    unknown = set(asked) - set(of("mean", "logmean", "median", "median-min"))
    if unknown:
        raise ValueError(f"unknown method {asked[unknown.pop()]['method']!r}")
    none, out, sums = F.lit(None).cast("double"), {}, {}
    for c in of("mean", "logmean"):
        x = F.col(c) if asked[c]["method"] == "mean" else F.when(F.col(c) > 0, F.log(c))
        sums |= {f"m_{c}": F.avg(x), f"d_{c}": F.stddev_pop(x)}
    row = one_row(df, **sums) if sums else None
    for c in of("mean", "logmean"):
        lo, hi = row[f"m_{c}"] - asked[c]["plo"] * row[f"d_{c}"], row[f"m_{c}"] + asked[c]["phi"] * row[f"d_{c}"]
        out[c] = (lo, hi) if asked[c]["method"] == "mean" else (F.exp(lo), F.exp(hi))
    if ranked := of("median", "median-min"):
        q = quantiles(df, ranked, {"a": 0.25, "m": 0.5, "b": 0.75})
        row = one_row(q, **{f"{k}_{c}": F.max(F.when(F.col("name") == c, F.col(k))) for c in ranked for k in "amb"})
        for c in of("median"):
            spread = row[f"b_{c}"] - row[f"a_{c}"]
            out[c] = (row[f"m_{c}"] - asked[c]["plo"] * spread, row[f"m_{c}"] + asked[c]["phi"] * spread)
    if least := of("median-min"):
        apart = quantiles(df.select(*[F.abs(F.col(c) - row[f"m_{c}"]).alias(c) for c in least]), least, {"mad": 0.5})
        mad = one_row(apart, **{c: F.max(F.when(F.col("name") == c, F.col("mad"))) for c in least})
        out |= {c: (row[f"m_{c}"] + asked[c]["plo"] * mad[c], none) for c in least}
    return out


def filter_by_cutoffs(cells: DataFrame, *, spec: Mapping[str, Mapping]) -> DataFrame:
    """Keep cells that are not below ``lo`` and not above ``hi`` of any attribute (missing values stay).

    Each entry gives ``xlo``/``xhi`` directly, or ``method``/``plo``/``phi`` for :func:`cutoffs`.
    """
    asked = {c: {"plo": 1, "phi": 1, **p} for c, p in spec.items() if "method" in p}
    bounds = _bounds(cells, asked) if asked else {}
    keep = F.lit(True)
    for col, par in spec.items():
        if "method" in par:
            lo, hi = bounds[col]
        else:
            lo = F.lit(par.get("xlo")).cast("double")
            hi = F.lit(par.get("xhi")).cast("double")
        keep = keep & ~F.coalesce(F.col(col) < lo, F.lit(False)) & ~F.coalesce(F.col(col) > hi, F.lit(False))
    return cells.where(keep)


def cutoff_summary(cells: DataFrame, *, cols: Sequence[str]) -> DataFrame:
    """Median, interquartile range and population standard deviation: one row per attribute."""
    q = quantiles(cells, cols, {"a": 0.25, "median": 0.5, "b": 0.75})
    std = cells.agg(*[F.stddev_pop(c).alias(c) for c in cols]).unpivot([], list(cols), "name", "std")
    return std.join(q, "name", "left").select("name", "median", (F.col("b") - F.col("a")).alias("iqr"), "std")


def has_cycle(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("initiation_time").isNotNull() & F.col("termination_time").isNotNull())


def analysed(df: DataFrame, specs: DataFrame, *, spec: int = 1) -> DataFrame:
    """Rows of the channels marked for analysis (1), as empty (0) or as ignored (-1)."""
    return df.join(specs.where(F.col("spec") == spec).select("fov", "peak"), ["fov", "peak"], "left_semi")


def pairs(df: DataFrame, *, x: str, y: str) -> DataFrame:
    return df.dropna(how="any", subset=[x, y])


def fl_frames(obs: DataFrame, *, start: int = 1, every: int = 2) -> DataFrame:
    """Observations of the frames that have a fluorescence image."""
    if every == 1:
        return obs
    if start == 1:
        return obs.where((F.col("t") % every == 1) | (F.col("t") == 1))
    return obs.where(F.col("t") % every == 0)
