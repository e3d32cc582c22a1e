"""Ordered computations that stay parallel inside one hot group.

A plain window sends a whole group to one task. These helpers split every group
into slices along its order (a fixed span of frames, or a range partition), run
the window inside a slice, and carry one summary row per slice across.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage_cut import cut

# frames per slice: a frame holds at most 255 labels of a channel (8-bit label
# images), so a slice is bounded at about a quarter of a million rows
SPAN = 1000


def _slice(at: str, span: int) -> Column:
    return F.floor(F.col(at) / F.lit(span))


def _sliced(df: DataFrame, keys: Sequence[str], at: str, span: int) -> DataFrame:
    """Rows with their slice ``_s`` and one key ``_g`` of group and slice.

    The key is a struct, which is equal where its fields are equal or both null: rows with a
    null key or a null order value form groups and slices of their own, as in a plain window.
    """
    return df.withColumn("_s", _slice(at, span)).withColumn("_g", F.struct(*keys, "_s"))


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: dict[str, str],
              *, back: bool = True, span: int = SPAN) -> DataFrame:
    """Add the previous (or next) row's columns: ``cols`` maps column to new name.

    ``order[0]`` must be numeric (a time); the order must be total within ``keys``.
    """
    keys, order = list(keys), list(order)
    sliced = _sliced(df, keys, order[0], span)
    inside = Window.partitionBy("_g").orderBy(*order)
    pick = F.lag if back else F.lead
    payload = F.struct(*[F.col(c).alias(n) for c, n in cols.items()])
    # the slice's row nearest to the neighbouring slice
    edge = F.max_by if back else F.min_by
    edges = sliced.groupBy("_g").agg(edge(payload, F.struct(*order)).alias("_edge"))
    across = Window.partitionBy(*[F.col("_g")[k] for k in keys]).orderBy(F.col("_g._s"))
    edges = edges.select("_g", pick("_edge").over(across).alias("_carry"))
    local = sliced.withColumn("_local", pick(payload).over(inside))
    near = F.coalesce("_local", "_carry")
    joined = local.join(edges, "_g")
    return joined.select(*df.columns, *[near[n].alias(n) for n in cols.values()])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, index: str | None = None,
            sums: dict[str, str] | None = None, tops: dict[str, str] | None = None,
            totals: bool = False, span: int = SPAN) -> DataFrame:
    """Add a 1-based row index, running sums and running maxima (current row included).

    ``totals`` also adds the whole group's sums, as ``<name>_all``.
    """
    keys, order = list(keys), list(order)
    sums, tops = dict(sums or {}), dict(tops or {})
    sliced = _sliced(df, keys, order[0], span)
    inside = Window.partitionBy("_g").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    per_slice = sliced.groupBy("_g").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_sum_{n}") for c, n in sums.items()],
        *[F.max(c).alias(f"_max_{n}") for c, n in tops.items()])
    group = Window.partitionBy(*[F.col("_g")[k] for k in keys])
    before = group.orderBy(F.col("_g._s")).rowsBetween(Window.unboundedPreceding, -1)
    per_slice = per_slice.select(
        "_g", *[F.sum(f"_sum_{n}").over(group).alias(f"{n}_all") for n in sums.values() if totals], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_sum0_{n}") for n in sums.values()],
        *[F.max(f"_max_{n}").over(before).alias(f"_max0_{n}") for n in tops.values()])
    local = sliced
    if index:
        local = local.withColumn("_i", F.row_number().over(inside))
    for c, n in sums.items():
        local = local.withColumn(f"_l_{n}", F.sum(c).over(upto))
    for c, n in tops.items():
        local = local.withColumn(f"_m_{n}", F.max(c).over(upto))
    out = [F.col(c) for c in df.columns]
    if index:
        out.append((F.col("_i") + F.col("_n0")).cast("long").alias(index))
    out += [(F.col(f"_l_{n}") + F.col(f"_sum0_{n}")).alias(n) for n in sums.values()]
    # greatest skips nulls
    out += [F.greatest(F.col(f"_m_{n}"), F.col(f"_max0_{n}")).alias(n) for n in tops.values()]
    out += [F.col(f"{n}_all") for n in sums.values() if totals]
    return local.join(per_slice, "_g").select(*out)


def ranged(df: DataFrame, *cols: str) -> DataFrame:
    """Range-partition by ``cols`` and store the partition number in ``_part``.

    The result is written out, so the numbers cannot move between two reads.
    """
    return cut(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()))


def positions(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Exact cumulative ``weight`` before each row, per ``by`` in the order of ``value``.

    Returns ``by, value, weight, _before, _total``. Works for any value distribution:
    slices are range partitions, not fixed widths.
    """
    by = list(by)
    placed = ranged(df, *by, value).withColumn("_g", F.struct(*by, "_part"))
    per_part = placed.groupBy("_g").agg(F.sum(weight).alias("_w"))
    group = Window.partitionBy(*[F.col("_g")[b] for b in by]) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(F.col("_g._part")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per group and range partition
    per_part = per_part.select("_g", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_off"),
                               F.sum("_w").over(group).alias("_total"))
    inside = Window.partitionBy("_g").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return (local.join(per_part, "_g")
            .select(*by, value, weight, (F.col("_in") + F.col("_off")).alias("_before"), "_total"))


def quantiles_long(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                   by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation: rows ``by, name, p, q``.

    Equal values are counted first, then located by cumulative count over range
    partitions; no task ever holds a group's whole set of values.
    """
    by = list(by)
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_e"))
    long = long.select(*by, "_e.name", "_e.v").where(F.col("v").isNotNull())
    counts = long.groupBy(*by, "name", "v").agg(F.count(F.lit(1)).alias("n"))
    at = positions(counts, [*by, "name"], "v", "n")
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")
    hit = at.select(*by, "name", "v", "n", "_before", "_total", wanted)
    h = F.col("p") * (F.col("_total") - 1)
    hit = hit.withColumn("_lo", F.floor(h)).withColumn("_hi", F.ceil(h)).withColumn("_f", h - F.floor(h))
    holds = lambda k: (F.col("_before") <= F.col(k)) & (F.col(k) < F.col("_before") + F.col("n"))
    hit = hit.where(holds("_lo") | holds("_hi"))
    got = hit.groupBy(*by, "name", "p").agg(
        F.max(F.when(holds("_lo"), F.col("v"))).alias("a"),
        F.max(F.when(holds("_hi"), F.col("v"))).alias("b"), F.max("_f").alias("_f"))
    return got.select(*by, "name", "p", (F.col("a") + (F.col("b") - F.col("a")) * F.col("_f")).alias("q"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: dict[str, float],
              by: Sequence[str] = ()) -> DataFrame:
    """Like :func:`quantiles_long` with one column per named probability: rows ``by, name``."""
    by = list(by)
    long = quantiles_long(df, cols, list(probs.values()), by)
    return long.groupBy(*by, "name").agg(*[
        F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(n) for n, p in probs.items()])


def one_row(df: DataFrame, **aggs: Column) -> Column:
    """A one-row aggregate as a scalar struct, evaluated once per query."""
    return df.agg(F.struct(*[c.alias(n) for n, c in aggs.items()]).alias("_x")).scalar()


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)
