"""Cell-cycle annotations: overlapping cycles, initiation, segregation and termination."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import volume
from ..functions.ordered import one_row


def initiation_cell(cells: DataFrame, obs: DataFrame, cycle: DataFrame) -> DataFrame:
    """Find in which of cell, mother, grandmother, great-grandmother the cycle began.

    Returns ``cell_id, initiation_time, termination_time, n_oc, init_cell_id,
    true_initiation_length, init_width`` for the annotated cells where it was found.
    """
    up = cells.select("cell_id", "parent_id")
    mother = up.select(F.col("cell_id").alias("m_id"), F.col("parent_id").alias("g_id"))
    grand = up.select(F.col("cell_id").alias("g_id"), F.col("parent_id").alias("gg_id"))
    marked = up.join(cycle.select("cell_id", "initiation_time", "termination_time"), "cell_id")
    line = (marked.withColumnRenamed("parent_id", "m_id")
            .join(mother, "m_id", "left").join(grand, "g_id", "left"))
    # at most four candidates per cell; the nearest one with an observation at that time counts
    step = lambda n, c: F.struct(F.lit(n).alias("n_oc"), F.col(c).alias("init_cell_id"))
    line = line.select("cell_id", "initiation_time", "termination_time", F.explode(F.array(
        step(1, "cell_id"), step(2, "m_id"), step(3, "g_id"), step(4, "gg_id"))).alias("_s")).select(
        "cell_id", "initiation_time", "termination_time", "_s.n_oc", "_s.init_cell_id").where("init_cell_id IS NOT NULL")
    at = obs.select(F.col("cell_id").alias("init_cell_id"), F.col("t").alias("initiation_time"), F.col("length").alias("_l"))
    width = cells.select(F.col("cell_id").alias("init_cell_id"), F.col("width").alias("_w"))
    hit = line.join(at, ["init_cell_id", "initiation_time"]).join(width, "init_cell_id")
    best = hit.groupBy("cell_id").agg(F.min(F.struct(
        "n_oc", "init_cell_id", "initiation_time", "termination_time", "_l", "_w")).alias("b"))
    return best.select("cell_id", "b.initiation_time", "b.termination_time", "b.n_oc", "b.init_cell_id",
                       F.col("b._l").alias("true_initiation_length"), F.col("b._w").alias("init_width"))


def initiation_size(cells: DataFrame, init: DataFrame) -> DataFrame:
    """Length and volume at initiation, per cycle in progress, and the unit cell."""
    share = F.pow(F.lit(2.0), F.col("n_oc") - 1)
    width = one_row(cells, w=F.avg("width"))["w"]
    length = F.col("true_initiation_length")
    whole = volume(length, "init_width")
    return init.select("cell_id", "n_oc", "true_initiation_length", (length / share).alias("initiation_length"),
                       whole.alias("true_initiation_volume"), (whole / share).alias("initiation_volume"),
                       (volume(length / share, width) * math.log(2)).alias("unit_cell"))


def cycle_periods(cells: DataFrame, init: DataFrame, *, time_int: float = 1.0) -> DataFrame:
    """B, C and D periods and their sum C + D, in minutes."""
    i, e = F.col("initiation_time"), F.col("termination_time")
    out = init.join(cells.select("cell_id", "birth_time", "division_time"), "cell_id")
    return out.select("cell_id", ((F.col("birth_time") - i) * time_int).alias("B"), ((e - i) * time_int).alias("C"),
                      ((F.col("division_time") - e) * time_int).alias("D"),
                      ((F.col("division_time") - i) * time_int).alias("tau_cyc"))


def daughter_delta(cells: DataFrame, values: DataFrame, *, attr: str) -> DataFrame:
    """Twice the first daughter's value minus the cell's own, where both have one."""
    v = values.where(F.col(attr).isNotNull()).select("cell_id", attr)
    child = v.select(F.col("cell_id").alias("child1_id"), F.col(attr).alias("_c"))
    return cells.select("cell_id", "child1_id").join(v, "cell_id").join(child, "child1_id").select(
        "cell_id", (2 * F.col("_c") - F.col(attr)).alias("delta"))


def _size_at(cells: DataFrame, obs: DataFrame, times: DataFrame) -> DataFrame:
    """Length and mean-width volume of a cell at a time it was observed; ``times(cell_id, t)``."""
    at = times.join(obs.select("cell_id", "t", "length"), ["cell_id", "t"])
    return at.join(cells.select("cell_id", "width"), "cell_id").select(
        "cell_id", "t", "length", volume("length", "width").alias("volume"))


def segregation(cells: DataFrame, obs: DataFrame, cycle: DataFrame, init: DataFrame, *, time_int: float = 1.0) -> DataFrame:
    """Size at segregation, the periods around it, and the size added since mother and until daughter."""
    seg = _size_at(cells, obs, cycle.where("seg_time IS NOT NULL").select("cell_id", F.col("seg_time").alias("t")))
    seg = seg.withColumnsRenamed({"t": "segregation_time", "length": "segregation_length", "volume": "segregation_volume"})
    rel = cells.select("cell_id", "parent_id", "child1_id", "division_time")
    times = init.select("cell_id", F.col("initiation_time").alias("_i"), F.col("termination_time").alias("_e"))
    size = lambda key, name: seg.select(F.col("cell_id").alias(key), F.col("segregation_length").alias(name))
    out = (seg.join(rel, "cell_id").join(times, "cell_id", "left").join(size("child1_id", "_d"), "child1_id", "left")
           .join(size("parent_id", "_m"), "parent_id", "left"))
    s, length = F.col("segregation_time"), F.col("segregation_length")
    known = F.col("_i") != 0
    return out.select(
        "cell_id", "segregation_time", "segregation_length", "segregation_volume",
        ((F.col("division_time") - s) * time_int).alias("S"), F.when(known, (s - F.col("_i")) * time_int).alias("IS"),
        F.when(known, (s - F.col("_e")) * time_int).alias("TS"), (2 * F.col("_d") - length).alias("segregation_delta"),
        (2 * length - F.col("_m")).alias("segregation_delta_mother"), F.col("_m").alias("segregation_length_mother"))


def termination(cells: DataFrame, obs: DataFrame, init: DataFrame) -> DataFrame:
    """Size at termination and the size added until the first daughter's termination."""
    end = _size_at(cells, obs, init.where("termination_time <> 0").select("cell_id", F.col("termination_time").alias("t")))
    end = end.select("cell_id", F.col("length").alias("termination_length"), F.col("volume").alias("termination_volume"))
    delta = daughter_delta(cells, end, attr="termination_length").withColumnRenamed("delta", "termination_delta")
    return end.join(delta, "cell_id", "left")


def attach_attributes(cells: DataFrame, ann: DataFrame, *, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Add annotation columns to the cells; annotations of unknown cells are dropped."""
    return cells.join(ann.withColumnsRenamed(dict(rename or {})), "cell_id", "left")
