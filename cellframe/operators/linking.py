"""Linking regions of consecutive frames: predicates, nearest leaves, candidate edges, event tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import union_all
from .regions import make_id

IMAGE = ["fov", "peak", "t"]
REGION = [*IMAGE, "label"]
CHANNEL = ["fov", "peak"]


# ---- growth and division predicates; ``prev`` and ``region`` are struct columns ----

def growth_ok(prev: Column, region: Column, *, max_len: float = 1.3, min_len: float = 0.8, max_area: float = 1.3,
              min_area: float = 0.8, area_check: str = "length") -> Column:
    """Whether a region can be the grown form of a cell's last region.

    The lower area bound compares the region's area with the previous *length*; pass
    ``area_check="area"`` to compare areas.
    """
    floor_of = prev["length"] if area_check == "length" else prev["area"]
    return ((region["length"] <= prev["length"] * max_len) & (region["length"] >= prev["length"] * min_len)
            & (region["area"] <= prev["area"] * max_area) & (region["area"] >= floor_of * min_area)
            & (region["y"] >= prev["min_y"]) & (region["y"] <= prev["max_y"]))


def division_class(cell: Column, first: Column, second: Column, *, max_len: float = 1.3, min_len: float = 0.8, **growth) -> Column:
    """0 nothing, 1 grow by the first region, 2 grow by the second, 3 divide into both."""
    grow = lambda r: growth_ok(cell, r, max_len=max_len, min_len=min_len, **growth)
    both = first["length"] + second["length"]
    fits = (both <= cell["length"] * max_len) & (both >= cell["length"] * min_len)
    above = (first["y"] >= cell["min_y"]) & (first["y"] <= cell["y"])
    below = (second["y"] >= cell["y"]) & (second["y"] <= cell["max_y"])
    return F.when(grow(first), 1).when(grow(second), 2).when(fits & above & below, 3).otherwise(0)


SHAPE = ("y", "min_y", "max_y", "area", "length")


def growing_pairs(regions: DataFrame, **growth) -> DataFrame:
    """Regions of consecutive frames that pass the growth predicate: ``fov, peak, t, label, next_label``."""
    a = regions.select(*REGION, F.struct(*SHAPE).alias("a"))
    b = regions.select(*CHANNEL, (F.col("t") - 1).alias("t"), F.col("label").alias("next_label"), F.struct(*SHAPE).alias("b"))
    return a.join(b, IMAGE).where(growth_ok(F.col("a"), F.col("b"), **growth)).select(*REGION, "next_label")


def nearest_leaf(leaves: DataFrame, regions: DataFrame) -> DataFrame:
    """The leaf nearest in y for every region of the same frame: ``fov, peak, t, label, leaf, distance``.

    ``leaves(fov, peak, t, leaf, y)``; the lower leaf number wins ties. Leaves and regions
    are merged in order of y, so no pairs are formed; a frame holds at most 255 of each.
    """
    marks = leaves.groupBy(*IMAGE, "y").agg(F.min("leaf").alias("leaf"))
    line = marks.select(*IMAGE, "y", F.struct("y", "leaf").alias("m"), F.lit(None).cast("int").alias("label")).unionByName(
        regions.select(*IMAGE, "y", F.lit(None).cast(marks.select(F.struct("y", "leaf")).schema[0].dataType).alias("m"),
                       F.col("label").cast("int").alias("label")))
    w = Window.partitionBy(*IMAGE).orderBy("y")
    # range frames include every row with the same y
    near = line.select(
        *IMAGE, "label", "y",
        F.last("m", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("lo"),
        F.first("m", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing)).alias("hi")).where("label IS NOT NULL")
    cand = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("y") - F.col(f"{c}.y")).alias("distance"), F.col(f"{c}.leaf").alias("leaf")))
    best = near.select(*REGION, F.least(cand("lo"), cand("hi")).alias("b")).where("b IS NOT NULL")
    return best.select(*REGION, "b.leaf", "b.distance")


def two_closest(links: DataFrame) -> DataFrame:
    """Mark the two closest regions of every leaf (``kept``); the others may start new cells."""
    w = Window.partitionBy(*IMAGE, "leaf").orderBy("distance", "label")
    return links.withColumn("rank", F.row_number().over(w)).withColumn("kept", F.col("rank") <= 2)


def divisions(leaves: DataFrame, regions: DataFrame, links: DataFrame, **limits) -> DataFrame:
    """Decision for every leaf with two kept regions: ``fov, peak, t, leaf, first, second, decision``."""
    kept = two_closest(links).where("kept").join(regions.select(*REGION, *SHAPE), REGION)
    one = F.struct("label", *SHAPE)
    two = kept.groupBy(*IMAGE, "leaf").agg(F.min(one).alias("a"), F.max(one).alias("b"), F.count(F.lit(1)).alias("n"))
    cell = leaves.select(*IMAGE, "leaf", F.struct(*SHAPE).alias("c"))
    return two.where("n = 2").join(cell, [*IMAGE, "leaf"]).select(
        *IMAGE, "leaf", F.col("a.label").alias("first"), F.col("b.label").alias("second"),
        division_class(F.col("c"), F.col("a"), F.col("b"), **limits).alias("decision"))


# ---- candidate edges ----

def track_edges(frames: DataFrame, regions: DataFrame, pairs: DataFrame, single: DataFrame, *,
                born: float = 0.75, appear: float = 0.75, prefix: str = "") -> DataFrame:
    """Typed, scored edges between detections, state nodes, start A and end B.

    ``pairs(region keys, next_label, p_migrate, p_child)`` and ``single(region keys,
    p_appear, p_born, p_disappear, p_die)`` carry the class probabilities; ``frames``
    lists the frames of each channel. The score is the logarithm of the weight. Every
    region is a node; to keep only some of a frame, pass :func:`first_regions` of them here
    and to the tracker.
    """
    ends = frames.groupBy(*CHANNEL).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    state = lambda name, t: F.format_string(f"{name}_%04d", t)
    t, none = F.col("t"), F.lit(None).cast("int")
    first, last = t == F.col("t0"), t == F.col("t1")

    def edge(src, dst, kind, weight, a=none, b=none, when=None):
        e = F.struct(t.cast("long").alias("t"), src.alias("src"), dst.alias("dst"), a.cast("int").alias("src_label"),
                     b.cast("int").alias("dst_label"), F.lit(kind).alias("type"), weight.cast("double").alias("weight"))
        return e if when is None else F.when(when, e)

    start, end, one = F.lit("A"), F.lit("B"), F.lit(1.0)
    chain = lambda name, kind, w: edge(state(name, t - 1), state(name, t), kind, F.lit(w), when=~first)
    by_frame = frames.select(*IMAGE).distinct().join(ends, CHANNEL).select(*CHANNEL, F.explode(F.array_compact(F.array(
        edge(start, state("appear", t), "start", F.lit(appear), when=first),
        edge(start, state("born", t), "start", F.lit(born), when=first),
        chain("dies", "die", 1.1), chain("disappear", "disappear", 1.1), chain("born", "born", born), chain("appear", "appear", appear),
        *[edge(state(n, t), end, "end", one, when=last) for n in ("appear", "disappear", "born", "dies")]))).alias("e"))

    named = make_id(regions.select(*REGION), prefix=prefix, name="node")
    me, lab = F.col("node"), F.col("label")
    # a detection keeps its start and end edges where no class probabilities are given
    alone = named.join(single, REGION, "left").join(ends, CHANNEL)
    given = lambda c: F.col(c).isNotNull()
    by_region = alone.select(*CHANNEL, F.explode(F.array_compact(F.array(
        edge(start, me, "start", one, b=lab, when=first), edge(me, end, "end", one, a=lab, when=last),
        edge(state("appear", t - 1), me, "appear", F.col("p_appear"), b=lab, when=~first & given("p_appear")),
        edge(state("born", t - 1), me, "born", F.col("p_born"), b=lab, when=~first & given("p_born")),
        edge(me, state("disappear", t + 1), "disappear", F.col("p_disappear"), a=lab, when=~last & given("p_disappear")),
        edge(me, state("dies", t + 1), "die", F.col("p_die"), a=lab, when=~last & given("p_die"))))).alias("e"))

    b, nxt = F.col("next_node"), F.col("next_label")
    after = named.select(*CHANNEL, (t - 1).alias("t"), F.col("label").alias("next_label"), me.alias("next_node"))
    by_pair = pairs.join(named, REGION).join(after, [*IMAGE, "next_label"]).select(*CHANNEL, F.explode(F.array(
        edge(me, b, "child", F.col("p_child"), lab, nxt), edge(me, b, "migrate", F.col("p_migrate"), lab, nxt))).alias("e"))
    edges = union_all([by_frame, by_region, by_pair]).select(*CHANNEL, "e.*")
    return edges.withColumn("score", F.log("weight"))


def best_edge(edges: DataFrame) -> DataFrame:
    """The highest-scoring edge between two nodes; the first type by name wins ties."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "type"))
    return edges.groupBy(*CHANNEL, "src", "dst").agg(best.alias("b")).select(
        *CHANNEL, "src", "dst", "b.type", (-F.col("b.s")).alias("score"))


def edges_of_type(edges: DataFrame, *, kind: str = "child") -> DataFrame:
    return edges.where(F.col("type") == kind).select(*CHANNEL, "src", "dst", "score")


def unvisited(nodes: DataFrame, tracks: DataFrame) -> DataFrame:
    """How many detections of each channel no track uses: ``fov, peak, n``."""
    used = tracks.select(*REGION).distinct().withColumn("_u", F.lit(1))
    return nodes.select(*REGION).join(used, REGION, "left").groupBy(*CHANNEL).agg(F.count_if(F.col("_u").isNull()).alias("n"))


# ---- event tables ----

EVENTS = ("migrate", "divide", "die", "born", "appear", "disappear", "false_join", "one_cell", "two_cells", "three_cells",
          "zero_cells", "no_data")
FOCUS_EVENTS = ("migrate", "split", "appear", "disappear", "no_data")


def _placed(obs: DataFrame, key: str) -> DataFrame:
    """Observations with the next label of the same object and flags for its first and last one."""
    # an object's frames bound its window; one shuffle by object serves all columns
    whole = Window.partitionBy(key)
    out = obs.select(key, *REGION).where(F.col(key).isNotNull()).withColumns({
        "next_label": F.lead("label").over(whole.orderBy("t")), "_a": F.min("t").over(whole), "_b": F.max("t").over(whole), "_n": F.count(F.lit(1)).over(whole)})
    return out.withColumns({"first": F.col("t") == F.col("_a"), "last": F.col("t") == F.col("_b")})


def _without_gaps(placed: DataFrame) -> DataFrame:
    return placed.where(F.col("_b") - F.col("_a") + 1 <= F.col("_n"))


def _flagged(regions: DataFrame, seen: DataFrame, flags: Sequence[str], defaults: dict[str, int]) -> DataFrame:
    """One row per region: flags of the objects seen there, or the defaults of an unseen region."""
    got = seen.groupBy(*REGION).agg(*[F.max(f).alias(f) for f in flags])
    return regions.select(*REGION).distinct().join(got, REGION, "left").select(
        *REGION, *[F.coalesce(f, F.lit(defaults.get(f, 0))).alias(f) for f in flags])


def region_events(regions: DataFrame, cells: DataFrame, obs: DataFrame) -> DataFrame:
    """Twelve 0/1 events of every region; cells observed with time gaps are left out."""
    c = cells.select("cell_id", "parent_id", "child1_id", "death")
    seen = _without_gaps(_placed(obs, "cell_id")).join(c, "cell_id")
    kids, up = F.col("child1_id").isNotNull(), F.col("parent_id").isNotNull()
    first, last = F.col("first"), F.col("last")
    rules = {"migrate": ~last, "divide": last & kids, "die": last & (F.coalesce("death", F.lit(0)) > 0), "born": first & up,
             "appear": first & ~up & (F.col("t") != 1), "disappear": last & ~kids, "one_cell": F.lit(True)}
    flags = {e: rules.get(e, F.lit(False)).cast("int") for e in EVENTS}
    return _flagged(regions, seen.withColumns(flags), EVENTS, {"one_cell": 1, "no_data": 1})


def _links(regions: DataFrame, seen: DataFrame, objects: DataFrame, first_labels: DataFrame, key: str) -> DataFrame:
    """Links from region to region of the next frame; 0 stands for disappearing."""
    moved = seen.where(~F.col("last")).select(*REGION, "next_label")
    last = seen.where("last").select(key, *REGION).join(objects.select(key, "child1_id", "child2_id"), key)
    born = lambda n: first_labels.select(F.col(key).alias(f"child{n}_id"), F.col("label").alias(f"_l{n}"))
    split = last.join(born(1), "child1_id").join(born(2), "child2_id").select(
        *REGION, F.explode(F.array("_l1", "_l2")).alias("next_label"))
    gone = last.where("child1_id IS NULL").select(*REGION, F.lit(0).alias("next_label"))
    unseen = regions.select(*REGION).join(seen.select(*REGION), REGION, "left_anti").withColumn("next_label", F.lit(0))
    return union_all([moved, split, gone, unseen]).distinct()


def region_links(regions: DataFrame, cells: DataFrame, obs: DataFrame) -> DataFrame:
    """Sparse link matrix of the cells: ``fov, peak, t, label, next_label``."""
    first = obs.groupBy("cell_id").agg(F.min_by("label", "t").alias("label"))
    return _links(regions, _without_gaps(_placed(obs, "cell_id")), cells, first, "cell_id")


def apply_overrides(table: DataFrame, new: DataFrame) -> DataFrame:
    """Replace all rows of the regions that appear in ``new``."""
    return table.join(new.select(*REGION), REGION, "left_anti").unionByName(new)


def merge_last(dfs: Sequence[DataFrame], *, key: str = "cell_id") -> DataFrame:
    """Union of tables with one row per key; the later table wins."""
    named = union_all([df.withColumn("_k", F.lit(i)) for i, df in enumerate(dfs)])
    cols = [c for c in dfs[0].columns if c != key]
    return named.groupBy(key).agg(F.max_by(F.struct(*cols), "_k").alias("_r")).select(key, "_r.*")


def distinct_times(focus_obs: DataFrame, *, order: str, key: str = "focus_id") -> DataFrame:
    """One row per focus and time; the first label by ``order`` stays."""
    return focus_obs.groupBy(key, *IMAGE).agg(F.min_by("label", order).alias("label"))


def focus_events(regions: DataFrame, foci: DataFrame, focus_obs: DataFrame) -> DataFrame:
    """Five 0/1 events of every focus region; ``focus_obs`` has distinct times."""
    c = foci.select("focus_id", "parent_id", "child1_id")
    seen = _placed(focus_obs, "focus_id").join(c, "focus_id")
    kids, up = F.col("child1_id").isNotNull(), F.col("parent_id").isNotNull()
    rules = {"migrate": ~F.col("last"), "split": F.col("last") & kids, "appear": F.col("first") & ~up & (F.col("t") != 1),
             "disappear": F.col("last") & ~kids, "no_data": F.lit(False)}
    return _flagged(regions, seen.withColumns({e: r.cast("int") for e, r in rules.items()}), FOCUS_EVENTS, {"no_data": 1})


def focus_links(regions: DataFrame, foci: DataFrame, focus_obs: DataFrame) -> DataFrame:
    first = focus_obs.groupBy("focus_id").agg(F.min_by("label", "t").alias("label"))
    return _links(regions, _placed(focus_obs, "focus_id"), foci, first, "focus_id")
