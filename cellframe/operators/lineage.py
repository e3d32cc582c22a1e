"""Lineage operators: ancestors, generations, chains, pole ages and their exports.

``child1_id`` is the daughter at the closed end. A relative counts only if it is
present in the given table, so a filter applied before changes the tree.

Walks along pointers double their reach every round (log2 of the depth rounds);
each round is one equi-join and is written to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage_cut import Rounds, cut, doublings
from ..functions.ordered import neighbour, running
from .filters import analysed

CHANNEL = ["fov", "peak"]


def _ids(cells: DataFrame) -> DataFrame:
    return cells.select("cell_id")


def parent_edges(cells: DataFrame) -> DataFrame:
    """``id, to``: every cell with a present parent."""
    up = cells.where(F.col("parent_id").isNotNull()).select(F.col("cell_id").alias("id"), F.col("parent_id").alias("to"))
    return up.join(_ids(cells).withColumnRenamed("cell_id", "to"), "to", "left_semi").select("id", "to")


def first_child_edges(cells: DataFrame) -> DataFrame:
    """``id, to``: every cell with a present first daughter."""
    down = cells.where(F.col("child1_id").isNotNull()).select(F.col("cell_id").alias("id"), F.col("child1_id").alias("to"))
    return down.join(_ids(cells).withColumnRenamed("cell_id", "to"), "to", "left_semi").select("id", "to")


def resolve(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Follow ``edges(id, to)`` to the end: ``cell_id, end, steps``, for every cell of ``ids``.

    ``ids`` must hold every node on the way. Rows that have arrived leave the loop, so the
    many cells below one root do not meet at that root's key again and again. Ids that form
    a cycle are an error.
    """
    first = cut(ids.join(edges, F.col("cell_id") == F.col("id"), "left").select(
        "cell_id", F.coalesce("to", "cell_id").alias("end"),
        F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("steps"),
        F.col("to").isNull().alias("done")))
    rounds, state = Rounds(doublings(first.count())), first
    while True:
        open_rows = state.where(~F.col("done"))
        if open_rows.isEmpty():
            return state.select("cell_id", "end", "steps")
        ahead = state.select(F.col("cell_id").alias("end"), F.col("end").alias("_end"),
                             F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        moved = open_rows.join(ahead, "end").select(
            "cell_id", F.col("_end").alias("end"), (F.col("steps") + F.col("_steps")).alias("steps"),
            F.col("_done").alias("done"))
        state = rounds.put(state.where("done").unionByName(moved))


def _composed(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two jump tables, one after the other."""
    on = second.select(F.col("id").alias("to"), F.col("to").alias("_to"))
    return first.join(on, "to").select("id", F.col("_to").alias("to"))


def _doubled(jump: DataFrame) -> DataFrame:
    """Compose a jump table with itself."""
    return _composed(jump, jump)


def ancestor_lists(cells: DataFrame) -> DataFrame:
    """``cell_id, up``: the ancestors of every cell, nearest first.

    A row carries as many ids as its cell has ancestors. Every round appends the list of the
    last ancestor so far; only rows whose list was full move.
    """
    first = cut(_ids(cells).join(parent_edges(cells), F.col("cell_id") == F.col("id"), "left").select(
        "cell_id", F.array_compact(F.array("to")).alias("up")))
    rounds, state, width = Rounds(doublings(first.count())), first, 1
    while True:
        full = F.size("up") == width
        left = state.where(full).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_contains("up", F.col("cell_id"))).alias("again")).first()
        if not left["n"]:
            return state
        if left["again"]:
            raise ValueError("the ids form a cycle")
        ahead = state.select(F.col("cell_id").alias("_at"), F.col("up").alias("_up")).where(F.size("_up") > 0)
        moved = state.where(full).withColumn("_at", F.element_at("up", -1)).join(ahead, "_at", "left").select(
            "cell_id", F.concat("up", F.coalesce("_up", F.slice("up", 1, 0))).alias("up"))
        state, width = rounds.put(state.where(~full).unionByName(moved)), 2 * width


def ancestors(cells: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``cell_id, ancestor_id, steps`` with the nearest ancestor at step 1; ``of`` restricts the start cells."""
    if of is None:
        return ancestor_lists(cells).select("cell_id", F.posexplode("up").alias("_i", "ancestor_id")).select(
            "cell_id", "ancestor_id", (F.col("_i") + 1).cast("long").alias("steps"))
    start = of.select("cell_id")
    reach = start.select("cell_id", F.col("cell_id").alias("ancestor_id"), F.lit(0).cast("long").alias("steps"))
    jump, width = cut(parent_edges(cells)), 1
    limit = doublings(jump.count())
    jumps, reached = Rounds(limit), Rounds(limit)
    while not jump.isEmpty():
        further = reach.join(jump, F.col("ancestor_id") == F.col("id")).select(
            "cell_id", F.col("to").alias("ancestor_id"), (F.col("steps") + width).alias("steps"))
        reach = reached.put(reach.unionByName(further))
        jump, width = jumps.put(_doubled(jump)), 2 * width
    return reach.where("steps > 0")


def mark_ancestors(edges: DataFrame, of: DataFrame, known: Sequence[DataFrame] = ()) -> DataFrame:
    """The distinct ancestors of the cells in ``of`` (``cell_id``) along parent edges; never more rows than cells.

    ``known`` lists jump tables of 2, 4, 8, ... steps that are there already.
    """
    known = list(known)
    marks = cut(edges.join(of.select(F.col("cell_id").alias("id")), "id", "left_semi")
                .select(F.col("to").alias("cell_id")).distinct())
    jump, limit = edges, doublings(edges.count())
    jumps, marked = Rounds(limit), Rounds(limit)
    while not jump.isEmpty():
        found = jump.join(marks.select(F.col("cell_id").alias("id")), "id", "left_semi").select(F.col("to").alias("cell_id"))
        marks = marked.put(marks.unionByName(found).distinct())
        jump = known.pop(0) if known else jumps.put(_doubled(jump))
    return marks


def _with_ancestors(ids: DataFrame, edges: DataFrame, n: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``ids`` with at least ``n`` ancestors, and the jump tables of 2, 4, ... steps this took."""
    at, jumps, jump = ids.select(F.col("cell_id").alias("id"), F.col("cell_id").alias("to")), [], edges
    while n > 0:
        if n % 2:
            at = _composed(at, jump)
        n //= 2
        if n:
            jump = cut(_doubled(jump))
            jumps.append(jump)
    return at.select(F.col("id").alias("cell_id")), jumps


def generation_gap(cells: DataFrame) -> DataFrame:
    """``cell_id, generations``: the number of continuous ancestors."""
    return resolve(_ids(cells), parent_edges(cells)).select("cell_id", F.col("steps").alias("generations"))


def last_daughter(cells: DataFrame) -> DataFrame:
    """``cell_id, last_id``: the end of the chain of first daughters."""
    return resolve(_ids(cells), first_child_edges(cells)).select("cell_id", F.col("end").alias("last_id"))


def lineages_of_length(cells: DataFrame, *, n_gens: int = 5, remove_ends: bool = False) -> DataFrame:
    """Cells on a lineage whose last daughter has at least ``n_gens`` ancestors.

    ``remove_ends`` drops the last daughter and the root of every such lineage.
    """
    # a cell is a last daughter exactly if its own first daughter is absent
    ends = _ids(cells).join(first_child_edges(cells).select(F.col("id").alias("cell_id")), "cell_id", "left_anti")
    edges = cut(parent_edges(cells))
    long_enough, known = _with_ancestors(ends, edges, n_gens)
    long_enough = cut(long_enough)
    kept = mark_ancestors(edges, long_enough, known)
    if remove_ends:
        kept = kept.join(edges.select(F.col("id").alias("cell_id")), "cell_id", "left_semi")
    else:
        kept = kept.unionByName(long_enough).distinct()
    return cells.join(kept, "cell_id", "left_semi")


def by_channel(cells: DataFrame, specs: DataFrame) -> DataFrame:
    """Cells of the channels marked for analysis; write it with ``partitionBy("fov", "peak")``."""
    return analysed(cells, specs)


def continuous_lineages(cells: DataFrame, specs: DataFrame, *, t1: int = 0, t2: int = 1000) -> DataFrame:
    """Cells of the channels whose line of first daughters spans the time from t1 to t2."""
    cells = by_channel(cells, specs)
    place = F.struct("birth_time", "cell_id")
    spans = (F.col("birth_time") < t1) & (F.col("division_time") >= t1) & (F.col("division_time") < t2)
    first = cells.groupBy(*CHANNEL).agg(F.min(F.when(spans, place)).alias("first"), F.max(place).alias("last"))
    # a channel is skipped if nothing spans t1, or if the spanning cell is the last one
    first = first.where("first IS NOT NULL AND first.cell_id <> last.cell_id").select(
        *CHANNEL, F.col("first.cell_id").alias("first_id"))
    ends = last_daughter(cells).join(cells.select(F.col("cell_id").alias("last_id"), "birth_time"), "last_id")
    late = ends.where(F.col("birth_time") > t2).select(F.col("cell_id").alias("first_id"))
    kept = first.join(late, "first_id", "left_semi")
    return cells.join(kept, CHANNEL).where(
        (F.col("birth_time") >= t1) | (F.col("cell_id") == F.col("first_id"))).select(cells.columns)


def mother_lineages(cells: DataFrame) -> DataFrame:
    """``lineage_id, position, length, cell_id``: chains that end in a label-1 cell without daughters, oldest first.

    The lineage is named by its last cell; long lineages stay one row per cell.
    """
    here = _ids(cells)
    leaf = cells.where(F.col("birth_label") == 1)
    for child in ("child1_id", "child2_id"):
        leaf = leaf.join(here.withColumnRenamed("cell_id", child), child, "left_anti")
    leaf = cut(leaf.select("cell_id"))
    chain = cut(ancestors(cells, leaf).unionByName(
        leaf.select("cell_id", F.col("cell_id").alias("ancestor_id"), F.lit(0).cast("long").alias("steps"))))
    sizes = chain.groupBy("cell_id").agg(F.max("steps").alias("generations"))
    return chain.join(sizes, "cell_id").select(
        F.col("cell_id").alias("lineage_id"), (F.col("generations") - F.col("steps")).alias("position"),
        (F.col("generations") + 1).alias("length"), F.col("ancestor_id").alias("cell_id"))


def select_lineages(lineages: DataFrame, *, min_gen: int) -> DataFrame:
    """Lineages of at least ``min_gen`` cells."""
    return lineages.where(F.col("length") >= min_gen)


def _first_daughter_parent(cells: DataFrame) -> DataFrame:
    """``id, to``: every cell that is the first daughter of a present cell."""
    return first_child_edges(cells).select(F.col("to").alias("id"), F.col("id").alias("to"))


def lineage_cells(cells: DataFrame) -> DataFrame:
    """Cells on the lines of first daughters that start at a root, with replicative age and channel id.

    Channel ids count in tens per channel of a field of view; the last digit numbers
    the roots of the channel and moves on to the next tens when it overflows.
    """
    up = parent_edges(cells)
    roots = cells.join(up.select(F.col("id").alias("cell_id")), "cell_id", "left_anti")
    numbered = running(roots.select("cell_id", *CHANNEL, "birth_time"), CHANNEL, ["birth_time", "cell_id"], index="root_no")
    channels = cells.groupBy(*CHANNEL).agg(F.count(F.lit(1)).alias("_cells"))
    sizes = roots.groupBy(*CHANNEL).agg(F.count(F.lit(1)).alias("n"))
    channels = channels.join(sizes, CHANNEL, "left").select(*CHANNEL, F.coalesce("n", F.lit(0)).alias("n"))
    # one row per channel of a field of view
    before = Window.partitionBy("fov").orderBy("peak").rowsBetween(Window.unboundedPreceding, -1)
    step = F.floor(F.col("n") / 10) * 10 + 10
    channels = channels.select(*CHANNEL, (F.coalesce(F.sum(step).over(before), F.lit(0)) + 10).alias("base"))
    numbered = numbered.join(channels, CHANNEL).select(
        F.col("cell_id").alias("root_id"), (F.col("base") + F.col("root_no")).alias("channel_id"))
    line = resolve(_ids(cells), _first_daughter_parent(cells)).select(
        "cell_id", F.col("end").alias("root_id"), F.col("steps").alias("replicative_age"))
    return cells.join(line, "cell_id").join(numbered, "root_id")


def lineage_export(cells: DataFrame, obs: DataFrame) -> DataFrame:
    """Observation rows along the exported lines, flagged at a cell's first and last observation."""
    line = lineage_cells(cells).select("cell_id", "fov", "channel_id", "replicative_age")
    # only rows on a line are looked at; a cell's frames from birth to division bound its window
    cell = Window.partitionBy("cell_id")
    return obs.select("cell_id", "t", "length").join(line, "cell_id").select(
        "fov", "channel_id", "cell_id", "replicative_age", "t", "length",
        (F.col("t") == F.max("t").over(cell)).cast("int").alias("division"), (F.col("t") == F.min("t").over(cell)).cast("int").alias("birth"))


def pole_age(cells: DataFrame) -> DataFrame:
    """``cell_id, pole_closed, pole_open``; null where no label-1 ancestor defines the ages.

    Label-1 cells are (1000, 0). Below them the second daughter starts the count, and
    each cell adds one to the age on the side that is the same as its parent's.
    """
    kid = cells.where((F.col("birth_label") != 1) & F.col("parent_id").isNotNull()).select("cell_id", "parent_id")
    of = cells.select(F.col("cell_id").alias("parent_id"), "child1_id", "child2_id",
                      (F.col("birth_label") == 1).alias("below_seed"))
    side = F.when(F.col("cell_id") == F.col("child1_id"), 1).when(F.col("cell_id") == F.col("child2_id"), 2)
    tied = kid.join(of, "parent_id").select("cell_id", "parent_id", side.alias("side"), "below_seed")
    # the first daughter of a label-1 cell inherits no age
    tied = cut(tied.where("side IS NOT NULL AND NOT (below_seed AND side = 1)"))
    up = tied.select(F.col("cell_id").alias("id"), F.col("parent_id").alias("to"))
    same = tied.alias("a").join(
        tied.select(F.col("cell_id").alias("parent_id"), F.col("side").alias("_side")), "parent_id").where(
        F.col("side") == F.col("_side")).select(F.col("cell_id").alias("id"), F.col("parent_id").alias("to"))
    top = resolve(_ids(cells), up).select("cell_id", F.col("end").alias("top_id"))
    seeds = cells.where(F.col("birth_label") == 1).select(F.col("cell_id").alias("top_id"), F.lit(True).alias("aged"))
    run = resolve(tied.select("cell_id"), same).select("cell_id", (F.col("steps") + 1).alias("run"))
    aged = (top.join(seeds, "top_id", "left").join(tied.select("cell_id", "side"), "cell_id", "left")
            .join(run, "cell_id", "left"))
    age = lambda s: F.when(F.col("side") == s, F.col("run")).otherwise(0)
    return aged.select(
        "cell_id",
        F.when(F.col("aged"), F.when(F.col("side").isNull(), 1000).otherwise(age(1))).alias("pole_closed"),
        F.when(F.col("aged"), F.when(F.col("side").isNull(), 0).otherwise(age(2))).alias("pole_open"))


def pole_counts(cells: DataFrame) -> DataFrame:
    """Thirteen named counts by pole age and birth label: ``name, n``."""
    ages = cells.select("cell_id", "birth_label").join(pole_age(cells), "cell_id")
    a, b, r = F.col("pole_closed"), F.col("pole_open"), F.col("birth_label")
    aged = a.isNotNull()
    known = {"mothers": (a == 1000) & (b == 0), "01 cells": (a == 0) & (b == 1) & (r <= 2),
             "10 cells": (a == 1) & (b == 0) & (r <= 3), "02 cells": (a == 0) & (b == 2)}
    other = aged & ~(known["mothers"] | known["01 cells"] | known["10 cells"] | known["02 cells"])
    named: dict[str, Column] = {
        "all cells": F.lit(True), "with pole age": aged, "without pole age": ~aged, **known,
        "other pole age": other, "r1 cells": r == 1, "r2 cells": r == 2, "r3 cells": r == 3, "r4 cells": r == 4,
        "r>4 cells": ~r.isin(1, 2, 3, 4)}
    row = ages.agg(*[F.count_if(c).alias(n) for n, c in named.items()])
    return row.unpivot([], [f"`{n}`" for n in named], "name", "n")


def mother_daughter(cells: DataFrame, *, attr: str, first_only: bool = False) -> DataFrame:
    """``cell_id, parent_id, mother, daughter`` values of an attribute for present pairs."""
    mother = cells.select(F.col("cell_id").alias("parent_id"), F.col(attr).alias("mother"), F.col("child1_id").alias("_c1"))
    out = cells.where(F.col("parent_id").isNotNull()).select("cell_id", "parent_id", F.col(attr).alias("daughter"))
    out = out.join(mother, "parent_id")
    if first_only:
        out = out.where(F.col("cell_id") == F.col("_c1"))
    return out.select("cell_id", "parent_id", "mother", "daughter")


def autocorrelation(cells: DataFrame, *, attrs: Sequence[str]) -> DataFrame:
    """Mother-daughter correlation of each attribute: ``attr, r, n``."""
    mother = cells.select(F.col("cell_id").alias("parent_id"), *[F.col(a).alias(f"m_{a}") for a in attrs])
    both = cells.where(F.col("parent_id").isNotNull()).select("parent_id", *attrs).join(mother, "parent_id")
    row = both.agg(*[F.struct(F.corr(f"m_{a}", a).alias("r"), F.count(F.col(f"m_{a}") + F.col(a)).alias("n")).alias(a)
                     for a in attrs])
    return row.unpivot([], list(attrs), "attr", "_v").select("attr", "_v.r", "_v.n")


def connectors(cells: DataFrame) -> DataFrame:
    """Line segments from a cell's division to the next cell's birth in the same channel.

    The next cell by birth must be born at the moment the previous one divides.
    """
    prev = neighbour(cells.select("cell_id", *CHANNEL, "birth_time", "division_time", "sb", "sd"), CHANNEL,
                     ["birth_time", "cell_id"],
                     {"division_time": "prev_division", "sd": "prev_sd", "cell_id": "prev_id"})
    return prev.where(F.col("prev_division") == F.col("birth_time")).select(
        "prev_id", "cell_id", *CHANNEL, F.col("birth_time").alias("t"), F.col("prev_sd").alias("y0"), F.col("sb").alias("y1"))


def parent_connectors(cells: DataFrame) -> DataFrame:
    """Line segments from a present parent's division to its daughters' births."""
    mother = cells.select(F.col("cell_id").alias("parent_id"), F.col("division_time").alias("t0"), F.col("sd").alias("y0"))
    return cells.where(F.col("parent_id").isNotNull()).join(mother, "parent_id").select(
        "parent_id", "cell_id", "t0", "y0", F.col("birth_time").alias("t1"), F.col("sb").alias("y1"))


def lineage_series(cells: DataFrame, *, attrs: Sequence[str], min_gen: int = 1) -> DataFrame:
    """Attribute values generation by generation along every mother lineage."""
    chains = select_lineages(mother_lineages(cells), min_gen=min_gen)
    return chains.join(cells.select("cell_id", *attrs), "cell_id")
