"""Sequential trackers, run over the sorted frames of each channel.

A tracker needs a channel's frames in order, but never a whole channel at once: channels are
dealt to tasks once, rows are sorted by channel and frame, and a task streams over them with
only the open cells of one channel and one frame (at most 255 labels) in memory.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANNEL = ["fov", "peak"]
TRACK = "fov int, peak int, cell_id string, parent_id string, t int, label int, event string"
FLUSH = 10_000  # output rows of a batch

# fixed values: default limits of the tracker
LIMITS = dict(lost_time=3, new_y=150.0, new_label=4, max_len=1.3, min_len=0.8, max_area=1.3, min_area=0.8)


def frames(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((fov, peak, t), rows) of sorted batches; a frame that ends in a later batch comes out whole."""
    key, held = None, []
    for pdf in batches:
        rows = zip(*[pdf[c].tolist() for c in pdf.columns])
        for k, part in groupby(rows, key=lambda r: r[:3]):
            if k != key:
                if held:
                    yield key, held
                key, held = k, []
            held.extend(part)
    if held:
        yield key, held


def in_order(df: DataFrame, start: Callable[[int, int], object], step: Callable[[object, int, list[tuple]], None]) -> DataFrame:
    """Walk over the frames of every channel: ``start(fov, peak)`` makes a walker, ``step(walker, t, rows)`` takes it one frame on.

    ``df`` begins with fov, peak and t; a walker collects its output in ``rows``. Rows without
    a channel, time or label have no place in an order and are left out.
    """
    # a fixed number of partitions: the rows are few but the work on them is not, so
    # small partitions must not be merged
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = df.where("fov IS NOT NULL AND peak IS NOT NULL AND t IS NOT NULL AND label IS NOT NULL")
    placed = whole.repartition(tasks, *CHANNEL).sortWithinPartitions(*CHANNEL, "t", "label")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walker, channel, out = None, None, []
        for (fov, peak, t), rows in frames(batches):
            if (fov, peak) != channel:
                channel, walker = (fov, peak), start(int(fov), int(peak))
            step(walker, int(t), rows)
            out += walker.rows
            walker.rows = []
            if len(out) >= FLUSH:
                yield as_rows(out)
                out = []
        yield as_rows(out)

    return placed.mapInPandas(run, TRACK)


def cell_name(fov: int, peak: int, t: int, label: int, prefix: str = "") -> str:
    return f"{prefix}f{fov:02d}p{peak:04d}t{t:04d}r{label:02d}"


def _grows(leaf: dict, r: dict, p: dict) -> bool:
    return (p["min_len"] * leaf["length"] <= r["length"] <= p["max_len"] * leaf["length"]
            and p["min_area"] * leaf["length"] <= r["area"] <= p["max_area"] * leaf["area"]
            and leaf["min_y"] <= r["y"] <= leaf["max_y"])


def _decide(leaf: dict, a: dict, b: dict, p: dict) -> int:
    if _grows(leaf, a, p):
        return 1
    if _grows(leaf, b, p):
        return 2
    both = a["length"] + b["length"]
    fits = p["min_len"] * leaf["length"] <= both <= p["max_len"] * leaf["length"]
    halves = leaf["min_y"] <= a["y"] <= leaf["y"] <= b["y"] <= leaf["max_y"]
    return 3 if fits and halves else 0


class OpenCells:
    """The leaves of one channel's growing lineages and the rule that takes them one frame further."""

    def __init__(self, fov: int, peak: int, limits: dict, state: str | None = None):
        self.fov, self.peak, self.p = fov, peak, limits
        saved = json.loads(state) if state else {"t": None, "leaves": []}
        self.last_t, self.leaves = saved["t"], saved["leaves"]
        self.rows: list[tuple] = []

    def state(self) -> str:
        return json.dumps({"t": self.last_t, "leaves": self.leaves})

    def _expire(self, t: int) -> None:
        # like a list shortened while it is walked: the leaf after a dropped one waits for the next frame
        kept, skip = [], False
        for leaf in self.leaves:
            if not skip and t - leaf["t"] > self.p["lost_time"]:
                skip = True
                continue
            kept.append(leaf)
            skip = False
        self.leaves = kept

    def _open(self, t: int, r: dict, parent: str | None = None) -> None:
        """Start a cell. Daughters are recorded anyway, but only regions near the closed end stay leaves."""
        near = r["y"] < self.p["new_y"] and r["label"] <= self.p["new_label"]
        if parent is None and not near:
            return
        name = cell_name(self.fov, self.peak, t, r["label"])
        self.rows.append((self.fov, self.peak, name, parent, t, r["label"], "daughter" if parent else "start"))
        if near:
            self.leaves.append({"id": name, "t": t, **r})

    def _grow(self, leaf: dict, t: int, r: dict) -> None:
        self.rows.append((self.fov, self.peak, leaf["id"], None, t, r["label"], "grow"))
        leaf.update(t=t, **r)

    def frame(self, t: int, regions: list[dict]) -> None:
        """Link the regions of frame ``t``, given in label order."""
        if self.last_t is not None and t <= self.last_t:
            return  # a late frame cannot be linked any more
        # frames without regions only age the leaves
        for quiet in range(t if self.last_t is None else self.last_t + 1, t + 1):
            if not self.leaves:
                break
            self._expire(quiet)
        self.last_t = t
        if not self.leaves:
            for r in regions:
                self._open(t, r)
            return
        links: dict[int, list[tuple[float, int]]] = {i: [] for i in range(len(self.leaves))}
        for j, r in enumerate(regions):
            gap, i = min((abs(r["y"] - leaf["y"]), i) for i, leaf in enumerate(self.leaves))
            links[i].append((gap, j))
        linked = list(self.leaves)
        for i, found in links.items():
            if len(found) > 2:
                found.sort()
                for _, j in found[2:]:
                    before = len(self.leaves)
                    self._open(t, regions[j])
                    if len(self.leaves) == before:
                        break
                links[i] = sorted(found[:2], key=lambda f: f[1])
        for i, leaf in enumerate(linked):
            near = [regions[j] for _, j in links[i]]
            if len(near) == 1 and _grows(leaf, near[0], self.p):
                self._grow(leaf, t, near[0])
            elif len(near) == 2:
                decision = _decide(leaf, near[0], near[1], self.p)
                if decision == 3:
                    self.leaves = [x for x in self.leaves if x is not leaf]
                    for r in near:
                        self._open(t, r, parent=leaf["id"])
                elif decision:
                    self._grow(leaf, t, near[decision - 1])
                    self._open(t, near[2 - decision])


def by_frame(rows: pd.DataFrame) -> Iterable[tuple[int, list[dict]]]:
    """Frames in order, each with its regions in label order."""
    shape = ["y", "min_y", "max_y", "area", "length"]
    ordered = rows.sort_values(["t", "label"])
    values = zip(ordered["t"].tolist(), ordered["label"].tolist(), ordered[shape].astype(float).values.tolist())
    for t, part in groupby(values, key=lambda v: v[0]):
        yield int(t), [{"label": int(label), **dict(zip(shape, v))} for _, label, v in part]


def as_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["fov", "peak", "cell_id", "parent_id", "t", "label", "event"])


SHAPE = ("label", "y", "min_y", "max_y", "area", "length")
REGION_COLUMNS = ("fov", "peak", "t", *SHAPE)


def track(regions: DataFrame, **limits) -> DataFrame:
    """Standard lineage tracker: one row per region taken up by a cell.

    ``event`` is start (new cell), grow or daughter (with its ``parent_id``). Regions that fit
    no cell are left out. ``limits`` overrides :data:`LIMITS`.
    """
    p = {**LIMITS, **limits}

    def step(cells, t, rows):
        cells.frame(t, [dict(zip(SHAPE, (int(r[3]), *map(float, r[4:])))) for r in rows])

    return in_order(regions.select(*REGION_COLUMNS), lambda fov, peak: OpenCells(fov, peak, p), step)


def tracked_cells(tracks: DataFrame) -> DataFrame:
    """One row per tracked cell: id, parent, birth, last observation, daughters in label order."""
    born = F.min_by(F.struct("label", "parent_id"), "t")
    cells = tracks.where("event IN ('start', 'daughter', 'grow')").groupBy("fov", "peak", "cell_id").agg(
        born.alias("b"), F.min("t").alias("birth_time"), F.max("t").alias("last_time"), F.count(F.lit(1)).alias("n_obs"))
    kids = tracks.where("event = 'daughter'").groupBy(F.col("parent_id").alias("cell_id")).agg(
        F.min(F.struct("label", F.col("cell_id").alias("id")))["id"].alias("child1_id"),
        F.when(F.count(F.lit(1)) > 1, F.max(F.struct("label", F.col("cell_id").alias("id")))["id"]).alias("child2_id"),
        F.min("t").alias("division_time"))
    return cells.select("fov", "peak", "cell_id", "b.parent_id", F.col("b.label").alias("birth_label"), "birth_time",
                        "last_time", "n_obs").join(kids, "cell_id", "left")


class OpenTracks:
    """Walks along candidate edges, advanced frame by frame.

    A walk claims one detection per frame. Walks that started earlier (then with the
    smaller label) choose first, which gives the same result as finishing one walk
    after the other.
    """

    def __init__(self, fov: int, peak: int, min_score: float | None, second: float | None, prefix: str):
        self.fov, self.peak, self.min_score, self.second, self.prefix = fov, peak, min_score, second, prefix
        self.t, self.walks, self.made = None, [], {}
        self.rows: list[tuple] = []

    def _name(self, t: int, label: int) -> str:
        return cell_name(self.fov, self.peak, t, label, self.prefix)

    def _row(self, cell: str, parent: str | None, t: int, label: int, event: str) -> None:
        self.rows.append((self.fov, self.peak, cell, parent, t, label, event))

    def frame(self, t: int, labels: list[int], edges: dict[int, list[tuple[float, str, int | None]]]) -> None:
        """Start walks at unclaimed detections of frame ``t``, then move every walk along its best edge."""
        if self.t != t:
            self.walks, self.made = [], {}
        claimed = {w[0] for w in self.walks}
        for label in labels:
            if label not in claimed:
                name = self._name(t, label)
                if label not in self.made:
                    self._row(name, None, t, label, "start")
                self.walks.append([label, name])
        visited: set[int] = set()
        made: dict[int, str] = {}  # daughters of the next frame with their parent; the last parent stays
        onward = []
        for label, cell in self.walks:
            best: dict[int | None, tuple[float, str]] = {}
            states = []
            for score, kind, to in edges.get(label, []):
                if to is None:
                    states.append((-score, kind))
                elif to not in visited and (to not in best or (-score, kind) < best[to]):
                    best[to] = (-score, kind)
            choice = min([(s, 0, to, kind) for to, (s, kind) in best.items()] + [(s, 1, -1, kind) for s, kind in states],
                         default=None)
            if choice is None:
                continue
            minus, _, to, kind = choice
            if self.min_score is not None and -minus < self.min_score:
                kind = "disappear"
            if kind in ("disappear", "die"):
                self._row(cell, None, t, label, kind)
            elif kind == "migrate":
                self._row(cell, None, t + 1, to, "grow")
                visited.add(to)
                onward.append([to, cell])
            elif kind == "child":
                made[to] = cell
                others = [(-s, k) for s, ty, k in edges[label] if ty == "child" and k != to and k not in visited]
                if others:
                    s, other = min(others)
                    if self.second is None or -s >= self.second:
                        made[other] = cell
                visited.add(to)
                onward.append([to, self._name(t + 1, to)])
        for to, parent in made.items():
            self._row(self._name(t + 1, to), parent, t + 1, to, "daughter")
        self.t, self.walks, self.made = t + 1, onward, made


def greedy_tracks(nodes: DataFrame, edges: DataFrame, *, min_score: float | None = math.log(0.1),
                  second: float | None = math.log(0.5), prefix: str = "") -> DataFrame:
    """Extract tracks from candidate edges by always following the best unclaimed successor.

    An edge below ``min_score`` ends the track as a disappearance; a second daughter needs
    a child score of at least ``second``. With both set to None every walk goes on as far as
    edges lead, and a division takes a second daughter whenever one is left.
    """
    out = edges.where("src_label IS NOT NULL AND type IN ('migrate', 'child', 'disappear', 'die', 'end')")
    # detections and their outgoing edges travel together
    rows = nodes.select("fov", "peak", "t", "label").withColumns(
        {"type": F.lit(None).cast("string"), "dst_label": F.lit(None).cast("int"), "score": F.lit(None).cast("double")}).unionByName(
        out.select("fov", "peak", F.col("t").cast("int").alias("t"), F.col("src_label").alias("label"), "type", "dst_label", "score"))

    def step(walks, t, found):
        labels, known = set(), {}
        for _, _, _, label, kind, dst, score in found:
            if kind:
                known.setdefault(int(label), []).append((score, kind, None if dst is None or dst != dst else int(dst)))
            else:
                labels.add(int(label))
        walks.frame(t, sorted(labels), known)

    return in_order(rows, lambda fov, peak: OpenTracks(fov, peak, min_score, second, prefix), step)
