"""Trackers: known cases, an independent brute-force walk, block splitting, and stream against batch."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellframe.operators.linking import track_edges
from cellframe.operators.regions import first_regions
from cellframe.operators.tracker import REGION_COLUMNS, greedy_tracks, track, tracked_cells
from cellframe.streaming.tracking import closing, streaming_session, track_stream
from cellframe.streaming.trends import run_to_table

SCHEMA = "fov int, peak int, t int, label int, y double, min_y double, max_y double, area double, length double"


def region(t, label, y, length, peak=0):
    return (1, peak, t, label, float(y), y - length / 2, y + length / 2, 5.0 * length, float(length))


def run(spark, rows, **kw):
    got = track(spark.createDataFrame(rows, SCHEMA), **kw).toPandas()
    return sorted((tuple(r) for r in got[["cell_id", "parent_id", "t", "label", "event"]].itertuples(index=False)), key=str)


def test_grow(spark):
    got = run(spark, [region(1, 1, 20, 20), region(2, 1, 20, 22), region(3, 1, 21, 24)])
    assert [(g[0], g[4]) for g in got] == [("f01p0000t0001r01", "start")] + [("f01p0000t0001r01", "grow")] * 2


def test_divide(spark):
    rows = [region(1, 1, 20, 20), region(2, 1, 15, 10), region(2, 2, 26, 10)]
    cells = tracked_cells(track(spark.createDataFrame(rows, SCHEMA))).toPandas().set_index("cell_id")
    mother = cells.loc["f01p0000t0001r01"]
    assert (mother.child1_id, mother.child2_id, mother.division_time) == ("f01p0000t0002r01", "f01p0000t0002r02", 2)
    assert cells.loc[mother.child1_id].parent_id == "f01p0000t0001r01"
    assert cells.loc[mother.child1_id].birth_time == mother.division_time


def test_lost_cell_starts_again(spark):
    # within the waiting time the old cell goes on, after it a new cell starts
    near = run(spark, [region(1, 1, 20, 20), region(4, 1, 20, 21)])
    late = run(spark, [region(1, 1, 20, 20), region(5, 1, 20, 21)])
    assert [g[4] for g in near] == ["start", "grow"] and [g[4] for g in late] == ["start", "start"]


def test_third_region_becomes_new_cell(spark):
    rows = [region(1, 1, 20, 30), region(2, 1, 15, 14), region(2, 2, 27, 14), region(2, 3, 60, 12)]
    got = run(spark, rows)
    assert ("f01p0000t0002r03", None, 2, 3, "start") in got
    assert sum(g[4] == "daughter" for g in got) == 2


def test_cutoffs(spark):
    # too far from the closed end, or too high a label
    assert run(spark, [region(1, 1, 151, 20)]) == []
    assert run(spark, [region(1, 5, 20, 20)]) == []


def movie(seed, frames=60, channels=4):
    rng, rows = random.Random(seed), []
    for peak in range(channels):
        for t in range(1, frames + 1):
            if rng.random() < 0.1:
                continue
            y = 0.0
            for label in range(1, rng.randint(1, 6) + 1):
                length = rng.choice([8, 9, 10, 11, 18, 20, 22])
                y += length / 2 + rng.random() * 4
                rows.append(region(t, label, y, length, peak))
                y += length / 2
    return rows


def brute_track(rows, lost=3, new_y=150.0, new_label=4):
    """The tracker written again, as plain loops over one channel's frames."""
    out, leaves, last = [], [], {}
    frames = {}
    for r in rows:
        frames.setdefault(r[2], []).append(r)

    def fits(c, r):
        return not (c[8] * 1.3 < r[8] or c[8] * 0.8 > r[8] or c[7] * 1.3 < r[7] or c[8] * 0.8 > r[7] or c[5] > r[4] or c[6] < r[4])

    def near(r):
        return r[4] < new_y and r[3] <= new_label

    def new(r, parent=None):
        name = "f%02dp%04dt%04dr%02d" % (r[0], r[1], r[2], r[3])
        out.append((name, parent, r[2], r[3], "daughter" if parent else "start"))
        last[name] = r
        if near(r):
            leaves.append(name)

    def grow(name, r):
        out.append((name, None, r[2], r[3], "grow"))
        last[name] = r

    for t in range(min(frames), max(frames) + 1):
        for name in leaves:
            if t - last[name][2] > lost:
                leaves.remove(name)
        here = sorted(frames.get(t, []), key=lambda r: r[3])
        if not leaves:
            for r in here:
                if near(r):
                    new(r)
            continue
        prev = [(n, last[n][4]) for n in leaves]
        got = {n: [] for n in leaves}
        for r in here:
            gaps = [abs(r[4] - y) for _, y in prev]
            got[prev[int(np.argmin(gaps))][0]].append((min(gaps), r))
        for n, found in got.items():
            if len(found) > 2:
                order = sorted(range(len(found)), key=lambda i: found[i][0])
                for i in order[2:]:
                    if not near(found[i][1]):
                        break
                    new(found[i][1])
                got[n] = [found[i] for i in sorted(order[:2])]
        for n, found in got.items():
            rs = [r for _, r in found]
            if len(rs) == 1 and fits(last[n], rs[0]):
                grow(n, rs[0])
            if len(rs) == 2:
                a, b = rs
                c = last[n]
                if fits(c, a):
                    grow(n, a)
                    if near(b):
                        new(b)
                elif fits(c, b):
                    grow(n, b)
                    if near(a):
                        new(a)
                elif c[8] * 0.8 <= a[8] + b[8] <= c[8] * 1.3 and c[5] <= a[4] <= c[4] <= b[4] <= c[6]:
                    leaves.remove(n)
                    new(a, n)
                    new(b, n)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = movie(seed)
    want = sorted((x for p in {r[1] for r in rows} for x in brute_track([r for r in rows if r[1] == p])), key=str)
    assert run(spark, rows) == want


@pytest.fixture
def small_batches(spark):
    """Frames that end in a later batch, and all channels in one task."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_batches_and_partitions_change_nothing(spark, small_batches):
    for rows in (movie(7), movie(8) + movie(9)[:0]):
        want = sorted((x for p in {r[1] for r in rows} for x in brute_track([r for r in rows if r[1] == p])), key=str)
        assert run(spark, rows) == want


def test_rows_without_a_time_are_left_out(spark):
    rows = movie(3)
    odd = [(1, 0, None, 1, 5.0, 1.0, 9.0, 4.0, 3.0), (1, 0, 2, None, 5.0, 1.0, 9.0, 4.0, 3.0)]
    assert run(spark, rows + odd) == run(spark, rows)


def test_eight_regions_that_migrate(spark):
    """More regions than a small model's slots: every one keeps its track."""
    frames = spark.createDataFrame([(1, 0, t) for t in (1, 2)], "fov int, peak int, t int")
    regions = spark.createDataFrame([(1, 0, t, a) for t in (1, 2) for a in range(1, 9)], "fov int, peak int, t int, label int")
    pairs = spark.createDataFrame([(1, 0, 1, a, b, 0.99 if a == b else 0.01, 0.001) for a in range(1, 9) for b in range(1, 9)],
                                  "fov int, peak int, t int, label int, next_label int, p_migrate double, p_child double")
    single = spark.createDataFrame([(1, 0, t, a, 0.01, 0.01, 0.01, 0.01) for t in (1, 2) for a in range(1, 9)],
                                   "fov int, peak int, t int, label int, p_appear double, p_born double, p_disappear double, p_die double")
    got = greedy_tracks(regions, track_edges(frames, regions, pairs, single)).toPandas()
    assert sorted(got["event"]) == ["grow"] * 8 + ["start"] * 8 and got["cell_id"].nunique() == 8
    few = first_regions(regions, n=3)
    got = greedy_tracks(few, track_edges(frames, few, pairs, single)).toPandas()
    assert sorted(got["event"]) == ["grow"] * 3 + ["start"] * 3


def test_tracks_partition_regions(spark):
    got = track(spark.createDataFrame(movie(5), SCHEMA)).toPandas()
    assert not got.duplicated(["fov", "peak", "t", "label"]).any()
    kids = got[got.event == "daughter"].groupby("parent_id").size()
    assert (kids <= 2).all()


@pytest.mark.parametrize("files", [1, 3, 100])
def test_stream_equals_batch(spark, tmp_path, files):
    """Whatever the number of files a micro-batch; frames arrive in no order, some in two parts."""
    rows = movie(11, frames=10)
    df = spark.createDataFrame(rows, SCHEMA)
    path, order = str(tmp_path / "in"), [*range(11), 5, 6]
    random.Random(files).shuffle(order)
    for i, t in enumerate(order):
        part = "true" if t not in (5, 6) else "label % 2 = 0" if t in order[:i] else "label % 2 = 1"
        df.where((F.col("t") == t) & F.expr(part)).coalesce(1).write.mode("append").parquet(path)
    closing(df, 10, late=30).coalesce(1).write.mode("append").parquet(path)
    streaming_session(spark)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)
    got = run_to_table(track_stream(stream, late=30), "test-tracks").toPandas()
    got = sorted((tuple(r) for r in got[["cell_id", "parent_id", "t", "label", "event"]].itertuples(index=False)), key=str)
    assert got == run(spark, rows)


def test_frames_later_than_the_watermark_are_left_out(spark, tmp_path):
    """Frame 1 comes two batches after frame 9: it is linked if that is within the allowed lateness, and dropped otherwise."""
    streaming_session(spark)
    found = {}
    for late in (20, 3):
        path = str(tmp_path / f"in{late}")
        frames = [region(t, 1, 20, 20) for t in (9, 10, 1)]
        for r in frames:
            spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        closing(spark.createDataFrame(frames, SCHEMA), 10, late=late).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
        got = run_to_table(track_stream(stream, late=late), "test-late").collect()
        found[late] = sorted((r.t, r.event) for r in got)
    assert found == {20: [(1, "start"), (9, "start"), (10, "grow")], 3: [(9, "start"), (10, "grow")]}


def graph(seed, frames=14, top=4):
    rng = random.Random(seed)
    nodes, edges = [], []
    count = {t: rng.randint(0, top) for t in range(1, frames + 1)}
    for t, n in count.items():
        for a in range(1, n + 1):
            nodes.append((1, 0, t, a))
            if t < frames:
                for b in range(1, count[t + 1] + 1):
                    for kind in ("child", "migrate"):
                        edges.append((1, 0, t, a, b, kind, math.log(rng.uniform(0.01, 1))))
                edges.append((1, 0, t, a, None, "disappear", math.log(rng.uniform(0.01, 0.6))))
                edges.append((1, 0, t, a, None, "die", math.log(rng.uniform(0.01, 0.3))))
            else:
                edges.append((1, 0, t, a, None, "end", 0.0))
    return nodes, edges


def walk_one_after_other(nodes, edges, min_score, second):
    """Finish each walk before the next one starts; cells as {id: (parent, [(t, label)])}."""
    name = lambda n: "f01p0000t%04dr%02d" % n
    out, visited, cells, ends = {}, set(), {}, set()
    for _, _, t, a, b, kind, s in edges:
        out.setdefault((t, a), []).append((s, kind, None if b is None else (t + 1, b)))
    for start in sorted((t, a) for _, _, t, a in nodes):
        if start in visited:
            continue
        cell = name(start)
        cells.setdefault(cell, [None, [start]])
        node = start
        visited.add(node)
        while True:
            best = {}
            for s, kind, to in out.get(node, []):
                if to is not None and to in visited:
                    continue
                key = to if to is not None else ("state", kind)
                if key not in best or (-s, kind) < best[key]:
                    best[key] = (-s, kind)
            options = sorted((v[0], k[0] == "state", k if k[0] != "state" else (), v[1]) for k, v in best.items())
            if not options:
                break
            minus, is_state, to, kind = options[0]
            if min_score is not None and -minus < min_score:
                kind = "disappear"
            if kind in ("disappear", "die", "end"):
                if kind != "end":
                    ends.add((cell, kind))
                break
            if kind == "migrate":
                cells[cell][1].append(to)
            else:
                cells[name(to)] = [cell, [to]]
                rest = sorted((-s, n) for s, k, n in out[node] if k == "child" and n != to and n not in visited)
                if rest and (second is None or -rest[0][0] >= second):
                    cells[name(rest[0][1])] = [cell, [rest[0][1]]]
                cell = name(to)
            node = to
            visited.add(node)
    return cells, ends


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("limits", [(math.log(0.1), math.log(0.5)), (None, None)])
def test_greedy_equals_sequential_walks(spark, seed, limits):
    nodes, edges = graph(seed)
    n = spark.createDataFrame(nodes, "fov int, peak int, t int, label int")
    e = spark.createDataFrame(edges, "fov int, peak int, t int, src_label int, dst_label int, type string, score double")
    for rows in ("10000", "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        got = greedy_tracks(n, e, min_score=limits[0], second=limits[1]).toPandas()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        cells = {}
        for r in got.itertuples():
            if r.event in ("start", "daughter", "grow"):
                c = cells.setdefault(r.cell_id, [None, []])
                c[0] = r.parent_id or c[0]
                c[1].append((r.t, r.label))
        cells = {k: [v[0], sorted(v[1])] for k, v in cells.items()}
        ends = {(r.cell_id, r.event) for r in got.itertuples() if r.event in ("disappear", "die")}
        want, want_ends = walk_one_after_other(nodes, edges, *limits)
        assert cells == {k: [v[0], sorted(v[1])] for k, v in want.items()}
        assert ends == want_ends
