"""Lineage tracker on a stream of region tables, in event time: one state per channel."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracker import CHANNEL, LIMITS, REGION_COLUMNS, SHAPE, TRACK, OpenCells, as_rows

#: frames by which a frame may come later than a later one
LATE = 10
#: event time of frame 0 in seconds, behind the time at which every watermark starts
START = 1_000_000_000


class _Channel(StatefulProcessor):
    """Frames of a channel wait until the watermark has passed them; then a timer links them, one after the other.

    A waiting frame is an entry of the state's map, so a task holds the open cells and one frame.
    """

    def __init__(self, limits: dict):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "cells string")
        self.waiting = handle.getMapState("waiting", "t long", "regions string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            # the closing row has no label: it moves the watermark and is no region
            for t, regions in part[part["label"].notna()].groupby("t", sort=False):
                t = int(t)
                if self.waiting.containsKey((t,)):
                    known = json.loads(self.waiting.getValue((t,))[0])
                else:
                    known = []
                    self.handle.registerTimer(1000 * (START + t))
                known += [[int(label), *map(float, shape)] for label, *shape in regions[list(SHAPE)].itertuples(index=False)]
                self.waiting.updateValue((t,), (json.dumps(known),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t = expiredTimerInfo.getExpiryTimeInMs() // 1000 - START
        regions = sorted(json.loads(self.waiting.getValue((t,))[0]))
        self.waiting.removeKey((t,))
        cells = OpenCells(int(key[0]), int(key[1]), self.limits, self.open.get()[0] if self.open.exists() else None)
        cells.frame(t, [dict(zip(SHAPE, r)) for r in regions])
        self.open.update((cells.state(),))
        yield as_rows(cells.rows)

    def close(self) -> None:
        pass


def track_stream(regions: DataFrame, *, late: int = LATE, **limits) -> DataFrame:
    """The tracker of :func:`cellframe.operators.tracker.track` on a stream, the same whatever the batches and the order of files.

    A frame is linked when the watermark, which stays ``late`` frames behind the latest one of
    all channels, has passed it; so frames may come in any order within ``late``, and a frame
    may come in parts. Rows that come later than that are dropped and counted by Spark
    (``numRowsDroppedByWatermark``). The last frames wait for later ones: :func:`closing` ends
    a stream. The state store must be RocksDB, which keeps the waiting frames outside the heap
    (``spark.sql.streaming.stateStore.providerClass``); :func:`streaming_session` sets it.
    """
    whole = regions.where("fov IS NOT NULL AND peak IS NOT NULL AND t IS NOT NULL")
    timed = whole.select(*REGION_COLUMNS, F.timestamp_seconds(F.col("t") + START).alias("at")).withWatermark("at", f"{late} seconds")
    return timed.groupBy(*CHANNEL).transformWithStateInPandas(_Channel({**LIMITS, **limits}), TRACK, "append", "eventtime")


def closing(regions: DataFrame, t: int, *, late: int = LATE) -> DataFrame:
    """The row that ends a stream after frame ``t``: a frame without regions, later than all others by more than ``late``."""
    values = {"fov": 0, "peak": 0, "t": t + late + 2}
    return regions.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in regions.schema])


def streaming_session(spark) -> None:
    """Let the session's streams keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
