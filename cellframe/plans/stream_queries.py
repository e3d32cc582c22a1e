"""Structured Streaming queries, run over everything available."""

from pyspark.sql import functions as F

from ..functions.lineage_cut import fresh_path
from ..streaming.tracking import closing, streaming_session, track_stream
from ..streaming.trends import run_to_latest, run_to_table, trend_stream
from .linking_queries import LIMITS, TRACK
from .registry import query
from .track_sql import STANDARD, STANDARD_ROWS


@query("a6_streaming_trend", "start_s:l end_s:l mean:d se:d n:l", """
b AS (SELECT floor(epoch(ts)/21600) AS k, value FROM events) ----
SELECT k*21600 AS start_s, k*21600 + 21600 AS end_s, avg(value) AS mean, stddev_pop(value)/sqrt(count(*)) AS se, count(*) AS n
FROM b GROUP BY k""")
def _(d):
    schema = d.raw("events").schema
    rows = d.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d.dir)
    # the source has no time zone: read its clock as UTC, whatever the session's zone
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    clock = F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("ts").cast("timestamp_ntz")))
    out = run_to_latest(trend_stream(rows.select(clock.alias("ts"), "value"), y="value"), "trend", "start", "end")
    return out.select("*", F.unix_timestamp("start").alias("start_s"), F.unix_timestamp("end").alias("end_s"))


def _tracked(d, files: int):
    """The tracker on files that hold frames in no order, so many a micro-batch, and a closing row."""
    path = fresh_path(d.spark, "regions")
    regions = d.regions.withColumn("length", F.col("major"))
    regions.repartition(6, "t").write.parquet(path)
    last = d.spark.read.schema(regions.schema).parquet(path).agg(F.max("t")).first()[0] or 0
    closing(regions, last, late=last).coalesce(1).write.mode("append").parquet(path)
    streaming_session(d.spark)
    stream = d.spark.readStream.schema(regions.schema).option("maxFilesPerTrigger", files).parquet(path)
    return run_to_table(track_stream(stream, late=last, **LIMITS), "tracks")


@query("k6_streaming_tracker", TRACK, f"{STANDARD} ---- {STANDARD_ROWS}", uses="regions")
def _(d):
    return _tracked(d, 100)


@query("k6_streaming_tracker_small_batches", TRACK, f"{STANDARD} ---- {STANDARD_ROWS}", uses="regions")
def _(d):
    return _tracked(d, 2)
