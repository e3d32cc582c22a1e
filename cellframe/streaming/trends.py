"""Windowed time trends on streams, and running a stream into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage_cut import fresh_path


def trend_stream(rows: DataFrame, *, y: str, ts: str = "ts", window: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Mean, standard error and count of y per tumbling window; rows later than ``late`` are dropped.

    Run it in update mode (:func:`run_to_latest`): a window comes out whenever it changes, also
    the last ones, and leaves the state once the watermark has passed it.
    """
    got = rows.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w")).agg(
        F.avg(y).alias("mean"), (F.stddev_pop(y) / F.sqrt(F.count(y))).alias("se"), F.count(y).alias("n"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "se", "n")


def run_to_latest(stream: DataFrame, name: str, *keys: str) -> DataFrame:
    """Process everything available now in update mode; the last version of each row by ``keys``.

    Every micro-batch writes its changed rows to a folder of its own, so a batch that is
    repeated after a failure replaces itself.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, name)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint")
             .outputMode("update").trigger(availableNow=True).start())
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    versions = spark.read.schema(schema).parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available now into a new table in the shared folder and read it."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
