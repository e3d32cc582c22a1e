"""Cutting long lineages with tables in the shared checkpoint folder.

Iterative jobs write every round there, so that losing an executor costs a re-read
and not the whole loop. A loop removes the rounds that a later one has replaced; what is
returned is left for the folder's owner to clear.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    A folder of our own is taken only in local mode, where the driver and the
    executors are one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "cellframe-checkpoints")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, for tables written and read back."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Rounds:
    """The tables of a loop: each round is written, and the one it replaces is removed.

    ``limit`` is the number of rounds after which the loop must have ended; going on means
    that pointers form a cycle.
    """

    def __init__(self, limit: int):
        self.left, self.path = limit, None

    def put(self, df: DataFrame) -> DataFrame:
        """Write the next round, which may read the last one; then the last one goes."""
        if self.left < 0:
            raise ValueError("the ids form a cycle")
        self.left -= 1
        spark, old, self.path = df.sparkSession, self.path, fresh_path(df.sparkSession, "round")
        df.write.parquet(self.path)
        if old:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        return spark.read.schema(df.schema).parquet(self.path)


def doublings(n: int) -> int:
    """Rounds after which a reach that doubles every time has passed any chain of ``n`` rows."""
    return max(n, 1).bit_length() + 1


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it from there.

    Unlike a row checkpoint this runs the plan once, keeps the columns prunable, and
    tells the next plan how large the table is.
    """
    path = fresh_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
