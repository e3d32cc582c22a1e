"""Objects of bounded size for tasks, also where the package is not installed."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, SparkContext, cloudpickle
from pyspark.sql import SparkSession


def ship(spark: SparkSession, thing) -> Broadcast:
    """Broadcast ``thing`` with the code of its classes."""
    sc: SparkContext = spark.sparkContext
    return sc.broadcast([cloudpickle.dumps(thing)])


def unpack(shipped: Broadcast):
    """The shipped object; a worker process unpacks it once and keeps it for its later tasks."""
    box = shipped.value
    if isinstance(box[0], bytes):
        box[0] = pickle.loads(box[0])
    return box[0]
