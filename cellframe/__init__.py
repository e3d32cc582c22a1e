"""Single-cell lineage analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry the package's code, so executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
