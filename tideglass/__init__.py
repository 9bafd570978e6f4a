"""tideglass: market-event analytics on PySpark DataFrames, SQL and Structured Streaming."""

import sys

from pyspark import cloudpickle

# Kernels travel to the Python workers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
