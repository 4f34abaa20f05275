"""Quantitative text-style analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value: workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
