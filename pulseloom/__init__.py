"""Physiological time series and training-data analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers go by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
