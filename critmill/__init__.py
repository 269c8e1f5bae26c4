"""Eligibility-criteria analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
