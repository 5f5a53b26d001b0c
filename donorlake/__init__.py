"""Donor-level analytics of single-cell cohorts as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few functions that run inside tasks travel by value, so executors need
# Spark's Python environment but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
