"""Spark-native document text analytics: clean, segment, correct, lint, render."""

import sys

from pyspark import cloudpickle

# Python workers of a cluster need not have this package on their path: what
# tasks use of it travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
