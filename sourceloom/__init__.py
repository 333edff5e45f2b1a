"""Code-intelligence analytics on Spark: a Java source tree as DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package run inside Python workers that may not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
