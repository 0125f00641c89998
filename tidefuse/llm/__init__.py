"""Operators of a training-data pipeline. Nothing outside this package imports it."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Tasks carry these functions with them, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
