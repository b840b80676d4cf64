"""Songfield: similarity-space analytics over item catalogues, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
