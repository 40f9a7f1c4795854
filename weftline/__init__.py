"""A Spark-native engine for sequences of feature frames: neighbourhood graphs, graphlet profiles, comparable layouts."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Kernels travel to the executors by value, so a cluster needs no copy of this package on its workers.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
