"""A PySpark engine for typed derivation graphs of words."""

import sys

from pyspark import cloudpickle

# Python kernels travel to the executors by value, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
