"""tideline: a PySpark-native engine for regular-grid time series."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions sent to Python workers travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
