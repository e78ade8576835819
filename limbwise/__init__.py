"""Spark-native analytics for landmark time series and recognition logs."""

import sys

from pyspark import cloudpickle

from limbwise.settings import Layout, Settings

# Functions sent to Python workers travel with their code, so a worker needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Layout", "Settings"]
