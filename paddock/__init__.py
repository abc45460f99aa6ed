"""Paddock: a Spark-native engine for event-result data and its training corpora."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
